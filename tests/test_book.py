"""Panel returns and the book on prices made by hand."""

import math
from datetime import date, timedelta

import pytest

from tidemark.config import CostAssumptions
from tidemark.operators import panel, portfolio, temporal
from tidemark.operators.portfolio import CostModel

SESSIONS = [d for d in (date(2020, 1, 2) + timedelta(n) for n in range(90)) if d.weekday() < 5][:60]
FREE = CostModel(CostAssumptions(0, 0, 0, 0, 0))


def grid(spark, close, open_=None):
    """close: ticker -> 60 prices; opens default to closes."""
    rows = [(i, SESSIONS[i], t, float((open_ or close).get(t, close[t])[i]), float(c)) for t, cs in close.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "session_pos int, session date, ticker string, open double, close double").cache()


def event(spark, *rows):
    return spark.createDataFrame(rows, "ticker string, category string, reaction_pos int, entry_pos_open int, entry_pos_close int")


def test_event_returns(spark):
    close = [100.0] * 10 + [110 + i for i in range(6)] + [115.0] * 44
    opens = close[:10] + [104.0] + close[11:]
    g = grid(spark, {"AAA": close, "SPY": [100.0] * 10 + [104.0] * 50}, {"AAA": opens})
    ev = spark.sql("SELECT 'AAA' AS ticker, 'n' AS accession, timestamp_ntz'2020-01-15 22:00:00' AS accepted_utc UNION ALL SELECT 'ZZZ', 'z', timestamp_ntz'2020-01-15 22:00:00' UNION ALL SELECT 'AAA', 'late', timestamp_ntz'2020-03-24 22:00:00'")
    (r,) = panel.build_event_panel(ev, g, (0, 1, 5)).collect()
    assert (r.reaction_pos, r.season, r.reaction_date) == (10, "2020Q1", SESSIONS[10])
    assert r.ret_d0 == pytest.approx(10) and r.gap_ret == pytest.approx(4) and r.open_to_close_ret == pytest.approx((110 / 104 - 1) * 100)
    assert r.ret_d5 == pytest.approx(15) and r.drift_d5 == pytest.approx(4.545454, abs=1e-5) and r.abret_d0 == pytest.approx(6)
    assert (1 + r.gap_ret / 100) * (1 + r.open_to_close_ret / 100) == pytest.approx(1 + r.ret_d0 / 100)
    paths = {p.day: p.car for p in panel.abnormal_paths(panel.build_event_panel(ev, g, (0, 1, 5)), g, 5).collect()}
    assert paths[0] == 0 and paths[5] == pytest.approx(r.abdrift_d5)
    before = panel.abnormal_paths(panel.build_event_panel(ev, g, (0, 1, 5)), g, 5, from_reaction_close=False).collect()
    assert {p.day: p.car for p in before}[0] == pytest.approx(r.abret_d0)


@pytest.fixture(scope="module")
def two(spark):
    a = [100.0] * 10 + [100 * 1.01 ** min(i, 5) for i in range(1, 51)]
    b = [100.0] * 30 + [100 * 0.99 ** min(i, 5) for i in range(1, 31)]
    return grid(spark, {"AAA": a, "BBB": b, "SPY": [100.0] * 60}), event(spark, ("AAA", "Beat", 10, 10, 10), ("BBB", "Miss", 30, 30, 30), ("AAA", "In-Line", 5, 5, 5), ("AAA", "Beat", 58, 58, 58))


def test_two_trades(two):
    g, ev = two
    book = portfolio.with_equity(portfolio.daily_book(ev, g, 4, temporal.NEXT_CLOSE), FREE).orderBy("session_pos").collect()
    assert book[-1].equity_net == pytest.approx(1.01**8) and (book[0].session_pos, book[-1].session_pos) == (10, 34)
    idle = [r for r in book if 14 < r.session_pos < 30]
    assert len(idle) == 15 and all(r.gross_ret is None and r.turnover == 0 and r.n_long == 0 for r in idle)
    trades = {r.category: r for r in portfolio.trade_log(ev, g, 4, temporal.NEXT_CLOSE, FREE).collect()}
    assert trades["Beat"].gross_ret_pct == pytest.approx((1.01**4 - 1) * 100) and trades["Miss"].gross_ret_pct == pytest.approx((1 - 0.99**4) * 100)


def test_costs_and_borrow(two):
    g, ev = two
    book = portfolio.daily_book(ev, g, 4, temporal.NEXT_CLOSE)
    total = portfolio.net_return_at_cost(book, FREE)
    assert total(0) - total(10) == pytest.approx(0.20, abs=0.03)
    lent = CostModel(CostAssumptions(0, 0, 0, 0, 252))
    net = {r.session_pos: r.net_ret - r.gross_ret for r in portfolio.with_equity(book, lent).where("gross_ret is not null").collect()}
    assert all(v == pytest.approx(-1e-4 if p >= 30 else 0, abs=1e-12) for p, v in net.items())
    curve = {r.round_trip_bps: r.net_total_return_pct for r in portfolio.cost_curve(book, FREE).collect()}
    assert [curve[b] for b in portfolio.COST_GRID] == pytest.approx([total(b) for b in portfolio.COST_GRID])
    assert list(curve[b] for b in portfolio.COST_GRID) == sorted(curve.values(), reverse=True)


def test_open_fill_earns_the_session(spark):
    close = [100.0] * 10 + [110.0] * 50
    g = grid(spark, {"AAA": close, "SPY": close}, {"AAA": close[:10] + [104.0] + close[11:]})
    ev = event(spark, ("AAA", "Beat", 10, 10, 10))
    last = lambda timing: portfolio.net_return_at_cost(portfolio.daily_book(ev, g, 4, timing), FREE)(0)
    assert last("next_close") == pytest.approx(0) and last("next_open") == pytest.approx((110 / 104 - 1) * 100)


def test_book_equals_a_walk_through_sessions(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    tickers = [f"T{i}" for i in range(6)]
    close = {t: (100 * np.cumprod(1 + rng.normal(0, 0.02, 60))).tolist() for t in tickers}
    opens = {t: (np.array(c) * (1 + rng.normal(0, 0.01, 60))).tolist() for t, c in close.items()}
    g = grid(spark, close, opens)
    raw = [(tickers[int(rng.integers(6))], str(rng.choice(["Beat", "Miss"])), int(p)) for p in (3, 4, 4, 9, 20, 21, 22, 40, 41, 41)]
    ev = event(spark, *((t, c, p, p + i % 2, p) for i, (t, c, p) in enumerate(raw)))
    for timing in (temporal.NEXT_OPEN, temporal.NEXT_CLOSE):
        held = [(t, 1 if c == "Beat" else -1, e := p + (i % 2 if timing == "next_open" else 0), e + 5) for i, (t, c, p) in enumerate(raw)]
        got = {r.session_pos: r for r in portfolio.daily_book(ev, g, 5, timing).collect()}
        weights = {}
        for s in range(60):
            live = [k for k, (_, _, a, z) in enumerate(held) if a <= s <= z]
            if not live:
                weights = {}
                continue
            gross = turnover = 0.0
            new = {}
            for k in live:
                t, side, a, z = held[k]
                if s == a:
                    r = close[t][s] / opens[t][s] - 1 if timing == "next_open" else 0.0
                elif s == z and timing == "next_open":
                    r = opens[t][s] / close[t][s - 1] - 1
                else:
                    r = close[t][s] / close[t][s - 1] - 1
                new[k] = 1 / len(live)
                gross += side * r / len(live)
                turnover += abs(new[k] - weights.get(k, 0.0) * (1 + r)) + (new[k] if s == z else 0)
            weights = {k: w for k, w in new.items() if held[k][3] != s}
            assert got[s].gross_ret == pytest.approx(gross) and got[s].turnover == pytest.approx(turnover)


def test_metrics_of_the_two_trades(two):
    g, ev = two
    book = portfolio.daily_book(ev, g, 4, temporal.NEXT_CLOSE)
    (m,) = portfolio.book_metrics(book, portfolio.trade_log(ev, g, 4, temporal.NEXT_CLOSE, FREE), g, FREE).collect()
    assert (m.n_trades, m.n_long_trades, m.n_short_trades, m.hit_rate_pct) == (2, 1, 1, 100)
    assert m.total_return_pct == pytest.approx((1.01**8 - 1) * 100) and m.max_drawdown_pct == pytest.approx(0) and m.profit_factor is None and m.avg_loss_pct is None
    assert m.benchmark_total_return_pct == 0 and m.benchmark_sharpe is None and m.exposure_pct == pytest.approx(40)
    empty = ev.where("ticker = 'NONE'")
    nothing = portfolio.daily_book(empty, g, 4, temporal.NEXT_CLOSE)
    assert nothing.count() == 0 and portfolio.book_metrics(nothing, portfolio.trade_log(empty, g, 4, temporal.NEXT_CLOSE, FREE), g, FREE).count() == 0


def test_cost_model():
    m = CostModel(CostAssumptions(0.5, 1, 10, 0.01, 40))
    assert (m.impact_bps, m.one_way_bps, m.round_trip_bps) == pytest.approx((1, 2.5, 5)) and m.borrow_bps_daily == pytest.approx(40 / 252)
    assert m.with_round_trip_bps(12).round_trip_bps == 12 and m.with_round_trip_bps(12).borrow_bps_daily == m.borrow_bps_daily


def test_break_even():
    find = portfolio.break_even_cost_bps
    assert find(lambda c: 40 - c) == pytest.approx(40, abs=0.05) and find(lambda c: -5 - c) == 0 and math.isinf(find(lambda c: 1000 - c, hi=100))
    assert find(lambda c: 11.0 - c) * 65536 / 1000 % 1 == 0


def test_unknown_fill(two):
    with pytest.raises(ValueError):
        portfolio.daily_book(two[1], two[0], 4, "later")
