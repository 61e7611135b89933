"""The queries' definitions in DuckDB SQL, written from the definitions and not from the DataFrame plans: native as-of
joins and QUALIFY, self-joins by position, sums over seasons one by one."""

from __future__ import annotations

from tidemark.plans.adapters import BENCHMARK, duckdb_ctes

WINDOWS = (0, 1, 5, 10, 20)
METRICS = ("abret_d0", "abret_d20", "abdrift_d5", "abdrift_d20")
DRAWS, CURVE_DRAWS, BAND_DRAWS, SEED = 10_000, 2000, 400, 20240719


def r(expression: str, name: str = "", places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0 AS {name or expression.split('.')[-1]}"


def picked(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::BIGINT"


SUE = """,
s0 AS (SELECT *, CASE WHEN period_end - lag(period_end, 4) OVER w BETWEEN 330 AND 400 THEN val - lag(val, 4) OVER w END AS seasonal_diff,
       greatest(lag(filed, 4) OVER w, max(filed) OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS history_known_by
       FROM fundamentals WINDOW w AS (PARTITION BY ticker ORDER BY period_end)),
s1 AS (SELECT a.ticker, a.k, count(b.seasonal_diff) AS n8, avg(b.seasonal_diff) AS m8, stddev_samp(b.seasonal_diff) AS sd8
       FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS i FROM s0) a JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end) AS i FROM s0) b
       ON a.ticker = b.ticker AND b.i BETWEEN a.i - 8 AND a.i - 1 GROUP BY a.ticker, a.k),
sue AS (SELECT s0.*, CASE WHEN n8 = 8 THEN m8 END AS drift, CASE WHEN n8 = 8 AND sd8 > 1e-9 THEN sd8 END AS sue_sigma,
        CASE WHEN n8 = 8 AND sd8 > 1e-9 THEN (seasonal_diff - m8) / sd8 END AS sue, CASE WHEN n8 = 8 AND sd8 > 1e-9 THEN seasonal_diff / sd8 END AS sue_plain FROM s0 LEFT JOIN s1 USING (ticker, k))"""

CALENDAR = """,
cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM prices)),
ncal AS (SELECT count(*) AS n FROM cal)"""

GRID = CALENDAR + f""",
g0 AS (SELECT pos, session, ticker, last_value(open IGNORE NULLS) OVER w AS open, last_value(close IGNORE NULLS) OVER w AS close
       FROM cal CROSS JOIN (SELECT DISTINCT ticker FROM prices) t LEFT JOIN prices USING (session, ticker) WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING)),
grid AS (SELECT * FROM g0 UNION ALL SELECT pos, session, '{BENCHMARK}', round(avg(open) + 0.0000013, 4), round(avg(close) + 0.0000013, 4) FROM g0 GROUP BY pos, session)"""

TIMED = """,
timed AS (SELECT *, (accepted_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM {0}),
labelled AS (SELECT *, et::DATE AS announcement_date, CASE WHEN et::TIME < TIME '09:30:00' THEN 'before_open' WHEN et::TIME <= TIME '16:00:00' THEN 'intraday' ELSE 'after_close' END AS timing FROM timed),
placed AS (SELECT l.*, coalesce(c.pos, ncal.n) + CASE WHEN l.timing = 'after_close' AND c.session = l.announcement_date THEN 1 ELSE 0 END AS reaction_pos, ncal.n AS n_sessions
           FROM labelled l ASOF LEFT JOIN cal c ON l.announcement_date <= c.session, ncal)"""

MATCH = """,
ann1 AS (SELECT * FROM announcements QUALIFY row_number() OVER (PARTITION BY ticker, accepted_utc::DATE ORDER BY accepted_utc, accession) = 1),
matched AS (SELECT s.*, a.accession, a.accepted_utc FROM sue s ASOF JOIN ann1 a ON s.ticker = a.ticker AND s.period_end + 1 <= a.accepted_utc::DATE
            WHERE a.accepted_utc::DATE - (s.period_end + 1) <= 100 QUALIFY row_number() OVER (PARTITION BY s.ticker, a.accession ORDER BY s.period_end DESC) = 1)"""

PLAUSIBLE = """,
at_end AS (SELECT m.*, coalesce(c.pos, 0) AS end_pos FROM {0} m ASOF LEFT JOIN cal c ON m.period_end >= c.session),
priced AS (SELECT a.*, g.close AS period_price, NOT coalesce(CASE WHEN g.close = 0 THEN a.val <> 0 ELSE abs(a.val) / g.close > 0.25 END, FALSE) AS plausible FROM at_end a LEFT JOIN grid g ON g.ticker = a.ticker AND g.pos = a.end_pos)"""


def _leg(w: int, base: str, name: str) -> str:
    return f"(g{w}.close / {base}.close - 1) * 100 AS {name}, (g{w}.close / {base}.close - 1) * 100 - (b{w}.close / b{base[1:]}.close - 1) * 100 AS ab{name}"


def _panel() -> str:
    joins = "".join(f" LEFT JOIN grid {k}{w if w >= 0 else 'm'} ON {k}{w if w >= 0 else 'm'}.ticker = {t} AND {k}{w if w >= 0 else 'm'}.pos = p.reaction_pos + {w}" for k, t in (("g", "p.ticker"), ("b", f"'{BENCHMARK}'")) for w in (-1, *WINDOWS))
    legs = ", ".join([_leg(w, "gm", f"ret_d{w}") for w in WINDOWS] + [_leg(w, "g0", f"drift_d{w}") for w in WINDOWS if w])
    return f""",
chosen AS (SELECT *, (accepted_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS ad FROM priced),
flags AS (SELECT c.*, plausible AS f1, plausible AND sue IS NOT NULL AS f2, plausible AND sue IS NOT NULL AND coalesce(history_known_by < ad, FALSE) AS f3, u.date_added IS NULL OR u.date_added <= ad AS mem
          FROM chosen c LEFT JOIN universe u USING (ticker)),
kept AS (SELECT * FROM flags WHERE f3 AND mem AND ad BETWEEN DATE '1997-06-01' AND DATE '2001-12-31'){TIMED.format("kept")},
panel AS (SELECT p.ticker, p.accession, p.accepted_utc, p.sue, p.timing, p.announcement_date, p.reaction_pos, p.reaction_pos AS entry_pos_close, p.reaction_pos + (p.timing = 'intraday')::INT AS entry_pos_open, g0.session AS reaction_date,
  year(p.announcement_date) || 'Q' || quarter(p.announcement_date) AS season, (g0.open / gm.close - 1) * 100 AS gap_ret, (g0.close / g0.open - 1) * 100 AS open_to_close_ret,
  (g0.open / gm.close - b0.open / bm.close) * 100 AS abgap_ret, (g0.close / g0.open - b0.close / b0.open) * 100 AS abopen_to_close_ret, {legs}
  FROM placed p{joins} WHERE p.reaction_pos >= 1 AND p.reaction_pos + 21 < p.n_sessions AND p.ticker IN (SELECT ticker FROM grid)),
events AS (SELECT *, CASE WHEN sue > 1 THEN 'Beat' WHEN sue < -1 THEN 'Miss' ELSE 'In-Line' END AS category FROM panel WHERE ret_d20 IS NOT NULL AND gap_ret IS NOT NULL AND open_to_close_ret IS NOT NULL)"""


def chain() -> str:
    """Everything up to the table ``events`` of the event panel. The driver's table of that name is not read by it."""
    return BASE + SUE + GRID + MATCH + PLAUSIBLE.format("matched") + _panel()


BASE = duckdb_ctes()
EVENTS = chain()
LONG = EVENTS + ", long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, season, category, {m} AS value FROM events WHERE {m} IS NOT NULL" for m in METRICS) + """),
ss AS (SELECT metric, season, coalesce(sum(value) FILTER (category = 'Beat'), 0) AS beat_sum, count(*) FILTER (category = 'Beat') AS beat_n, coalesce(sum(value) FILTER (category = 'Miss'), 0) AS miss_sum, count(*) FILTER (category = 'Miss') AS miss_n FROM long GROUP BY ALL)"""
SPREAD = "sum(beat_sum) / nullif(sum(beat_n), 0) - sum(miss_sum) / nullif(sum(miss_n), 0)"
NUMBERED = ", num AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY season) - 1 AS g, count(*) OVER (PARTITION BY metric) AS clusters FROM ss)"


def drawn(draws: int, spread: str = SPREAD, seed: int = SEED) -> str:
    return f""",
slots AS (SELECT metric, clusters, d.draw, unnest(range(clusters)) AS slot FROM (SELECT DISTINCT metric, clusters FROM num), (SELECT unnest(range({draws})) AS draw) d),
picks AS (SELECT metric, draw, {picked(str(seed), "draw", "slot")} % clusters AS g FROM slots),
drawn AS (SELECT metric, draw, {spread} AS v FROM picks JOIN num USING (metric, g) GROUP BY metric, draw)"""


def book(timing: str) -> str:
    entry, at_open = ("entry_pos_open", True) if timing == "next_open" else ("entry_pos_close", False)
    on_entry, on_exit = ("g.close / g.open - 1", "g.open / gb.close - 1") if at_open else ("0.0", "g.close / gb.close - 1")
    return f""",
pos_{timing} AS (SELECT ticker, category, CASE WHEN category = 'Beat' THEN 1 ELSE -1 END AS side, {entry} AS a, {entry} + 20 AS z FROM events, ncal WHERE category IN ('Beat', 'Miss') AND {entry} + 20 < ncal.n),
held_{timing} AS (SELECT p.*, p.t AS pos, coalesce(CASE WHEN p.t = p.a THEN {on_entry} WHEN p.t = p.z THEN {on_exit} ELSE g.close / gb.close - 1 END, 0) AS ret
  FROM (SELECT *, unnest(range(a, z + 1)) AS t FROM pos_{timing}) p LEFT JOIN grid g ON g.ticker = p.ticker AND g.pos = p.t LEFT JOIN grid gb ON gb.ticker = p.ticker AND gb.pos = p.t - 1),
cnt_{timing} AS (SELECT pos, count(*) AS n FROM held_{timing} GROUP BY pos),
day_{timing} AS (SELECT h.pos, sum(side * ret) / any_value(c.n) AS gross_ret, sum(abs(1.0 / c.n - CASE WHEN h.pos > a THEN (1 + ret) / b.n ELSE 0 END) + CASE WHEN z = h.pos THEN 1.0 / c.n ELSE 0 END) AS turnover, count(*) FILTER (side > 0) AS n_long, count(*) FILTER (side < 0) AS n_short
  FROM held_{timing} h JOIN cnt_{timing} c ON c.pos = h.pos LEFT JOIN cnt_{timing} b ON b.pos = h.pos - 1 GROUP BY h.pos),
book_{timing} AS (SELECT cal.pos, cal.session, gross_ret, coalesce(turnover, 0) AS turnover, coalesce(n_long, 0) AS n_long, coalesce(n_short, 0) AS n_short, coalesce(n_short / (n_long + n_short), 0) AS short_exposure
  FROM cal LEFT JOIN day_{timing} d USING (pos) WHERE cal.pos BETWEEN (SELECT min(pos) FROM day_{timing}) AND (SELECT max(pos) FROM day_{timing})),
net_{timing} AS (SELECT *, coalesce(gross_ret - turnover * 2.5 / 1e4 - short_exposure * 40.0 / 252 / 1e4, 0) AS net, coalesce(gross_ret, 0) AS gross FROM book_{timing})"""


BOOK_ROWS = "session, {0}, {1}, n_long::BIGINT AS n_long, n_short::BIGINT AS n_short, {2}".format(r("gross_ret"), r("turnover"), r("short_exposure"))
CURVE = ", curve AS (SELECT pos, session, product(1 + net) OVER (ORDER BY pos) AS equity FROM net_next_close), dd AS (SELECT *, max(equity) OVER (ORDER BY pos) AS peak FROM curve), fall AS (SELECT *, equity / peak - 1 AS drawdown FROM dd)"


def trades(timing: str) -> str:
    px = "open" if timing == "next_open" else "close"
    return f""",
log_{timing} AS (SELECT p.ticker, p.category, p.side, p.a AS entry_pos, p.z AS exit_pos, x.session AS entry_date, y.session AS exit_date, x.{px} AS entry_price, y.{px} AS exit_price, p.side * (y.{px} / x.{px} - 1) * 100 AS gross_ret_pct,
  p.side * (y.{px} / x.{px} - 1) * 100 - 0.05 - CASE WHEN p.side < 0 THEN 40.0 / 252 * 20 / 100 ELSE 0 END AS net_ret_pct
  FROM pos_{timing} p JOIN grid x ON x.ticker = p.ticker AND x.pos = p.a JOIN grid y ON y.ticker = p.ticker AND y.pos = p.z WHERE x.{px} IS NOT NULL AND y.{px} IS NOT NULL)"""


NEAREST = """,
cands AS (SELECT l.ticker, l.accession, c.announced_date, c.eps_estimate, c.eps_actual, c.announced_date - l.announcement_date AS d FROM {0} l JOIN consensus c ON c.ticker = l.ticker AND abs(c.announced_date - l.announcement_date) <= 2),
near AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY ticker, accession ORDER BY abs(d), d, CASE WHEN d > 0 THEN eps_estimate ELSE -eps_estimate END) = 1)"""
PCT = "greatest(-200.0, least(200.0, (eps_actual - eps_estimate) / abs(eps_estimate) * 100))"
BOTH = EVENTS + NEAREST.format("events") + f", both_ AS (SELECT e.*, {PCT} AS pct_surprise FROM events e JOIN near n USING (ticker, accession) WHERE abs(n.eps_estimate) >= 0.01)"

RETURNS = ", ".join(r(c) for c in [f"{p}_d{w}" for p in ("ret", "abret") for w in WINDOWS] + [f"{p}_d{w}" for p in ("drift", "abdrift") for w in WINDOWS if w])
CT = """,
ret1 AS (SELECT a.ticker, a.pos, a.close / b.close - 1 AS x FROM grid a JOIN grid b ON b.ticker = a.ticker AND b.pos = a.pos - 1 WHERE a.close IS NOT NULL AND b.close IS NOT NULL),
hold AS (SELECT ticker, category, unnest(range(reaction_pos + 1, reaction_pos + 21)) AS pos FROM events WHERE category IN ('Beat', 'Miss')),
legs AS (SELECT pos, avg(x) FILTER (category = 'Beat') AS long_ret, count(*) FILTER (category = 'Beat') AS n_long, avg(x) FILTER (category = 'Miss') AS short_ret, count(*) FILTER (category = 'Miss') AS n_short FROM hold JOIN ret1 USING (ticker, pos) GROUP BY pos),
ct AS (SELECT session, long_ret, coalesce(n_long, 0) AS n_long, short_ret, coalesce(n_short, 0) AS n_short, CASE WHEN long_ret IS NOT NULL OR short_ret IS NOT NULL THEN coalesce(long_ret, 0) - coalesce(short_ret, 0) END AS spread_ret FROM cal LEFT JOIN legs USING (pos))"""
X = ("mkt_rf", "smb", "hml", "mom")
ICC = """,
gr AS (SELECT metric, season, count(*) AS n, avg(value) AS m FROM {0} GROUP BY ALL),
grand AS (SELECT metric, avg(value) AS mm FROM {0} GROUP BY ALL),
sw AS (SELECT l.metric, sum((l.value - gr.m) ** 2) AS ssw FROM {0} l JOIN gr USING (metric, season) GROUP BY l.metric),
sb AS (SELECT gr.metric, count(*) AS k, sum(n) AS n, sum(n * n) AS n2, sum(n * (m - mm) ** 2) AS ssb FROM gr JOIN grand USING (metric) GROUP BY gr.metric),
ic AS (SELECT metric, ssb / (k - 1) AS msb, ssw / greatest(n - k, 1) AS msw, (n - n2 / n) / (k - 1) AS m0 FROM sb JOIN sw USING (metric)),
icc_ AS (SELECT metric, greatest((msb - msw) / greatest(m0, 1e-9), 0) / (greatest((msb - msw) / greatest(m0, 1e-9), 0) + msw) AS icc FROM ic)"""


def roll(width: int, least: int) -> str:
    return f""",
one AS (SELECT *, row_number() OVER (ORDER BY season) AS i FROM ss WHERE metric = 'abdrift_d20'),
win AS (SELECT e.season AS metric, o.season, o.beat_sum, o.beat_n, o.miss_sum, o.miss_n FROM one e JOIN one o ON o.i BETWEEN e.i - {width - 1} AND e.i WHERE e.i >= {width}),
ok AS (SELECT metric, {SPREAD} AS spread, sum(beat_n) AS n_beat, sum(miss_n) AS n_miss FROM win GROUP BY metric HAVING sum(beat_n) + sum(miss_n) >= {least}),
num AS (SELECT win.*, row_number() OVER (PARTITION BY metric ORDER BY season) - 1 AS g, count(*) OVER (PARTITION BY metric) AS clusters FROM win WHERE metric IN (SELECT metric FROM ok))"""


def rolled(width: int, least: int) -> str:
    return LONG + roll(width, least) + drawn(CURVE_DRAWS) + f""", ci AS (SELECT metric, quantile_cont(v, [0.05, 0.95]) AS q FROM drawn WHERE v IS NOT NULL GROUP BY metric)
        SELECT metric AS season, {ENDED} AS end_date, {r('spread')}, {r('q[1]', 'ci_low')}, {r('q[2]', 'ci_high')}, (n_beat + n_miss)::BIGINT AS n_events, n_beat::BIGINT AS n_beat, n_miss::BIGINT AS n_miss FROM ok LEFT JOIN ci USING (metric)"""


def quintiles(least: int) -> str:
    cells = (f"SELECT 'Q' || bin AS quintile, {w}::BIGINT AS horizon, count(abret_d{w})::BIGINT AS n, {r(f'CASE WHEN count(abret_d{w}) >= {least} THEN avg(abret_d{w}) END', 'mean_abret')} FROM b GROUP BY bin" for w in WINDOWS)
    return EVENTS + ", b AS " + BINS("sue", "[0.2, 0.4, 0.6, 0.8]", ">", "events") + " " + " UNION ALL ".join(cells)


ENDED = "last_day(make_date(substr(metric, 1, 4)::INT, substr(metric, 6, 1)::INT * 3, 1))"
WILD = f""",
arms AS (SELECT l.*, value - avg(value) OVER (PARTITION BY metric) AS res FROM long l WHERE category IN ('Beat', 'Miss')),
rs AS (SELECT metric, season, coalesce(sum(res) FILTER (category = 'Beat'), 0) AS sb, count(*) FILTER (category = 'Beat') AS nb, coalesce(sum(res) FILTER (category = 'Miss'), 0) AS sm, count(*) FILTER (category = 'Miss') AS nm FROM arms GROUP BY ALL),
rg AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY season) - 1 AS g, count(*) OVER (PARTITION BY metric) AS gg, sum(nb) OVER (PARTITION BY metric) AS tb, sum(nm) OVER (PARTITION BY metric) AS tm FROM rs),
signed AS (SELECT *, -1 AS draw, 1 AS w FROM rg UNION ALL SELECT rg.*, d.draw, 1 - 2 * ({picked(str(SEED), "d.draw", "rg.g")} % 2) AS w FROM rg, (SELECT unnest(range({DRAWS})) AS draw) d),
bm AS (SELECT *, sum(w * sb) OVER (PARTITION BY metric, draw) / tb AS B, sum(w * sm) OVER (PARTITION BY metric, draw) / tm AS M FROM signed),
tt AS (SELECT metric, draw, any_value(B - M) AS slope, any_value(tb + tm) AS n, any_value(gg) AS gg, sqrt(any_value(gg / (gg - 1) * (tb + tm - 1) / (tb + tm - 2)) * sum(((w * sb - nb * B) / tb - (w * sm - nm * M) / tm) ** 2)) AS se FROM bm GROUP BY metric, draw),
seen AS (SELECT *, slope / se AS t FROM tt WHERE draw = -1),
pv AS (SELECT s.metric, greatest(avg((abs(d.slope / d.se) >= abs(s.t) * (1 - 1e-9))::INT), 1.0 / (count(*) + 1)) AS p_value FROM tt d JOIN seen s USING (metric) WHERE d.draw >= 0 GROUP BY s.metric)"""
METRIC_COLUMNS = """n_trades::BIGINT AS n_trades, n_long_trades::BIGINT AS n_long_trades, n_short_trades::BIGINT AS n_short_trades"""
FILLS = " UNION ALL ".join(
    f"SELECT '{name}' AS fill, count(*)::BIGINT AS n FROM placed p JOIN cal c ON c.pos = p.reaction_pos + {extra} WHERE ((c.session + TIME '{clock}') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' <= p.accepted_utc"
    for name, extra, clock in (("close", "0", "16:00:00"), ("open", "(p.timing = 'intraday')::INT", "09:30:00"), ("open_early", "(p.timing = 'intraday')::INT - 1", "09:30:00"), ("close_early", "0 - 1", "16:00:00"))
)


def _metrics() -> str:
    m = lambda e, n: r(e, n, 4)
    return EVENTS + book("next_close") + trades("next_close") + CURVE + f""",
x AS (SELECT n.*, n.net - coalesce(f.rf, 0) AS ex FROM net_next_close n LEFT JOIN factors f ON f.date = n.session),
h AS (SELECT count(*) AS c, min(session) AS s0, max(session) AS s1, product(1 + net) AS e, product(1 + gross) AS eg, stddev_samp(net) AS vol, avg(ex) / stddev_samp(ex) * sqrt(252) AS sharpe, avg(ex) / stddev_samp(ex) FILTER (ex < 0) * sqrt(252) AS sortino, avg(turnover) * 252 AS tov,
      avg((n_long + n_short > 0)::INT) * 100 AS expo, avg(n_long + n_short) AS ap, greatest((max(session) - min(session)) / 365.25, 1e-9) AS years FROM x),
tr AS (SELECT drawdown, pos, session FROM fall ORDER BY drawdown, pos LIMIT 1),
pk AS (SELECT session FROM fall WHERE pos <= (SELECT pos FROM tr) ORDER BY equity DESC, pos LIMIT 1),
tl AS (SELECT count(*) AS n_trades, count(*) FILTER (side > 0) AS n_long_trades, count(*) FILTER (side < 0) AS n_short_trades, avg((net_ret_pct > 0)::INT) * 100 AS hit, avg(net_ret_pct) FILTER (net_ret_pct > 0) AS aw, avg(net_ret_pct) FILTER (net_ret_pct <= 0) AS al,
       sum(net_ret_pct) FILTER (net_ret_pct > 0) / -sum(net_ret_pct) FILTER (net_ret_pct <= 0) AS pf FROM log_next_close),
bw AS (SELECT pos, close, close / lag(close) OVER (ORDER BY pos) - 1 AS ret, session FROM grid WHERE ticker = '{BENCHMARK}' AND pos BETWEEN (SELECT min(pos) FROM book_next_close) AND (SELECT max(pos) FROM book_next_close)),
bx AS (SELECT bw.*, ret - coalesce(rf, 0) AS ex FROM bw LEFT JOIN factors f ON f.date = bw.session),
bc AS (SELECT pos, product(1 + ret) OVER (ORDER BY pos) AS eq FROM bw WHERE ret IS NOT NULL), bd AS (SELECT min(eq / pk - 1) * 100 AS bdd FROM (SELECT eq, max(eq) OVER (ORDER BY pos) AS pk FROM bc)),
bt AS (SELECT (arg_max(close, pos) / arg_min(close, pos) - 1) * 100 AS total, stddev_samp(ret) * sqrt(252) * 100 AS bvol, avg(ex) / stddev_samp(ex) * sqrt(252) AS bsh FROM bx)
SELECT {METRIC_COLUMNS}, {m("(e - 1) * 100", "total_return_pct")}, {m("(eg - 1) * 100", "gross_total_return_pct")}, {m("(pow(e, 1 / years) - 1) * 100", "cagr_pct")}, {m("vol * sqrt(252) * 100", "ann_vol_pct")}, {m("sharpe", "sharpe")}, {m("sortino", "sortino")},
  {m("tr.drawdown * 100", "max_drawdown_pct")}, strftime(pk.session, '%Y-%m-%d') AS max_drawdown_peak, strftime(tr.session, '%Y-%m-%d') AS max_drawdown_trough, {m("hit", "hit_rate_pct")}, {m("aw", "avg_win_pct")}, {m("al", "avg_loss_pct")}, {m("pf", "profit_factor")},
  {m("tov", "ann_turnover_x")}, {m("expo", "exposure_pct")}, {m("ap", "avg_positions")}, 5.0::DOUBLE AS round_trip_cost_bps, {m("total", "benchmark_total_return_pct")}, {m("bvol", "benchmark_ann_vol_pct")}, {m("bsh", "benchmark_sharpe")}, {m("bdd", "benchmark_max_drawdown_pct")},
  {m("(pow(1 + total / 100, 1 / years) - 1) * 100", "benchmark_cagr_pct")}, {m("years", "years")} FROM h, tr, pk, tl, bt, bd"""


def _curve(timing: str) -> str:
    return f"SELECT c.round_trip_bps::DOUBLE AS round_trip_bps, {r('(product(1 + coalesce(gross_ret - turnover * c.round_trip_bps / 2e4 - short_exposure * 40.0 / 252 / 1e4, 0)) - 1) * 100', 'net_total_return_pct', 4)}, '{timing}' AS timing FROM book_{timing}, (SELECT unnest([0, 5, 10, 20, 30, 50, 75, 100, 150, 200]) AS round_trip_bps) c GROUP BY c.round_trip_bps"


BINS = lambda col, edges, op, src: f"""(SELECT *, 1 + len(list_filter(cuts, lambda c: {col} {op} c)) AS bin FROM {src}, (SELECT quantile_cont({col}, {edges}) AS cuts FROM {src}))"""

def t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t, by Simpson's rule over the density between 0 and |t|."""
    return f"""(SELECT 1 - sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs({t}) * i / 2000, 2) / {df}, -({df} + 1) / 2)) * abs({t}) / 3000 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) FROM range(2001) s(i))"""


def normal_tail(z: str) -> str:
    return f"""(SELECT 1 - sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({z} * i / 2000, 2) / 2)) * abs({z}) / 3000 / sqrt(2 * pi()) FROM range(2001) s(i))"""


def tested(metrics: str = "long") -> str:
    """welch_, boot_ and wild_: the three tests of every metric of ``long``; needs LONG, drawn draws and WILD."""
    arm = lambda c: f"count(*) FILTER (category = '{c}') AS n{c[0]}, avg(value) FILTER (category = '{c}') AS a{c[0]}, var_samp(value) FILTER (category = '{c}') / count(*) FILTER (category = '{c}') AS e{c[0]}"
    return f""",
wm AS (SELECT metric, count(DISTINCT season) AS g, {arm("Beat")}, {arm("Miss")} FROM {metrics} GROUP BY metric),
wt AS (SELECT *, (aB - aM) / sqrt(eB + eM) AS t, (eB + eM) ** 2 / (eB * eB / (nB - 1) + eM * eM / (nM - 1)) AS df FROM wm),
welch_ AS (SELECT metric, aB - aM AS estimate, sqrt(eB + eM) AS std_error, t AS statistic, {t_tail("t", "df")} AS p_value, nB + nM AS n_obs, g AS n_clusters, aB - aM - 1.96 * sqrt(eB + eM) AS ci_low, aB - aM + 1.96 * sqrt(eB + eM) AS ci_high FROM wt),
bp AS (SELECT metric, {SPREAD} AS e, sum(beat_n + miss_n) AS n, count(*) AS g FROM ss GROUP BY metric),
boot_ AS (SELECT bp.metric, any_value(e) AS estimate, stddev_samp(v) AS std_error, NULL::DOUBLE AS statistic, greatest(avg((abs(v - e) >= abs(e))::INT), 1.0 / (count(*) + 1)) AS p_value, any_value(n) AS n_obs, any_value(g) AS n_clusters, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high
  FROM bp JOIN drawn USING (metric) WHERE v IS NOT NULL GROUP BY bp.metric)"""


LABELS = {"abret_d0": "Day 0", "abret_d20": "Day 0-20", "abdrift_d5": "Drift 1-5", "abdrift_d20": "Drift 1-20"}


def _inference() -> str:
    shown = f"metric, {r('estimate')}, {r('std_error')}, {r('statistic')}, {r('p_value')}, n_obs::BIGINT AS n_obs, n_clusters::BIGINT AS n_clusters, {r('ci_low')}, {r('ci_high')}, {r('icc', 'icc_season')}"
    label = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in LABELS.items()) + " END AS label"
    return LONG + NUMBERED + drawn(DRAWS) + WILD + ICC.format("long") + tested() + ", wild_ AS (SELECT metric, slope AS estimate, se AS std_error, t AS statistic, p_value, n AS n_obs, gg AS n_clusters, slope - 1.96 * se AS ci_low, slope + 1.96 * se AS ci_high FROM seen JOIN pv USING (metric)) " + " UNION ALL ".join(
        f"SELECT '{method}' AS method, {label}, {shown} FROM {table} JOIN icc_ USING (metric)" for method, table in (("welch_t", "welch_"), ("season_block_bootstrap", "boot_"), ("wild_cluster_bootstrap_t", "wild_"))
    )


def _alpha(column: str, excess: bool) -> str:
    """CTEs that end in al_<column>: least squares by Gauss-Jordan steps on the Gram matrix beside the unit matrix, then
    lagged products of the scores with Bartlett weights."""
    k, p = 5, column.removesuffix("_ret")
    cell = lambda i, j: f"c{i}_{j}"
    steps, before = [], f"{p}g"
    for s in range(k):
        rows = [f"{cell(s, j)} / {cell(s, s)} AS {cell(s, j)}" if i == s else f"{cell(i, j)} - {cell(i, s)} * {cell(s, j)} / {cell(s, s)} AS {cell(i, j)}" for i in range(k) for j in range(2 * k)]
        steps.append(f"{p}s{s} AS (SELECT {', '.join(rows)}, {', '.join(f'm{i}' for i in range(k))} FROM {before})")
        before = f"{p}s{s}"
    gram = ", ".join([f"sum(x{i} * x{j}) AS {cell(i, j)}" for i in range(k) for j in range(k)] + [f"{float(i == j)} AS {cell(i, j + k)}" for i in range(k) for j in range(k)] + [f"sum(x{i} * y) AS m{i}" for i in range(k)])
    beta = ", ".join(" + ".join(f"{cell(i, j + k)} * m{j}" for j in range(k)) + f" AS b{i}" for i in range(k))
    fitted = " + ".join(f"x{i} * b{i}" for i in range(k))
    weight = "CASE WHEN a.t = b.t THEN 1 ELSE 1 - abs(a.t - b.t) / 21.0 END"
    middle = ", ".join(f"sum({weight} * a.e{i} * b.e{j}) AS h{i}_{j}" for i in range(k) for j in range(k))
    variance = " + ".join(f"{cell(0, i + k)} * h{i}_{j} * {cell(j, k)}" for i in range(k) for j in range(k))
    return f""",
{p}r AS (SELECT {column} {'- f.rf' if excess else ''} AS y, 1.0::DOUBLE AS x0, mkt_rf AS x1, smb AS x2, hml AS x3, mom AS x4, row_number() OVER (ORDER BY session) AS t FROM ct JOIN factors f ON f.date = ct.session WHERE {column} IS NOT NULL AND mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND mom IS NOT NULL AND f.rf IS NOT NULL),
{p}g AS (SELECT {gram} FROM {p}r), {", ".join(steps)},
{p}b AS (SELECT {beta} FROM {before}), {p}e AS (SELECT t, {", ".join(f"x{i} * (y - ({fitted})) AS e{i}" for i in range(k))} FROM {p}r, {p}b),
{p}h AS (SELECT {middle} FROM {p}e a JOIN {p}e b ON abs(a.t - b.t) <= 20),
{p}v AS (SELECT b0, b1, b2, b3, b4, sqrt({variance}) AS se FROM {before}, {p}h, {p}b),
al_{column} AS (SELECT '{column}' AS portfolio, {r('b0 * 1e4', 'alpha_bps')}, {r('se * 1e4', 'std_error_bps')}, {r('b0 / se', 't')}, {r(normal_tail('(b0 / se)'), 'p_value')}, {r('(b0 - 1.959963984540054 * se) * 1e4', 'ci_low_bps')}, {r('(b0 + 1.959963984540054 * se) * 1e4', 'ci_high_bps')},
  {r('b1', 'beta_mkt_rf')}, {r('b2', 'beta_smb')}, {r('b3', 'beta_hml')}, {r('b4', 'beta_mom')}, (SELECT count(*) FROM {p}r)::BIGINT AS n_obs FROM {p}v)"""


def _definitions() -> str:
    by = {"SUE (point-in-time)": "CASE WHEN sue > 1 THEN 'Beat' WHEN sue < -1 THEN 'Miss' ELSE 'In-Line' END", "percent of consensus (not point-in-time)": "CASE WHEN pct_surprise > 5 THEN 'Beat' WHEN pct_surprise < -5 THEN 'Miss' ELSE 'In-Line' END"}
    rows = " UNION ALL ".join(f"SELECT '{name}' AS metric, season, {bucket} AS category, abdrift_d20 AS value FROM both_ WHERE sue IS NOT NULL" for name, bucket in by.items())
    leg = lambda c, k: f"coalesce(sum(value) FILTER (category = '{c}'), 0) AS {k}_sum, count(*) FILTER (category = '{c}') AS {k}_n"
    first, second = by.values()
    return BOTH + f""", long AS ({rows}), ss AS (SELECT metric, season, {leg("Beat", "beat")}, {leg("Miss", "miss")} FROM long GROUP BY ALL){NUMBERED}{drawn(DRAWS)}{tested()},
rk AS (SELECT rank() OVER (ORDER BY sue) + (count(*) OVER (PARTITION BY sue) - 1) / 2 AS a, rank() OVER (ORDER BY pct_surprise) + (count(*) OVER (PARTITION BY pct_surprise) - 1) / 2 AS b FROM both_ WHERE sue IS NOT NULL),
ov AS (SELECT count(*) AS n, min(announcement_date) AS d0, max(announcement_date) AS d1, avg(({first} = {second})::INT) * 100 AS agree FROM both_ WHERE sue IS NOT NULL)
SELECT w.metric AS definition, (SELECT count(*) FROM long l WHERE l.metric = w.metric AND category = 'Beat')::BIGINT AS n_beat, (SELECT count(*) FROM long l WHERE l.metric = w.metric AND category = 'Miss')::BIGINT AS n_miss, {r('w.estimate', 'drift_d20_spread_pp')}, {r('w.p_value', 'p_naive')}, {r('b.p_value', 'p_season_clustered')},
  ov.n::BIGINT AS n_overlap_events, d0 AS first_overlap, d1 AS last_overlap, {r('(SELECT corr(a, b) FROM rk)', 'rank_correlation')}, {r('agree', 'bucket_agreement_pct')} FROM welch_ w JOIN boot_ b ON b.metric = w.metric, ov"""


def _break_even(timing: str, side: str) -> str:
    """The search halves [0, 1000] fifteen times, so its answer is the middle of the last of 32768 cells that starts above zero."""
    return f"""SELECT '{timing}' AS entry_timing, '{side}' AS legs, {r("CASE WHEN max(total) FILTER (k = 0) <= 0 THEN 0 WHEN max(total) FILTER (k = 32768) > 0 THEN 'inf'::DOUBLE ELSE (max(k) FILTER (total > 0) + 0.5) * 1000 / 32768 END", "break_even_round_trip_bps")}
      FROM (SELECT k, product(1 + coalesce(gross_ret + {0.002 if side == 'lifted' else 0.0} - turnover * (k * 1000.0 / 32768) / 2e4 - short_exposure * 40.0 / 252 / 1e4, 0)) - 1 AS total FROM book_{timing}, range(32769) s(k) GROUP BY k)"""


ORACLES: dict[str, str] = {
    "drop_empty": BASE + " SELECT ticker, count(*)::BIGINT AS n, count(*)::BIGINT AS closes FROM prices WHERE ticker NOT IN ('Brand#3', 'Brand#7') GROUP BY ticker",
    "panel_subset": BASE + " SELECT ticker, count(*)::BIGINT AS n FROM prices WHERE ticker IN (SELECT ticker FROM universe WHERE cik <= 5) GROUP BY ticker",
    "market_symbols": "SELECT p_partkey, replace(upper(trim(p_name)), ' ', '-') AS symbol FROM part",
    "earnings_filings": """SELECT cik, count(*)::BIGINT AS n, min(day) AS first, max(day) AS last FROM (SELECT o_custkey % 50 AS cik, o_orderkey % 5000 AS acc, arg_min(o_orderdate::DATE, (o_orderdate, o_orderdate::DATE)) AS day
        FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 3 = 0 GROUP BY ALL) GROUP BY cik""",
    "eps_tags": BASE + f""", tagged AS (SELECT *, CASE WHEN cik % 4 = 0 OR days > 200 THEN 'EarningsPerShareBasic' ELSE 'EarningsPerShareDiluted' END AS tag FROM facts WHERE month(period_end) <> 6)
        SELECT cik, tag, count(*)::BIGINT AS n, sum(days)::BIGINT AS days, {r('sum(val)', 'val')} FROM tagged t WHERE tag = CASE WHEN EXISTS (SELECT 1 FROM tagged u WHERE u.cik = t.cik AND u.tag = 'EarningsPerShareDiluted') THEN 'EarningsPerShareDiluted' ELSE 'EarningsPerShareBasic' END GROUP BY cik, tag""",
    "factor_join": BASE + f" SELECT a.date, {r('a.mkt_rf')}, {r('a.smb')}, {r('a.hml')}, {r('a.rf')}, {r('b.mom')} FROM factors a LEFT JOIN (SELECT date, mom FROM factors WHERE day(date) <> 13) b USING (date)",
    "sample_filter": BASE + " SELECT ticker, accession, filing_date FROM announcements WHERE cik % 2 = 0 AND filing_date >= DATE '1999-01-01'",
    "first_reported": BASE + f" SELECT cik, period_end, {r('val')}, filed, days::BIGINT AS days FROM facts WHERE days BETWEEN 80 AND 100 QUALIFY row_number() OVER (PARTITION BY cik, period_end ORDER BY filed, start, val) = 1",
    "quarterly_derived": BASE + f""",
        q AS (SELECT * FROM facts WHERE days BETWEEN 80 AND 100 QUALIFY row_number() OVER (PARTITION BY cik, period_end ORDER BY filed, start, val) = 1),
        a AS (SELECT * FROM facts WHERE days BETWEEN 350 AND 380 QUALIFY row_number() OVER (PARTITION BY cik, period_end ORDER BY filed, start, val) = 1),
        f AS (SELECT a.cik, max(q.period_end) + 1 AS start, a.period_end, any_value(a.val) - sum(q.val) AS val, any_value(a.filed) AS filed FROM a JOIN q ON q.cik = a.cik AND q.start >= a.start AND q.period_end <= a.period_end GROUP BY a.cik, a.period_end HAVING count(*) = 3)
        SELECT cik, start, period_end, {r('val')}, filed, days::BIGINT AS days, FALSE AS derived FROM q UNION ALL SELECT cik, start, period_end, {r('val')}, filed, (period_end - start)::BIGINT, TRUE FROM f WHERE (cik, period_end) NOT IN (SELECT (cik, period_end) FROM q)""",
    "sue_panel": BASE + SUE + f" SELECT ticker, period_end, {r('seasonal_diff')}, {r('drift')}, {r('sue_sigma')}, {r('sue')}, history_known_by FROM sue",
    "sue_without_drift": BASE + SUE + f" SELECT ticker, period_end, {r('sue_plain', 'sue')} FROM sue",
    "sue_buckets": BASE + SUE + f" SELECT year(period_end) || 'Q' || quarter(period_end) AS season, CASE WHEN sue IS NULL THEN 'Unknown' WHEN sue > 1 THEN 'Beat' WHEN sue < -1 THEN 'Miss' ELSE 'In-Line' END AS category, count(*)::BIGINT AS n, {r('avg(sue)', 'mean_sue')} FROM sue GROUP BY 1, 2",
    "percent_surprise": BASE + f" SELECT ticker, announced_date, {r(f'CASE WHEN abs(eps_estimate) >= 0.01 THEN {PCT} END', 'pct_surprise')}, CASE WHEN abs(eps_estimate) < 0.01 THEN 'Unknown' WHEN {PCT} > 5 THEN 'Beat' WHEN {PCT} < -5 THEN 'Miss' ELSE 'In-Line' END AS bucket FROM consensus",
    "timing_mix": """WITH e AS (SELECT ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::TIME AS t FROM events), l AS (SELECT CASE WHEN t < TIME '09:30:00' THEN 'before_open' WHEN t <= TIME '16:00:00' THEN 'intraday' ELSE 'after_close' END AS timing FROM e)
        SELECT timing, count(*)::BIGINT AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM l), 2) + 0.0 AS share_pct FROM l GROUP BY timing""",
    "timing_by_type": """WITH e AS (SELECT event_type, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)
        SELECT event_type, CASE WHEN t::TIME < TIME '09:30:00' THEN 'before_open' WHEN t::TIME <= TIME '16:00:00' THEN 'intraday' ELSE 'after_close' END AS timing, t::DATE AS day, count(*)::BIGINT AS n FROM e GROUP BY ALL""",
    "reaction_positions": BASE + CALENDAR + TIMED.format("announcements") + " SELECT ticker, accession, timing, announcement_date, reaction_pos, reaction_pos AS entry_pos_close, reaction_pos + (timing = 'intraday')::INT AS entry_pos_open FROM placed",
    "asof_forward": BASE + SUE + MATCH + " SELECT ticker, period_end, accession, (accepted_utc::DATE - period_end)::BIGINT AS lag_days FROM matched",
    "asof_nearest": BASE + CALENDAR + TIMED.format("announcements") + NEAREST.format("labelled") + f" SELECT l.ticker, l.accession, n.announced_date, {r('n.eps_estimate')} FROM labelled l LEFT JOIN near n USING (ticker, accession)",
    "plausibility": BASE + GRID + PLAUSIBLE.format("(SELECT ticker, cik, k, period_end, val * 12 AS val FROM fundamentals)") + f" SELECT ticker, period_end, {r('period_price')}, plausible FROM priced",
    "point_in_time_guard": BASE + SUE + MATCH + " SELECT ticker, accession, history_known_by, coalesce(history_known_by < (accepted_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE, FALSE) AS known_before FROM matched",
    "membership": BASE + " SELECT a.ticker, a.accession, u.date_added IS NULL OR u.date_added <= a.filing_date AS member FROM announcements a LEFT JOIN universe u ON u.ticker = a.ticker AND u.cik <> 7",
    "members_on": BASE + " SELECT ticker FROM universe WHERE date_added IS NULL OR date_added <= DATE '1996-06-01'",
    "lookahead_violations": BASE + CALENDAR + TIMED.format("announcements") + " " + FILLS,
    "audit": EVENTS + """ SELECT 'eps_rows' AS stage, count(*)::BIGINT AS n FROM sue UNION ALL SELECT 'with_sue', count(sue) FROM sue UNION ALL SELECT 'matched', count(*) FROM matched UNION ALL SELECT 'plausible', count(*) FROM flags WHERE f1
        UNION ALL SELECT 'sue_required', count(*) FROM flags WHERE f2 UNION ALL SELECT 'point_in_time', count(*) FROM flags WHERE f3 UNION ALL SELECT 'member', count(*) FROM flags WHERE f3 AND mem UNION ALL SELECT 'in_window', count(*) FROM kept
        UNION ALL SELECT 'returns', count(*) FROM panel UNION ALL SELECT 'complete', count(*) FROM events""",
    "event_returns": EVENTS + f" SELECT ticker, accession, reaction_date, season, category, {r('sue')}, {r('gap_ret')}, {r('open_to_close_ret')}, {r('abgap_ret')}, {r('abopen_to_close_ret')}, {RETURNS} FROM events",
    "car_paths": EVENTS + f""", d AS (SELECT category, ticker, reaction_pos, unnest(range(21)) AS day FROM events),
        c AS (SELECT d.category, d.day, (g.close / h.close - b.close / e.close) * 100 AS car FROM d LEFT JOIN grid g ON g.ticker = d.ticker AND g.pos = d.reaction_pos + d.day LEFT JOIN grid h ON h.ticker = d.ticker AND h.pos = d.reaction_pos
          LEFT JOIN grid b ON b.ticker = '{BENCHMARK}' AND b.pos = d.reaction_pos + d.day LEFT JOIN grid e ON e.ticker = '{BENCHMARK}' AND e.pos = d.reaction_pos) SELECT category, day::BIGINT AS day, count(car)::BIGINT AS n, {r('avg(car)', 'mean_car')} FROM c GROUP BY category, day""",
    "car_paths_from_before": EVENTS + f""", d AS (SELECT accession, ticker, reaction_pos, unnest(range(6)) AS day FROM events)
        SELECT d.ticker, d.accession, d.day::BIGINT AS day, {r('(g.close / h.close - b.close / e.close) * 100', 'car')} FROM d LEFT JOIN grid g ON g.ticker = d.ticker AND g.pos = d.reaction_pos + d.day LEFT JOIN grid h ON h.ticker = d.ticker AND h.pos = d.reaction_pos - 1
          LEFT JOIN grid b ON b.ticker = '{BENCHMARK}' AND b.pos = d.reaction_pos + d.day LEFT JOIN grid e ON e.ticker = '{BENCHMARK}' AND e.pos = d.reaction_pos - 1""",
    "decomposition": EVENTS + f""", b AS (SELECT category, count(*) AS n, avg(abgap_ret) AS gap, avg(abopen_to_close_ret) AS open_to_close, avg(abdrift_d20) AS drift, avg(abret_d20) AS total FROM events GROUP BY category)
        SELECT category, n::BIGINT AS n, {r('gap')}, {r('open_to_close')}, {r('drift')}, {r('total')} FROM b UNION ALL
        SELECT 'Beat - Miss', (x.n + y.n)::BIGINT, {r('x.gap - y.gap', 'gap')}, {r('x.open_to_close - y.open_to_close', 'o')}, {r('x.drift - y.drift', 'd')}, {r('x.total - y.total', 't')} FROM b x, b y WHERE x.category = 'Beat' AND y.category = 'Miss'""",
    "season_stats": LONG + f" SELECT metric, season, {r('beat_sum')}, beat_n, {r('miss_sum')}, miss_n FROM ss",
    "spread_by_metric": LONG + f" SELECT metric, {r(SPREAD, 'spread')} FROM ss GROUP BY metric",
    "welch_moments": LONG + f""", m AS (SELECT metric, count(DISTINCT season) AS g, count(*) FILTER (category = 'Beat') AS nb, avg(value) FILTER (category = 'Beat') AS ab, var_samp(value) FILTER (category = 'Beat') / count(*) FILTER (category = 'Beat') AS eb,
          count(*) FILTER (category = 'Miss') AS nm, avg(value) FILTER (category = 'Miss') AS am, var_samp(value) FILTER (category = 'Miss') / count(*) FILTER (category = 'Miss') AS em FROM long GROUP BY metric)
        SELECT metric, {r('ab - am', 'estimate')}, {r('sqrt(eb + em)', 'std_error')}, {r('(ab - am) / sqrt(eb + em)', 'statistic')}, {r('(eb + em) ** 2 / (eb * eb / (nb - 1) + em * em / (nm - 1))', 'df')}, (nb + nm)::BIGINT AS n_obs, g::BIGINT AS n_clusters,
          {r('ab - am - 1.96 * sqrt(eb + em)', 'ci_low')}, {r('ab - am + 1.96 * sqrt(eb + em)', 'ci_high')} FROM m""",
    "block_bootstrap": LONG + NUMBERED + drawn(DRAWS) + f""", pt AS (SELECT metric, {SPREAD} AS e, sum(beat_n + miss_n) AS n, count(*) AS g FROM ss GROUP BY metric)
        SELECT pt.metric, {r('any_value(e)', 'estimate')}, any_value(n)::BIGINT AS n_obs, any_value(g)::BIGINT AS n_clusters, {r('stddev_samp(v)', 'std_error')}, {r('greatest(avg((abs(v - e) >= abs(e))::INT), 1.0 / (count(*) + 1))', 'p_value')},
          {r('quantile_cont(v, 0.025)', 'ci_low')}, {r('quantile_cont(v, 0.975)', 'ci_high')} FROM pt JOIN drawn USING (metric) WHERE v IS NOT NULL GROUP BY pt.metric""",
    "wild_bootstrap": LONG + WILD + f" SELECT metric, {r('slope', 'estimate')}, {r('se', 'std_error')}, {r('t', 'statistic')}, {r('p_value')}, n::BIGINT AS n_obs, gg::BIGINT AS n_clusters, {r('slope - 1.96 * se', 'ci_low')}, {r('slope + 1.96 * se', 'ci_high')} FROM seen JOIN pv USING (metric)",
    "icc": LONG + ICC.format("long") + f" SELECT metric, {r('icc')} FROM icc_",
    "power_inputs": LONG + ", arms AS (SELECT * FROM long WHERE metric = 'abdrift_d20' AND category IN ('Beat', 'Miss'))" + ICC.format("arms") + f" SELECT a.metric, {r('stddev_samp(value)', 'pooled_sd_pct')}, count(*)::BIGINT AS n_events_observed, count(DISTINCT season)::BIGINT AS n_seasons, {r('any_value(icc)', 'icc_season')} FROM arms a JOIN icc_ USING (metric) GROUP BY a.metric",
    "calendar_time": EVENTS + CT + f" SELECT session, {r('long_ret')}, n_long::BIGINT AS n_long, {r('short_ret')}, n_short::BIGINT AS n_short, {r('spread_ret')} FROM ct",
    "hac_moments": EVENTS + CT + ", m AS (SELECT spread_ret AS y, mkt_rf AS x1, smb AS x2, hml AS x3, mom AS x4 FROM ct JOIN factors f ON f.date = ct.session WHERE spread_ret IS NOT NULL AND mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND mom IS NOT NULL AND rf IS NOT NULL) SELECT count(*)::BIGINT AS n, "
    + ", ".join([r("sum(y)", "y"), *(r(f"sum(x{i} * y)", f"x{i}y") for i in range(1, 5)), *(r(f"sum(x{i} * x{j})", f"x{i}x{j}") for i in range(1, 5) for j in range(i, 5))]) + " FROM m",
    "rolling_spread": rolled(12, 50),
    "rolling_spread_short": rolled(6, 20),
    "trend": LONG + roll(6, 20) + f""", c AS (SELECT spread, {ENDED} AS d FROM ok), y AS (SELECT spread, d, (d - (SELECT min(d) FROM c)) / 365.25 AS x FROM c WHERE spread IS NOT NULL)
        SELECT count(*)::BIGINT AS n_windows, {r('CASE WHEN count(*) >= 3 THEN regr_slope(spread, x) * 10 END', 'slope_per_decade')}, {r('arg_min(spread, d)', 'first_spread')}, {r('arg_max(spread, d)', 'last_spread')} FROM y""",
    "spearman": BOTH + f""", k AS (SELECT rank() OVER (ORDER BY sue) + (count(*) OVER (PARTITION BY sue) - 1) / 2 AS a, rank() OVER (ORDER BY pct_surprise) + (count(*) OVER (PARTITION BY pct_surprise) - 1) / 2 AS b FROM both_ WHERE sue IS NOT NULL)
        SELECT count(*)::BIGINT AS n, {r('corr(a, b)', 'rank_correlation')} FROM k""",
    "bucket_agreement": BOTH + f" SELECT count(*)::BIGINT AS n, {r('''avg((category = CASE WHEN pct_surprise > 5 THEN 'Beat' WHEN pct_surprise < -5 THEN 'Miss' ELSE 'In-Line' END)::INT) * 100''', 'bucket_agreement_pct')} FROM both_",
    "quintile_matrix": quintiles(100),
    "quintile_matrix_small": quintiles(40),
    "bin_medians": EVENTS + ", b AS " + BINS("sue", "[0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]", ">=", "events") + f" SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n, {r('median(sue)', 'median_x')}, {r('median(abret_d0)', 'median_y')} FROM b GROUP BY bin HAVING count(*) >= 20",
    "kde_grid": EVENTS + f""", e AS (SELECT quantile_cont(abret_d20, 0.005) AS lo, quantile_cont(abret_d20, 0.995) AS hi FROM events), v AS (SELECT category, abret_d20 AS v, lo, hi FROM events, e WHERE category IN ('Beat', 'Miss') AND abret_d20 BETWEEN lo AND hi),
        w AS (SELECT category, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v GROUP BY category HAVING count(*) >= 10), i AS (SELECT unnest(range(256)) AS i)
        SELECT v.category, {r('any_value(lo + (hi - lo) / 255 * i.i)', 'x')}, {r('sum(exp(-0.5 * (((lo + (hi - lo) / 255 * i.i) - v) / h) ** 2)) / any_value(n * h * sqrt(2 * pi()))', 'density')} FROM v JOIN w USING (category), i GROUP BY v.category, i.i""",
    "linear_fit": EVENTS + f" SELECT count(*)::BIGINT AS n, {r('regr_slope(abret_d0, sue)', 'slope')}, {r('regr_intercept(abret_d0, sue)', 'intercept')}, {r('corr(sue, abret_d0) ** 2', 'r2')} FROM events WHERE sue IS NOT NULL AND abret_d0 IS NOT NULL",
    "linear_fit_band": EVENTS + f""", z AS (SELECT sue AS x, abret_d0 AS y, ticker || '|' || accession AS id FROM events WHERE sue IS NOT NULL AND abret_d0 IS NOT NULL),
        pk AS (SELECT d.draw, z.x, z.y, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726562, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]::DOUBLE[], lambda p: p <= {picked(str(SEED), "d.draw", "z.id")} / 4294967296.0::DOUBLE)) AS times
          FROM z, (SELECT unnest(range({BAND_DRAWS})) AS draw) d),
        ft AS (SELECT draw, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT draw, x, y, unnest(range(times)) FROM pk) GROUP BY draw),
        pt AS (SELECT p.p, (SELECT min(x) FROM z) + ((SELECT max(x) FROM z) - (SELECT min(x) FROM z)) * p.p / 159 AS x FROM (SELECT unnest(range(160)) AS p) p)
        SELECT {r('any_value(x)', 'x')}, {r('quantile_cont(a * x + b, 0.025)', 'low')}, {r('quantile_cont(a * x + b, 0.975)', 'high')} FROM pt, ft GROUP BY p""",
    "bucket_means": EVENTS + ", ss AS (SELECT category AS metric, season, sum(abret_d5) AS beat_sum, count(*) AS beat_n, 0.0 AS miss_sum, 0 AS miss_n FROM events WHERE abret_d5 IS NOT NULL GROUP BY ALL)" + NUMBERED + drawn(CURVE_DRAWS, "sum(beat_sum) / sum(beat_n)") + f""",
        ci AS (SELECT metric, quantile_cont(v, [0.025, 0.975]) AS q FROM drawn GROUP BY metric) SELECT ss.metric, {r('sum(beat_sum) / sum(beat_n)', 'mean')}, sum(beat_n)::BIGINT AS n, {r('any_value(CASE WHEN g >= 2 THEN q[1] END)', 'ci_low')}, {r('any_value(CASE WHEN g >= 2 THEN q[2] END)', 'ci_high')}
        FROM ss JOIN ci USING (metric) JOIN (SELECT metric, count(*) AS g FROM ss GROUP BY metric) USING (metric) GROUP BY ss.metric""",
    "daily_book": EVENTS + book("next_close") + book("next_open") + f" SELECT pos AS session_pos, {BOOK_ROWS} FROM book_next_close UNION ALL SELECT pos + 100000, {BOOK_ROWS} FROM book_next_open",
    "trade_log": EVENTS + book("next_open") + trades("next_open") + f" SELECT ticker, category, side::BIGINT AS side, entry_pos, exit_pos, entry_date, exit_date, {r('entry_price')}, {r('exit_price')}, {r('gross_ret_pct')}, {r('net_ret_pct')} FROM log_next_open",
    "equity_drawdown": EVENTS + book("next_close") + CURVE + f" SELECT pos AS session_pos, {r('equity', places=4)}, {r('peak', places=4)}, {r('drawdown', places=4)} FROM fall",
    "book_metrics": _metrics(),
    "inference_tests": _inference(),
    "calendar_time_alpha": EVENTS + CT + _alpha("spread_ret", False) + _alpha("long_ret", True) + _alpha("short_ret", True) + " SELECT * FROM al_spread_ret UNION ALL SELECT * FROM al_long_ret UNION ALL SELECT * FROM al_short_ret",
    "surprise_definitions": _definitions(),
    "break_even": EVENTS + book("next_close") + book("next_open") + " " + " UNION ALL ".join(_break_even(t, side) for t in ("next_close", "next_open") for side in ("as held", "lifted")),
    "cost_pivot": EVENTS + book("next_close") + book("next_open") + f" SELECT round_trip_bps, max(net_total_return_pct) FILTER (timing = 'next_close') AS next_close, max(net_total_return_pct) FILTER (timing = 'next_open') AS next_open FROM ({_curve('next_close')} UNION ALL {_curve('next_open')}) GROUP BY round_trip_bps",
    "equity_drawn": EVENTS + book("next_close") + f""", eq AS (SELECT session, product(1 + net) OVER (ORDER BY pos) AS equity_net, product(1 + gross) OVER (ORDER BY pos) AS equity_gross, row_number() OVER (ORDER BY pos) - 1 AS i FROM net_next_close WHERE gross_ret IS NOT NULL)
        SELECT session, {r('equity_net', places=4)}, {r('equity_gross', places=4)} FROM eq WHERE i % 5 = 0""",
    "bin_intervals": EVENTS + ", b AS " + BINS("sue", "[0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]", ">=", "events") + f""",
        ss AS (SELECT bin AS metric, season, sum(abret_d0) AS beat_sum, count(*) AS beat_n, 0.0 AS miss_sum, 0 AS miss_n FROM b GROUP BY ALL){NUMBERED}{drawn(600, "sum(beat_sum) / sum(beat_n)")},
        ci AS (SELECT metric, quantile_cont(v, [0.025, 0.975]) AS q FROM drawn GROUP BY metric), g AS (SELECT metric, count(*) AS g FROM ss GROUP BY metric)
        SELECT bin::BIGINT AS bin, count(*)::BIGINT AS n, {r('median(sue)', 'median_x')}, {r('median(abret_d0)', 'median_y')}, {r('avg(abret_d0)', 'mean_y')}, {r('any_value(CASE WHEN g >= 2 THEN q[1] END)', 'ci_low')}, {r('any_value(CASE WHEN g >= 2 THEN q[2] END)', 'ci_high')}
        FROM b JOIN ci ON ci.metric = b.bin JOIN g ON g.metric = b.bin GROUP BY bin HAVING count(*) >= 20""",
    "untrimmed_means": EVENTS + f""", v AS (SELECT category, abdrift_d20 AS x FROM events WHERE abdrift_d20 IS NOT NULL), m AS (SELECT avg(x) FILTER (category = 'Beat') AS beat, avg(x) FILTER (category = 'Miss') AS miss, stddev_pop(x) AS sd FROM v)
        SELECT {r('beat', 'mean_beat')}, {r('miss', 'mean_miss')}, {r('beat - miss', 'gap')}, {r('sd', 'sd_all')} FROM m""",
    "cost_curve": EVENTS + book("next_close") + book("next_open") + " " + _curve("next_close") + " UNION ALL " + _curve("next_open"),
}
