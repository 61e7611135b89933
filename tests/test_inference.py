"""Tests of the tests: algebra against the textbook forms, planted effects, and published values."""

import math

import numpy as np
import pytest

from tidemark.functions import stats
from tidemark.operators import decay, inference


def synthetic(spark, effect, seed, seasons=24, per=30, season_sd=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(seasons):
        shift = rng.normal(0, season_sd)
        for _ in range(per):
            c = str(rng.choice(["Beat", "In-Line", "Miss"]))
            rows.append((f"{2000 + s // 4}Q{s % 4 + 1}", c, float(rng.normal(shift + effect * {"Beat": 0.5, "Miss": -0.5}.get(c, 0), 3))))
    return spark.createDataFrame(rows, "season string, category string, m double").cache()


@pytest.fixture(scope="module")
def planted(spark):
    return synthetic(spark, 2.0, 1)


def frame(df):
    return df.toPandas()


def test_planted_effect_is_found_by_all_three(spark, planted):
    got = {r.method: r for r in inference.run_inference(planted, {"m": "M"}, 300, 7).collect()}
    assert len(got) == 3 and len({round(r.estimate, 9) for r in got.values()}) == 1
    assert all(r.p_value < 0.02 for r in got.values()) and all(r.ci_low < r.estimate < r.ci_high for r in got.values())
    d = frame(planted)
    b, m = d[d.category == "Beat"].m, d[d.category == "Miss"].m
    assert got["welch_t"].estimate == pytest.approx(b.mean() - m.mean())
    assert got["welch_t"].std_error == pytest.approx(math.sqrt(b.var() / len(b) + m.var() / len(m)))
    assert got["season_block_bootstrap"].p_value >= 1 / 301


def test_null_is_kept(spark):
    got = inference.run_inference(synthetic(spark, 0.0, 2), {"m": "M"}, 300, 7).collect()
    assert all(r.p_value > 0.05 for r in got)


def test_wild_t_is_the_clustered_regression(spark, planted):
    d = frame(planted)
    d = d[d.category != "In-Line"]
    x = np.column_stack([np.ones(len(d)), d.category == "Beat"]).astype(float)
    y = d.m.to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    u = y - x @ beta
    scores = np.array([x[g].T @ u[g] for g in (np.flatnonzero(d.season == s) for s in d.season.unique())])
    g, n = len(scores), len(y)
    se = math.sqrt((inv @ (scores.T @ scores) @ inv)[1, 1] * g / (g - 1) * (n - 1) / (n - 2))
    (r,) = inference.wild_bootstrap(inference.by_metric(planted, ["m"]), 50, 1).collect()
    assert r.estimate == pytest.approx(beta[1], rel=1e-10) and r.std_error == pytest.approx(se, rel=1e-9) and r.n_clusters == g


def test_numpy_picks(spark, planted):
    seasons = inference.season_stats(inference.by_metric(planted, ["m"]))
    got = inference.block_bootstrap(seasons, 50, 3, inference.numpy_picks(seasons, 50, 3)).first()
    s = frame(seasons).sort_values("season")
    picks = np.random.default_rng(3).integers(0, len(s), size=(50, len(s)))
    k = {c: s[c].to_numpy()[picks].sum(axis=1) for c in ("beat_sum", "beat_n", "miss_sum", "miss_n")}
    draws = k["beat_sum"] / k["beat_n"] - k["miss_sum"] / k["miss_n"]
    assert got.std_error == pytest.approx(draws.std(ddof=1)) and got.ci_low == pytest.approx(np.percentile(draws, 2.5))


def test_numpy_signs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"{2000 + int(rng.integers(6))}Q1", str(rng.choice(["Beat", "Miss", "In-Line"])), float(rng.normal())) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, season string, category string, m double")
    long = inference.by_metric(df, ["m"])
    seen = inference.first_seen(df, ["m"], ["i"])
    (got,) = inference.wild_bootstrap(long, 60, 5, seen).collect()
    arms = [r for r in rows if r[2] != "In-Line"]
    order = list(dict.fromkeys(r[1] for r in arms))
    codes, y = np.array([order.index(r[1]) for r in arms]), np.array([r[3] for r in arms])
    x = np.column_stack([np.ones(len(arms)), [r[2] == "Beat" for r in arms]]).astype(float)
    inv, g, n = np.linalg.inv(x.T @ x), len(order), len(arms)

    def t(v):
        beta = inv @ x.T @ v
        s = np.array([x[codes == c].T @ (v - x @ beta)[codes == c] for c in range(g)])
        return beta[1] / math.sqrt((inv @ (s.T @ s) @ inv)[1, 1] * g / (g - 1) * (n - 1) / (n - 2))

    w = np.random.default_rng(5).choice(np.array([-1.0, 1.0]), size=(g, 60))
    drawn = np.array([t(y.mean() + (y - y.mean()) * w[codes, d]) for d in range(60)])
    assert got.statistic == pytest.approx(t(y)) and got.p_value == pytest.approx(max((abs(drawn) >= abs(t(y))).mean(), 1 / 61))


def test_seasons_without_a_leg_are_clusters(spark):
    df = spark.createDataFrame([("2000Q1", "In-Line", 1.0), ("2000Q2", "Beat", 2.0), ("2000Q2", "Miss", None)], "season string, category string, m double")
    rows = {r.season: r for r in inference.season_stats(inference.by_metric(df, ["m"])).collect()}
    assert set(rows) == {"2000Q1", "2000Q2"} and rows["2000Q1"].beat_n == 0
    assert inference.spreads(inference.season_stats(inference.by_metric(df, ["m"]))).first().spread is None


def test_icc(spark, planted):
    d = frame(planted)
    groups = [g.m.to_numpy() for _, g in d.groupby("season")]
    n, k, mean = len(d), len(groups), d.m.mean()
    msb = sum(len(g) * (g.mean() - mean) ** 2 for g in groups) / (k - 1)
    msw = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - k)
    m0 = (n - sum(len(g) ** 2 for g in groups) / n) / (k - 1)
    between = max((msb - msw) / m0, 0)
    assert inference.icc(inference.by_metric(planted, ["m"])).first().icc == pytest.approx(between / (between + msw))


def test_published_tails_and_power():
    assert stats.t_two_sided(2.7200, 6330) == pytest.approx(0.00656, abs=3e-5)
    assert stats.t_two_sided(1.0, 1) == pytest.approx(0.5) and stats.t_two_sided(2.0, 2) == pytest.approx(0.18350342)
    assert stats.normal_two_sided(2.2097) == pytest.approx(0.02713, abs=1e-5)
    assert stats.required_sample_size(0, 1) == math.inf
    assert stats.achieved_power(1.0, 0.0) is not None and math.isnan(stats.achieved_power(1.0, 0.0))
    assert stats.effective_sample_size(100, [10, 10], 0.1) == pytest.approx(100 / 1.9) and stats.effective_sample_size(0, [], 0.1) == 0
    n = stats.required_sample_size(0.7779, 9.844)
    assert stats.achieved_power(0.7779, 9.844 * math.sqrt(4 / n)) == pytest.approx(0.8, abs=1e-3)


def test_planted_alpha(spark):
    from datetime import date, timedelta

    rng = np.random.default_rng(5)
    f = rng.normal(0, 0.01, (600, 4))
    y = 0.0004 + 0.2 * f[:, 0] + rng.normal(0, 0.0005, 600)
    days = [date(2015, 1, 1) + timedelta(i) for i in range(600)]
    factors = spark.createDataFrame([(d, *map(float, r), 0.0001) for d, r in zip(days, f, strict=True)], "date date, mkt_rf double, smb double, hml double, mom double, rf double")
    returns = spark.createDataFrame([(d, float(v)) for d, v in zip(days, y, strict=True)], "session date, spread_ret double")
    got = inference.calendar_time_alpha(returns, factors, hac_lags=5)
    assert got["alpha"] == pytest.approx(0.0004, abs=8e-5) and got["beta_mkt_rf"] == pytest.approx(0.2, abs=0.02) and got["p_value"] < 1e-6
    x = np.column_stack([np.ones(600), f])
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    s = x * (y - x @ beta)[:, None]
    middle = s.T @ s + sum((1 - k / 6) * ((g := s[k:].T @ s[:-k]) + g.T) for k in range(1, 6))
    inv = np.linalg.inv(x.T @ x)
    assert got["std_error"] == pytest.approx(math.sqrt((inv @ middle @ inv)[0, 0]), rel=1e-8)
    assert inference.calendar_time_alpha(returns, factors, excess=True)["alpha"] == pytest.approx(got["alpha"] - 0.0001, abs=1e-6)


def test_quantile_bins_close_on_opposite_sides(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double")
    right = [r.bin for r in inference.quantile_bins(df, "v", 2, True).orderBy("v").collect()]
    left = [r.bin for r in inference.quantile_bins(df, "v", 2, False).orderBy("v").collect()]
    assert right == [1, 1, 1, 2, 2] and left == [1, 1, 2, 2, 2]


def test_spearman_averages_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0), (2.0, 2.0), (5.0, 9.0), (None, 1.0)], "x double, y double")
    rx, ry = np.array([1.5, 1.5, 3, 4]), np.array([1, 3, 2, 4])
    assert inference.spearman(df, "x", "y").first().rank_correlation == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_rolling_windows(spark, planted):
    seasons = inference.season_stats(inference.by_metric(planted, ["m"]))
    curve = decay.rolling_spread(seasons, 12, 40, 1, 50).orderBy("season").collect()
    assert len(curve) == 13 and curve[0].season == "2002Q4" and str(curve[0].end_date) == "2002-12-31"
    assert all(r.ci_low <= r.spread <= r.ci_high for r in curve)
    t = decay.trend(spark.createDataFrame(curve)).first()
    assert t.n_windows == 13 and t.first_spread == curve[0].spread and t.last_spread == curve[-1].spread
    assert decay.trend(spark.createDataFrame(curve[:2])).first().slope_per_decade is None
