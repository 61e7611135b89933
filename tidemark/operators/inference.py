"""Tests of the Beat - Miss spread: Welch, season block bootstrap, wild cluster bootstrap, ICC, power, calendar time.

Every test starts from a few sums a season. Both bootstraps draw seasons, so a draw needs those sums only: draws times
seasons rows meet a broadcast table of one row a season and metric, and one aggregation by (metric, draw) ends it.
Draws come from MD5, so partitioning does not change them and another engine can repeat them; ``numpy_picks`` gives
those of numpy's generator instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import stats
from tidemark.operators import ranks
from tidemark.operators.fundamentals import BEAT, MISS
from tidemark.session import checkpointed

Z95 = 1.959963984540054
NW_Z = Z95
#: Draws that turn no sign, or all of them, give the statistic itself; rounding must not decide whether they reach it.
TIE = 1e-9


def by_metric(events: DataFrame, metrics: Sequence[str], cluster: str = "season") -> DataFrame:
    """metric, season, category, value: non-null values, long."""
    own = events.select(F.col(cluster).alias("season"), "category", *(F.col(m).cast("double").alias(m) for m in metrics))
    return own.unpivot(["season", "category"], list(metrics), "metric", "value").where(F.col("value").isNotNull())


def season_stats(long: DataFrame) -> DataFrame:
    """metric, season, beat_sum, beat_n, miss_sum, miss_n; a season without a Beat or a Miss is a cluster all the same."""
    leg = lambda c: F.when(F.col("category") == c, F.col("value"))
    total = lambda c: F.coalesce(F.sum(leg(c)), F.lit(0.0))
    return long.groupBy("metric", "season").agg(total(BEAT).alias("beat_sum"), F.count(leg(BEAT)).alias("beat_n"), total(MISS).alias("miss_sum"), F.count(leg(MISS)).alias("miss_n"))


def _spread(prefix: str = "") -> Column:
    leg = lambda k: F.try_divide(F.sum(f"{prefix}{k}_sum"), F.sum(f"{prefix}{k}_n"))
    return leg("beat") - leg("miss")


def spreads(seasons: DataFrame) -> DataFrame:
    """metric, spread: pooled over seasons; null if a leg is empty."""
    return seasons.groupBy("metric").agg(_spread().alias("spread"))


def welch(long: DataFrame) -> DataFrame:
    """One row a metric in the result schema but for the p-value's tail: adds df. Null unless both arms have two rows."""
    arm = lambda f, c: f(F.when(F.col("category") == c, F.col("value")))
    s = long.groupBy("metric").agg(
        F.count_distinct("season").alias("n_clusters"), *(f_.alias(n) for c, k in ((BEAT, "b"), (MISS, "m")) for f_, n in ((arm(F.count, c), f"n{k}"), (arm(F.avg, c), f"a{k}"), (arm(F.var_samp, c), f"v{k}")))
    )
    eb, em = F.try_divide(F.col("vb"), F.col("nb")), F.try_divide(F.col("vm"), F.col("nm"))
    both = (F.col("nb") >= 2) & (F.col("nm") >= 2)
    s = s.withColumns({"estimate": F.when(both, F.col("ab") - F.col("am")), "std_error": F.when(both, F.sqrt(eb + em))})
    s = s.withColumn("df", F.when(both, F.try_divide((eb + em) * (eb + em), F.try_divide(eb * eb, F.col("nb") - 1) + F.try_divide(em * em, F.col("nm") - 1))))
    return s.select("metric", "estimate", "std_error", F.try_divide(F.col("estimate"), F.col("std_error")).alias("statistic"), "df", (F.col("nb") + F.col("nm")).alias("n_obs"), "n_clusters", (F.col("estimate") - 1.96 * F.col("std_error")).alias("ci_low"), (F.col("estimate") + 1.96 * F.col("std_error")).alias("ci_high"))


# -- draws


def md5_int(*parts: Column) -> Column:
    """A 32-bit integer from the MD5 of the parts, joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def numbered(seasons: DataFrame) -> DataFrame:
    """Adds g (from 0 in the order of seasons) and clusters (their number), by metric."""
    own = Window.partitionBy("metric")
    return seasons.withColumn("g", F.row_number().over(own.orderBy("season")) - 1).withColumn("clusters", F.count(F.lit(1)).over(own))


def md5_picks(seasons: DataFrame, draws: int, seed: int) -> DataFrame:
    """metric, draw, g: as many seasons a draw as there are, with replacement; the same picks for all metrics of a size."""
    spark = seasons.sparkSession
    sizes = numbered(seasons).select("metric", "clusters").distinct()
    slots = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(sizes)).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("clusters") - 1).cast("int"))))
    return slots.select("metric", "draw", F.pmod(md5_int(F.lit(seed), F.col("draw"), F.col("slot")), F.col("clusters")).cast("int").alias("g"))


def numpy_picks(seasons: DataFrame, draws: int, seed: int) -> DataFrame:
    """Like :func:`md5_picks` with numpy's default generator, which starts anew for each metric."""
    spark = seasons.sparkSession
    sizes = {r["metric"]: r["clusters"] for r in numbered(seasons).select("metric", "clusters").distinct().collect()}
    rows = [(m, d, pick) for m, n in sizes.items() for d, pick in enumerate(np.random.default_rng(seed).integers(0, n, size=(draws, n)).tolist())]
    return spark.createDataFrame(rows, "metric string, draw long, pick array<int>").select("metric", "draw", F.explode("pick").alias("g"))


def drawn_spreads(seasons: DataFrame, picks: DataFrame) -> DataFrame:
    return picks.join(F.broadcast(numbered(seasons)), ["metric", "g"]).groupBy("metric", "draw").agg(_spread().alias("drawn"))


def block_bootstrap(seasons: DataFrame, draws: int = 10_000, seed: int = 0, picks: DataFrame | None = None) -> DataFrame:
    """metric, estimate, std_error, p_value, n_obs, n_clusters, ci_low, ci_high. The p-value recentres the draws on the
    estimate and is at least 1 / (draws + 1); draws with an empty leg drop out; under two seasons: nulls."""
    point = seasons.groupBy("metric").agg(_spread().alias("estimate"), F.sum(F.col("beat_n") + F.col("miss_n")).alias("n_obs"), F.count(F.lit(1)).alias("n_clusters"))
    drawn = drawn_spreads(seasons, md5_picks(seasons, draws, seed) if picks is None else picks).where(F.col("drawn").isNotNull())
    far = (F.abs(F.col("drawn") - F.col("estimate")) >= F.abs("estimate")).cast("double")
    ends = drawn.join(F.broadcast(point.select("metric", "estimate")), "metric").groupBy("metric").agg(
        F.stddev_samp("drawn").alias("std_error"), F.greatest(F.avg(far), 1.0 / (F.count(F.lit(1)) + 1)).alias("p_value"), F.percentile("drawn", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")
    )
    out = point.join(F.broadcast(ends), "metric", "left")
    enough = F.col("n_clusters") >= 2
    value = {"std_error": F.col("std_error"), "p_value": F.col("p_value"), "ci_low": F.col("ci")[0], "ci_high": F.col("ci")[1]}
    return out.select("metric", "estimate", "n_obs", "n_clusters", *(F.when(enough, v).alias(k) for k, v in value.items()))


def residual_stats(long: DataFrame) -> DataFrame:
    """metric, season, sb, nb, sm, nm: by season and arm, sums of Beat and Miss values less their grand mean, and counts."""
    arms = long.where(F.col("category").isin(BEAT, MISS))
    mean = arms.groupBy("metric").agg(F.avg("value").alias("mu"))
    left = arms.join(F.broadcast(mean), "metric").withColumn("r", F.col("value") - F.col("mu"))
    leg = lambda c: F.when(F.col("category") == c, F.col("r"))
    return left.groupBy("metric", "season").agg(F.coalesce(F.sum(leg(BEAT)), F.lit(0.0)).alias("sb"), F.count(leg(BEAT)).alias("nb"), F.coalesce(F.sum(leg(MISS)), F.lit(0.0)).alias("sm"), F.count(leg(MISS)).alias("nm"))


def _cluster_t(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys…, w, sb, nb, sm, nm by season. Adds b (slope) and t: sums by season and arm are all that the slope, and
    the clustered variance with its small-sample factor, need; both come from second moments, in one aggregation."""
    wb, wm = F.col("w") * F.col("sb"), F.col("w") * F.col("sm")
    terms = {"g": F.count(F.lit(1)), "nbt": F.sum("nb"), "nmt": F.sum("nm"), "x": F.sum(wb), "y": F.sum(wm), "xx": F.sum(wb * wb), "yy": F.sum(wm * wm), "xy": F.sum(wb * wm), "bb": F.sum(F.col("nb") * F.col("nb")), "mm": F.sum(F.col("nm") * F.col("nm")), "bm": F.sum(F.col("nb") * F.col("nm")), "xb": F.sum(wb * F.col("nb")), "ym": F.sum(wm * F.col("nm")), "xm": F.sum(wb * F.col("nm")), "yb": F.sum(wm * F.col("nb"))}
    s = rows.groupBy(*keys).agg(*(v.alias(k) for k, v in terms.items()))
    c = F.col
    s = s.withColumn("B", F.try_divide(c("x"), c("nbt"))).withColumn("M", F.try_divide(c("y"), c("nmt")))
    beat = c("xx") - 2 * c("B") * c("xb") + c("B") * c("B") * c("bb")
    miss = c("yy") - 2 * c("M") * c("ym") + c("M") * c("M") * c("mm")
    both = c("xy") - c("M") * c("xm") - c("B") * c("yb") + c("B") * c("M") * c("bm")
    n = c("nbt") + c("nmt")
    factor = F.try_divide(c("g"), c("g") - 1) * F.try_divide(n - 1, n - 2)
    v = factor * (F.try_divide(beat, c("nbt") * c("nbt")) + F.try_divide(miss, c("nmt") * c("nmt")) - 2 * F.try_divide(both, c("nbt") * c("nmt")))
    return s.withColumn("slope", c("B") - c("M")).withColumn("se", F.when(v > 0, F.sqrt(v))).select(*keys, "slope", "se", F.try_divide(c("slope"), c("se")).alias("t"), n.alias("n_obs"), c("g").alias("n_clusters"))


def md5_signs(stats_: DataFrame, draws: int, seed: int) -> DataFrame:
    """metric, g, draw, w: 1 or -1 for each season."""
    spark = stats_.sparkSession
    rows = numbered(stats_)
    return spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(rows)).withColumn("w", 1.0 - 2.0 * F.pmod(md5_int(F.lit(seed), F.col("draw"), F.col("g")), F.lit(2)))


def first_seen(events: DataFrame, metrics: Sequence[str], order: Sequence[str], cluster: str = "season") -> DataFrame:
    """metric, season, place (from 0, in the order in which Beat and Miss rows first show a season), n_obs."""
    arms = ranks.with_sum_before(events.where(F.col("category").isin(BEAT, MISS)), order, None, "_i")
    long = arms.select("_i", F.col(cluster).alias("season"), *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["_i", "season"], list(metrics), "metric", "value").where("value IS NOT NULL")
    seasons = long.groupBy("metric", "season").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("metric")
    return seasons.select("metric", "season", (F.row_number().over(own.orderBy("_first")) - 1).alias("place"), F.sum("_n").over(own).alias("n_obs"))


def numpy_signs(stats_: DataFrame, seen: DataFrame, draws: int, seed: int, cells: int = 2_000_000) -> DataFrame:
    """Like :func:`md5_signs` with numpy's default generator: seasons in the order ``seen``, draws in chunks of so many that
    rows times draws stay within ``cells``. The driver makes draws times seasons signs; it is for parity, not for scale."""
    by: dict[str, list[str]] = {}
    rows = []
    sizes = {}
    for r in seen.orderBy("metric", "place").collect():
        by.setdefault(r["metric"], []).append(r["season"])
        sizes[r["metric"]] = r["n_obs"]
    for metric, seasons in by.items():
        rng, left, parts = np.random.default_rng(seed), draws, []
        while left:
            size = min(max(1, min(draws, cells // max(sizes[metric], 1))), left)
            parts.append(rng.choice(np.array([-1.0, 1.0]), size=(len(seasons), size)))
            left -= size
        rows += [(metric, s, w.tolist()) for s, w in zip(seasons, np.concatenate(parts, axis=1), strict=True)]
    signs = stats_.sparkSession.createDataFrame(rows, "metric string, season string, signs array<double>")
    return stats_.join(signs, ["metric", "season"]).select(*stats_.columns, F.posexplode("signs").alias("draw", "w"))


def wild_bootstrap(long: DataFrame, draws: int = 10_000, seed: int = 0, seen: DataFrame | None = None) -> DataFrame:
    """metric, estimate, std_error, statistic, p_value, n_obs, n_clusters, ci_low, ci_high: t of the Beat dummy with errors
    clustered by season against its distribution with the null imposed and signs flipped by season. With ``seen``, from
    :func:`first_seen`, the signs are numpy's."""
    rs = residual_stats(long)
    signs = md5_signs(rs, draws, seed) if seen is None else numpy_signs(rs, seen, draws, seed)
    seen = _cluster_t(rs.withColumn("w", F.lit(1.0)), ["metric"])
    drawn = _cluster_t(signs, ["metric", "draw"]).where(F.col("t").isNotNull()).select("metric", F.col("t").alias("t_drawn"))
    p = drawn.join(F.broadcast(seen.select("metric", "t")), "metric").groupBy("metric").agg(F.greatest(F.avg((F.abs("t_drawn") >= F.abs("t") * (1 - TIE)).cast("double")), 1.0 / (F.count(F.lit(1)) + 1)).alias("p_value"))
    out = seen.join(F.broadcast(p), "metric", "left")
    return out.select("metric", F.col("slope").alias("estimate"), F.col("se").alias("std_error"), F.col("t").alias("statistic"), "p_value", "n_obs", "n_clusters", (F.col("slope") - 1.96 * F.col("se")).alias("ci_low"), (F.col("slope") + 1.96 * F.col("se")).alias("ci_high"))


def icc(long: DataFrame) -> DataFrame:
    """metric, icc: one-way analysis of variance by season; 0 with fewer than two seasons."""
    groups = long.groupBy("metric", "season").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    grand = long.groupBy("metric").agg(F.avg("value").alias("grand"))
    s = groups.join(F.broadcast(grand), "metric").groupBy("metric").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("var")).alias("ssw"))
    msb, msw = F.try_divide(F.col("ssb"), F.col("k") - 1), F.col("ssw") / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    m0 = F.try_divide(F.col("n") - F.col("n2") / F.col("n"), F.col("k") - 1)
    s = s.withColumns({"msw": msw, "between": F.greatest((msb - msw) / F.greatest(m0, F.lit(1e-9)), F.lit(0.0))})
    return s.select("metric", F.when(F.col("k") < 2, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("msw")), F.lit(0.0))).alias("icc"))


def with_t_tail(rows: DataFrame) -> DataFrame:
    """Adds p_value to Welch rows: Student's tail has no SQL function, so the few result rows get it on the driver."""
    spark = rows.sparkSession
    done = [(*r, stats.t_two_sided(r["statistic"], r["df"]) if r["statistic"] is not None and r["df"] is not None else None) for r in rows.collect()]
    return spark.createDataFrame(done, rows.schema.add("p_value", "double"))


def run_inference(events: DataFrame, metrics: dict[str, str], draws: int, seed: int) -> DataFrame:
    """metrics: column -> label. The result schema and icc_season: three tests a metric."""
    long = checkpointed(by_metric(events, list(metrics)))
    seasons = season_stats(long)
    names = ["metric", "estimate", "std_error", "statistic", "p_value", "n_obs", "n_clusters", "ci_low", "ci_high"]
    none = F.lit(None).cast("double")
    tests = (
        ("welch_t", with_t_tail(welch(long)).select(*names)), ("season_block_bootstrap", block_bootstrap(seasons, draws, seed).withColumn("statistic", none).select(*names)),
        ("wild_cluster_bootstrap_t", wild_bootstrap(long, draws, seed).select(*names)),
    )
    rows = None
    for method, t in tests:
        t = t.withColumn("method", F.lit(method))
        rows = t if rows is None else rows.unionByName(t)
    label = F.create_map(*(F.lit(x) for kv in metrics.items() for x in kv))
    order = [f.split()[0] for f in schema.TEST_RESULT.split(", ")]
    return rows.join(icc(long).withColumnRenamed("icc", "icc_season"), "metric", "left").withColumn("label", label[F.col("metric")]).select(*order, "icc_season")


def power_inputs(events: DataFrame, metric: str) -> DataFrame:
    """What the power table starts from: moments of Beat and Miss rows."""
    arms = events.where(F.col("category").isin(BEAT, MISS) & F.col(metric).isNotNull())
    one = arms.agg(F.lit(metric).alias("metric"), F.stddev_samp(metric).alias("pooled_sd_pct"), F.count(F.lit(1)).alias("n_events_observed"), F.count_distinct("season").alias("n_seasons"))
    return one.join(icc(by_metric(arms, [metric])).withColumnRenamed("icc", "icc_season"), "metric", "left")


@dataclass(frozen=True)
class Power:
    metric: str
    observed_spread_pct: float
    pooled_sd_pct: float
    n_events_observed: int
    n_seasons: int
    se_naive: float
    se_clustered: float
    icc_season: float

    def table(self) -> dict[str, float | str]:
        inflation = (self.se_clustered / self.se_naive) ** 2 if self.se_naive > 0 else math.nan
        mean_size = self.n_events_observed / self.n_seasons if self.n_seasons else math.nan
        need = lambda vif: stats.required_sample_size(self.observed_spread_pct, self.pooled_sd_pct, variance_inflation=vif)
        return {
            "metric": self.metric, "observed_spread_pct": self.observed_spread_pct, "pooled_sd_pct": self.pooled_sd_pct, "n_events_observed": self.n_events_observed, "n_seasons": self.n_seasons,
            "mean_events_per_season": mean_size, "se_naive": self.se_naive, "se_clustered": self.se_clustered, "variance_inflation": inflation, "icc_season": self.icc_season,
            "design_effect_from_icc": 1 + (mean_size - 1) * self.icc_season, "effective_sample_size": self.n_events_observed / inflation if inflation > 0 else math.nan,
            "n_for_80pct_power_independent": need(1.0), "n_for_80pct_power_clustered": need(inflation), "achieved_power_clustered": stats.achieved_power(self.observed_spread_pct, self.se_clustered),
            "achieved_power_at_100_events": stats.achieved_power(self.observed_spread_pct, self.pooled_sd_pct * math.sqrt(4 / 100 * inflation)),
        }


# -- calendar time


def calendar_time_returns(events: DataFrame, grid: DataFrame, window: int = 20) -> DataFrame:
    """session, long_ret, n_long, short_ret, n_short, spread_ret: equal weights of what was announced in the ``window``
    sessions before; a row for every session. Null returns are skipped; an empty leg counts 0 in the spread."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("session_pos"))
    daily = grid.select("ticker", "session_pos", (F.try_divide(F.col("close"), before) - 1).alias("r")).where(F.col("r").isNotNull())
    held = events.where(F.col("category").isin(BEAT, MISS)).select("ticker", "category", F.explode(F.sequence(F.col("reaction_pos") + 1, F.col("reaction_pos") + window)).alias("session_pos"))
    leg = lambda c: F.when(F.col("category") == c, F.col("r"))
    legs = held.join(daily, ["ticker", "session_pos"]).groupBy("session_pos").agg(F.avg(leg(BEAT)).alias("long_ret"), F.count(leg(BEAT)).alias("n_long"), F.avg(leg(MISS)).alias("short_ret"), F.count(leg(MISS)).alias("n_short"))
    out = grid.select("session_pos", "session").distinct().join(F.broadcast(legs), "session_pos", "left")  # at most a row a session
    spread = F.when(F.col("long_ret").isNotNull() | F.col("short_ret").isNotNull(), F.coalesce("long_ret", F.lit(0.0)) - F.coalesce("short_ret", F.lit(0.0)))
    return out.select("session", "long_ret", F.coalesce("n_long", F.lit(0)).alias("n_long"), "short_ret", F.coalesce("n_short", F.lit(0)).alias("n_short"), spread.alias("spread_ret"))


def hac_moments(portfolio: DataFrame, factors: DataFrame, column: str, factor_columns: Sequence[str] = ("mkt_rf", "smb", "hml", "mom"), excess: bool = False) -> DataFrame:
    """day, y, x (with a leading 1), in order t: sessions where nothing is null after the join with the factors."""
    joined = portfolio.select(F.col("session").alias("date"), F.col(column).alias("_y")).join(factors.select("date", *factor_columns, "rf"), "date").dropna()
    y = F.col("_y") - F.col("rf") if excess else F.col("_y")
    return joined.select("date", y.alias("y"), F.array(F.lit(1.0), *factor_columns).alias("x"), (F.row_number().over(Window.orderBy("date")) - 1).alias("t"))


def calendar_time_alpha(portfolio: DataFrame, factors: DataFrame, column: str = "spread_ret", factor_columns: Sequence[str] = ("mkt_rf", "smb", "hml", "mom"), excess: bool = False, hac_lags: int = 20) -> dict[str, float]:
    """Alpha a day and its Newey-West inference (Bartlett weights, normal tail), betas. Gram sums and lagged score products
    are aggregated by Spark; the driver solves the small system."""
    rows = hac_moments(portfolio, factors, column, factor_columns, excess)
    k = len(factor_columns) + 1
    pairs = [(i, j) for i in range(k) for j in range(k)]
    cell = lambda i: F.col("x")[i]
    got = rows.agg(F.count(F.lit(1)), *(F.sum(cell(i) * cell(j)) for i, j in pairs), *(F.sum(cell(i) * F.col("y")) for i in range(k))).first()
    n = got[0]
    if n <= k:
        return {"alpha": math.nan, "n_obs": n}
    gram, moment = np.array(got[1 : 1 + k * k]).reshape(k, k), np.array(got[1 + k * k :])
    beta = np.linalg.solve(gram, moment)
    fitted = sum((cell(i) * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    score = rows.select("t", *((cell(i) * (F.col("y") - fitted)).alias(f"s{i}") for i in range(k)))
    lagged = score.select(F.explode(F.sequence(F.lit(0), F.lit(hac_lags))).alias("lag"), "t", *(F.col(f"s{i}").alias(f"l{i}") for i in range(k))).withColumn("t", F.col("t") + F.col("lag"))
    gammas = lagged.join(score, "t").groupBy("lag").agg(*(F.sum(F.col(f"s{i}") * F.col(f"l{j}")).alias(f"g{i}_{j}") for i, j in pairs)).collect()
    middle = np.zeros((k, k))
    for r in gammas:
        g = np.array(r[1:]).reshape(k, k)
        middle += g if r["lag"] == 0 else (1 - r["lag"] / (hac_lags + 1)) * (g + g.T)
    bread = np.linalg.inv(gram)
    se = np.sqrt(np.diag(bread @ middle @ bread))
    out = {"alpha": beta[0], "std_error": se[0], "t": beta[0] / se[0], "p_value": stats.normal_two_sided(beta[0] / se[0]), "ci_low": beta[0] - NW_Z * se[0], "ci_high": beta[0] + NW_Z * se[0], "alpha_annual_pct": beta[0] * 252 * 100, "n_obs": n}
    return {k_: float(v) for k_, v in (out | {f"beta_{c}": b for c, b in zip(factor_columns, beta[1:], strict=True)}).items()}


# -- ranks and bins


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rank_correlation: Pearson's of average ranks, over rows where both are known. Values are ranked once each."""
    both = checkpointed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y")))
    ranked = both.join(ranks.average_rank(both, "x", "rx"), "x").join(ranks.average_rank(both, "y", "ry"), "y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rank_correlation"))


def quantile_bins(df: DataFrame, column: str, bins: int, right_closed: bool) -> DataFrame:
    """Adds bin (from 1), by exact quantiles; ``right_closed``: a value on an edge belongs below it, else above."""
    cuts = df.agg(F.percentile(column, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("_cuts"))
    below = (lambda x: F.col(column) > x) if right_closed else (lambda x: F.col(column) >= x)
    return df.join(F.broadcast(cuts)).withColumn("bin", F.when(F.col(column).isNotNull(), F.size(F.filter("_cuts", below)) + 1)).drop("_cuts")


def quintile_matrix(panel: DataFrame, windows: Sequence[int], score: str = "sue", min_n: int = 100) -> DataFrame:
    """quintile, horizon, n, mean_abret: mean abnormal return by quintile of the score; null for cells under ``min_n``."""
    binned = quantile_bins(panel.where(F.col(score).isNotNull()), score, 5, right_closed=True)
    long = binned.select(F.concat(F.lit("Q"), F.col("bin")).alias("quintile"), *(F.col(f"abret_d{w}").alias(str(w)) for w in windows)).unpivot("quintile", [str(w) for w in windows], "horizon", "v")
    return long.groupBy("quintile", F.col("horizon").cast("int").alias("horizon")).agg(F.count("v").alias("n"), F.when(F.count("v") >= min_n, F.avg("v")).alias("mean_abret"))


def bin_medians(panel: DataFrame, x: str, y: str, bins: int = 20, min_n: int = 20) -> DataFrame:
    """bin, n, median_x, median_y, over equal-count bins of x; bins under ``min_n`` rows are left out."""
    both = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return quantile_bins(both, x, bins, right_closed=False).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.percentile(x, 0.5).alias("median_x"), F.percentile(y, 0.5).alias("median_y")).where(F.col("n") >= min_n)


def kde_grid(panel: DataFrame, metric: str, buckets: Sequence[str] = (BEAT, MISS), points: int = 256, trim: float = 0.005) -> DataFrame:
    """category, x, density: Gaussian kernel density at ``points`` places between the trimmed quantiles, Scott's bandwidth.

    Every row adds to every place, so the work is rows times places; a task sums them before anything is shuffled, and
    what is shuffled is a row for each bucket and place of each task."""
    usable = panel.where(F.col(metric).isNotNull()).select("category", F.col(metric).alias("v"))
    ends = usable.agg(F.percentile("v", F.array(F.lit(trim), F.lit(1 - trim))).alias("e"))
    inside = usable.where(F.col("category").isin(*buckets)).join(F.broadcast(ends)).where((F.col("v") >= F.col("e")[0]) & (F.col("v") <= F.col("e")[1]))
    width = inside.groupBy("category").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h")).where("n >= 10")
    step = (F.col("e")[1] - F.col("e")[0]) / (points - 1)
    at = inside.join(F.broadcast(width), "category").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("e")[0] + F.col("i") * step)
    u = (F.col("x") - F.col("v")) / F.col("h")
    return at.groupBy("category", "i").agg(F.first("x").alias("x"), (F.sum(F.exp(-u * u / 2)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density")).drop("i")


def linear_fit(panel: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept, r2."""
    both = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.pow(F.corr(x, y), F.lit(2.0)).alias("r2"))


#: Cumulative probabilities of the Poisson distribution with mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726562, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def linear_fit_band(panel: DataFrame, x: str, y: str, row_id: Sequence[str], points: int = 50, draws: int = 400, seed: int = 0) -> DataFrame:
    """x, low, high: 95 % band of the fitted line over event resamples.

    In a draw each event counts a Poisson number of times with mean 1, which MD5 of the draw and the event's id gives, so
    events need no numbers and no join: a task adds its events to five sums a draw, and those are all that is shuffled."""
    both = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.concat_ws("|", *row_id).alias("id"))
    drawn = both.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("u", md5_int(F.lit(seed), F.col("draw"), F.col("id")) / float(1 << 32))
    w = sum(((F.col("u") >= p).cast("int") for p in POISSON), F.lit(0))
    sums = drawn.withColumn("w", w.cast("double")).groupBy("draw").agg(*(F.sum(e).alias(n) for n, e in (("n", F.col("w")), ("sx", F.col("w") * F.col("x")), ("sy", F.col("w") * F.col("y")), ("sxx", F.col("w") * F.col("x") * F.col("x")), ("sxy", F.col("w") * F.col("x") * F.col("y")))))
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fits = sums.withColumn("a", slope).withColumn("b", F.try_divide(F.col("sy") - F.col("a") * F.col("sx"), F.col("n")))
    ends = both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = fits.join(F.broadcast(ends)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("p") / (points - 1))
    return at.groupBy("p").agg(F.first("x").alias("x"), F.percentile(F.col("a") * F.col("x") + F.col("b"), F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).select("x", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def group_means(panel: DataFrame, metric: str, group: Column, draws: int = 600, seed: int = 0) -> DataFrame:
    """metric (the group's name), mean, n, ci_low, ci_high: pooled means and percentile intervals over resampled seasons."""
    own = panel.where(F.col(metric).isNotNull()).select(group.alias("metric"), "season", F.lit(BEAT).alias("category"), F.col(metric).alias("value"))
    seasons = season_stats(own)
    mean = F.try_divide(F.sum("beat_sum"), F.sum("beat_n"))
    point = seasons.groupBy("metric").agg(mean.alias("mean"), F.sum("beat_n").alias("n"), F.count(F.lit(1)).alias("g"))
    drawn = md5_picks(seasons, draws, seed).join(F.broadcast(numbered(seasons)), ["metric", "g"]).groupBy("metric", "draw").agg(mean.alias("d"))
    ci = drawn.groupBy("metric").agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    out = point.join(F.broadcast(ci), "metric", "left")
    return out.select("metric", "mean", "n", F.when(F.col("g") >= 2, F.col("ci")[0]).alias("ci_low"), F.when(F.col("g") >= 2, F.col("ci")[1]).alias("ci_high"))


def bin_intervals(panel: DataFrame, x: str, y: str, bins: int = 20, min_n: int = 20, draws: int = 600, seed: int = 0) -> DataFrame:
    """:func:`bin_medians` with mean_y and the interval of that mean over resampled seasons; bins in few rows are left out."""
    both = quantile_bins(panel.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, bins, right_closed=False)
    means = group_means(both, y, F.col("bin"), draws, seed).select(F.col("metric").alias("bin"), F.col("mean").alias("mean_y"), "ci_low", "ci_high")
    return bin_medians(panel, x, y, bins, min_n).join(means, "bin")


def bucket_gap(panel: DataFrame, metric: str) -> DataFrame:
    """mean_beat, mean_miss, gap and sd_all (of all events, over n), of every event: nothing is trimmed."""
    mean = lambda c: F.avg(F.when(F.col("category") == c, F.col(metric)))
    return panel.where(F.col(metric).isNotNull()).agg(mean(BEAT).alias("mean_beat"), mean(MISS).alias("mean_miss"), (mean(BEAT) - mean(MISS)).alias("gap"), F.stddev_pop(metric).alias("sd_all"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col(a) == F.col(b)).cast("double")) * 100).alias("bucket_agreement_pct"))
