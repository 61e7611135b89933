"""The whole study: from inputs to every table."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import decay, fundamentals, inference, panel, portfolio, temporal
from tidemark.session import checkpointed
from tidemark.sources import readers

METRICS = {
    "abret_d0": "Day 0", "abret_d5": "Day 0-5", "abret_d20": "Day 0-20", "abdrift_d1": "Drift day 1", "abdrift_d5": "Drift 1-5", "abdrift_d10": "Drift 1-10", "abdrift_d20": "Drift 1-20",
}
LEAST_OVERLAP = 200
#: Draws of the intervals in the second figure.
BUCKET_DRAWS = 2000


@dataclass(frozen=True)
class Inputs:
    eps: DataFrame
    announcements: DataFrame
    prices: DataFrame
    universe: DataFrame
    factors: DataFrame
    consensus: DataFrame | None = None


def load_inputs(spark: SparkSession, folder: str, universe: str | None = None) -> Inputs:
    """The landed tables of a folder. Members come from its ``universe.csv`` or ``universe`` table, else from the CSV that
    ``universe`` names; consensus is there or not."""
    table = lambda name: readers.load(spark, f"{folder}/{name}", f"main.py fetch --data {folder}")
    try:
        consensus = table("consensus")
    except FileNotFoundError:
        consensus = None
    try:
        members = readers.universe(spark, f"{folder}/universe.csv")
    except AnalysisException:
        members = readers.universe(spark, universe) if universe else table("universe")
    return Inputs(table("quarterly_eps"), table("announcements"), readers.prices(spark, f"{folder}/prices"), members, table("factors"), consensus)


@dataclass
class Results:
    events: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def compare_definitions(events: DataFrame, consensus: DataFrame | None, cfg: StudyConfig, least: int = LEAST_OVERLAP) -> DataFrame | None:
    """The drift under two measures of surprise, on events that have both; None under ``least`` of them."""
    if consensus is None:
        return None
    quotes = temporal.asof_nearest(events, consensus, "ticker", "announcement_date", "announced_date", ["eps_estimate", "eps_actual"], 2, ["ticker", "accession"], ["announced_date", "eps_estimate"])
    both = checkpointed(quotes.withColumn("pct_surprise", fundamentals.percent_surprise(F.col("eps_actual"), F.col("eps_estimate"))).where("sue is not null and pct_surprise is not null"))
    n = both.count()
    if n < least:
        return None
    metric = f"abdrift_d{cfg.hold_days}"
    by = {"SUE (point-in-time)": fundamentals.categorize(F.col("sue"), cfg.beat_threshold, cfg.miss_threshold), "percent of consensus (not point-in-time)": fundamentals.categorize(F.col("pct_surprise"), cfg.pct_beat_threshold, cfg.pct_miss_threshold)}
    rows = None
    for name, bucket in by.items():
        frame = both.withColumn("category", bucket)
        long = inference.by_metric(frame, [metric])
        naive = inference.with_t_tail(inference.welch(long)).select(F.col("estimate").alias("drift_d20_spread_pp"), F.col("p_value").alias("p_naive"))
        cluster = inference.block_bootstrap(inference.season_stats(long), cfg.n_bootstrap, cfg.random_seed).select(F.col("p_value").alias("p_season_clustered"))
        counts = frame.agg(F.count_if(F.col("category") == fundamentals.BEAT).alias("n_beat"), F.count_if(F.col("category") == fundamentals.MISS).alias("n_miss"))
        row = counts.join(naive).join(cluster).select(F.lit(name).alias("definition"), "*")
        rows = row if rows is None else rows.unionByName(row)
    overlap = both.agg(F.count(F.lit(1)).alias("n_overlap_events"), F.min("announcement_date").alias("first_overlap"), F.max("announcement_date").alias("last_overlap"))
    labels = both.withColumns(dict(zip(("a", "b"), by.values(), strict=True)))
    return rows.join(overlap).join(inference.spearman(both, "sue", "pct_surprise").select("rank_correlation")).join(inference.agreement(labels, "a", "b").select("bucket_agreement_pct"))


def power_table(events: DataFrame, tests: DataFrame, metric: str) -> DataFrame:
    """One row: what the sample can find, from the two standard errors and the moments."""
    got = {r["method"]: r for r in tests.where(F.col("metric") == metric).collect()}
    m = inference.power_inputs(events, metric).first()
    naive, cluster = got["welch_t"], got["season_block_bootstrap"]
    if naive["std_error"] is None or cluster["std_error"] is None:
        return events.sparkSession.createDataFrame([], "metric string, observed_spread_pct double")
    row = inference.Power(metric, naive["estimate"], m["pooled_sd_pct"], m["n_events_observed"], m["n_seasons"], naive["std_error"], cluster["std_error"], m["icc_season"]).table()
    return events.sparkSession.createDataFrame([{k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}])


ALPHAS = (("spread_ret", False), ("long_ret", True), ("short_ret", True))
_ALPHA = "portfolio string, alpha double, std_error double, t double, p_value double, ci_low double, ci_high double, alpha_annual_pct double, n_obs double, beta_mkt_rf double, beta_smb double, beta_hml double, beta_mom double"


def run_calendar_time(events: DataFrame, grid: DataFrame, factors: DataFrame, window: int) -> DataFrame:
    """Alpha of the spread and, over the bill rate, of each leg; a portfolio with too few days is left out."""
    returns = checkpointed(inference.calendar_time_returns(events, grid, window))
    rows = [inference.calendar_time_alpha(returns, factors, c, excess=e, hac_lags=window) | {"portfolio": c} for c, e in ALPHAS]
    names = [f.split()[0] for f in _ALPHA.split(", ")]
    return events.sparkSession.createDataFrame([tuple(r[n] if n == "portfolio" else float(r[n]) for n in names) for r in rows if "std_error" in r], _ALPHA)


def pivoted_curves(curves: DataFrame) -> DataFrame:
    """The cost curves side by side, a column for each entry timing."""
    return curves.groupBy("round_trip_bps").pivot("entry_timing", [temporal.NEXT_CLOSE, temporal.NEXT_OPEN]).agg(F.first("net_total_return_pct"))


def break_evens(books: dict[str, DataFrame], model: portfolio.CostModel) -> DataFrame:
    """entry_timing, break_even_round_trip_bps."""
    rows = [(timing, float(portfolio.break_even_cost_bps(portfolio.net_return_at_cost(book, model)))) for timing, book in books.items()]
    return next(iter(books.values())).sparkSession.createDataFrame(rows, "entry_timing string, break_even_round_trip_bps double")


DRAWN_EVERY = 5


def every_nth(curve: DataFrame, n: int = DRAWN_EVERY) -> DataFrame:
    """Every ``n``-th row of a curve with a row a session, from the first on."""
    return curve.withColumn("_i", F.row_number().over(Window.orderBy("session_pos")) - 1).where(F.pmod("_i", F.lit(n)) == 0).drop("_i")


def equity_drawn(daily: DataFrame) -> DataFrame:
    """session_pos, session, equity_net, equity_gross, peak, drawdown on the sessions that are drawn, of those traded."""
    traded = daily.where(F.col("net_ret").isNotNull())
    fall = portfolio.drawdown(traded).select("session_pos", "peak", "drawdown")
    return every_nth(traded.join(fall, "session_pos").select("session_pos", "session", "equity_net", "equity_gross", "peak", "drawdown"))


def benchmark_drawn(daily: DataFrame, grid: DataFrame, benchmark: str) -> DataFrame:
    """session_pos, session, growth of one held in the benchmark over the sessions traded."""
    span = daily.where(F.col("net_ret").isNotNull()).agg(F.min("session_pos").alias("_lo"), F.max("session_pos").alias("_hi"))
    own = grid.where((F.col("ticker") == benchmark) & F.col("close").isNotNull()).join(F.broadcast(span)).where(F.col("session_pos").between(F.col("_lo"), F.col("_hi")))
    first = own.agg(F.min_by("close", "session_pos").alias("_first"))
    return every_nth(own.join(F.broadcast(first)).select("session_pos", "session", (F.col("close") / F.col("_first")).alias("growth")))


def run_study(inputs: Inputs, cfg: StudyConfig = StudyConfig()) -> Results:
    """Every table of the study; they are plans until written, but for the grid, the events and the books."""
    grid = checkpointed(panel.dense_grid(panel.drop_empty(inputs.prices)))
    built = panel.build_events(inputs.eps, inputs.announcements, grid, inputs.universe, cfg)
    events = checkpointed(built.panel)
    model = portfolio.CostModel(cfg.costs)
    drift = f"abdrift_d{cfg.hold_days}"
    tests = checkpointed(inference.run_inference(events, {k: v for k, v in METRICS.items() if k in events.columns}, cfg.n_bootstrap, cfg.random_seed))
    rf = inputs.factors.select(F.col("date").alias("session"), "rf")
    out = {"sample_audit": built.audit.orderBy("place").select("stage", "n"), "announcement_timing": panel.timing_breakdown(events), "reaction_decomposition": panel.decompose_reaction(events, cfg.hold_days), "inference_tests": tests, "power_analysis": power_table(events, tests, drift)}

    out["calendar_time_alpha"] = run_calendar_time(events, grid, inputs.factors, cfg.hold_days)

    summaries, curves, books = None, None, {}
    for timing in (temporal.NEXT_CLOSE, temporal.NEXT_OPEN):
        books[timing] = book = checkpointed(portfolio.daily_book(events, grid, cfg.hold_days, timing))
        trades = portfolio.trade_log(events, grid, cfg.hold_days, timing, model)
        metrics = portfolio.book_metrics(book, trades, grid, model, rf, cfg.benchmark).withColumn("entry_timing", F.lit(timing))
        curve = portfolio.cost_curve(book, model).withColumn("entry_timing", F.lit(timing))
        summaries = metrics if summaries is None else summaries.unionByName(metrics)
        curves = curve if curves is None else curves.unionByName(curve)
        if timing == cfg.entry_timing:
            out |= {"daily": portfolio.with_equity(book, model), "trades": trades}
    out |= {"backtest_summary": summaries, "cost_curve": pivoted_curves(curves), "breakeven_cost": break_evens(books, model)}

    seasons = inference.season_stats(inference.by_metric(events, [drift]))
    rolling = checkpointed(decay.rolling_spread(seasons, draws=max(cfg.n_bootstrap // 5, 1000), seed=cfg.random_seed))
    out |= {"decay_rolling_spread": rolling, "decay_trend": decay.trend(rolling)}
    compared = compare_definitions(events, inputs.consensus, cfg)
    if compared is not None:
        out["surprise_definitions"] = compared
    return Results(events, out)


def figure_tables(results: Results, grid: DataFrame, cfg: StudyConfig = StudyConfig()) -> dict[str, DataFrame]:
    """What the nine figures show, as tables; drawing them is left to a front end."""
    events, tables = results.events, results.tables
    trimmed = events.join(F.broadcast(events.agg(F.percentile("sue", F.array(F.lit(0.01), F.lit(0.99))).alias("_e")))).where((F.col("sue") >= F.col("_e")[0]) & (F.col("sue") <= F.col("_e")[1])).drop("_e")
    paths = panel.abnormal_paths(events, grid, cfg.hold_days, cfg.benchmark).join(events.select("ticker", "accession", "category", "season"), ["ticker", "accession"])
    out = {"1_fit": inference.linear_fit(trimmed, "sue", "abret_d0"), "1_fit_band": inference.linear_fit_band(trimmed, "sue", "abret_d0", ["ticker", "accession"]), "1_bins": inference.bin_intervals(trimmed, "sue", "abret_d0")}
    out |= {f"2_bucket_d{w}": inference.group_means(events, f"abret_d{w}", F.col("category"), BUCKET_DRAWS) for w in (0, 5, 20)}
    out["3_drift_paths"] = inference.group_means(paths, "car", F.concat_ws("|", "category", F.format_string("%02d", "day")))
    drift = f"abdrift_d{cfg.hold_days}"
    out |= {"4_density": inference.kde_grid(events, drift), "4_means": inference.bucket_gap(events, drift), "5_quintiles": inference.quintile_matrix(events, cfg.windows)}
    out |= {"6_equity": equity_drawn(tables["daily"]), "6_benchmark": benchmark_drawn(tables["daily"], grid, cfg.benchmark)}
    top = tables["decay_rolling_spread"].agg(F.max_by("end_date", "spread").alias("_top"))
    out["7_decay"] = tables["decay_rolling_spread"].join(F.broadcast(top)).withColumn("is_highest", F.col("end_date") == F.col("_top")).drop("_top")
    spread = tables["reaction_decomposition"].where("category = 'Beat - Miss'").select(F.expr("stack(3, 'gap', gap, 'open_to_close', open_to_close, 'drift', drift) AS (leg, pp)"), "total")
    out["8_legs"] = spread.withColumn("share_pct", F.try_divide(F.col("pp"), F.col("total")) * 100).orderBy(F.abs("pp").desc())
    out["9_break_even"] = tables["cost_curve"].where("round_trip_bps <= 60")
    return out
