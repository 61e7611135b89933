"""A query for each operator, over the driver's tables through the adapters. Results are rounded so that engines that sum
in another order agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import decay, fundamentals, inference, panel, portfolio, temporal
from tidemark.plans import study
from tidemark.plans.adapters import BENCHMARK, Fixtures

CFG = StudyConfig(event_start_date="1997-06-01", end_date="2001-12-31", benchmark=BENCHMARK, windows=(0, 1, 5, 10, 20))
METRICS = ("abret_d0", "abret_d20", "abdrift_d5", "abdrift_d20")
DRAWS, CURVE_DRAWS, BAND_DRAWS, SEED = 10_000, 2000, 400, 20240719
MODEL = portfolio.CostModel(CFG.costs)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


_FIXTURES: dict[tuple[str, str], Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """The inputs over one folder, one for an application: grid, events and books are written once and shared by its queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIXTURES:
        for old in [k for k in _FIXTURES if k[0] != key[0]]:
            del _FIXTURES[old]
        _FIXTURES[key] = Fixtures(spark, sf_dir)
    return _FIXTURES[key]


def query(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(fixtures(spark, sf_dir)))
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Counts as long, measures to ``places`` decimals, no negative zero."""
    change = {}
    for name, kind in df.dtypes:
        if kind == "double":
            change[name] = F.round(F.col(f"`{name}`"), places) + F.lit(0.0)
        elif kind in ("int", "bigint"):
            change[name] = F.col(f"`{name}`").cast("long")
    return df.withColumns(change) if change else df


def events(fx: Fixtures) -> DataFrame:
    return fx.kept("events", lambda: panel.build_events(fx.eps, fx.announcements, fx.grid, fx.universe, CFG).panel)


def long(fx: Fixtures) -> DataFrame:
    return inference.by_metric(events(fx), METRICS)


def seasons(fx: Fixtures) -> DataFrame:
    return fx.kept("seasons", lambda: inference.season_stats(long(fx)))


def book(fx: Fixtures, timing: str = "next_close") -> DataFrame:
    return fx.kept(f"book {timing}", lambda: portfolio.daily_book(events(fx), fx.grid, CFG.hold_days, timing))


# -- sources and fundamentals


@query
def drop_empty(fx):
    holes = fx.prices.withColumn("close", F.when(~F.col("ticker").isin("Brand#3", "Brand#7"), F.col("close")))
    return panel.drop_empty(holes).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("closes"))


@query
def panel_subset(fx):
    return panel.subset(fx.prices, fx.universe.where("cik <= 5")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query
def market_symbols(fx):
    raw = F.concat(F.lit("  "), F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("."))), F.lit(" "))
    return fx.table("part").select("p_partkey", fundamentals.market_symbol(raw).alias("symbol"))


@query
def earnings_filings(fx):
    """Filings made of orders: forms and items by key."""
    o = fx.table("orders")
    form = F.when(F.col("o_orderkey") % 4 == 0, "8-K").when(F.col("o_orderkey") % 4 == 1, "8-K/A").otherwise("10-Q")
    items = F.when(F.col("o_custkey") % 3 == 0, "2.02,9.01").when(F.col("o_custkey") % 3 == 1, "5.02")
    filings = o.select((F.col("o_custkey") % 50).alias("cik"), F.concat(F.lit("a"), F.col("o_orderkey") % 5000).alias("accession"), form.alias("form"), items.alias("items"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderdate").cast("timestamp_ntz").alias("accepted_utc"))
    return fundamentals.earnings_announcements(filings).groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.min("filing_date").alias("first"), F.max("filing_date").alias("last"))


@query
def eps_tags(fx):
    tag = F.when((F.col("cik") % 4 == 0) | (F.col("days") > 200), "EarningsPerShareBasic").otherwise("EarningsPerShareDiluted")
    facts = fx.facts.withColumn("tag", tag).withColumn("start", F.when(F.month("end") != 6, F.col("start")))
    return fundamentals.pick_eps_tag(facts).groupBy("cik", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("days").alias("days"), F.sum("val").alias("val"))


@query
def factor_join(fx):
    """Factors with momentum joined from a file that lacks some days."""
    mom = fx.factors.where(F.dayofmonth("date") != 13).select("date", "mom")
    return fx.factors.drop("mom").join(mom, "date", "left")


@query
def sample_filter(fx):
    tickers = fx.universe.where("cik % 2 = 0").select("ticker")
    return fx.announcements.join(tickers, "ticker", "left_semi").where("filing_date >= date '1999-01-01'").select("ticker", "accession", "filing_date")


@query
def first_reported(fx):
    return fundamentals.first_reported(fx.facts, *fundamentals.QUARTER_DAYS).select("cik", F.col("end").alias("period_end"), "val", "filed", "days")


@query
def quarterly_derived(fx):
    return fundamentals.quarterly_eps(fx.facts).select("cik", "start", F.col("end").alias("period_end"), "val", "filed", "days", "derived")


@query
def sue_panel(fx):
    return fundamentals.standardized_unexpected_earnings(fx.eps).select("ticker", F.col("end").alias("period_end"), "seasonal_diff", "drift", "sue_sigma", "sue", "history_known_by")


@query
def sue_without_drift(fx):
    return fundamentals.standardized_unexpected_earnings(fx.eps, include_drift=False).select("ticker", F.col("end").alias("period_end"), "sue")


@query
def sue_buckets(fx):
    scored = fundamentals.standardized_unexpected_earnings(fx.eps).withColumn("category", fundamentals.categorize(F.col("sue"), 1.0, -1.0))
    return scored.groupBy(panel.season(F.col("end")).alias("season"), "category").agg(F.count(F.lit(1)).alias("n"), F.avg("sue").alias("mean_sue"))


@query
def percent_surprise(fx):
    return fx.consensus.select("ticker", "announced_date", fundamentals.percent_surprise(F.col("eps_actual"), F.col("eps_estimate")).alias("pct_surprise"), fundamentals.categorize(fundamentals.percent_surprise(F.col("eps_actual"), F.col("eps_estimate")), 5.0, -5.0).alias("bucket"))


# -- calendar, timing, as-of joins, guards


@query
def timing_mix(fx):
    return panel.timing_breakdown(fx.table("events").withColumn("timing", temporal.timing_label(F.col("ts"))))


@query
def timing_by_type(fx):
    return fx.table("events").groupBy("event_type", temporal.timing_label(F.col("ts")).alias("timing"), temporal.eastern_date(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def reaction_positions(fx):
    cal = temporal.calendar(fx.prices)
    return temporal.reaction_and_entry(fx.announcements, cal).select("ticker", "accession", "timing", "announcement_date", "reaction_pos", "entry_pos_close", "entry_pos_open")


@query
def asof_forward(fx):
    return panel.match_announcements(fx.eps, fx.announcements).select("ticker", F.col("end").alias("period_end"), "accession", F.datediff("accepted_utc", "end").alias("lag_days"))


@query
def asof_nearest(fx):
    left = fx.announcements.withColumn("announcement_date", temporal.eastern_date(F.col("accepted_utc")))
    hit = temporal.asof_nearest(left, fx.consensus, "ticker", "announcement_date", "announced_date", ["announced_date", "eps_estimate"], 2, ["ticker", "accession"], ["announced_date", "eps_estimate"])
    return hit.select("ticker", "accession", "announced_date", "eps_estimate")


@query
def plausibility(fx):
    """Earnings are scaled so that some exceed a quarter of the price."""
    return panel.plausible_eps(fx.eps.withColumn("val", F.col("val") * 12), fx.grid).select("ticker", F.col("end").alias("period_end"), "period_price", "plausible")


@query
def point_in_time_guard(fx):
    scored = fundamentals.standardized_unexpected_earnings(fx.eps)
    matched = panel.match_announcements(scored, fx.announcements)
    return matched.select("ticker", "accession", "history_known_by", panel.point_in_time(F.col("history_known_by"), F.col("accepted_utc")).alias("known_before"))


@query
def membership(fx):
    universe = fx.universe.where("cik <> 7")
    return panel.with_membership(fx.announcements, universe, "filing_date").select("ticker", "accession", "member")


@query
def members_on(fx):
    return panel.members_on(fx.universe, "1996-06-01")


@query
def lookahead_violations(fx):
    """Entries as built have none; entries a session early, planted here, have some."""
    cal = temporal.calendar(fx.prices)
    placed = temporal.reaction_and_entry(fx.announcements, cal)
    at = lambda c, shift: placed.withColumn("session_pos", F.col(c) - shift).join(F.broadcast(cal), "session_pos")
    parts = [("close", at("entry_pos_close", 0), "next_close"), ("open", at("entry_pos_open", 0), "next_open"), ("open_early", at("entry_pos_open", 1), "next_open"), ("close_early", at("entry_pos_close", 1), "next_close")]
    out = None
    for name, rows, timing in parts:
        n = temporal.lookahead_violations(rows, "accepted_utc", "session", timing).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fill"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# -- the event panel


@query
def audit(fx):
    return panel.build_events(fx.eps, fx.announcements, fx.grid, fx.universe, CFG).audit.select("stage", "n")


@query
def event_returns(fx):
    names = [c for pre in ("ret_d", "abret_d") for c in (f"{pre}{w}" for w in CFG.windows)] + [c for pre in ("drift_d", "abdrift_d") for c in (f"{pre}{w}" for w in CFG.windows if w)]
    return events(fx).select("ticker", "accession", "reaction_date", "season", "category", "sue", "gap_ret", "open_to_close_ret", "abgap_ret", "abopen_to_close_ret", *names)


@query
def car_paths(fx):
    e = events(fx)
    paths = panel.abnormal_paths(e, fx.grid, 20, BENCHMARK)
    return paths.join(e.select("ticker", "accession", "category"), ["ticker", "accession"]).groupBy("category", "day").agg(F.count("car").alias("n"), F.avg("car").alias("mean_car"))


@query
def car_paths_from_before(fx):
    return panel.abnormal_paths(events(fx), fx.grid, 5, BENCHMARK, from_reaction_close=False)


@query
def decomposition(fx):
    return panel.decompose_reaction(events(fx), 20)


# -- inference


@query
def season_stats(fx):
    return seasons(fx)


@query
def spread_by_metric(fx):
    return inference.spreads(seasons(fx))


@query
def welch_moments(fx):
    return inference.welch(long(fx))


@query
def block_bootstrap(fx):
    return inference.block_bootstrap(seasons(fx), DRAWS, SEED)


@query
def wild_bootstrap(fx):
    return inference.wild_bootstrap(long(fx), DRAWS, SEED)


@query
def inference_tests(fx):
    """All three tests of every metric, with the season's intra-cluster correlation."""
    return inference.run_inference(events(fx), {m: study.METRICS[m] for m in METRICS}, DRAWS, SEED)


@query
def icc(fx):
    return inference.icc(long(fx))


@query
def power_inputs(fx):
    return inference.power_inputs(events(fx), "abdrift_d20")


@query
def calendar_time(fx):
    return inference.calendar_time_returns(events(fx), fx.grid, 20)


@query
def hac_moments(fx):
    """Gram sums of the regression that gives alpha."""
    m = inference.hac_moments(inference.calendar_time_returns(events(fx), fx.grid, 20), fx.factors, "spread_ret")
    x = lambda i: F.col("x")[i]
    return m.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *(F.sum(x(i) * F.col("y")).alias(f"x{i}y") for i in range(1, 5)), *(F.sum(x(i) * x(j)).alias(f"x{i}x{j}") for i in range(1, 5) for j in range(i, 5)))


@query
def calendar_time_alpha(fx):
    """Daily alphas in basis points, with Newey-West errors and betas."""
    rows = study.run_calendar_time(events(fx), fx.grid, fx.factors, 20)
    bps = lambda c: (F.col(c) * 1e4).alias(f"{c}_bps")
    return rows.select("portfolio", bps("alpha"), bps("std_error"), "t", "p_value", bps("ci_low"), bps("ci_high"), "beta_mkt_rf", "beta_smb", "beta_hml", "beta_mom", F.col("n_obs").cast("long").alias("n_obs"))


@query
def surprise_definitions(fx):
    """On however many events have both measures: small tables have fewer than the study asks for."""
    return study.compare_definitions(events(fx), fx.consensus, CFG, least=0)


@query
def rolling_spread(fx):
    own = seasons(fx).where("metric = 'abdrift_d20'")
    return decay.rolling_spread(own, 12, CURVE_DRAWS, SEED, 50)


@query
def rolling_spread_short(fx):
    """Windows that the few seasons of small tables fill."""
    own = seasons(fx).where("metric = 'abdrift_d20'")
    return decay.rolling_spread(own, 6, CURVE_DRAWS, SEED, 20)


@query
def trend(fx):
    return decay.trend(decay.rolling_spread(seasons(fx).where("metric = 'abdrift_d20'"), 6, 10, SEED, 20))


@query
def spearman(fx):
    return inference.spearman(with_consensus(fx), "sue", "pct_surprise")


def with_consensus(fx: Fixtures) -> DataFrame:
    hit = temporal.asof_nearest(events(fx), fx.consensus, "ticker", "announcement_date", "announced_date", ["eps_estimate", "eps_actual"], 2, ["ticker", "accession"], ["announced_date", "eps_estimate"])
    return hit.withColumn("pct_surprise", fundamentals.percent_surprise(F.col("eps_actual"), F.col("eps_estimate")))


@query
def bucket_agreement(fx):
    both = with_consensus(fx).where("pct_surprise is not null").withColumn("by_percent", fundamentals.categorize(F.col("pct_surprise"), 5.0, -5.0))
    return inference.agreement(both, "category", "by_percent")


@query
def quintile_matrix(fx):
    return inference.quintile_matrix(events(fx), CFG.windows)


@query
def quintile_matrix_small(fx):
    """With the least number of events that small tables reach."""
    return inference.quintile_matrix(events(fx), CFG.windows, min_n=40)


@query
def bin_medians(fx):
    return inference.bin_medians(events(fx), "sue", "abret_d0", 8, 20)


@query
def bin_intervals(fx):
    return inference.bin_intervals(events(fx), "sue", "abret_d0", 8, 20, seed=SEED)


@query
def untrimmed_means(fx):
    return inference.bucket_gap(events(fx), "abdrift_d20")


@query
def kde_grid(fx):
    return inference.kde_grid(events(fx), "abret_d20")


@query
def linear_fit(fx):
    return inference.linear_fit(events(fx), "sue", "abret_d0")


@query
def linear_fit_band(fx):
    return inference.linear_fit_band(events(fx), "sue", "abret_d0", ["ticker", "accession"], points=160, draws=BAND_DRAWS, seed=SEED)


@query
def bucket_means(fx):
    return inference.group_means(events(fx), "abret_d5", F.col("category"), CURVE_DRAWS, SEED)


# -- the book


@query
def daily_book(fx):
    return book(fx, "next_close").unionByName(book(fx, "next_open").withColumn("session_pos", F.col("session_pos") + 100_000))


@query
def trade_log(fx):
    return portfolio.trade_log(events(fx), fx.grid, 20, "next_open", MODEL)


@query
def equity_drawdown(fx):
    curve = portfolio.with_equity(book(fx), MODEL)
    return rounded(portfolio.drawdown(curve).select("session_pos", "equity", "peak", "drawdown"), 4)


@query
def book_metrics(fx):
    rf = fx.factors.select(F.col("date").alias("session"), "rf")
    return rounded(portfolio.book_metrics(book(fx), portfolio.trade_log(events(fx), fx.grid, 20, "next_close", MODEL), fx.grid, MODEL, rf, BENCHMARK), 4)


@query
def cost_curve(fx):
    close, open_ = (portfolio.cost_curve(book(fx, t), MODEL).withColumn("timing", F.lit(t)) for t in ("next_close", "next_open"))
    return rounded(close.unionByName(open_), 4)


@query
def cost_pivot(fx):
    curves = [portfolio.cost_curve(book(fx, t), MODEL).withColumn("entry_timing", F.lit(t)) for t in ("next_close", "next_open")]
    return rounded(study.pivoted_curves(curves[0].unionByName(curves[1])), 4)


@query
def break_even(fx):
    """Of both books as they are held, and with 20 basis points more a session, so that there is something to lose."""
    books = {t: book(fx, t) for t in ("next_close", "next_open")}
    lifted = {t: b.withColumn("gross_ret", F.col("gross_ret") + 0.002) for t, b in books.items()}
    return study.break_evens(books, MODEL).withColumn("legs", F.lit("as held")).unionByName(study.break_evens(lifted, MODEL).withColumn("legs", F.lit("lifted")))


@query
def equity_drawn(fx):
    return rounded(study.equity_drawn(portfolio.with_equity(book(fx), MODEL)).select("session", "equity_net", "equity_gross"), 4)
