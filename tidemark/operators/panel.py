"""The price grid, the event panel, cumulative return paths, and the audited chain of filters that builds events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import fundamentals, temporal

MAX_YIELD = 0.25
MAX_LAG_DAYS = 100


# -- prices


def drop_empty(prices: DataFrame) -> DataFrame:
    """Without tickers that never have a close."""
    return prices.join(prices.groupBy("ticker").agg(F.count("close").alias("_n")).where("_n > 0").select("ticker"), "ticker", "left_semi")


def subset(prices: DataFrame, tickers: DataFrame) -> DataFrame:
    return prices.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def dense_grid(prices: DataFrame, fill_forward: bool = False) -> DataFrame:
    """session_pos, session, ticker, open, close with a row for every session of every ticker: on it a lag of rows is a
    lag of sessions. ``fill_forward`` carries the last known prices on."""
    cal = temporal.calendar(prices)
    cells = prices.select("ticker").distinct().join(F.broadcast(cal)).join(prices, ["session", "ticker"], "left").select("session_pos", "session", "ticker", "open", "close")
    if fill_forward:
        past = Window.partitionBy("ticker").orderBy("session_pos").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in ("open", "close")})
    return cells


def percent(now: Column, then: Column) -> Column:
    return (F.try_divide(now, then) - 1) * 100


def session_returns(grid: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Returns, in percent, of a reaction in each session: gap, open_to_close, ret_{w}, drift_{w}; one pass over the grid."""
    order = Window.partitionBy("ticker").orderBy("session_pos")
    before = F.lag("close", 1).over(order)
    out = grid.withColumn("_before", before).withColumns({f"_close{w}": F.lead("close", w).over(order) for w in windows})
    return out.select(
        "ticker", "session_pos", "session", percent(F.col("open"), F.col("_before")).alias("gap"), percent(F.col("close"), F.col("open")).alias("open_to_close"),
        *(percent(F.col(f"_close{w}"), F.col("_before")).alias(f"ret_{w}") for w in windows), *(percent(F.col(f"_close{w}"), F.col("close")).alias(f"drift_{w}") for w in windows if w > 0),
    )


def season(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def build_event_panel(events: DataFrame, grid: DataFrame, windows: Sequence[int] = (0, 1, 5, 10, 20), benchmark: str = "SPY") -> DataFrame:
    """``events`` (ticker, accepted_utc, …) with timing, positions and returns, own and in excess of the benchmark.

    Kept are events with a session before the reaction and max(windows) + 1 sessions after it, of tickers in the grid."""
    cal = grid.select("session_pos", "session").distinct()
    placed = temporal.reaction_and_entry(events, cal).where((F.col("reaction_pos") >= 1) & (F.col("reaction_pos") + max(windows) + 1 < F.col("n_sessions")))
    own = session_returns(grid, windows)
    legs = [c for c in own.columns if c not in ("ticker", "session_pos", "session")]
    bench = own.where(F.col("ticker") == benchmark).select(F.col("session_pos").alias("reaction_pos"), *(F.col(c).alias(f"_b_{c}") for c in legs))
    joined = placed.join(own.withColumnRenamed("session_pos", "reaction_pos").withColumnRenamed("session", "reaction_date"), ["ticker", "reaction_pos"]).join(F.broadcast(bench), "reaction_pos", "left")  # a row a session
    name = {"gap": "gap_ret", "open_to_close": "open_to_close_ret"} | {c: c.replace("_", "_d") for c in legs if c[0] in "rd"}
    ab = {"gap": "abgap_ret", "open_to_close": "abopen_to_close_ret"} | {c: "ab" + c.replace("_", "_d") for c in legs if c[0] in "rd"}
    rest = [c for c in placed.columns if c != "n_sessions"]
    return joined.select(*rest, "reaction_date", *(F.col(c).alias(name[c]) for c in legs), *((F.col(c) - F.col(f"_b_{c}")).alias(ab[c]) for c in legs), season(F.col("announcement_date")).alias("season"))


def abnormal_paths(events: DataFrame, grid: DataFrame, max_days: int = 20, benchmark: str = "SPY", from_reaction_close: bool = True, event_id: Sequence[str] = ("ticker", "accession")) -> DataFrame:
    """event_id…, day, car: cumulative return over the benchmark's, in percent, from day 0 to ``max_days``; the base is
    the close of the reaction, or the one before it; null past the calendar."""
    base = F.col("reaction_pos") - (0 if from_reaction_close else 1)
    wide = events.select(*event_id, "reaction_pos", base.alias("base_pos"), *([] if "ticker" in event_id else ["ticker"])).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(max_days)))).withColumn("pos", F.col("reaction_pos") + F.col("day"))
    close = grid.select("ticker", F.col("session_pos").alias("pos"), F.col("close").alias("now"))
    start = grid.select("ticker", F.col("session_pos").alias("base_pos"), F.col("close").alias("then"))
    b_close = close.where(F.col("ticker") == benchmark).select("pos", F.col("now").alias("b_now"))
    b_start = start.where(F.col("ticker") == benchmark).select("base_pos", F.col("then").alias("b_then"))
    out = wide.join(close, ["ticker", "pos"], "left").join(start, ["ticker", "base_pos"], "left").join(F.broadcast(b_close), "pos", "left").join(F.broadcast(b_start), "base_pos", "left")
    return out.select(*event_id, "day", (percent(F.col("now"), F.col("then")) - percent(F.col("b_now"), F.col("b_then"))).alias("car"))


# -- from quarters to events


def match_announcements(eps: DataFrame, announcements: DataFrame, max_lag_days: int = MAX_LAG_DAYS) -> DataFrame:
    """Each quarter with the first filing whose UTC date is after its end, within the lag; a filing that several quarters
    claim goes to the latest of them."""
    left = eps.withColumn("_from", F.date_add("end", 1))
    right = announcements.withColumn("_day", F.to_date("accepted_utc"))
    hit = temporal.asof_forward(left, right, "ticker", "_from", "_day", ["accession", "accepted_utc"], max_lag_days, ["accepted_utc", "accession"]).where(F.col("accession").isNotNull()).drop("_from")
    latest = Window.partitionBy("ticker", "accession").orderBy(F.col("end").desc())
    return hit.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def plausible_eps(events: DataFrame, grid: DataFrame, max_yield: float = MAX_YIELD) -> DataFrame:
    """Adds period_price (last session on or before ``end``, the first session before that) and plausible: false where
    earnings exceed ``max_yield`` of it. Without a price an event passes; a price of zero passes zero earnings only."""
    cal = grid.select("session_pos", "session").distinct()
    at = temporal.locate(events, "end", cal).drop("forward_pos", "is_session", "n_sessions")
    price = grid.select("ticker", F.col("session_pos").alias("backward_pos"), F.col("close").alias("period_price"))
    out = at.join(price, ["ticker", "backward_pos"], "left").drop("backward_pos")
    ratio = F.when(F.col("period_price") == 0, F.when(F.col("val") == 0, None).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(F.abs("val"), F.col("period_price")))
    return out.withColumn("plausible", F.coalesce(~(ratio > max_yield), F.lit(True)))


def point_in_time(known_by: Column, accepted_utc: Column) -> Column:
    """The history was known strictly before the day of the announcement, in New York."""
    return F.coalesce(known_by < temporal.eastern_date(accepted_utc), F.lit(False))


def with_membership(events: DataFrame, universe: DataFrame, on: str = "announcement_date") -> DataFrame:
    """Adds member: the ticker had joined by then. Unknown tickers and undated members count as members; of several dates
    of a ticker the first counts, and no date before any."""
    joined = universe.groupBy("ticker").agg(F.when(F.count("date_added") == F.count(F.lit(1)), F.min("date_added")).alias("_added"))
    return events.join(joined, "ticker", "left").withColumn("member", F.col("_added").isNull() | (F.col("_added") <= F.col(on))).drop("_added")


def members_on(universe: DataFrame, day: str) -> DataFrame:
    return universe.where(F.col("date_added").isNull() | (F.col("date_added") <= F.lit(day).cast("date"))).select("ticker")


STAGES = ("eps_rows", "with_sue", "matched", "plausible", "sue_required", "point_in_time", "member", "in_window", "returns", "complete")


@dataclass(frozen=True)
class Events:
    """The event panel, and the audit: stage, n, in order."""

    panel: DataFrame
    audit: DataFrame


def build_events(eps: DataFrame, announcements: DataFrame, grid: DataFrame, universe: DataFrame, cfg: StudyConfig = StudyConfig()) -> Events:
    """Score, match, filter, and add returns. Every filter is a boolean column, so one aggregation counts all stages."""
    scored = fundamentals.standardized_unexpected_earnings(eps, cfg.sue_history_quarters)
    matched = plausible_eps(match_announcements(scored, announcements), grid)
    dated = with_membership(matched.withColumn("announcement_date", temporal.eastern_date(F.col("accepted_utc"))), universe)
    day = F.col("announcement_date")
    flags = {
        "_plausible": F.col("plausible"), "_sue": F.col("sue").isNotNull(), "_pit": point_in_time(F.col("history_known_by"), F.col("accepted_utc")),
        "_member": F.col("member"), "_window": day.between(F.lit(cfg.event_start_date).cast("date"), F.lit(cfg.end_date).cast("date")),
    }
    so_far, chained = F.lit(True), {}
    for name, flag in flags.items():
        so_far = so_far & flag
        chained[name] = so_far
    flagged = dated.withColumns(chained)
    candidates = flagged.where("_window").drop(*chained, "announcement_date", "plausible", "member", "period_price")
    panel = build_event_panel(candidates, grid, cfg.windows, cfg.benchmark)
    last = max(cfg.windows)
    complete = F.col(f"ret_d{last}").isNotNull() & F.col("gap_ret").isNotNull() & F.col("open_to_close_ret").isNotNull()
    events = panel.where(complete).withColumn("category", fundamentals.categorize(F.col("sue"), cfg.beat_threshold, cfg.miss_threshold)).withColumn("fiscal_quarter_end", F.col("end"))
    one = lambda *cols: [c.cast("long").alias(f"n{i}") for i, c in enumerate(cols)]
    parts = (
        scored.select(*one(F.count(F.lit(1)), F.count("sue"))), ["eps_rows", "with_sue"],
        flagged.select(*one(F.count(F.lit(1)), *(F.count_if(c) for c in chained))), ["matched", "plausible", "sue_required", "point_in_time", "member", "in_window"],
        panel.select(*one(F.count(F.lit(1)), F.count_if(complete))), ["returns", "complete"],
    )
    audit = None
    for counts, names in zip(parts[::2], parts[1::2], strict=True):
        rows = counts.select(F.explode(F.array(*(F.struct(F.lit(STAGES.index(n)).alias("place"), F.lit(n).alias("stage"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)))).alias("r")).select("r.*")
        audit = rows if audit is None else audit.unionByName(rows)
    return Events(events, audit)


def timing_breakdown(panel: DataFrame) -> DataFrame:
    counts = panel.groupBy("timing").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_pct", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def decompose_reaction(panel: DataFrame, hold_days: int = 20) -> DataFrame:
    """Mean legs of the reaction by bucket, and the row Beat - Miss (n: both)."""
    legs = {"gap": "abgap_ret", "open_to_close": "abopen_to_close_ret", "drift": f"abdrift_d{hold_days}", "total": f"abret_d{hold_days}"}
    of = panel.where(F.col("category").isin(fundamentals.BEAT, fundamentals.MISS, fundamentals.IN_LINE))
    rows = of.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(k) for k, c in legs.items()))
    sign = lambda k: F.max(F.when(F.col("category") == fundamentals.BEAT, F.col(k))) - F.max(F.when(F.col("category") == fundamentals.MISS, F.col(k)))
    spread = rows.where(F.col("category") != fundamentals.IN_LINE).agg(F.sum("n").alias("n"), *(sign(k).alias(k) for k in legs)).select(F.lit("Beat - Miss").alias("category"), "n", *legs)
    return rows.unionByName(spread)
