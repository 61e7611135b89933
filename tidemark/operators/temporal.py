"""The trading calendar, positions on it, announcement timing and as-of joins.

As-of joins union both sides and take one window over the key: one shuffle on the equality key, no range join.
Calendar lookups join on the civil day, through a map that has a row for every day between the first and last
session; a century is 37,000 rows, so the map is always small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EASTERN = "America/New_York"
BEFORE_OPEN, INTRADAY, AFTER_CLOSE = "before_open", "intraday", "after_close"
OPEN_SECOND, CLOSE_SECOND = 9 * 3600 + 30 * 60, 16 * 3600
NEXT_OPEN, NEXT_CLOSE = "next_open", "next_close"


# -- calendar


def calendar(prices: DataFrame) -> DataFrame:
    """session_pos (from 0), session: the distinct sessions of a price panel."""
    return prices.select("session").where(F.col("session").isNotNull()).distinct().withColumn("session_pos", F.row_number().over(Window.orderBy("session")) - 1)


def day_map(cal: DataFrame) -> DataFrame:
    """For each civil day from the first to the last session: forward_pos (first session on or after), backward_pos
    (last on or before), is_session."""
    ends = cal.agg(F.min("session").alias("lo"), F.max("session").alias("hi")).where("lo is not null")
    days = ends.select(F.explode(F.sequence("lo", "hi")).alias("day")).join(F.broadcast(cal), F.col("day") == F.col("session"), "left")
    known_by = lambda order: F.last("session_pos", ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return days.select(
        "day",
        known_by(F.desc("day")).alias("forward_pos"),
        known_by(F.asc("day")).alias("backward_pos"),
        F.col("session").isNotNull().alias("is_session"),
    )


def locate(df: DataFrame, day: str, cal: DataFrame) -> DataFrame:
    """Adds forward_pos (the number of sessions past the end), backward_pos (0 before the start), is_session, n_sessions."""
    span = cal.agg(F.min("session").alias("lo"), F.count(F.lit(1)).cast("int").alias("n_sessions"))
    found = df.join(F.broadcast(day_map(cal).withColumnRenamed("day", "_day")), F.col(day) == F.col("_day"), "left").join(F.broadcast(span), F.lit(True))
    early = F.col(day) < F.col("lo")
    known = F.col(day).isNotNull()
    return (
        found.withColumn("forward_pos", F.when(known, F.coalesce("forward_pos", F.when(early, 0).otherwise(F.col("n_sessions")))))
        .withColumn("backward_pos", F.when(known, F.coalesce("backward_pos", F.when(early, 0).otherwise(F.col("n_sessions") - 1))))
        .withColumn("is_session", F.coalesce("is_session", F.lit(False)))
        .drop("_day", "lo")
    )


# -- announcement timing


def eastern(utc: Column) -> Column:
    """Wall clock in New York of a UTC time, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), utc.cast("timestamp_ntz"))


def eastern_date(utc: Column) -> Column:
    return F.to_date(eastern(utc))


def timing_label(utc: Column) -> Column:
    """before_open below 09:30, intraday up to and with 16:00:00 exactly, after_close later, by New York's clock."""
    clock = eastern(utc)
    second = F.hour(clock) * 3600 + F.minute(clock) * 60 + F.extract(F.lit("SECOND"), clock)
    return F.when(utc.isNull(), None).when(second < OPEN_SECOND, BEFORE_OPEN).when(second <= CLOSE_SECOND, INTRADAY).otherwise(AFTER_CLOSE)


def reaction_and_entry(events: DataFrame, cal: DataFrame, utc: str = "accepted_utc") -> DataFrame:
    """Adds timing, announcement_date, reaction_pos, entry_pos_close, entry_pos_open, n_sessions.

    A release after the close of a session reacts in the next one; one on another day, whatever its clock, in the first
    session that follows. At the open only a release outside the session can be traded in the reaction session."""
    timed = events.withColumn("timing", timing_label(F.col(utc))).withColumn("announcement_date", eastern_date(F.col(utc)))
    at = locate(timed, "announcement_date", cal)
    reaction = F.col("forward_pos") + (F.col("is_session") & (F.col("timing") == AFTER_CLOSE)).cast("int")
    return (
        at.withColumn("reaction_pos", reaction).withColumn("entry_pos_close", F.col("reaction_pos"))
        .withColumn("entry_pos_open", F.col("reaction_pos") + (F.col("timing") == INTRADAY).cast("int"))
        .drop("forward_pos", "backward_pos", "is_session")
    )


def entry_column(entry_timing: str) -> str:
    columns = {NEXT_OPEN: "entry_pos_open", NEXT_CLOSE: "entry_pos_close"}
    if entry_timing not in columns:
        raise ValueError(f"unknown entry_timing: {entry_timing!r}")
    return columns[entry_timing]


def fill_time(session: Column, entry_timing: str) -> Column:
    """UTC instant at which an order of a session fills: 09:30 or 16:00 in New York, summer or winter."""
    entry_column(entry_timing)
    seconds = OPEN_SECOND if entry_timing == NEXT_OPEN else CLOSE_SECOND
    local = session.cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(seconds))
    return F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), local)


def lookahead_violations(fills: DataFrame, utc: str, session: str, entry_timing: str) -> DataFrame:
    """Rows whose fill is at or before the announcement."""
    return fills.withColumn("fill_utc", fill_time(F.col(session), entry_timing)).where(F.col("fill_utc") <= F.col(utc).cast("timestamp_ntz"))


def assert_no_lookahead(fills: DataFrame, utc: str, session: str, entry_timing: str) -> None:
    bad = lookahead_violations(fills, utc, session, entry_timing).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col("fill_utc"), F.col(utc).alias("announced")), F.struct(utc, "fill_utc")).alias("first")).first()
    if bad["n"]:
        raise AssertionError(f"{bad['n']} fills look ahead; the earliest announcement among them, {bad['first']['announced']}, was filled at {bad['first']['fill_utc']}")


# -- as-of joins


def asof_forward(left: DataFrame, right: DataFrame, by: str, left_key: str, right_key: str, take: Sequence[str], tolerance_days: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the first row of ``right`` at or after its key, null if there is
    none within the tolerance (inclusive). Of rows with one key the first by ``tiebreak``. Keys are dates.

    The window goes backward in time, so what is ahead of a row has been seen: a running value, one step a row."""
    payload = F.struct(F.col(right_key).alias("_key"), *(F.col(c).alias(c) for c in take))
    rights = right.where(F.col(right_key).isNotNull()).select(F.col(by).alias("_by"), F.col(right_key).alias("_at"), F.lit(1).alias("_kind"), F.struct(*(F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak or [right_key]))).alias("_tie"), payload.alias("_hit"))
    lefts = left.select(F.col(by).alias("_by"), F.col(left_key).alias("_at"), F.lit(0).alias("_kind"), F.struct(*(F.col(c) for c in left.columns)).alias("_row"))
    ahead = Window.partitionBy("_by").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_next", F.last("_hit", ignorenulls=True).over(ahead)).where("_kind = 0")
    near = F.datediff("_next._key", "_at") <= tolerance_days
    return joined.select("_row.*", *(F.when(near, F.col(f"_next.{c}")).alias(c) for c in take))


def asof_nearest(left: DataFrame, right: DataFrame, by: str, left_key: str, right_key: str, take: Sequence[str], tolerance_days: int, left_id: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """Every row of ``left`` with ``take`` of the row of ``right`` nearest in days, within the tolerance (inclusive).

    Of two equally near the earlier wins; of rows with one key the last by ``tiebreak`` before the left key and the
    first after it. ``left_id`` identifies a row of ``left``. The equality key is widened to the days that the
    tolerance allows, so this is an equi-join of 2 * tolerance + 1 rows a left row, not a range join."""
    days = F.explode(F.sequence(F.lit(-tolerance_days), F.lit(tolerance_days)))
    wide = left.withColumn("_d", days).withColumn("_at", F.date_add(left_key, F.col("_d")))
    rank_first = F.row_number().over(Window.partitionBy(by, right_key).orderBy(*(F.col(c) for c in tiebreak or [right_key])))
    rank_last = F.row_number().over(Window.partitionBy(by, right_key).orderBy(*(F.col(c).desc() for c in tiebreak or [right_key])))
    rights = right.select(F.col(by).alias("_by"), F.col(right_key).alias("_rk"), rank_first.alias("_first"), rank_last.alias("_last"), F.struct(*(F.col(c) for c in take)).alias("_hit"))
    hit = wide.join(rights, (F.col(by) == F.col("_by")) & (F.col("_at") == F.col("_rk")) & (F.when(F.col("_d") > 0, F.col("_first")).otherwise(F.col("_last")) == 1))
    best = hit.groupBy(*left_id).agg(F.min_by("_hit", F.struct(F.abs("_d"), "_d")).alias("_hit"))
    return left.join(best, list(left_id), "left").select(*(F.col(c) for c in left.columns), *(F.col(f"_hit.{c}").alias(c) for c in take))
