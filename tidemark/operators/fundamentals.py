"""Filings to quarterly earnings, and earnings to surprises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import require_columns

QUARTER_DAYS, YEAR_DAYS = (80, 100), (350, 380)
BEAT, MISS, IN_LINE, UNKNOWN = "Beat", "Miss", "In-Line", "Unknown"
SIGMA_FLOOR = 1e-9
GAP_DAYS = (330, 400)


def first_reported(facts: DataFrame, lo: int, hi: int, by: str = "cik") -> DataFrame:
    """Per company and period end, the fact that was filed first, of periods that last from ``lo`` to ``hi`` days."""
    first = Window.partitionBy(by, "end").orderBy("filed", "start", "val")
    return facts.where(F.col("days").between(lo, hi)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def quarterly_eps(facts: DataFrame, by: str = "cik") -> DataFrame:
    """Reported quarters, and fourth quarters derived as a year less its exactly three quarters; a reported one wins.

    Containment is an equi-join on the company with a condition on dates: a company has a few dozen rows."""
    columns = [by, "start", "end", "val", "filed", "days"]
    direct, annual = first_reported(facts, *QUARTER_DAYS, by).select(columns), first_reported(facts, *YEAR_DAYS, by).select(columns)
    d, y = direct.alias("d"), annual.alias("y")
    inside = y.join(d, (F.col(f"y.{by}") == F.col(f"d.{by}")) & (F.col("d.start") >= F.col("y.start")) & (F.col("d.end") <= F.col("y.end")))
    sums = inside.groupBy(F.col(f"y.{by}").alias(by), F.col("y.end").alias("end"), F.col("y.val").alias("year_val"), F.col("y.filed").alias("filed")).agg(F.count(F.lit(1)).alias("n"), F.sum("d.val").alias("quarters"), F.max("d.end").alias("last_end"))
    fourth = sums.where("n = 3").select(by, F.date_add("last_end", 1).alias("start"), "end", (F.col("year_val") - F.col("quarters")).alias("val"), "filed").withColumn("days", F.datediff("end", "start"))
    both = direct.withColumn("derived", F.lit(False)).unionByName(fourth.withColumn("derived", F.lit(True)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(by, "end").orderBy("derived"))).where("_n = 1").drop("_n")


def earnings_announcements(filings: DataFrame) -> DataFrame:
    """Of filings (cik, accession, form, items, filing_date, accepted_utc) the 8-Ks with item 2.02, each accession once."""
    wanted = filings.where((F.col("form") == "8-K") & F.coalesce(F.col("items"), F.lit("")).contains("2.02"))
    once = Window.partitionBy("cik", "accession").orderBy("accepted_utc", "filing_date")
    return wanted.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("cik", "accession", "filing_date", "accepted_utc")


def pick_eps_tag(facts: DataFrame, tags: tuple[str, ...] = ("EarningsPerShareDiluted", "EarningsPerShareBasic")) -> DataFrame:
    """Facts of the first of ``tags`` for which a company has usable ones, with ``days``; never mixed in a company."""
    rank = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    usable = facts.where((rank > 0) & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("val").isNotNull()).withColumn("_rank", rank)
    best = F.min("_rank").over(Window.partitionBy("cik"))
    return usable.withColumn("_best", best).where("_rank = _best").drop("_rank", "_best").withColumn("days", F.datediff("end", "start"))


def standardized_unexpected_earnings(eps: DataFrame, history_quarters: int = 8, include_drift: bool = True, by: str = "ticker") -> DataFrame:
    """Adds seasonal_diff, drift, sue_sigma, sue, history_known_by.

    Lags count rows, not quarters; a gap shows in the days between the two ends and leaves the difference null, which
    leaves the next ``history_quarters`` scores null. Only history is used: the frame ends one row before the current."""
    require_columns(eps, (by, "end", "val", "filed"), "quarterly eps")
    order = Window.partitionBy(by).orderBy("end")
    history = order.rowsBetween(-history_quarters, -1)
    gap = F.datediff("end", F.lag("end", 4).over(order))
    out = eps.withColumn("seasonal_diff", F.when(gap.between(*GAP_DAYS), F.col("val") - F.lag("val", 4).over(order)))
    full = F.count("seasonal_diff").over(history) == history_quarters
    sigma = F.when(full, F.stddev_samp("seasonal_diff").over(history))
    out = out.withColumn("drift", F.when(full, F.avg("seasonal_diff").over(history))).withColumn("sue_sigma", F.when(sigma > SIGMA_FLOOR, sigma))
    surprise = F.col("seasonal_diff") - F.col("drift") if include_drift else F.col("seasonal_diff")
    known = F.greatest(F.lag("filed", 4).over(order), F.max("filed").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return out.withColumn("sue", surprise / F.col("sue_sigma")).withColumn("history_known_by", known)


def percent_surprise(actual: Column, estimate: Column, cap: float = 200.0, least: float = 0.01) -> Column:
    """Percent by which actual exceeds the estimate, by its size; null for estimates below ``least``."""
    raw = F.try_divide(actual - estimate, F.abs(estimate)) * 100
    return F.when(actual.isNotNull() & (F.abs(estimate) >= least), F.greatest(F.lit(-cap), F.least(F.lit(cap), raw)))


def categorize(value: Column, beat: float, miss: float) -> Column:
    """Both thresholds are strict; null is Unknown."""
    return F.when(value.isNull() | F.isnan(value), UNKNOWN).when(value > beat, BEAT).when(value < miss, MISS).otherwise(IN_LINE)


def market_symbol(symbol: Column) -> Column:
    return F.replace(F.upper(F.trim(symbol)), F.lit("."), F.lit("-"))
