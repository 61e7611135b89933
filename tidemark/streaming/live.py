"""Announcements as a stream: timing and reaction sessions as filings arrive, against a calendar that does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import temporal


def placed(stream: DataFrame, cal: DataFrame, lateness: str = "2 days") -> DataFrame:
    """A stream of announcements (ticker, accession, accepted_utc) with timing and positions, each accession once within
    the watermark. Stateless but for the accessions that the watermark keeps."""
    once = stream.withColumn("accepted_utc", F.col("accepted_utc").cast("timestamp")).withWatermark("accepted_utc", lateness).dropDuplicatesWithinWatermark(["ticker", "accession"])
    return temporal.reaction_and_entry(once, cal)


def timing_counts(stream: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Announcements by UTC day and timing label; a day is final once the watermark has passed it."""
    timed = stream.withColumn("accepted_utc", F.col("accepted_utc").cast("timestamp")).withWatermark("accepted_utc", lateness)
    return timed.groupBy(F.window("accepted_utc", window).alias("w"), temporal.timing_label(F.col("accepted_utc")).alias("timing")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "timing", "n")
