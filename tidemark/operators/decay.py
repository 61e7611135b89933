"""How the spread changes over time: rolling windows of seasons, and the trend of their curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import inference


def season_end(label: Column) -> Column:
    year, quarter = F.substring(label, 1, 4).cast("int"), F.substring(label, 6, 1).cast("int")
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def rolling_spread(seasons: DataFrame, width: int = 12, draws: int = 2000, seed: int = 0, min_events: int = 50) -> DataFrame:
    """season, end_date, spread, ci_low, ci_high (5 and 95 %), n_events, n_beat, n_miss: windows of ``width`` seasons that
    exist, one ending at each; those with too few events are left out. ``seasons``: one metric's sums."""
    own = seasons.select("season", "beat_sum", "beat_n", "miss_sum", "miss_n").withColumn("i", F.row_number().over(Window.orderBy("season")))
    ends = own.select(F.col("i").alias("end_i"), F.col("season").alias("metric")).where(F.col("i") >= width)
    inside = ends.withColumn("i", F.explode(F.sequence(F.col("end_i") - width + 1, F.col("end_i")))).join(F.broadcast(own), "i")
    kept = inside.groupBy("metric").agg(inference._spread().alias("spread"), F.sum("beat_n").alias("n_beat"), F.sum("miss_n").alias("n_miss")).where(F.col("n_beat") + F.col("n_miss") >= min_events)
    windows = inside.join(F.broadcast(kept.select("metric")), "metric", "left_semi")
    drawn = inference.drawn_spreads(windows, inference.md5_picks(windows, draws, seed)).where(F.col("drawn").isNotNull())
    band = drawn.groupBy("metric").agg(F.percentile("drawn", F.array(F.lit(0.05), F.lit(0.95))).alias("ci"))
    out = kept.join(F.broadcast(band), "metric", "left")
    return out.select(F.col("metric").alias("season"), season_end(F.col("metric")).alias("end_date"), "spread", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), (F.col("n_beat") + F.col("n_miss")).alias("n_events"), "n_beat", "n_miss")


def trend(curve: DataFrame) -> DataFrame:
    """n_windows, slope_per_decade, first_spread, last_spread; a null slope below three windows."""
    start = curve.agg(F.min("end_date").alias("start"))
    years = curve.where(F.col("spread").isNotNull()).join(F.broadcast(start)).withColumn("years", F.datediff("end_date", "start") / 365.25)
    return years.agg(F.count(F.lit(1)).alias("n_windows"), F.when(F.count(F.lit(1)) >= 3, F.regr_slope("spread", "years") * 10).alias("slope_per_decade"), F.min_by("spread", "end_date").alias("first_spread"), F.max_by("spread", "end_date").alias("last_spread"))
