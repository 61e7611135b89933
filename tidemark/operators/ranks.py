"""Running sums and ranks over the whole of a table, without one task that holds it.

Rows are ranged by the order, each range is summed, and a row's sum is that of its range so far plus those of the ranges
before: one row a partition, which is all that meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpointed


def with_sum_before(df: DataFrame, order: Sequence[str], amount: str | None, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` (rows, if None) over all rows before in ascending order, nulls first.
    Rows equal in ``order`` come in any order, so it has to tell rows apart where that matters."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn("_amount", F.lit(1).cast("long") if amount is None else F.col(amount)))
    ends = ranged.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    ends = ends.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(F.broadcast(ends), "_range").withColumn(name, F.col("_before") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return summed.drop("_range", "_amount", "_before")


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of ``column`` with ``name``: their rank from 1, for ties the mean of the ranks they take."""
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("_ties"))
    return with_sum_before(values, [column], "_ties", "_less").select(column, (F.col("_less") + (F.col("_ties") + 1) / 2.0).alias(name))
