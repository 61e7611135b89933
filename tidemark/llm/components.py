"""Connected components of a graph whose links live in a DataFrame: smallest labels spread, then jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """links: a, b (same orderable type). Returns node, root: the smallest node that can be reached.

    Only nodes with a link appear. Each round takes the smallest label among neighbours (a partial minimum before the
    shuffle, so a node with very many links costs no more than others) and then follows labels once, which doubles
    the reach; rounds end when nothing changes. Every round is checkpointed; nothing is collected but a count."""
    links = links.filter(F.col("a") != F.col("b"))
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        moved = cut(lower.join(jump, "root").select("node", "was", F.least("root", "over").alias("root")))
        labels = moved.select("node", "root")
        if not moved.filter(F.col("was") != F.col("root")).limit(1).count():
            return labels
