"""One query for each operator, over whole tables; each adds the columns that its result is to have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidemark.llm import ann, bm25, linededup, lm, mixing, packing, quality, sharding, simhash, warc
from tidemark.llm.common import new_path, read


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of the documents whose id is divisible by 50, against all documents."""
    docs = read(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter("doc_id % 50 = 0"), k=10)


def op2_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by bytes; a place for each."""
    return sharding.shard_records(read(spark, sf_dir, "documents"), shards=24)


def op3_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the vectors whose id is divisible by 20, against all vectors."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, equal payloads as revisits, and read back."""
    return warc.archived(read(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op5_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source, with the number of lines before."""
    docs = read(spark, sf_dir, "documents").withColumn("lines_before", F.size(F.split("text", "\n")))
    return linededup.drop_boilerplate(docs).select("doc_id", "source", "lines_before", "text")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled as good."""
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.score_documents(read(spark, sf_dir, "documents"), good)


def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix of all sources takes of each document."""
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bm25_search, op2_virtual_slot_shards, op3_collision_neighbours, op4_warc_roundtrip, op5_site_line_dedup, op6_simhash_groups, op7_cross_entropy_difference, op8_quality_discriminant, op9_source_mix, op10_best_two_fit)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_roundtrip": warc.ORACLE, "op5_site_line_dedup": linededup.ORACLE, "op9_source_mix": mixing.ORACLE}
