"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of repeated rows up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_REPEATS = 200_000


#: Bytes of rows that go to a Python worker together, and so of the buffers that the JVM and the worker hold for them.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. In local mode, where driver and
    executors are one, a folder of this machine will do; on a cluster a session without that setting is an error."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and end its lineage in the shared folder, so that a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    """A name in the application's own folder in the shared one; the folder goes when the application ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/tidemark-{sc.applicationId}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Like :func:`cut`, but as a Parquet table: columns that a later step does not use are not read."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, which goes to Python with its texts: from now on the session sends at most BATCH_BYTES of rows together (a longer
    row goes alone). Plans read the setting when they run, which for a lazy result is after its operator has returned, so it stays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (computed before) marked for broadcast if it has at most ``rows`` rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def occurrences(rows: DataFrame, keys: Sequence[str], name: str = "nth") -> DataFrame:
    """``rows``, computed once, with ``name``: from 0, which of the rows equal in ``keys`` a row is.

    Repeats are counted by partition and numbered on from the partitions before, so however often a row repeats, no task
    gets more of them than one partition holds."""
    rows = cut(rows.withColumn("_key", F.xxhash64(*keys)).withColumn("_part", F.spark_partition_id()))
    repeated = cut(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"))
    parts = rows.join(small(repeated, BROADCAST_REPEATS), "_key").groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")
    parts = small(cut(parts.select("_key", "_part", before.alias("_before"))), BROADCAST_REPEATS)
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*keys)) - 1
    alone = rows.join(parts, ["_key", "_part"], "left_anti").withColumn(name, F.lit(0).cast("long"))
    return alone.unionByName(rows.join(parts, ["_key", "_part"]).withColumn(name, nth).drop("_before")).drop("_key", "_part")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of nothing for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def input_splits(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())
