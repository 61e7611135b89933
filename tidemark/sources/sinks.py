"""Sinks: Parquet and CSV tables, each with a sidecar that says where it came from."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import StudyConfig


def git_commit() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip() or "unknown"
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def write_provenance(spark: SparkSession, artifact: str, command: str, data_source: str, data_as_of: str, **extra: object) -> None:
    """``<artifact>.meta.json`` beside the artifact, keys sorted, through the file system of its path."""
    record = {"artifact": artifact.rstrip("/").rsplit("/", 1)[-1], "command": command, "git_commit": git_commit(), "generated_utc": datetime.now(UTC).isoformat(timespec="seconds"), "data_source": data_source, "data_as_of": data_as_of} | extra
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(artifact.rstrip("/") + ".meta.json")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True, indent=2, default=str).encode()))
    finally:
        out.close()


def write_parquet(df: DataFrame, path: str, command: str, data_source: str, data_as_of: str, **extra: object) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    write_provenance(df.sparkSession, path, command, data_source, data_as_of, **extra)


def write_csv(df: DataFrame, path: str, command: str, data_source: str, data_as_of: str, **extra: object) -> None:
    """For tables of a few thousand rows at most: one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    write_provenance(df.sparkSession, path, command, data_source, data_as_of, **extra)


def save_events(events: DataFrame, path: str, cfg: StudyConfig, command: str, data_source: str) -> None:
    """The event panel as Parquet; its sidecar says how many events of how many companies, from when to when, and how they
    were scored."""
    write_parquet(events, path, command, data_source, cfg.end_date)
    saved = events.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("ticker").alias("n_tickers"), F.min("announcement_date").cast("string").alias("first_event"), F.max("announcement_date").cast("string").alias("last_event")).first()
    scored = {"sue_history_quarters": cfg.sue_history_quarters, "beat_threshold_sigma": cfg.beat_threshold, "miss_threshold_sigma": cfg.miss_threshold}
    write_provenance(events.sparkSession, path, command, data_source, cfg.end_date, **saved.asDict(), **scored)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`save_events` wrote; if it is not there, the error names the command that writes it."""
    from tidemark.sources.readers import load

    return load(spark, path, "main.py study")


def write_results(tables: dict[str, DataFrame], folder: str, command: str, data_source: str, data_as_of: str) -> list[str]:
    """Every table as CSV with its sidecar, ``daily`` as Parquet; an empty ``surprise_definitions`` is left out."""
    done = []
    for name, df in tables.items():
        if name == "surprise_definitions" and df.isEmpty():
            continue
        path = f"{folder.rstrip('/')}/{name}"
        (write_parquet if name == "daily" else write_csv)(df, path, command, data_source, data_as_of)
        done.append(path)
    return done
