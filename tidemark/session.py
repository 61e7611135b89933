"""Spark sessions with the settings that the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", **settings: str) -> SparkSession:
    """UTC, adaptive plans with skew joins; other settings come from the cluster or from ``settings`` (``_`` for ``.``)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the folder that the cluster shares, with its lineage cut: operators that join it many times
    then plan in no time, and a lost executor costs no rerun. In local mode without such a folder one of this machine is
    made; on a cluster that is an error."""
    sc, named = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)
