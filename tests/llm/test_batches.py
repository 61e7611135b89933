"""Rows go to Python workers in batches of bounded bytes, whatever the length of their texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, nearcopies, packing, quality

LONG = 40_000


@pytest.fixture
def seen(spark, monkeypatch, tmp_path):
    """Sizes of the batches whose texts ``statistics`` gets, as executors note them."""
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    whole = quality.statistics

    def noted(texts: pa.Array):
        (tmp_path / f"{id(texts)}-{len(texts)}-{texts.offset}").write_text(str(texts.nbytes))
        return whole(texts)

    monkeypatch.setattr(quality, "statistics", noted)
    yield lambda: [int(p.read_text()) for p in tmp_path.iterdir()]
    spark.conf.set(name, before)


def test_scores_come_from_batches_of_bounded_bytes(spark, seen):
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('ab cd. ', {LONG // 7})").alias("text"))
    model = quality.Discriminant.fit({c: (9.0, quality.np.full(17, c), quality.np.eye(17) * 9 + 9 * c) for c in (0, 1)})
    assert quality.with_score(docs, model, "s").agg(F.count("s")).first()[0] == 400
    assert seen() and max(seen()) <= common.BATCH_BYTES + 2 * LONG


@pytest.mark.parametrize("operator", [lambda d: packing.tokenized(d), lambda d: nearcopies.near_copies(d), lambda d: quality.with_score(d, None, "s")])
def test_operators_on_texts_bound_the_batch(spark, operator):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(name, "64m")
    operator(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert spark.conf.get(name) == str(common.BATCH_BYTES)
    spark.conf.set(name, before)
