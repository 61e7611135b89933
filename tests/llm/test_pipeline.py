import hashlib

import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.common import read

SMALL = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_columns(spark):
    docs = read(spark, SMALL, "documents")
    first, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == first, name
        counts.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.where("piece = 0").count() == counts[-1] and counts[0] >= counts[2] > 0 and counts[0] == counts[1]
    assert corpus_pipeline.run(spark, SMALL).where("piece = 0").count() == counts[-1]


def test_clean_documents_pass_the_classifier(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    kept = corpus_pipeline.quality_classifier(spark, docs, SMALL).join(labels, "doc_id")
    share = {r.quality: r["count"] for r in kept.groupBy("quality").count().collect()}
    whole = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert share[1] >= 0.98 * whole[1] and share.get(0, 0) <= 0.1 * whole[0]


def test_no_exact_copies_after_near_dedup(spark):
    kept = corpus_pipeline.simhash_near_dedup(spark, read(spark, SMALL, "documents"), SMALL).collect()
    assert len({hashlib.md5(r.text.encode()).digest() for r in kept}) == len(kept)


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
