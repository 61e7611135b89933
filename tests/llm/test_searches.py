"""Search, neighbours, archives and language models against brute force."""

import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bm25, lm, warc

DOCS = "doc_id long, text string"


# -- BM25


def slow_bm25(docs, queries, k):
    docs = [(i, bm25.terms_of(t)) for i, t in docs if i is not None]
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    tf = [Counter(t) for _, t in docs]
    df = Counter(w for c in tf for w in c)
    out = []
    for q, text in queries:
        scores = []
        for (i, t), c in zip(docs, tf, strict=True):
            s = sum(m * np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, m in Counter(bm25.terms_of(text)).items() if w in c)
            if s:
                scores.append((-round(s, 9), i))
        out.append((q, [(i, -s) for s, i in sorted(scores)[:k]]))
    return out


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 4000) if x < 3000]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 120))))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, rows[0][1]), (303, rows[0][1].upper() + "!!"), (None, "w1 w2"), (304, "w1 " * 700)]
    docs = spark.createDataFrame(rows, DOCS)
    asked = [(i, t) for i, t in rows if i is not None and i % 10 == 0]
    got = bm25.search(docs, docs.where("doc_id % 10 = 0"), k=7, shard_docs=70, block_queries=11).collect()
    for q, want in slow_bm25(rows, asked, 7):
        mine = sorted((r.rank, r.doc_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        assert [i for _, i, _ in mine] == [i for i, _ in want]
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in want])


def one_shard(texts, asked):
    terms = [bm25.terms_of(t) for t in texts]
    row = bm25.shard_row(list(range(len(texts))), [len(t) for t in terms], [bm25.encoded([w for t in terms for w in t])])
    block = bm25.Block.of(enumerate(asked))
    df = Counter(w for t in terms for w in set(t))
    idf = np.array([np.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) for w in block.vocabulary.to_pylist()])
    return bm25.Shard(row, block.vocabulary, sum(map(len, terms)) / len(texts)), block, idf[block.terms] * block.times


def test_bounds_prune_documents():
    rng = np.random.default_rng(6)
    texts = [" ".join(["the"] * int(rng.integers(1, 9)) + (["rare"] if i % 500 == 3 else []) + [f"x{rng.integers(0, 4000)}"] * 3) for i in range(8000)]
    shard, block, weights = one_shard(texts, ["rare the", "the rare rare"])
    best = [(np.zeros(0), np.zeros(0, np.int64))] * 2
    shard.search(block.terms, weights, block.ptr, 5, best)
    first = shard.looked_up
    shard.search(block.terms, weights, block.ptr, 5, [(b[0], b[1] + 10**6) for b in best])  # with the thresholds of a shard before
    assert shard.looked_up - first < 0.1 * 2 * len(texts) and shard.scored < 0.02 * 4 * len(texts)


def test_long_queries_are_exact():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(1500)]
    texts = [" ".join(rng.choice(words, 700)) for _ in range(200)]
    texts += [t + " w1" for t in texts[:40]]  # scores that differ in the last places
    asked = [" ".join(words), " ".join(words * 3)]
    shard, block, weights = one_shard(texts, asked)
    best = [(np.zeros(0), np.zeros(0, np.int64))] * 2
    shard.search(block.terms, weights, block.ptr, 9, best)
    for (q, want), (score, ids) in zip(slow_bm25(list(enumerate(texts)), list(enumerate(asked)), 9), best, strict=True):
        assert ids.tolist() == [i for i, _ in want] and score.tolist() == pytest.approx([s for _, s in want])


def tongues(rng, documents):
    """Texts of three vocabularies in turn, with some words that all share."""
    share = 1 / np.arange(1, 401)
    return [" ".join(f"{'abc'[i % 3]}{w}" if w % 40 else f"all{w}" for w in rng.choice(400, 120, p=share / share.sum())) for i in range(documents)]


def rows_of(texts, size):
    terms = [bm25.terms_of(t) for t in texts]
    parts = [range(lo, min(lo + size, len(texts))) for lo in range(0, len(texts), size)]
    return [bm25.shard_row(list(p), [len(terms[i]) for i in p], [bm25.encoded([w for i in p for w in terms[i]])]) for p in parts]


def test_documents_of_other_groups_are_not_looked_up(monkeypatch):
    monkeypatch.setattr(bm25, "GROUP_DOCS", 200, raising=False)
    texts = tongues(np.random.default_rng(12), 2000)
    asked = texts[:60]
    shard, block, weights = one_shard(texts, asked)
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
    shard.search(block.terms, weights, block.ptr, 5, best)
    for (_, want), (score, ids) in zip(slow_bm25(list(enumerate(texts)), list(enumerate(asked)), 5), best, strict=True):
        assert ids.tolist() == [i for i, _ in want] and score.tolist() == pytest.approx([s for _, s in want])
    first = shard.looked_up
    shard.search(block.terms, weights, block.ptr, 5, [(b[0], b[1] + 10**6) for b in best])
    assert shard.looked_up - first < 0.5 * len(texts) * len(asked)


@pytest.mark.parametrize("group_docs", [50, 10**6])
def test_rows_are_searched_as_one_from_a_known_score_on(monkeypatch, group_docs):
    monkeypatch.setattr(bm25, "GROUP_DOCS", group_docs, raising=False)
    texts = tongues(np.random.default_rng(13), 900) + ["", "w " * 70_000 + "a1", "a1", "a1"]
    asked = [*texts[:30], "a1 a1 all0", "a1", "", "none", "b399 c399 c399"]
    _, block, weights = one_shard(texts, asked)
    idf = np.zeros(len(block.vocabulary))
    idf[block.terms] = weights / block.times
    idf = np.where(idf > 0, idf, 1)
    mean = sum(len(bm25.terms_of(t)) for t in texts) / len(texts)
    want = slow_bm25(list(enumerate(texts)), list(enumerate(asked)), 6)
    shard = bm25.Shard(rows_of(texts, 250), block.vocabulary, mean, idf)
    floor = np.array([w[5][1] * (1 - 1e-12) if len(w) == 6 else 0.0 for _, w in want])
    for bar in (None, floor, floor * 0.7):
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
        before = shard.scored
        shard.search(block.terms, weights, block.ptr, 6, best, bar)
        for (_, w), (score, ids) in zip(want, best, strict=True):
            assert ids.tolist() == [i for i, _ in w] and score.tolist() == pytest.approx([s for _, s in w])
        assert bar is not floor or shard.scored - before <= sum(len(w) for _, w in want) + 10


def test_index_rows_are_taken_together_up_to_a_size():
    schema = [f.split()[0] for f in bm25.INDEX.split(", ")][:6]
    rows = rows_of(tongues(np.random.default_rng(14), 100), 10)
    batches = [bm25.pa.RecordBatch.from_arrays([bm25.pa.array([r[c].to_pylist() if c == "terms" else r[c]], bm25.pa.list_(bm25.pa.binary()) if c == "terms" else bm25.pa.binary()) for c in schema], names=schema) for r in rows]
    assert [len(x) for x in bm25.merged(iter(batches), most=35)] == [3, 3, 3, 1]
    assert [len(x) for x in bm25.merged(iter(batches), most_words=2400)] == [2] * 5 and [len(x) for x in bm25.merged(iter(batches), most=1)] == [1] * 10


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert bm25.search(none, some).count() == 0 and bm25.search(some, none).count() == 0
    assert bm25.search(some.where("doc_id = 2"), some).count() == 0
    twice = some.where("doc_id = 1").unionByName(some.where("doc_id = 1")).withColumn("score", F.lit(1)).withColumn("n", F.lit(2))
    assert [(r.query_id, r["rank"], r.doc_id) for r in bm25.search(twice, twice).collect()] == [(1, 1, 1), (1, 2, 1)] * 2


# -- neighbours


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24)) * rng.uniform(0.5, 2, (900, 1))
    x[5] = x[6] = x[7] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 24), (902, [None] + [1.0] * 23), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [1.0]), (920, [2.0]), (921, [3.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("v", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, vector_block=400).collect()
    found, total = 0, 0
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(axis=1)
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in [i for _, i, _ in mine]
        assert all(v == s[i] for _, i, v in mine)
        assert mine == sorted(mine, key=lambda r: (-r[2], r[1]))
        s[q] = -np.inf
        found += len({i for _, i, _ in mine} & set(np.lexsort((np.arange(900), -s))[:20].tolist()))
        total += 20
    assert found / total >= 0.9
    assert {r.query_id for r in got} == {*range(0, 900, 20), 920}
    assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 920) == [(1, 921, 6.0), (2, 905, 2.0)]  # of its length


def test_index_verifies_few_and_finds_most():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 48))
    index = ann.CollisionIndex(np.arange(6000), x, float(np.linalg.norm(x, axis=1).max()), 10)
    asked, hits = np.arange(0, 6000, 100), 0
    for q, (found, _) in zip(asked, index.search(x[asked], asked), strict=True):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(found.tolist()) & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(asked) and index.verified < 0.35 * len(x) * len(asked)


def test_repeated_ids_and_copies_are_candidates_each(spark):
    rows = [(i % 30, [1.0, float(i % 7)]) for i in range(300)] + [(20, [9.0, 9.0])] * 50
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=60, vector_block=64)
    assert [r.vec_id for r in got.orderBy("rank").limit(50).collect()] == [20] * 50 and got.count() == 60


def test_few_or_no_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.nearest(few.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(few.where("vec_id > 0"), F.col("vec_id") % 20 == 0).count() == 0


# -- archives


PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark, tmp_path):
    long, short = "<p>é " + "x" * 2000, "y" * 999
    rows = [(1, "http://a/\r\n1", long), (2, "http://b", long), (9, None, long), (3, "http://c", short), (4, "http://c", short), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "z" * 300_000), (8, "u", "k" * 1500), (8, "u", "k" * 1500)]
    df = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("first", F.lit(2)).repartition(3)
    got = Counter(map(tuple, warc.archived(df, str(tmp_path / "w")).collect()))
    want = Counter()
    for i, _, html in rows:
        b = (html or "").encode()
        other = html == long and i != 9
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", 9 if other else None] += 1
    assert got == want
    back = warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()
    assert Counter(bytes(r.payload) for r in back) == Counter((h or "").encode() for i, _, h in rows if not (h == long and i != 9))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(rows)


def test_reader_splits_and_false_magic(spark, tmp_path):
    """Members whose stored bytes hold the magic, cut into ranges of a few hundred bytes."""
    rng = np.random.default_rng(3)
    parts, want = [], Counter()
    for i in range(120):
        payload = b"".join([rng.bytes(int(rng.integers(0, 400))), warc.MAGIC * int(rng.integers(0, 4)), rng.bytes(int(rng.integers(0, 90)))])
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        content = warc.record("response", i, "http://x", payload, hashlib.sha1(payload).hexdigest(), None)
        parts.append(z.compress(content) + z.flush() + (warc.PADDING if i % 7 == 0 else b""))
        want[f"urn:page:{i}", payload] += 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(b"".join(parts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = warc.read_archives(spark, str(tmp_path / "f")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert Counter((r.record_id, bytes(r.payload)) for r in got) == want
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() and r.payload_bytes == len(r.payload) for r in got)


def test_damage_is_an_error_and_nothing_is_nothing(spark, tmp_path):
    good = warc.member(warc.record("response", 1, "u", b"hello", "d", None))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(good + good[:-9])
    with pytest.raises(Exception, match="damaged gzip member"):
        warc.read_archives(spark, str(tmp_path / "a")).count()
    assert warc.archived(spark.createDataFrame([], PAGES), str(tmp_path / "b")).count() == 0


# -- language models


@pytest.mark.parametrize("sizes", [{}, {"pack_words": 300, "block_words": 500, "packs_a_task": 3}])
def test_losses_against_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    words = ["the", "of", *(f"v{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 90)), p=[0.2, 0.1] + [0.7 / 60] * 60))) for i in range(150)]
    rows += [(i, "in every text " * 3 + t) for i, t in rows] + [(200, None), (201, ""), (202, "The THE the"), (3, "v1 v2"), (None, "v1 v2 v3"), (203, "once\x0b \u00e9t\u00e9 " + "w" * 9000)]
    good = [(i,) for i in range(0, 80)] + [(3,), (None,)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit(1)).withColumn("pack", F.lit(2)).withColumn("of", F.lit(3))
    got = lm.score_documents(docs, spark.createDataFrame(good, "doc_id long"), **sizes).collect()
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    vocab = {w for _, t in texts for w in t}
    targets = {i for (i,) in good if i is not None}

    def model(keep):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for i, t in texts:
            if keep(i):
                uni.update(t)
                ctx.update(t[:-1])
                bi.update(zip(t, t[1:]))
        total = sum(uni.values())

        def loss(t):
            s = 0.0
            for j, w in enumerate(t):
                p = (uni[w] + 1) / (total + len(vocab))
                if j and ctx[t[j - 1]]:
                    p = 0.7 * bi[t[j - 1], w] / ctx[t[j - 1]] + 0.3 * p
                s -= np.log(p)
            return s / len(t) if t else 0.0

        return loss

    target, background = model(lambda i: i in targets), model(lambda i: True)
    want = sorted((str(i), len(t), target(t), background(t)) for i, t in texts)
    mine = sorted((str(r.doc_id), r.n_words, r.target_loss, r.background_loss) for r in got)
    assert [w[:2] for w in want] == [m[:2] for m in mine]
    np.testing.assert_allclose([w[2:] for w in want], [m[2:] for m in mine], rtol=1e-9)
    assert all(r.score == r.target_loss - r.background_loss for r in got)


def test_lm_without_targets_or_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b a")], DOCS), spark.createDataFrame([], "doc_id long")
    one = lm.score_documents(docs, none).first()
    assert one.target_loss == pytest.approx(np.log(2))
    assert lm.score_documents(spark.createDataFrame([], DOCS), none).count() == 0
    assert lm.score_documents(spark.createDataFrame([("x", None), (None, "")], "doc_id string, text string"), none).select("doc_id", "n_words", "score").collect() == [("x", 0, 0.0), (None, 0, 0.0)]


def test_a_bigram_in_every_pack_is_sent_once_a_pack():
    docs = [b"a b " * 50, b"a b c", b"", b"a b " * 7]
    tokens = [w for d in docs for w in d.split()]
    coded = lm.pa.array(tokens, lm.pa.binary()).dictionary_encode()
    hashes = np.array([lm.xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], "<u8") >> np.uint64(16)
    lengths = np.array([len(d.split()) for d in docs])
    pack = lm.Pack(48, b"\1\0\0\1", lm.squeezed(lengths), lm.squeezed(hashes), lm.squeezed(coded.indices.to_numpy()), len(tokens), 3)
    n, ends, target_n, target_ends = pack.counts()
    assert len(pack.keys) == len(set(pack.keys.tolist())) == 3 + 3 and sorted(n.tolist()) == [1, 1, 55, 58, 58, 58]
    assert sorted(ends.tolist()) == [0, 0, 0, 0, 1, 2] and target_ends.sum() == 2 and sorted(target_n.tolist()) == [0, 0, 55, 57, 57, 57]
    block, bounds = lm.split(pack.keys, 48, 1000)
    assert len(block) == len(set(block.tolist())) <= 6 and bounds[-1] == 6


@pytest.mark.parametrize("x", [[], [0], [1] * 300, [2**63 - 1, 0, 5], [255, 256, 65535, 65536]])
def test_squeezed_numbers_come_back(x):
    assert lm.expanded(lm.squeezed(np.array(x, np.int64)), len(x)).tolist() == x
