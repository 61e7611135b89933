"""Exact BM25 top-k search: an inverted index in shards, block-max WAND pruning in each, an exact merge.

A shard is the documents of a stretch of one input partition, so building moves no text. Its postings are written as one
row of a Parquet table. Collection statistics (documents, mean length, document frequencies) are global sums, so
scores do not depend on the sharding.

Queries come in blocks of bounded size; a block is broadcast. A first part of the index gives each query a bar, which its k
best documents reach; tasks take the rest, some shards at a time, carrying the k best so far. Documents that share frequent
terms lie together; a list that is long among them keeps its largest impact in each cut. A query reads its short lists; the
block maxima of its long ones, summed cut by cut, bound what those can add (the pivot test of WAND, done for a whole shard at
once). Documents whose bound reaches the bar are looked up in the long lists, all at once where the maxima alone reach half
of it, and only one that then still reaches the bar, or the k-th best of the shard, is scored in full.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, in_batches, stored

K1, B = 1.2, 0.75
#: A shard ends at this many documents or words.
SHARD_DOCS, SHARD_WORDS = 4096, 8_000_000
#: A block of queries ends at this many queries or bytes of text.
BLOCK_QUERIES, BLOCK_BYTES = 8192, 32 << 20
#: Documents between two cuts of the lists; a list is long if it holds at least one document in LONG.
CUT, LONG = 64, 16
#: Queries that are taken through a shard together; words that are encoded together while a shard is built.
TOGETHER, ENCODED = 256, 250_000
#: Steps of the highest gain of a short list.
STEPS = 65534
#: Shards are searched together up to so many documents (at most 32,768) or words.
MERGED_DOCS, MERGED_WORDS = 12288, 12_000_000
#: Groups of a shard at most, and documents for each; a list is long in a group only from LEAST of its documents on.
GROUPS, GROUP_DOCS, LEAST = 8, 1024, 8
#: Rows of the index whose frequencies are counted together.
COUNTED = 8
#: Queries whose short lists are fetched together.
FETCHED = 16
#: Postings that are weighed together while a shard is read.
STRETCH = 1 << 18
#: Shards that one task takes, one after another, at most if there are more shards than slots for them.
SHARDS_A_TASK = 8
#: Twice the rounding unit of single precision. A sum of m positive products in it, of factors rounded to it, is off by
#: under (m + 3) units, in any order; two such sums compare to within twice that. What is listed is summed in double precision.
ROUNDING = 2.0**-23
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123)) + b" " * 32)


def terms_of(text: str | None) -> list[bytes]:
    """Terms: A-Z as a-z, ASCII punctuation and white space separate."""
    return (text or "").encode().translate(_FOLD).split()


# -- index

INDEX = "ids binary, lengths binary, terms array<binary>, df binary, docs binary, tf binary, n long, words long"


def encoded(terms: list[bytes]) -> pa.DictionaryArray:
    return pa.array(terms, pa.binary()).dictionary_encode()


def shard_row(ids: list[int], lengths: list[int], coded: list[pa.DictionaryArray]) -> dict[str, object]:
    """One shard: documents by id, terms with their lists one after another. ``coded``: all terms, in order."""
    whole = pa.chunked_array(coded, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries()
    terms = whole.chunk(0).dictionary if whole.num_chunks else pa.array([], pa.binary())
    flat = np.concatenate([c.indices.to_numpy() for c in whole.chunks] or [np.zeros(0, np.int32)]).astype(np.int64)
    lengths = np.array(lengths, "<i4")
    key, tf = np.unique(flat * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    df = np.bincount(key // len(ids), minlength=len(terms)).astype("<i4")
    return {
        "ids": np.array(ids, "<i8").tobytes(), "lengths": lengths.tobytes(), "terms": terms, "df": df.tobytes(), "docs": (key % len(ids)).astype("<u2").tobytes(),
        "tf": tf.astype("<u4" if tf.size and tf.max() > 255 else "u1").tobytes(), "n": len(ids), "words": int(lengths.sum()),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index as a table with one row a shard. Rows without an id take no part."""
    schema = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.binary())), ("df", pa.binary()), ("docs", pa.binary()), ("tf", pa.binary()), ("n", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, coded, held = [], [], [], []

        def shard() -> pa.RecordBatch:
            row = shard_row(ids, lengths, [*coded, encoded(held)])
            terms = pa.ListArray.from_arrays(pa.array([0, len(row["terms"])], pa.int32()), row["terms"])
            return pa.RecordBatch.from_arrays([terms if f.name == "terms" else pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        words = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms_of(text.as_py())
                ids.append(i)
                lengths.append(len(own))
                held += own
                words += len(own)
                if len(held) >= ENCODED:
                    coded.append(encoded(held))
                    held = []
                if len(ids) >= min(shard_docs, 1 << 15) or words >= shard_words:
                    yield shard()
                    ids, lengths, coded, held, words = [], [], [], [], 0
                    pa.default_memory_pool().release_unused()
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    return stored(in_batches(rows).mapInArrow(run, INDEX), "bm25")


# -- queries


@dataclass
class Block:
    """Queries over one vocabulary: those of query i are terms[ptr[i]:ptr[i + 1]], in ascending order, ``times`` often."""

    vocabulary: pa.Array
    ids: np.ndarray
    ptr: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, queries: Iterable[tuple[int, str | None]]) -> Block:
        """Takes the queries one by one; of a text, only the numbers of its terms are kept."""
        ids, sizes, terms, times, number = [], [], [], [], {}
        for i, text in queries:
            c = Counter(terms_of(text))
            ids.append(i)
            sizes.append(len(c))
            terms.append(np.fromiter((number.setdefault(t, len(number)) for t in c), np.int32, len(c)))
            times.append(np.fromiter(c.values(), np.int32, len(c)))
        vocabulary = sorted(number)
        rank = np.empty(len(number), np.int32)
        rank[[number[t] for t in vocabulary]] = np.arange(len(number))
        for i, (t, n) in enumerate(zip(terms, times, strict=True)):
            order = np.argsort(rank[t])
            terms[i], times[i] = rank[t[order]], n[order]
        none = [np.zeros(0, np.int32)]
        return cls(pa.array(vocabulary, pa.binary()), np.array(ids, np.int64), np.r_[0, np.cumsum(sizes, dtype=np.int64)], np.concatenate(terms or none), np.concatenate(times or none))


def blocks_of(queries: DataFrame, most: int = BLOCK_QUERIES, most_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Streams ``queries`` (id, text) to the driver, which holds one block at a time."""
    rows = queries.toLocalIterator()

    def some(first: Row) -> Iterator[tuple[int, str | None]]:
        n, size, r = 0, 0, first
        while r is not None:
            yield r["id"], r["text"]
            n, size = n + 1, size + len(r["text"] or "")
            r = next(rows, None) if n < most and size < most_bytes else None

    while (first := next(rows, None)) is not None:
        yield Block.of(some(first))


# -- search


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    at = np.repeat(start - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return at


def numbers_of(terms: list[pa.Array], vocabulary: pa.Array) -> list[np.ndarray]:
    """Each term's place in the vocabulary, or -1, of some rows at once, since each call hashes the vocabulary."""
    found = pc.fill_null(pc.index_in(pa.concat_arrays(terms), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    return np.split(found, np.cumsum([len(t) for t in terms])[:-1])


def groups_of(vectors: np.ndarray, most: int) -> np.ndarray:
    """Each document's group, of up to ``most``: that of the nearest of as many documents, which are chosen one by one from a
    few hundred so that these come nearest to them. Which group it is changes no result. ``vectors``: a column a document."""
    length = np.sqrt(np.einsum("ij,ij->j", vectors, vectors))
    some = np.flatnonzero(length)
    some = some[:: -(-len(some) // 512) or 1]
    of = vectors[:, some] / length[some]
    alike, near, chosen = of.T @ of, np.zeros(len(some), np.float32), []
    while len(chosen) < min(most, len(some)):
        chosen.append(int(np.maximum(alike - near, 0).sum(axis=1).argmax()))
        near = np.maximum(near, alike[chosen[-1]])
    return (of[:, chosen].T @ vectors).argmax(axis=0) if chosen else np.zeros(vectors.shape[1], np.int64)


class Shard:
    """What a block of queries needs of one row of the index, or of a list of rows (which it empties) as if they were one.

    Documents that share frequent terms, as those of one language do, lie together in a group of columns. A list that is long
    in a group is kept there by column, with the maxima of its cuts; all other postings are in the terms' short lists."""

    def __init__(self, rows: dict[str, object] | list[dict[str, object]], vocabulary: pa.Array, mean_length: float, idf: np.ndarray | None = None):
        rows = [rows] if isinstance(rows, dict) else rows
        self.ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
        self.damp = K1 * (1 - B + B * np.concatenate([np.frombuffer(r["lengths"], "<i4") for r in rows]) / mean_length)
        self.n = len(self.ids)
        total, owns, tf_type = np.zeros(len(vocabulary), np.int64), [], np.uint8
        for r, asked in zip(rows, numbers_of([r["terms"] for r in rows], vocabulary), strict=True):
            own = np.flatnonzero(asked >= 0)
            own = own[np.argsort(asked[own])]
            df = np.frombuffer(r["df"], "<i4").astype(np.int64)
            total[asked[own]] += df[own]
            at, n = spans((np.cumsum(df) - df)[own], df[own]), len(r["ids"]) // 8
            docs, tf = np.frombuffer(r["docs"], "<u2"), r["tf"]
            tf = np.frombuffer(tf, "u1" if len(tf) == len(docs) else "<u4")
            tf_type = max(tf_type, tf.dtype.type, key=lambda t: np.dtype(t).itemsize)
            owns.append((asked[own].astype(np.int32), df[own], docs[at], tf[at], n))
        rows.clear()
        term = np.flatnonzero(total)
        df = total[term]
        self.place = np.full(len(vocabulary), -1, np.int32)
        self.place[term] = np.arange(len(term))
        self.weight = np.zeros(len(vocabulary))  # of a query's terms, while it is scored
        self.looked_up = self.scored = 0  # documents, over all queries

        # Groups, by the lists that are long in the whole; and each document's column.
        many = np.flatnonzero(df * LONG >= self.n)
        row = np.full(len(term), -1, np.int32)
        row[many] = np.arange(len(many))
        groups, first = max(1, min(GROUPS, self.n // GROUP_DOCS)), 0
        vectors = np.zeros((len(many), self.n), np.float32)
        for asked, n_docs, docs, tf, n in owns:
            at = np.repeat(row[self.place[asked]], n_docs)
            used = np.flatnonzero(at >= 0)
            for lo in range(0, len(used), STRETCH):
                some = used[lo : lo + STRETCH]
                here = docs[some].astype(np.int64) + first
                vectors[at[some], here] = tf[some] / (tf[some] + self.damp[here])
            first += n
        at = used = None
        group = groups_of(vectors, groups) if groups > 1 else np.zeros(self.n, np.int64)
        vectors = None
        size = np.bincount(group, minlength=groups)
        self.cut_at = np.r_[0, np.cumsum(-(-size // CUT))]  # of each group, its first cut
        self.cuts = int(self.cut_at[-1])
        order = np.argsort(group, kind="stable")
        column = np.empty(self.n, np.int64)
        column[order] = np.arange(self.n) + (self.cut_at[:-1] * CUT - (np.cumsum(size) - size))[group[order]]
        self.doc = np.full(self.cuts * CUT, -1)
        self.doc[column] = np.arange(self.n)
        self.group_docs, self.group = size, np.repeat(np.arange(groups), np.diff(self.cut_at))

        # Lists that are long in a group: a row each there.
        count, first = np.zeros((groups, len(term)), np.int32), 0
        for asked, n_docs, docs, _, n in owns:
            at = np.repeat(self.place[asked], n_docs)
            for lo in range(0, len(docs), STRETCH):
                some = at[lo : lo + STRETCH]
                if not len(some):
                    continue
                low, high = int(some[0]), int(some[-1]) + 1  # places ascend
                own = (some - low) + group[first : first + n][docs[lo : lo + STRETCH]] * (high - low)
                count[:, low:high] += np.bincount(own, minlength=groups * (high - low)).reshape(groups, high - low).astype(np.int32)
            first += n
        at = own = None
        is_long = (count * LONG >= size[:, None]) & (count >= np.minimum(LEAST, df))
        self.row = np.where(is_long, np.cumsum(is_long, axis=1) - 1, -1).astype(np.int32)
        self.in_row = is_long.any(axis=0)
        self.df = df - (count * is_long).sum(axis=0)  # of what is left in the short lists
        rows_of, width = is_long.sum(axis=1), np.diff(self.cut_at) * CUT
        base = np.r_[0, np.cumsum(rows_of * width)]
        dense = np.zeros(base[-1], np.float32)
        self.dense = [dense[base[g] : base[g + 1]].reshape(rows_of[g], width[g]) for g in range(groups)]
        offset = base[:-1] - self.cut_at[:-1] * CUT  # of a group's row 0, less its first column

        # A posting of a short list is one number: the column, and its gain in steps, rounded up.
        self.unit = np.ones(len(term)) if idf is None else idf[term]  # what impacts are multiplied with beforehand
        self.step = 2.0 ** np.ceil(np.log2((K1 + 1) * max(self.unit.max(initial=0), 1e-300) / STEPS))
        steps = self.unit / self.step
        self.start = np.cumsum(self.df) - self.df
        self.packed, free, first, done = np.empty(self.df.sum(), np.uint32), self.start.copy(), 0, 0
        self.doc_term, self.doc_tf = np.empty(df.sum(), np.int32), np.empty(df.sum(), tf_type)
        self.doc_n = np.empty(self.n, np.int64)
        owns.reverse()
        while owns:
            asked, n_docs, docs, tf, n = owns.pop()
            at = np.argsort(docs, kind="stable")  # terms stay in order: equal documents add up alike in every shard
            self.doc_term[done : done + len(at)] = np.repeat(asked, n_docs)[at]
            self.doc_tf[done : done + len(at)] = tf[at]
            self.doc_n[first : first + n] = np.bincount(docs, minlength=n)
            done += len(at)
            at, places, own_group, own_column = None, np.repeat(self.place[asked], n_docs), group[first : first + n], column[first : first + n]
            left = np.zeros(len(term), np.int64)
            for lo in range(0, len(docs), STRETCH):
                here, at = docs[lo : lo + STRETCH], places[lo : lo + STRETCH]
                own = own_group[here]
                to = self.row[own, at]
                impact = tf[lo : lo + STRETCH] * (K1 + 1) / (tf[lo : lo + STRETCH] + self.damp[first : first + n][here])
                used = np.flatnonzero(to >= 0)
                dense[offset[own[used]] + to[used] * width[own[used]] + own_column[here[used]]] = impact[used]
                used = np.flatnonzero(to < 0)
                at = at[used]
                if not len(at):
                    continue
                number = np.bincount(at - at[0])  # places ascend
                to = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number) + (free + left)[at]
                self.packed[to] = own_column[here[used]].astype(np.uint32) << np.uint32(16) | np.ceil(impact[used] * steps[at]).astype(np.uint32)
                left[at[0] : at[0] + len(number)] += number
            free += left
            first += n
        self.doc_start = np.cumsum(self.doc_n) - self.doc_n
        self.cut_top = [d.reshape(len(d), d.shape[1] // CUT, CUT).max(axis=2) for d in self.dense]

    def exact(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        parts = [slice(a, a + n) for a, n in zip(self.doc_start[docs].tolist(), self.doc_n[docs].tolist())]
        w = weight[np.concatenate([self.doc_term[p] for p in parts])]
        used = np.flatnonzero(w)
        which = np.repeat(np.arange(len(docs)), self.doc_n[docs])[used]
        tf = np.concatenate([self.doc_tf[p] for p in parts])[used].astype(np.float64)
        return np.bincount(which, w[used] * (tf * (K1 + 1) / (tf + self.damp[docs][which])), len(docs))

    def search(self, terms: np.ndarray, weights: np.ndarray, ptr: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]], floor: np.ndarray | None = None) -> None:
        """Bring ``best``, the k best (scores, ids) of each query, up to date with this shard. Query j: terms and weights
        from ptr[j] to ptr[j + 1]. ``floor``: scores that k documents are known to reach, here or elsewhere; what is below is left out."""
        queries = len(ptr) - 1
        place = self.place[terms]
        known = place >= 0
        query = np.repeat(np.arange(queries), np.diff(ptr))[known]
        place, w, terms = place[known], weights[known], terms[known]
        some = np.flatnonzero(self.in_row[place])
        slack = ROUNDING * (4 + np.bincount(query[some], minlength=queries))
        bars = np.zeros(queries) if floor is None else floor.copy()
        for j, (scores, _) in enumerate(best):
            if len(scores) == k:
                bars[j] = max(bars[j], scores[-1])
        bars *= 1 - slack
        # Where a group's long lists alone may give half of what is needed, one product looks its documents up, with no other test.
        lookups, bound, added = [], np.zeros((queries, self.cuts)), np.zeros((queries, self.cuts * CUT), np.float32)
        for g, (dense, top) in enumerate(zip(self.dense, self.cut_top, strict=True)):
            row = self.row[g, place[some]]
            used = np.flatnonzero(row >= 0)
            lookup = np.zeros((queries, len(dense)), np.float32)
            lookup[query[some[used]], row[used]] = w[some[used]]
            lookups.append(lookup)
            own, cuts = lookup @ top, slice(self.cut_at[g], self.cut_at[g + 1])
            wide = np.flatnonzero(own.max(axis=1, initial=0) * 2 >= bars)
            if len(wide):
                added[wide, cuts.start * CUT : cuts.stop * CUT] = lookup[wide] @ dense
                own[wide] = 0
                self.looked_up += len(wide) * int(self.group_docs[g])
            bound[:, cuts] = own
        most = bound.max(axis=1)  # under half the bar
        at_all, in_short = np.searchsorted(query, np.arange(queries + 1)), np.flatnonzero(self.df[place])
        at_short, times = np.searchsorted(query[in_short], np.arange(queries + 1)), (w / self.unit[place])[in_short]
        over = self.step * np.bincount(query[in_short], times, queries)  # what gains may be too high by
        often = times != 1
        at_often = at_short[1:] - np.bincount(query[in_short][often], minlength=queries)
        order = np.argsort((query[in_short] * 2 + often).astype(np.int16), kind="stable")  # of a query: lists that count once, then others
        short, times = place[in_short][order], times[order]
        start, n = self.start[short], self.df[short]
        for j in range(queries):
            if j % FETCHED == 0:
                lo, hi = at_short[j], at_short[min(j + FETCHED, queries)]
                fetched = self.packed.take(spans(start[lo:hi], n[lo:hi]), mode="clip").view("<u2")  # faster than an index; none is out of range
                ends = np.r_[0, np.cumsum(n[lo:hi])][at_short[j : j + FETCHED + 1] - lo] * 2
            bar, lo, mid, hi = bars[j], at_short[j], at_often[j], at_short[j + 1]
            if hi > lo:
                pairs = fetched[ends[j % FETCHED] : ends[j % FETCHED + 1]]
                gain = pairs[::2].astype(np.float64)
                if mid < hi:
                    gain[len(gain) - n[mid:hi].sum() :] *= np.repeat(times[mid:hi], n[mid:hi])
                gained = np.bincount(pairs[1::2], gain, self.cuts * CUT)
                gained *= self.step
            else:
                gained = np.zeros(self.cuts * CUT)
            gained += added[j]
            docs = np.flatnonzero(gained >= bar - most[j]) if bar else np.flatnonzero(gained)
            docs = docs[gained[docs] + bound[j, docs // CUT] >= bar] if most[j] else docs
            if not len(docs):
                continue
            score = gained[docs]
            far = np.flatnonzero(bound[j, docs // CUT] > 0)
            self.looked_up += len(far)
            for g in np.unique(self.group[docs[far] // CUT]):
                own = far[self.group[docs[far] // CUT] == g]
                used = np.flatnonzero(lookups[g][j])
                score[own] += lookups[g][j, used] @ self.dense[g][used[:, None], docs[own] - self.cut_at[g] * CUT]
            docs = self.doc[docs]  # none of the columns between groups, which gain nothing
            if len(docs) > k:
                bar = max(bar, np.partition(score, len(docs) - k)[len(docs) - k] * (1 - slack[j]) - over[j])
            docs = docs[(score >= bar) & (score > 0)]
            if not len(docs):
                continue
            self.scored += len(docs)
            own = slice(at_all[j], at_all[j + 1])
            self.weight[terms[own]] = w[own]
            score = np.concatenate([best[j][0], self.exact(docs, self.weight)])
            self.weight[terms[own]] = 0
            ids = np.concatenate([best[j][1], self.ids[docs]])
            first = np.lexsort((ids, -score))[:k]
            best[j] = score[first], ids[first]


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """A shard is tens of megabytes, so workers get them one by one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def search_block(index: DataFrame, block: Block, n: int, mean_length: float, k: int, tasks: int) -> list[DataFrame]:
    """query_no, query_id, doc_id, score: for each task that took shards, its k best of each query of the block.

    About the square root of all files of the index is searched first; the k-th best score there is every query's bar elsewhere."""
    spark = index.sparkSession
    sc = spark.sparkContext
    shared = sc.broadcast(block)  # at most BLOCK_QUERIES queries of BLOCK_BYTES

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        total = np.zeros(len(vocabulary), np.int64)
        rows = ((terms.values, np.frombuffer(df.as_py(), "<i4")) for batch in batches for terms, df in zip(batch.column(0), batch.column(1), strict=True))
        while some := list(islice(rows, COUNTED)):
            for at, (_, df) in zip(numbers_of([t for t, _ in some], vocabulary), some, strict=True):
                total[at[at >= 0]] += df[at >= 0]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["term", "df"])

    df = np.zeros(len(block.vocabulary))
    with one_row_batches(index.sparkSession):
        counted = cut(index.select("terms", "df").coalesce(tasks).mapInArrow(frequencies, "term int, df long"))
    for part in counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_batches():  # a row for each term of the block
        df[part.column(0).to_numpy()] = part.column(1).to_numpy()
    idf = sc.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))

    names = [f.split()[0] for f in INDEX.split(", ")][:6]

    def found_in(files: list[str], floor: Broadcast | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q.ids)
            for rows in merged(batches):
                shard = Shard(rows, q.vocabulary, mean_length, idf.value)
                for lo in range(0, len(q.ids), TOGETHER):
                    hi = min(lo + TOGETHER, len(q.ids))
                    own, some = slice(q.ptr[lo], q.ptr[hi]), best[lo:hi]
                    shard.search(q.terms[own], idf.value[q.terms[own]] * q.times[own], q.ptr[lo : hi + 1] - q.ptr[lo], k, some, None if floor is None else floor.value[lo:hi])
                    best[lo:hi] = some
                shard = None  # one at a time
                pa.default_memory_pool().release_unused()
            size = [len(s) for s, _ in best]
            which = np.repeat(np.arange(len(best)), size)
            score, ids = (np.concatenate(x) if best else np.zeros(0) for x in (list(zip(*best)) or [[], []]))
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(q.ids[which]), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.float64))], names=["query_no", "query_id", "doc_id", "score"])

        rows = spark.read.schema(index.schema).parquet(*files).select(*names)
        with one_row_batches(spark):
            return cut(rows.coalesce(tasks).mapInArrow(run, "query_no int, query_id long, doc_id long, score double"))

    files = sorted(index.inputFiles())
    every = max(1, math.isqrt(len(files)))
    found = [found_in(files[::every], None)]
    if rest := [f for i, f in enumerate(files) if i % every]:
        nth = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score")))
        bars = np.zeros(len(block.ids))
        for part in found[0].withColumn("nth", nth).filter(F.col("nth") == k).select("query_no", "score").toArrow().to_batches():  # at most a row a query
            bars[part.column(0).to_numpy()] = part.column(1).to_numpy()
        floor = sc.broadcast(bars)
        found.append(found_in(rest, floor))
        floor.unpersist()
    shared.unpersist()
    idf.unpersist()
    return found


def merged(batches: Iterator[pa.RecordBatch], most: int = MERGED_DOCS, most_words: int = MERGED_WORDS) -> Iterator[list[dict[str, object]]]:
    """Rows of the index that are searched as one: what a query costs in a shard besides its postings is then paid once."""
    held, docs, words = [], 0, 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: (batch.column(c)[i].values if c == "terms" else batch.column(c)[i].as_buffer()) for c in batch.schema.names}
            n, w = len(row["ids"]) // 8, int(np.frombuffer(row["lengths"], "<i4").sum(dtype=np.int64))
            if held and (docs + n > most or words + w > most_words):
                whole, held, docs, words = held, [], 0, 0
                yield whole
            held.append(row)
            row = None
            docs, words = docs + n, words + w
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text", shard_docs: int = SHARD_DOCS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k best documents for each query, exactly.

    BM25 with k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term that a query repeats counts as often.
    Returns query_id, rank (from 1), doc_id, score; ties go to the smaller doc_id; documents without a term of the
    query are not listed. Null ids take no part; null and empty texts count as documents of length 0 and, as queries,
    find nothing; repeated documents are found each, and repeated queries answered each; other columns are ignored;
    empty tables: no rows.
    """
    spark = docs.sparkSession
    schema = "query_id long, rank int, doc_id long, score double"
    index = build_index(docs, id_col, text_col, shard_docs)
    total = index.agg(F.sum("n"), F.sum("words"), F.count(F.lit(1))).first()
    if not total[0] or not total[1]:
        return spark.createDataFrame([], schema)
    asked = queries.select(F.col(query_id_col).cast("long").alias("id"), F.col(query_text_col).alias("text")).filter(F.col("id").isNotNull())
    tasks = max(spark.sparkContext.defaultParallelism, -(-total[2] // SHARDS_A_TASK))
    found = [f.withColumn("block", F.lit(i)) for i, b in enumerate(blocks_of(asked, block_queries)) for f in search_block(index, b, total[0], total[1] / total[0], k, tasks)]
    if not found:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("block", "query_no").orderBy(F.desc("score"), "doc_id"))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
