"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order.

Fingerprints within three differing bits agree on one of four 16-bit blocks, so each fingerprint is sent to four
shards, rotated so that the agreeing block leads. A shard sorts its fingerprints by Gray rank, in which neighbours
share most bits, and factors the bits that all members of a run share into a node: a mask and a pattern. Nodes over
nodes keep only the bits that their parent does not have. A search walks down, adds up the differences on the bits
of each node, and drops a whole run once the sum passes the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, text_digest
from tidemark.llm.components import components

SEED = 42
SHINGLE = 3
MAX_DIFFERENCE = 3
#: Children of a node, and members of a leaf.
FAN = 16
#: (query, node) pairs that a search holds at once.
FRONTIER = 1 << 21
#: Fingerprint copies that a shard is meant to hold.
SHARD_ROWS = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits: bit b is 1 if it is set in over half of the shingles' hashes; no words: zero."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, digest (MD5 of the text) and fp (the fingerprint as a signed long), one row for each row of ``docs``."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """A forest over ``words``, one tree for each value of ``group``; built by factoring shared bits level by level."""

    def __init__(self, words: np.ndarray, group: np.ndarray, fan: int = FAN):
        order = np.lexsort((gray_rank(words), group))
        self.words, self.group, self.order = words[order], group[order], order
        self.levels: list[dict[str, np.ndarray]] = []
        low, high = self.words, self.words  # AND and OR of each node's members
        owner = self.group
        while True:
            first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
            start = np.flatnonzero(first)
            if self.levels and len(start) == len(owner):
                break  # one node a group: the roots
            within = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
            begin = np.flatnonzero(within % fan == 0)
            low, high, owner = (np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin), owner[begin]) if len(begin) else (low, high, owner)
            self.levels.append({"mask": ~(low ^ high), "bits": low, "begin": begin, "end": np.r_[begin[1:], len(within)], "owner": owner})
            if not len(begin):
                break
        for child, parent in zip(self.levels, self.levels[1:], strict=False):  # a child keeps what its parent has not
            over = np.repeat(parent["mask"], parent["end"] - parent["begin"])
            child["own"] = child["mask"] & ~over
        if self.levels:
            self.levels[-1]["own"] = self.levels[-1]["mask"]

    def links(self, limit: int = MAX_DIFFERENCE, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (in Gray order, first before second) of words of one group that differ in at most ``limit`` bits."""
        if len(self.words) < 2:
            return
        top = self.levels[-1]
        root = np.searchsorted(top["owner"], self.group)
        step = max(1, frontier // (FAN * FAN))
        for lo in range(0, len(self.words), step):
            query = np.arange(lo, min(lo + step, len(self.words)))
            yield from self._down(query, root[query], np.zeros(len(query), np.uint8), len(self.levels) - 1, limit, frontier)

    def _down(self, query, node, paid, level, limit, frontier):
        if len(query) > frontier // FAN and len(query) > 1:  # too wide: one half after the other
            half = len(query) // 2
            yield from self._down(query[:half], node[:half], paid[:half], level, limit, frontier)
            yield from self._down(query[half:], node[half:], paid[half:], level, limit, frontier)
            return
        at = self.levels[level]
        paid = paid + np.bitwise_count((self.words[query] ^ at["bits"][node]) & at["own"][node])
        last = self._last(level)[node]
        keep = (paid <= limit) & (last > query)  # each pair once: only runs that reach beyond the query
        query, node, paid = query[keep], node[keep], paid[keep]
        if not len(query):
            return
        begin, n = at["begin"][node], at["end"][node] - at["begin"][node]
        below = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        query, paid = np.repeat(query, n), np.repeat(paid, n)
        if level:
            yield from self._down(query, below, paid, level - 1, limit, frontier)
            return
        hit = (below > query) & (np.bitwise_count(self.words[query] ^ self.words[below]) <= limit)
        if hit.any():
            yield query[hit], below[hit]

    def _last(self, level: int) -> np.ndarray:
        """Of each node, the place of its last member."""
        at = self.levels[level]
        if "last" not in at:
            at["last"] = at["end"] - 1 if level == 0 else self._last(level - 1)[at["end"] - 1]
        return at["last"]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; ``label`` points each member to a smaller one of its class."""
    while len(a):
        a, b = label[a], label[b]
        while len(deeper := np.flatnonzero(label[a] != a)):
            a[deeper] = label[a[deeper]]
        while len(deeper := np.flatnonzero(label[b] != b)):
            b[deeper] = label[b[deeper]]
        open_ = a != b
        a, b = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
        np.minimum.at(label, b, a)


def linked(fps: DataFrame, limit: int = MAX_DIFFERENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fps: distinct fp. Returns a, b: links that connect, in each shard, what its index finds connected.

    A class of a shard comes out as a star, not as all its pairs: the components are the same, and rows stay linear."""
    if limit != MAX_DIFFERENCE:
        raise ValueError("four blocks find up to three differing bits")
    rows = fps.count()
    shards = max(16, -(-4 * rows // shard_rows))
    block = F.explode(F.sequence(F.lit(0), F.lit(3)))
    sent = fps.select("fp", block.alias("block"))
    turned = F.expr("shiftleft(fp, 16 * block) | shiftrightunsigned(fp, (64 - 16 * block) % 64)")
    sent = sent.withColumn("turned", F.when(F.col("block") == 0, F.col("fp")).otherwise(turned))
    sent = sent.withColumn("shard", F.pmod(F.xxhash64("block", F.expr("shiftrightunsigned(turned, 48)")), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        fp, word = table["fp"].to_numpy(), table["turned"].to_numpy().view(np.uint64)
        group = (word >> np.uint64(48)).astype(np.int64) | (table["block"].to_numpy().astype(np.int64) << 16)
        index = GrayIndex(word, group)
        label = np.arange(len(word))
        for a, b in index.links(limit):
            merged(label, a, b)
        while (label[label] != label).any():
            label = label[label]
        fp = fp[index.order]
        move = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(fp[move], pa.int64()), "b": pa.array(fp[label[move]], pa.int64())})

    return sent.groupBy("shard").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """Every document's fingerprint and group.

    Returns doc_id, digest (MD5 of the text), fingerprint (16 hex digits), component_id (the smallest id that links
    reach, the own included) and root_fp (a long, the same for one group, never null). Null and empty texts have
    fingerprint zero and link like others; ids may repeat or be null (a group of null ids only has a null
    component_id); other columns are ignored; empty table: no rows. Equal fingerprints are one node, so a group of
    copies of any size costs one.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked(nodes.select("fp")))
    node = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root_fp", F.coalesce("root", "fp"))
    least = node.groupBy("root_fp").agg(F.min("least").alias("component_id"))
    of = node.select("fp", "root_fp").join(least, "root_fp")
    return fps.join(of, "fp").select("doc_id", "digest", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root_fp")


def _row_key(doc_id: Column, digest: Column) -> Column:
    """Of an id and a text's digest, never null; equal for equal rows only."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), digest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one row of each group that ``find`` gives: that of the smallest id (nulls last), then the smallest digest; of rows
    with equal id and text, the first by the other columns. Columns, whatever their names, stay as they are."""
    columns = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    key, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    groups = find(own, key, text, width)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    kept = groups.groupBy("root_fp").agg(first.alias("k")).select(_row_key(F.col("k.doc_id"), F.col("k.digest")).alias("kept_key"))
    own = own.withColumn("row_key", _row_key(F.col(key), text_digest(F.col(text))))
    chosen = own.join(kept, F.col("row_key") == F.col("kept_key"))
    others = [f"c{i}" for i in range(len(columns)) if f"c{i}" != text]
    one = F.row_number().over(Window.partitionBy("row_key").orderBy(*others))  # partitioned as the join has left it
    return chosen.withColumn("one", one).filter("one = 1").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
