"""Best-two-fit packing of token sequences.

Pieces of equal length are interchangeable, so what has to be packed is a histogram with at most ``capacity``
lengths, whatever the number of documents. The driver packs that histogram: it fills a bin greedily, replaces the
bin's smallest piece by the two unpacked ones that fit the widened gap more tightly, and then uses the same bin as
many times as the counts allow. Executors then find each piece's place from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, in_batches, input_splits

CAPACITY = 2048
SEPARATOR = 0
#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's ``\s`` has it. The pattern looks ahead behind white space and keeps a step for each
#: character of a run until it fails, so runs of LONG_RUN and more are cut out first.
WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 4096
#: Pieces of one length are ranked in so many buckets of a hash, or in as many as the input has partitions if those are
#: more, so no length is ranked in one task at any size.
BUCKETS = 256


class Encoder:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file, by the faster of two public encoders.

    The merge ranks come from the file itself. Texts that hold one of the file's added tokens, and every text if the
    file is of another kind, go through ``tokenizers``. A long run of white space is encoded as the one piece that the
    pattern makes of it: all of it at the end of a text, else all but its last character, which goes with what follows."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = tuple(t["content"] for t in model.get("added_tokens", ()))
        pre = model.get("pre_tokenizer") or {}
        self.fast = None
        if model["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer"):
            shown = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.added}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        parts, at, half = [], 0, LONG_RUN // 2
        if any(text[i : i + half].isspace() for i in range(0, len(text) - half + 1, half)):  # any long run fills such a block
            for run in WHITE.finditer(text):
                if run.end() - run.start() >= LONG_RUN:
                    end = run.end() - (run.end() < len(text))
                    parts += self.fast.encode_ordinary(text[at : run.start()]), self.piece.encode_ordinary(text[run.start() : end])
                    at = end
        return np.concatenate([np.array(x, dtype="<u4") for x in (*parts, self.fast.encode_ordinary(text[at:]))])


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a first that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenized(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. Null text: empty, so the separator alone."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encoder = Encoder(path)
        end = np.array([SEPARATOR], dtype="<u4")
        for batch in batches:
            row, piece, start, length, crcs = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), end])
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crcs.append(zlib.crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())], names=schema.names)

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


@dataclass(frozen=True)
class Bins:
    """``repeats`` equal bins, numbered from ``first``; ``pieces``: (length, copies), in order of place."""

    first: int
    repeats: int
    pieces: tuple[tuple[int, int], ...]


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for ``histogram`` (length: count). Every kind of bin but those cut short by the counts uses up a length,
    so the kinds are a few for each length, and the work does not depend on the counts."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] = n
    out: list[Bins] = []
    used = 0
    while (there := np.flatnonzero(left)).size:
        bin_, gap = [], capacity

        def take(n: int) -> None:
            nonlocal gap
            left[n] -= 1
            bin_.append(n)
            gap -= n

        while gap:  # greedily: always the largest that fits
            k = np.searchsorted(there, gap, side="right") - 1
            while k >= 0 and not left[there[k]]:
                k -= 1
            if k < 0:
                break
            n = int(there[k])
            copies = min(int(left[n]), gap // n)
            left[n] -= copies
            bin_ += [n] * copies
            gap -= copies * n
        while gap and len(bin_) > 1:
            least = bin_[-1]
            pair = tightest_pair(left, gap + least, least)
            if pair is None:
                break
            bin_.pop()
            left[least] += 1
            gap += least
            for n in pair:
                take(n)
            bin_.sort(reverse=True)
        kind = Counter(bin_)
        more = min(int(left[n]) // m for n, m in kind.items())
        for n, m in kind.items():
            left[n] -= more * m
        out.append(Bins(used, more + 1, tuple(sorted(kind.items(), reverse=True))))
        used += more + 1
    return out


def tightest_pair(left: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (above, room]; of equal sums, that with the largest member."""
    lengths = np.flatnonzero(left[: room + 1])
    if not lengths.size:
        return None
    mate = np.searchsorted(lengths, room - lengths, side="right") - 1
    mate = np.where((mate >= 0) & (lengths[mate] == lengths) & (left[lengths] < 2), mate - 1, mate)
    total = np.where(mate >= 0, lengths + lengths[mate], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(lengths[best]), int(lengths[mate[best]])) if total[best] > above else None


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece's sequence and place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its ids and a separator;
    null and empty texts are the separator alone; texts of any length and kind, one word or one run of white space
    included, are encoded whole; only documents above ``capacity`` are cut. Repeated rows are packed
    each on its own; null ids are ids like others; empty table: no rows; other columns are ignored. Which of the
    pieces of one length goes where follows a hash of the row, so reruns agree.
    """
    spark = docs.sparkSession
    pieces = tokenized(docs, tokenizer_path, capacity, id_col, text_col)
    pieces = cut(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(BUCKETS, input_splits(docs)))).cast("int")))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.select("length", "bucket", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length

    rows, ranked = [], Counter()
    for b in best_two_fit(histogram, capacity):
        place = 0
        for length, copies in b.pieces:
            rows.append((length, ranked[length], ranked[length] + copies * b.repeats, copies, b.first, place))
            ranked[length] += copies * b.repeats
            place += copies * length
    plan = F.broadcast(spark.createDataFrame(rows, "length long, from_rank long, to_rank long, copies long, first long, place long"))  # bounded by capacity, not by rows
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked_pieces = pieces.withColumn("local", local).join(counts.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    k = F.col("rank") - F.col("from_rank")
    return (
        ranked_pieces.join(plan, (ranked_pieces["length"] == plan["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .select(
            "doc_id", "piece", "start", ranked_pieces["length"], "ids_crc32", (F.col("first") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("place") + F.pmod(k, F.col("copies")) * ranked_pieces["length"]).cast("long").alias("offset"),
        )
    )
