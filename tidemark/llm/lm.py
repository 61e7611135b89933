"""Cross-entropy difference of two n-gram models.

The target model learns from target documents, the background model from all; both are bigram models interpolated
with unigrams over one vocabulary: all words of all documents. A document's score is its cross-entropy a word under the
target model less that under the background model; lower means more like the target.

Nothing that grows with the vocabulary is gathered in one place. Documents are counted in packs of about PACK_WORDS words.
A pack sends each of its words and bigrams once, as a hash with its counts in the pack, to the block that the hash
names. A block adds up what all packs sent and tells each pack the sums of its own entries; then the pack scores its
documents. However frequent a bigram is, a block gets it once a pack, and blocks are hash ranges of equal size, as many
as the words ask for. What is sent is compressed: hashes as differences in ascending order, counts of which most are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, small, stored

#: Weight of the bigram estimate.
BIGRAM = 0.7
#: Words at which a pack of documents ends, and words of the corpus for each block of counts.
PACK_WORDS, BLOCK_WORDS = 1 << 19, 1 << 20
#: Packs that one task scores.
PACKS_A_TASK = 4
BROADCAST_IDS = 1_000_000
#: Bits that a hash has above those that number the corpus's bytes, of which its words are fewer: less than one in 2^20 meets
#: another. Corpora of 2^43 bytes and more use all 63 bits, and more meet.
SPARE_BITS = 20


def hash_bits(corpus_bytes: int) -> int:
    return max(40, min(63, corpus_bytes.bit_length() + SPARE_BITS))


def words(text: str | None) -> list[bytes]:
    """Words of a text: no ASCII white space in them, A-Z as a-z."""
    return (text or "").encode().lower().split()


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed byte place by byte place; :func:`expanded` reads them."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.Codec("zstd", 3).compress(planes, asbytes=True)


def ascending(x: np.ndarray) -> bytes:
    """Like :func:`squeezed`, for numbers in ascending order, as differences; their running sums give them back."""
    return squeezed(np.r_[x[:1], np.diff(x)])


def expanded(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[1:], n * raw[0]), "u1").reshape(raw[0], n)
    out = np.zeros((n, 8), "u1")
    out[:, : raw[0]] = planes.T
    return out.view("<i8")[:, 0]


# -- packs


def packs(docs: DataFrame, bits: int, pack_words: int) -> DataFrame:
    """pack, ids and target of its documents, lengths (words of each), words (hashes of the distinct ones, from the most
    frequent on), tokens (their places), n and n_target (words), n_distinct. ``docs``: doc_id, target, text. A document is never split."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("pack", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("target", "lengths", "words", "tokens")), *(T.StructField(c, T.LongType()) for c in ("n", "n_target", "n_distinct"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, target, lengths, held = [], [], [], []

        def out() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            coded = pa.array(held, pa.binary()).dictionary_encode()
            place = coded.indices.to_numpy()
            common = np.argsort(-np.bincount(place, minlength=len(coded.dictionary)), kind="stable")
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.take(pa.array(common)).to_pylist()], "<u8") >> np.uint64(64 - bits)
            number_of = np.empty(len(common), np.int64)
            number_of[common] = np.arange(len(common))
            n = np.array(lengths, np.int64)
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            values = [pa.array([number]), lists, *(pa.array([x], pa.binary()) for x in (np.array(target, "u1").tobytes(), squeezed(n), squeezed(hashes), squeezed(number_of[place]))), *(pa.array([int(x)]) for x in (n.sum(), n[np.array(target, bool)].sum(), len(common)))]
            return pa.RecordBatch.from_arrays(values, names=schema.names)

        for batch in batches:
            flags = batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                own = words(text.as_py())
                ids.append(batch.column(0).slice(i, 1))
                target.append(flags[i])
                lengths.append(len(own))
                held += own
                if len(held) >= pack_words or len(ids) >= pack_words:
                    yield out()
                    number += 1
                    ids, target, lengths, held = [], [], [], []
        if ids:
            yield out()

    return docs.select("doc_id", "target", "text").mapInArrow(run, schema)


def split(keys: np.ndarray, bits: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that ascending keys fall into, in order, and where each begins; the last bound is the number of keys. Keys
    of words are hashes, those of bigrams have one more bit: they come last, and their blocks are numbered on."""
    hashed, pair = keys & np.uint64((1 << bits) - 1), keys >> np.uint64(bits)
    block = (((hashed >> np.uint64(bits - 32)) * np.uint64(blocks)) >> np.uint64(32)) + pair * np.uint64(blocks)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    return block[first].astype(np.int64), np.r_[first, len(block)]


class Pack:
    """A pack's documents as numbers, and what it asks of the blocks: ``keys`` in ascending order, with the pack's own
    counts; ``place`` says where the words and bigrams, one after the other, stand in that order."""

    def __init__(self, bits: int, target: bytes, lengths: bytes, hashes: bytes, tokens: bytes, n: int, distinct: int):
        self.target = np.frombuffer(target, "u1").astype(bool)
        self.lengths, self.tokens = expanded(lengths, len(self.target)), expanded(tokens, n)
        hashed, self.distinct = expanded(hashes, distinct).view(np.uint64), distinct
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.joins = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        pairs, self.pair = np.unique(self.tokens[self.joins - 1] * self.distinct + self.tokens[self.joins], return_inverse=True)
        mixed = (hashed[pairs // max(1, self.distinct)] * np.uint64(0x9E3779B97F4A7C15)) ^ hashed[pairs % max(1, self.distinct)]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        keys = np.concatenate([hashed, ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(64 - bits)) | np.uint64(1 << bits)])
        order = np.argsort(keys, kind="stable")
        self.order, self.keys, self.place = order, keys[order], np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def counts(self) -> list[np.ndarray]:
        """How often each key occurs, and how often it is a document's last word: in all documents, then in target ones."""
        last = np.cumsum(self.lengths)[self.lengths > 0] - 1
        out = []
        for keep in (slice(None), self.target[self.doc]):
            joined = keep if isinstance(keep, slice) else keep[self.joins]
            seen = np.concatenate([np.bincount(self.tokens[keep], minlength=self.distinct), np.bincount(self.pair[joined], minlength=len(self.keys) - self.distinct)])
            ends = np.bincount(self.tokens[last] if isinstance(keep, slice) else self.tokens[last][keep[last]], minlength=len(self.keys))
            out += seen[self.order], ends[self.order]
        return out


PACKED = ("target", "lengths", "words", "tokens", "n", "n_distinct")
COUNTS = ("n", "ends", "target_n", "target_ends")


def entries(rows: DataFrame, bits: int, blocks: int) -> DataFrame:
    """block, pack, size, keys and counts: what each pack sends to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *row = (c[i].as_py() for c in batch.columns)
                p = Pack(bits, *row)
                block, bounds = split(p.keys, bits, blocks)
                parts = [slice(lo, hi) for lo, hi in zip(bounds, bounds[1:])]
                packed = (pa.array([ascending(p.keys[s]) for s in parts], pa.binary()), *(pa.array([squeezed(c[s]) for s in parts], pa.binary()) for c in p.counts()))
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.full(len(block), number, np.int64)), pa.array(np.diff(bounds).astype(np.int64)), *packed], names=["block", "pack", "size", "keys", *COUNTS])

    schema = ", ".join(["block int", "pack long", "size long", "keys binary", *(f"{c} binary" for c in COUNTS)])
    return rows.select("pack", *PACKED).mapInArrow(run, schema)


def totals(sent: DataFrame, blocks: int) -> DataFrame:
    """block, pack, size and counts: those of the corpus for what each pack sent. A partition is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        parts = pa.Table.from_batches(held)
        size = parts["size"].to_pylist()
        kind, place = np.unique(np.concatenate([np.cumsum(expanded(k.as_py(), s)) for k, s in zip(parts["keys"], size, strict=True)]), return_inverse=True)
        ends, sums = np.cumsum(size), []
        for c in COUNTS:
            own = np.concatenate([expanded(x.as_py(), s) for x, s in zip(parts[c], size, strict=True)])
            whole = np.bincount(place, own, len(kind)).astype(np.int64)[place]  # sums below 2^53 are exact
            sums.append(pa.array([squeezed(whole[e - s : e]) for s, e in zip(size, ends, strict=True)], pa.binary()))
        whole = pa.table([parts["block"], parts["pack"], parts["size"], *sums], names=["block", "pack", "size", *COUNTS])
        yield from whole.combine_chunks().to_batches()

    schema = ", ".join(["block int", "pack long", "size long", *(f"{c} binary" for c in COUNTS)])
    return sent.repartitionById(blocks, F.col("block")).mapInArrow(run, schema)


def vocabulary_size(rows: DataFrame, bits: int, blocks: int) -> int:
    """Distinct words of all packs, counted block by block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys = np.unique(expanded(x.as_py(), n).view(np.uint64))
                block, bounds = split(keys, bits, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.diff(bounds).astype(np.int64)), pa.array([ascending(keys[lo:hi]) for lo, hi in zip(bounds, bounds[1:])], pa.binary())], names=["block", "size", "keys"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.cumsum(expanded(k.as_py(), n)) for batch in batches for n, k in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(np.concatenate(seen))) if seen else 0], pa.int64())], names=["words"])

    sent = rows.select("words", "n_distinct").mapInArrow(send, "block int, size long, keys binary").repartitionById(blocks, F.col("block"))
    return sent.select("size", "keys").mapInArrow(count, "words long").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]


# -- scores


def score_documents(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", bigram: float = BIGRAM, pack_words: int = PACK_WORDS, block_words: int = BLOCK_WORDS, packs_a_task: int = PACKS_A_TASK
) -> DataFrame:
    """Cross-entropies (nats a word) of every document under both models, and their difference.

    Returns doc_id, n_words, target_loss, background_loss, score (target_loss - background_loss). A document's first
    word, and a word after one that the model never saw as a context, has its unigram probability; unigrams are smoothed
    by one count for each word of the vocabulary. A document is scored with all counts, its own included, so a target
    document finds itself in the target model. Null and empty texts: 0 words and zeros. Repeated rows count and are scored
    each; null ids are never targets; no targets: the target model is uniform; other columns are ignored; empty
    table: no rows. ``target_ids``: a column doc_id, repeats do no harm.
    """
    wanted = cut(target_ids.select(F.col("doc_id").alias("of")).filter(F.col("of").isNotNull()).distinct())
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    flagged = own.join(small(wanted, BROADCAST_IDS), F.col("doc_id") == F.col("of"), "left").withColumn("target", F.col("of").isNotNull())
    bits = hash_bits(own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    rows = stored(packs(flagged, bits, pack_words), "lm-packs")
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0)), F.count(F.lit(1))).first()
    blocks, tasks = max(1, -(-size[0] // block_words)), max(1, -(-size[2] // packs_a_task))
    vocab, corpus = vocabulary_size(rows, bits, blocks), (size[0], size[1])
    result = T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss"))])

    def losses(pack: pa.Table, answers: pa.Table) -> pa.Table:
        p = Pack(bits, *(pack[c][0].as_py() for c in PACKED))
        order = np.argsort(answers["block"].to_numpy(), kind="stable").tolist()
        told = {c: np.concatenate([np.zeros(0, np.int64), *(expanded(answers[c][i].as_py(), answers["size"][i].as_py()) for i in order)])[p.place] for c in COUNTS}
        n_docs, out = len(p.lengths), []
        v, first = p.tokens[p.joins - 1], np.ones(len(p.tokens), bool)
        first[p.joins] = False
        for kind, total in (("target_", corpus[1]), ("", corpus[0])):
            count = told[kind + "n"]
            alone = ((count[: p.distinct] + 1.0) / (total + vocab))[p.tokens]
            seen = (count - told[kind + "ends"])[v]  # as a context: wherever it is not the last word
            mix = np.where(seen > 0, bigram, 0.0)
            joined = mix * count[p.distinct :][p.pair] / np.maximum(seen, 1) + (1 - mix) * alone[p.joins]
            out.append(np.bincount(p.doc[first], -np.log(alone[first]), n_docs) + np.bincount(p.doc[p.joins], -np.log(joined), n_docs))
        mean = [x / np.maximum(p.lengths, 1) for x in out]
        return pa.table([pack["ids"].combine_chunks().flatten(), pa.array(p.lengths), *(pa.array(x) for x in mean)], names=result.names)

    answered = totals(entries(rows, bits, blocks), blocks).repartition(tasks, "pack").groupBy("pack")
    asked = rows.select("pack", "ids", *PACKED).repartition(tasks, "pack").groupBy("pack")
    scored = asked.cogroup(answered).applyInArrow(losses, result)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
