"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics are per document and bounded in number; class moments are sums over all labelled training rows (partial
sums in each task, then one sum a class). Each class has a mean and a covariance shrunk towards the pooled one and
its diagonal; the score is the logistic of the difference of Mahalanobis log-densities, with each class's Cholesky
factor inverted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, in_batches

THRESHOLD = 0.3
#: Shares of the pooled covariance and of its diagonal in each class's covariance.
POOLED, DIAGONAL = 0.2, 0.1
#: The model is fitted on at most so many labelled documents, the first by a hash of their id.
FIT_DOCUMENTS = 50_000
#: Bytes of text whose statistics are computed at once; a longer text is a group of its own.
GROUP_BYTES = 1 << 21
NAMES = ("log_words", "word_length", "word_length_spread", "distinct", "repeated", "upper", "shouted", "digit", "punctuation", "symbol", "plain", "wordless", "sentence_length", "line_length", "same_lines", "short", "non_ascii")
SPACE, UPPER, LOWER, DIGIT, STOP, PUNCTUATION, SYMBOL, CONTROL, HIGH = range(9)
_CLASS = np.full(256, CONTROL, np.uint8)
for _kind, _set in ((SPACE, b" \t\n\r\x0b\x0c"), (UPPER, range(65, 91)), (LOWER, range(97, 123)), (DIGIT, range(48, 58)), (STOP, b".!?"), (PUNCTUATION, b",;:'\"()-"), (SYMBOL, b"#$%&*+/<=>@[\\]^_`{|}~"), (HIGH, range(128, 256))):
    _CLASS[list(_set)] = _kind


def logit(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a share of n things, with half a thing added to both sides."""
    return np.log((share * n + 0.5) / ((1 - share) * n + 0.5))


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics of whole texts, a row each, in the order of NAMES. Null: like empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    out, lo = [np.zeros((0, len(NAMES)))], 0
    if len(texts):
        bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + GROUP_BYTES, side="right")) - 1)
            out.append(group_statistics(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]))
            lo = hi
    return np.concatenate(out)


def group_statistics(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Statistics of the texts that lie one after another in ``raw``, cut at ``bounds``."""
    n_docs, size = len(bounds) - 1, np.maximum(1, np.diff(bounds))
    kind = _CLASS[raw]
    ends_doc, starts_doc = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    starts_doc[bounds[:-1]] = ends_doc[bounds[1:]] = True
    word = kind != SPACE
    first = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | starts_doc[:-1])) if len(raw) else np.zeros(0, np.int64)
    last = np.flatnonzero(word & (np.r_[~word[1:], True] | ends_doc[1:])) if len(raw) else first
    doc = np.searchsorted(bounds, first, side="right") - 1
    per_word, per_doc = {}, {}
    for k in (UPPER, LOWER, DIGIT, STOP, PUNCTUATION, SYMBOL, HIGH):
        upto = np.r_[0, np.cumsum(kind == k, dtype=np.int64)]
        per_word[k], per_doc[k] = upto[last + 1] - upto[first], upto[bounds[1:]] - upto[bounds[:-1]]
    length = last + 1 - first
    count = lambda x: np.bincount(doc[x], minlength=n_docs)
    words = np.bincount(doc, minlength=n_docs)
    m = np.maximum(1, words)
    mean = np.bincount(doc, length, n_docs) / m
    spread = np.sqrt(np.maximum(0.0, np.bincount(doc, length.astype(float) ** 2, n_docs) / m - mean**2))
    letters = per_word[UPPER] + per_word[LOWER] + per_word[HIGH]
    end_mark = np.isin(kind[last], (STOP, PUNCTUATION))
    distinct, repeated, lines, distinct_lines = np.zeros((4, n_docs))
    for i in range(n_docs):
        text = raw[bounds[i] : bounds[i + 1]].tobytes()
        own, rows = text.split(), [x for x in text.split(b"\n") if not x.isspace() and x]
        distinct[i], repeated[i], lines[i], distinct_lines[i] = len(set(own)), sum(map(eq, own, own[1:])), len(rows), len(set(rows))
    cased = np.maximum(1, per_doc[UPPER] + per_doc[LOWER])
    some = np.maximum(1, lines)
    return np.column_stack([
        np.log1p(words), np.log(np.maximum(1.0, mean)), np.log1p(spread), logit(distinct / m, m) - 0.5 * np.log1p(words) * (words > 0), logit(repeated / m, m), logit(per_doc[UPPER] / cased, cased),
        logit(count((per_word[UPPER] >= 2) & (per_word[LOWER] == 0)) / m, m), logit(per_doc[DIGIT] / size, size), logit((per_doc[STOP] + per_doc[PUNCTUATION]) / size, size), logit(per_doc[SYMBOL] / size, size),
        logit(count(letters == length - end_mark) / m, m), logit(count((letters == 0) & (per_word[DIGIT] == 0)) / m, m), np.log1p(words / (1 + count(kind[last] == STOP))),
        np.log1p(np.diff(bounds) / some), logit(1 - distinct_lines / some, some), logit(count(length <= 3) / m, m), logit(per_doc[HIGH] / size, size),
    ])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class Discriminant:
    """For each class (0, 1): log prior, mean, inverse of the Cholesky factor, log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
        """moments: for each class n, sum of x, sum of outer products. None unless both classes have rows."""
        if set(moments) != {0, 1} or not all(n >= 1 for n, _, _ in moments.values()):
            return None
        n = np.array([moments[c][0] for c in (0, 1)])
        mean = np.array([moments[c][1] / moments[c][0] for c in (0, 1)])
        own = [moments[c][2] / moments[c][0] - np.outer(mean[c], mean[c]) for c in (0, 1)]
        both = (n[0] * own[0] + n[1] * own[1]) / n.sum()
        floor = 1e-3 * max(1e-9, np.trace(both) / len(both)) * np.eye(len(both))
        inverse, logdet = [], []
        for c in (0, 1):
            p = max(pooled, len(both) / (len(both) + n[c]))  # few rows: more of the pooled one
            s = (1 - p) * own[c] + p * both
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(both)) + floor
            factor = np.linalg.cholesky(s)
            inverse.append(np.linalg.inv(factor))
            logdet.append(2 * np.log(np.diag(factor)).sum())
        return cls(np.log(n / n.sum()), mean, np.array(inverse), np.array(logdet))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        log = [self.prior[c] - 0.5 * (np.square((x - self.mean[c]) @ self.inverse[c].T).sum(axis=1) + self.logdet[c]) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def class_moments(docs: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """docs: label (0 or 1), text. Partial sums in each task; the driver gets one sum a class and entry."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = statistics(batch.column(1)), np.array(batch.column(0))
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"label": pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()), "k": pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()), "v": pa.array(total.ravel(), pa.float64())})

    sums = in_batches(docs.select("label", "text")).mapInArrow(run, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()  # 2 (1 + d + d^2) rows
    out = np.zeros((2, 1 + d + d * d))
    for r in sums:
        out[r["label"], r["k"]] = r["v"]
    return {c: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in enumerate(out) if v[0]}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS) -> Discriminant | None:
    """The model of ``documents`` labelled ids that are not held out, the first by XXH64. Repeated labels of a document
    count once, by the smallest; null ids and labels, and other values, are ignored; a text with several rows counts with
    each. None without documents of both classes."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    chosen = cut(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).withColumnRenamed("doc_id", "of"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))  # at most `documents` rows
    return Discriminant.fit(class_moments(rows))


def with_score(docs: DataFrame, model: Discriminant | None, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``name``, last: the score of the text. Without a model every score is 1.

    The other columns, whatever their names, stay as they are; rows are scored where they are read: no join, no shuffle."""
    columns = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    schema, at = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())]), columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.ones(batch.num_rows) if model is None else model.score(statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=schema.names)

    return in_batches(own).mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's quality score.

    Returns doc_id, held_out, score, predicted. Null and empty texts are scored by their statistics like others;
    repeated rows are scored each; a null id is held out; without training rows of both classes every score is 1
    (nothing is rejected); other columns are ignored; empty table: no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_score(own, fit(own, labels, label_col), "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the classifier rejects; columns, whatever their names, stay as they are.

    Null and empty texts are judged by their statistics like others, repeated rows each; null ids are never learned from
    and are judged; without training rows of both classes all stay; empty table: no rows.
    """
    score = "score"
    while score in docs.columns:
        score += "_"
    return with_score(docs, fit(docs, labels, label_col, id_col, text_col), score, text_col).filter(F.col(score) >= threshold).drop(score)
