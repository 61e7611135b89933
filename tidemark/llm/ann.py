"""Approximate nearest neighbours by collision counting.

Each vector is projected on single random directions, orthogonal to each other; every direction keeps its projections in
a sorted array. A query's window in each array is centred on the query's own projection and as wide as a radius says.
Vectors that fall into enough of the windows are verified by their true inner product. Then the radius grows to the
distance of the k-th best found, the windows grow with it (virtual rehashing: nothing is hashed again), and only what
they gained is counted. A query ends when its k-th best is within the radius: at that radius a vector as near as that
has reached the threshold with high probability.

Collisions are counted from the side that is smaller: what the windows hold, or what they leave out.

Inner products become distances on the unit sphere: vectors are scaled by the largest norm and get one more
coordinate that completes them to norm one, queries are scaled to norm one.

Vectors are dealt evenly in blocks of bounded memory, each moved once, to the task that indexes it. Queries follow them,
one copy a block, and stream through. Results of a query's blocks meet by window, k rows from each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut


@dataclass(frozen=True)
class Parameters:
    """directions: projections of a vector, one for each of its coordinates at most. width: half a window, in radii.
    sigmas: how far below the mean number of collisions, of a vector as far as the radius, the threshold is.
    sample: vectors of a block that say which radius its queries start from. growth: of a radius with too few found."""

    directions: int = 128
    width: float = 1.8
    sigmas: float = 0.5
    sample: int = 64
    growth: float = 1.25
    seed: int = 7


class CollisionIndex:
    """Sorted projections of one block of vectors; ``norm``: the largest norm of all vectors, in any block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, k: int, parameters: Parameters = Parameters()):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.p, self.norm, self.k = ids[order], vectors[order], parameters, norm, k
        n, d = vectors.shape
        scaled = self.vectors / norm
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        rng = np.random.default_rng(parameters.seed)
        self.m = min(parameters.directions, d + 1)
        self.directions = np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0][:, : self.m] * math.sqrt(d + 1)
        values = (np.column_stack([scaled, rest]) @ self.directions).T
        self.places = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.places, axis=1)
        self.verified = 0
        hit = math.erf(parameters.width / math.sqrt(2))  # a difference in one direction is about normal, the distance its deviation
        self.may_miss = self.m - max(1, math.floor(self.m * hit - parameters.sigmas * math.sqrt(self.m * hit * (1 - hit))))
        some = rng.choice(n, min(n, parameters.sample), replace=False)
        near = np.partition(self.vectors[some] @ self.vectors.T / (norm * np.linalg.norm(self.vectors[some], axis=1))[:, None], max(0, n - k - 1), axis=1)[:, max(0, n - k - 1)]
        self.start = max(1e-3, float(np.quantile(np.sqrt(np.maximum(0.0, 2 - 2 * near)), 0.1)))

    def windows(self, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in the windows, and first behind them: a row a query, a column a direction."""
        t = radius * self.p.width
        return tuple(np.column_stack([np.searchsorted(v, c + s, side=side) for v, c in zip(self.values, centres.T, strict=True)]) for s, side in ((-t, "left"), (t, "right")))

    def search(self, queries: np.ndarray, own: np.ndarray, together: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and inner products of the k nearest found, nearest first, ties to smaller ids; not those
        with the query's ``own`` id. ``together`` queries go from round to round side by side."""
        for lo in range(0, len(queries), together):
            yield from self.search_some(queries[lo : lo + together], own[lo : lo + together])

    def search_some(self, queries: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n, k, q = len(self.ids), self.k, len(queries)
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        centres = (queries / length[:, None]) @ self.directions[:-1]
        mine, past = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        radius = np.full(q, self.start)
        low, high = self.windows(centres, radius)
        missed, done = np.empty((q, n), np.int16), 2 * self.m + 2  # more than windows can take away
        for i in range(q):
            bounds = list(zip(self.places, low[i].tolist(), high[i].tolist()))
            if 2 * (high[i] - low[i]).sum() <= self.m * n:
                missed[i] = self.m - np.bincount(np.concatenate([p[a:b] for p, a, b in bounds]), minlength=n)
            else:
                missed[i] = np.bincount(np.concatenate([s for p, a, b in bounds for s in (p[:a], p[b:])]), minlength=n)
            missed[i, mine[i] : past[i]] = done
        found, score = [np.zeros(0, np.int64)] * q, [np.zeros(0)] * q
        active = np.arange(q)
        while len(active):
            wider = []
            for i in active.tolist():
                r = radius[i]
                new = np.flatnonzero(missed[i] <= (self.may_miss if r < 2.0 else self.m))  # 2: as far as two points of the sphere can be
                if len(new):
                    missed[i, new] = done
                    self.verified += len(new)
                    f, s = np.concatenate([found[i], new]), np.concatenate([score[i], self.vectors[new] @ queries[i]])
                    if len(s) > k:  # keep what can still be among the k; rounding apart, all ties
                        stay = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * length[i] * self.norm
                        f, s = f[stay], s[stay]
                    found[i], score[i] = f, s
                if r >= 2.0:
                    continue
                radius[i] = r * self.p.growth
                if len(score[i]) >= k:
                    kth = np.partition(score[i], len(score[i]) - k)[len(score[i]) - k]
                    radius[i] = math.sqrt(max(0.0, 2 - 2 * float(kth) / (length[i] * self.norm)))
                if radius[i] > r:
                    wider.append(i)
            active = np.array(wider, np.int64)
            if len(active):
                wide_low, wide_high = self.windows(centres[active], radius[active])
                for j, i in enumerate(active.tolist()):
                    if radius[i] < 2.0:
                        bounds = zip(self.places, wide_low[j].tolist(), low[i].tolist(), high[i].tolist(), wide_high[j].tolist())
                        missed[i] -= np.bincount(np.concatenate([s for p, a, b, c, e in bounds for s in (p[a:b], p[c:e])]), minlength=n).astype(np.int16)
                low[active], high[active] = wide_low, wide_high
        out = []
        for i in range(q):
            exact = (self.vectors[found[i]] * queries[i]).sum(axis=1)  # summed alike for all, so equal vectors tie
            best = np.lexsort((self.ids[found[i]], -exact))[:k]
            out.append((self.ids[found[i]][best], exact[best]))
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: rows that take part: an id, and a vector without null, NaN or infinite components that is not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", vector_block: int = 1 << 14, parameters: Parameters = Parameters()) -> DataFrame:
    """For each row of ``vectors`` for which ``is_query`` (over vec_id) holds, its k nearest other rows by inner product.

    Returns query_id, rank (from 1), vec_id, score (double precision, of the vectors as they are), nearest first, ties
    to the smaller vec_id. Vectors that are null, zero or hold null or non-finite components take no part, nor do null
    ids. Vectors of each length are searched among themselves: others have no inner product with them. Candidates are all
    rows whose id is not the query's; repeated ids are candidates each, and a repeated query id asks with each of its
    vectors (the result has the best k by id and score). Fewer than k candidates: all of them. Other columns are ignored;
    empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, id_col, vector_col).withColumn("d", F.size("v")).withColumn("at", F.monotonically_increasing_id()))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lengths = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).orderBy("d").collect()  # a row for each length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norms, plan, blocks = {r["d"]: r["norm"] for r in lengths}, [], 0
    for r in lengths:
        plan.append((r["d"], blocks, -(-r["n"] // vector_block)))
        blocks += plan[-1][2]
    placed = rows.join(F.broadcast(spark.createDataFrame(plan, "d int, first int, blocks int")), "d")
    data = placed.select((F.col("first") + F.pmod("at", F.col("blocks"))).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))
    asked = placed.filter(is_query).select(every.alias("block"), F.lit(True).alias("asks"), "vec_id", "v")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, vs = None, [], []  # a partition is one block: its vectors, then the queries
        for batch in batches:
            asks, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            ids.append(own[~asks])
            vs.append(flat[~asks])
            if not asks.any():
                continue
            if index is None:
                index = CollisionIndex(np.concatenate(ids), np.concatenate(vs), norms[flat.shape[1]], k, parameters)
                ids, vs = [], []
            found = list(index.search(flat[asks], own[asks]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[asks], [len(f) for f, _ in found])), pa.array(np.concatenate([f for f, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    both = data.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("asks").select("asks", "vec_id", "v")
    found = both.mapInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
