"""Nearest neighbours by collision counting over single projections.

Vectors are compared by inner product: scaled by the largest norm and given one more component, which makes all of
them unit vectors, the largest inner product is the smallest distance. Each of ``PROJECTIONS`` orthogonal lines has a sorted
array of the projected vectors. A query opens a window around its own projection in every array; windows
widen by a factor (virtual rehashing: the array stands for the hash tables of all widths). Only what enters a window is counted; of a first
window that holds most of its array, what lies outside. A vector found in enough windows is verified: its inner product is computed. A
query is done when its k-th nearest verified vector lies within the radius, or when every vector is verified.

First radius and threshold are measured in each block, on ``SAMPLE`` of its vectors whose nearest are computed: the radius is one that holds the k nearest of
most of them, the threshold one that all but ``MISS`` of their nearest reach.

The queries are a stated set against all rows, in blocks: vectors are dealt into blocks of a bounded number of rows, each block's arrays are built once, the queries
stream past it, and the nearest of all blocks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shipping import ship

PROJECTIONS, SEED = 64, 17
#: Width of a window in units of the radius, and the factor from one radius to the next, which itself grows by as much.
WIDTH, FACTOR = 3.2, 1.05
#: Vectors of a block that are searched in full to measure radius and threshold, the share of their nearest that may stay below it, and of
#: the radii that the first one covers.
SAMPLE, MISS, MOST = 64, 0.05, 0.75
VECTOR_BLOCK = 8_192


def lines(dim: int) -> np.ndarray:
    """``PROJECTIONS`` directions, orthogonal as far as there are dimensions, scaled so that a unit vector projects to about 1."""
    rng, bases = np.random.default_rng(SEED), []
    while sum(b.shape[1] for b in bases) < PROJECTIONS:
        bases.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS] * math.sqrt(dim)


class Block:
    """Sorted arrays over some vectors, in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.longest, self.k = ids[order], vectors[order], longest, k
        unit = self.vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        self.lines = lines(vectors.shape[1] + 1)
        at = unit @ self.lines[:-1] + rest[:, None] * self.lines[-1]
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(at, self.order.T, axis=0).T.copy()
        self.first, self.least = self._measured(at)

    def _projected(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt((queries * queries).sum(axis=1))
        return norms, (queries / norms[:, None]) @ self.lines[:-1]

    def _measured(self, at: np.ndarray) -> tuple[float, int]:
        """(first radius, threshold)."""
        rows = np.unique(np.linspace(0, len(self.ids) - 1, SAMPLE).astype(int))
        norms, places = self._projected(self.vectors[rows])
        radii, hits = [], []
        for row, norm, place in zip(rows, norms, places, strict=True):
            scores = self.vectors @ self.vectors[row]
            scores[row] = -np.inf
            near = np.argsort(-scores)[: min(self.k, len(scores) - 1)]
            if len(near):
                radius = math.sqrt(max(0.0, 2.0 - 2.0 * scores[near[-1]] / (norm * self.longest)))
                radii.append(radius)
                hits.append((np.abs(at[near] - place) <= radius * WIDTH / 2).sum(axis=1))
        if not radii:
            return 2.0, 0
        # A radius of zero (copies) could never widen.
        return max(float(np.quantile(radii, MOST)), 0.01), int(np.quantile(np.concatenate(hits), MISS, method="lower"))

    def nearest(self, queries: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, (ids, scores) of the nearest found but its own id."""
        norms, places = self._projected(queries)
        count = len(self.ids)
        hits: list[np.ndarray | None] = [None] * len(queries)
        seen = np.zeros((len(queries), count), bool)
        seen |= self.ids == own[:, None]
        rows = [np.zeros(0, np.int64) for _ in queries]
        scores = [np.zeros(0) for _ in queries]
        low = high = np.zeros((PROJECTIONS, len(queries)), np.int64)
        active, radius, factor = np.arange(len(queries)), self.first, FACTOR
        while len(active):
            half = radius * WIDTH / 2
            before = low, high
            low, high = low.copy(), high.copy()
            for j, line in enumerate(self.sorted):
                low[j, active] = np.searchsorted(line, places[active, j] - half, "left")
                high[j, active] = np.searchsorted(line, places[active, j] + half, "right")
            going = []
            for q in active:
                windows = zip(self.order, low[:, q], high[:, q], strict=True)
                if hits[q] is None and (high[:, q] - low[:, q]).sum() * 2 > count * PROJECTIONS:
                    hits[q] = PROJECTIONS - np.bincount(np.concatenate([part for o, a, b in windows for part in (o[:a], o[b:])]), minlength=count)
                elif hits[q] is None:
                    hits[q] = np.bincount(np.concatenate([o[a:b] for o, a, b in windows]), minlength=count)
                else:
                    olds = zip(windows, before[0][:, q], before[1][:, q], strict=True)
                    np.add.at(hits[q], np.concatenate([part for (o, a, b), c, d in olds for part in (o[a:c], o[d:b])]), 1)
                found = np.flatnonzero((hits[q] >= self.least) & ~seen[q])
                seen[q, found] = True
                rows[q], scores[q] = self._best(queries[q], np.concatenate([rows[q], found]), np.concatenate([scores[q], self.vectors[found] @ queries[q]]))
                full = len(rows[q]) >= self.k and 2.0 - 2.0 * scores[q][-1] / (norms[q] * self.longest) <= radius * radius
                if not (full or seen[q].all()):
                    going.append(q)
            active, radius, factor = np.array(going, np.int64), radius * factor, factor * FACTOR
        out = []
        for query, found in zip(queries, rows, strict=True):
            # Summed row by row, equal vectors have equal scores.
            exact = (self.vectors[found] * query).sum(axis=1)
            best = np.lexsort((self.ids[found], -exact))[: self.k]
            out.append((self.ids[found[best]], exact[best]))
        return out

    def _best(self, query: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k largest scores, largest first, and behind the k-th only what may tie with it but for rounding."""
        order = np.argsort(-scores, kind="stable")
        rows, scores = rows[order], scores[order]
        if len(rows) > self.k:
            slack = 1e-12 * (1.0 + math.sqrt(float((query * query).sum())) * self.longest)
            keep = scores >= scores[self.k - 1] - slack
            rows, scores = rows[keep], scores[keep]
        return rows, scores


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row among all rows but its own.

    ``is_query`` is a condition on the id column. Nearness is the largest inner product in double precision; ties
    go to the smaller id. Rows with a null id take no part, nor do vectors that are null, empty, zero, hold a null
    or non-finite component, or are not of the most frequent length (the larger one, if two are). Of rows with the same id, the smallest vector counts.
    Fewer candidates than k: all of them. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0))
    own = own.groupBy("id").agg(F.min("v").alias("v"), F.first("q").alias("q"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = own.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.max(norm).alias("longest"))
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    out = "query_id long, vec_id long, score double"
    if top is None or not top.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, longest = top.dim, top.longest
    n_blocks = -(-top.n // VECTOR_BLOCK)
    own = own.where(F.size("v") == dim)
    mine = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    rows = own.select("id", "v", F.lit(False).alias("asks"), mine.alias("block"))
    asked = own.where("q").select("id", "v", F.lit(True).alias("asks"), every.alias("block"))
    dealt = rows.unionByName(asked).repartition(2 * n_blocks, "block").sortWithinPartitions("block", "asks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block its vectors come first, then the queries, a batch at a time."""
        at, ids, data, block = None, [], [], None
        for batch in batches:
            numbers, asks, own_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks", "id"))
            vectors = _matrix(batch.column("v"), dim)
            for number in np.unique(numbers):
                if number != at:
                    at, ids, data, block = number, [], [], None
                here, asking = (numbers == number) & ~asks, (numbers == number) & asks
                if here.any():
                    ids.append(own_ids[here])
                    data.append(vectors[here])
                if asking.any() and ids:
                    block = block or Block(np.concatenate(ids), np.concatenate(data), longest, k)
                    found = block.nearest(vectors[asking], own_ids[asking])
                    of = np.repeat(own_ids[asking], [len(f[0]) for f in found])
                    columns = [of, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(searched, out)
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
