"""Nearest neighbours by collision counting over query-centred windows.

Every vector is projected on ``PROJECTIONS`` random directions (a seed fixes them); a block of
vectors keeps one sorted array per direction.  For a query, a window centred on its own projection
opens in every array and widens step by step (virtual rehashing): each vector it reaches collides
once.  When enough vectors of the block have collided in at least ``THRESHOLD`` of the directions,
all vectors at or above the threshold are verified by their exact Euclidean distance; the windows
stop widening when the nearest verified ones are well inside them.  Nothing at the threshold is
left out, so equal vectors stand or fall together.

All rows are indexed, block by block; the queries go round in broadcasts of at most
``QUERY_BLOCK`` rows.  The nearest of the blocks are merged by a window per query.

Defined results: vectors that are null, zero or hold null or non-finite components, and those of
another length than most, take no part, nor do rows without an id; a repeated id counts once, with
its smallest distance, as a query with its smallest vector; fewer candidates than asked for are
all returned; an empty table gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PROJECTIONS, THRESHOLD, WIDEN, FIRST_WIDTH = 128, 0.75, 1.1, 0.5
#: A query stops once the k-th verified distance is so near that a vector at MARGIN times that
#: distance collides in THRESHOLD of the directions in expectation (REACH: the half width at which
#: it does, in distances), or else once this share of the block and ten a neighbour are verified.
MARGIN, REACH, VERIFY_SHARE, VERIFY_EACH = 1.2, 1.15, 0.2, 10
BLOCK_ROWS, QUERY_BLOCK = 32_768, 16_384


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vectors that take part, in double precision."""
    v = F.col("v")
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        projected = (vectors @ directions).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def search(self, ids: np.ndarray, queries: np.ndarray, directions: np.ndarray, k: int):
        """(query number, block row, distance) of the ``k`` nearest verified rows of each query."""
        n, m = len(self.ids), len(self.sorted)
        need = min(n, math.ceil(VERIFY_SHARE * n) + VERIFY_EACH * k)
        least = math.ceil(THRESHOLD * m)
        at = queries @ directions
        hits = np.zeros((len(queries), n), np.uint8)
        lo = np.stack([np.searchsorted(self.sorted[j], at[:, j]) for j in range(m)], axis=1)
        hi, open_ = lo.copy(), np.arange(len(queries))
        width = FIRST_WIDTH * max(float(self.sorted.std(axis=1).mean()), 1e-9)
        exact = np.full((len(queries), n), np.nan)
        while len(open_):
            left, right = lo.copy(), hi.copy()
            for j in range(m):
                left[open_, j] = np.searchsorted(self.sorted[j], at[open_, j] - width, "left")
                right[open_, j] = np.searchsorted(self.sorted[j], at[open_, j] + width, "right")
            still = []
            for q in open_:
                new = [self.order[j, a:b] for j in range(m) for a, b in ((left[q, j], lo[q, j]), (hi[q, j], right[q, j])) if a < b]
                if new:
                    hits[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)
                near = np.flatnonzero(hits[q] >= least)
                fresh = near[np.isnan(exact[q, near])]
                exact[q, fresh] = np.sqrt(((self.vectors[fresh] - queries[q]) ** 2).sum(axis=1))
                near = near[self.ids[near] != ids[q]]
                d = exact[q, near]
                close = len(d) >= k and np.partition(d, k - 1)[k - 1] * MARGIN * REACH <= width
                if close or len(near) >= need or ((left[q] == 0) & (right[q] == n)).all():
                    best = np.lexsort((self.ids[near], d))
                    best = best[np.sort(np.unique(self.ids[near][best], return_index=True)[1])][:k]     # an id once
                    yield q, near[best], d[best]
                else:
                    still.append(q)
            lo, hi, open_, width = left, right, np.array(still, np.int64), width * WIDEN


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` for every row of
    ``queries``, by Euclidean distance, ties to the smaller id."""
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["d"]
    rows = rows.where(F.size("v") == dim)
    asked = usable(queries, id_col, vec_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / (QUERY_BLOCK // 2)))
    directions = np.random.default_rng(seed).standard_normal((dim, PROJECTIONS))
    parts = []
    for b in range(blocks):
        q = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()   # at most QUERY_BLOCK rows
        if not q.num_rows:
            continue
        sent = spark.sparkContext.broadcast((q["id"].to_numpy(), _matrix(q["v"], dim)))

        def run(batches, sent=sent):
            ids, vecs = sent.value

            def search(held):
                block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), directions)
                step = max(1, (8 << 20) // len(block.ids))        # queries whose counts and distances are held at once
                for a in range(0, len(ids), step):
                    for i, near, d in block.search(ids[a:a + step], vecs[a:a + step], directions, k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[a + i])), pa.array(block.ids[near]), pa.array(d)],
                                                         names=["query_id", "vec_id", "score"])
            held, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), dim)))
                    size += batch.num_rows
                if size >= BLOCK_ROWS:
                    yield from search(held)
                    held, size = [], 0
            if held:
                yield from search(held)

        parts.append(written(rows.mapInArrow(run, result), f"nearest-{b}"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
