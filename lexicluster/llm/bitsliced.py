"""Exact top-k search by integer inner product on a bit-sliced index.

Components are quantised to floor(scale * x).  The index holds blocks of rows, sorted by id; for
each attribute a block keeps the offset (its least value there) and slices: slice b is a bitmap
over the rows, bit b of value minus offset.  A query is cut into bit planes of its two's complement
weights.  The sum of the attributes that one plane selects is added slice by slice with ripple
carries (Horner's rule over the planes doubles the running total), and groups of ``GROUP``
attributes come from a table of their subset sums, which all queries of a block share.  The top
rows are then selected from the most significant slice of the total downward: rows with the bit
set are sure while they fit, otherwise the rest is out.  What is left at the end has one and the
same score, and the boundary is resolved by id.  All sums are exact, so nothing is verified by a
second path.

The index is a written table (a row per block); the queries go round in broadcasts of about
``QUERY_ROWS`` rows.  A task merges the results of its blocks, so that it emits at most ``k`` rows a
query; a window per query merges the tasks.

Defined results: vectors that are null, empty or hold null or non-finite components, those of
another length than most, and rows without an id take no part; quantised components are clipped at
+-``CLIP``; every row but those with the query's own id is a candidate, so that a repeated row may
take several ranks; a query id that is repeated counts once, with its smallest vector; fewer
candidates than asked for are all returned; an empty table gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_matrix, quantised, usual_length, written

GROUP, BLOCK_ROWS, QUERY_ROWS = 8, 8192, 16_384
STEP_WORDS = 8192            # words of a slice over the queries that are added up at once
CLIP = 1 << 28               # 2^28 * 2^28 * 64 components fit a long
INDEX = "n int, width int, ids binary, offsets binary, slices binary"
RESULT = "query_id long, vec_id long, score long"


def add(x: np.ndarray, y: np.ndarray, width: int, negative: bool = False) -> np.ndarray:
    """Sum of two sliced numbers (slices, ..., words) to ``width`` slices; ``y`` isn't negative,
    ``x`` may be, in two's complement."""
    out = np.empty((width, *np.broadcast_shapes(x.shape[1:], y.shape[1:])), np.uint64)
    carry, half = np.zeros(out.shape[1:], np.uint64), np.empty(out.shape[1:], np.uint64)
    for i in range(width):
        a = x[i] if i < len(x) else x[-1] if negative else None
        b = y[i] if i < len(y) else None
        if a is None or b is None:
            one = a if b is None else b
            if one is None:
                out[i] = carry
                carry = np.zeros_like(carry)
            else:
                np.bitwise_xor(one, carry, out=out[i])
                np.bitwise_and(one, carry, out=carry)
        else:
            np.bitwise_xor(a, b, out=half)
            np.bitwise_xor(half, carry, out=out[i])
            np.bitwise_and(half, carry, out=carry)
            carry |= a & b
    return out


class Block:
    """Sliced attributes of some rows."""

    def __init__(self, n: int, width: int, ids: np.ndarray, offsets: np.ndarray, slices: np.ndarray):
        self.n, self.width, self.ids, self.offsets, self.slices = n, width, ids, offsets, slices

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        offsets = values.min(axis=0)
        above = (values - offsets).T                                        # (attributes, rows)
        width = max(1, int(above.max()).bit_length())
        rows = np.zeros((len(above), width, -(-len(ids) // 64) * 64), np.uint8)
        for b in range(width):
            rows[:, b, :len(ids)] = (above >> b) & 1
        return cls(len(ids), width, ids, offsets, np.packbits(rows, axis=2, bitorder="little").view(np.uint64))

    def subset_sums(self) -> list[np.ndarray]:
        """For each group of attributes, the sums of all its subsets: (slices, subsets, words)."""
        tables = []
        for at in range(0, len(self.slices), GROUP):
            sums = np.zeros((1, 1, self.slices.shape[2]), np.uint64)
            for i, attribute in enumerate(self.slices[at:at + GROUP]):
                width = ((i + 1) * ((1 << self.width) - 1)).bit_length()
                more = add(sums, attribute[:, None, :], width)
                kept = np.zeros_like(more)
                kept[:len(sums)] = sums
                sums = np.concatenate([kept, more], axis=1)
            tables.append(sums)
        return tables

    def totals(self, tables: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sliced scores (slices, queries, words) in two's complement, and what each query adds to them."""
        planes = max(1, int(np.abs(weights).max()).bit_length() + 1)         # the first is the sign
        top = weights.shape[1] * ((1 << self.width) - 1)                     # the largest sum of a plane
        total, low, high = None, 0, 0
        for p in range(planes - 1, -1, -1):
            bits = (weights >> p) & 1
            parts = []
            for g, sums in enumerate(tables):
                own = bits[:, g * GROUP:(g + 1) * GROUP]
                parts.append(sums[:, own @ (1 << np.arange(own.shape[1])), :])
            while len(parts) > 1:
                parts = [parts[i] if i + 1 == len(parts) else
                         add(parts[i], parts[i + 1], max(len(parts[i]), len(parts[i + 1])) + 1) for i in range(0, len(parts), 2)]
            if total is None:
                # Minus the sum, less one: the complement.
                total, low, high = np.concatenate([~parts[0], np.full((1, *parts[0].shape[1:]), ~np.uint64(0))]), -top - 1, 0
                continue
            low, high = 2 * low, 2 * high + top
            width = max(high.bit_length(), (-low).bit_length()) + 1
            total = np.concatenate([parts[0][:1], add(total, parts[0][1:], width - 1, negative=True)])
        return total, weights @ self.offsets + (1 << (planes - 1))

    def search(self, asked: np.ndarray, queries: np.ndarray, k: int):
        """(query number, ids, scores) of the ``k`` best rows of the block for each query."""
        words = self.slices.shape[2]
        step = max(1, STEP_WORDS // words)
        valid = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(np.uint64)
        tables = self.subset_sums()
        for at in range(0, len(asked), step):
            total, plus = self.totals(tables, queries[at:at + step])
            maybe = np.repeat(valid[None], total.shape[1], axis=0)
            first, last = (np.searchsorted(self.ids, asked[at:at + step], side) for side in ("left", "right"))
            for q in np.flatnonzero(last > first):
                for row in range(first[q], last[q]):
                    maybe[q, row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
            sure, found = np.zeros_like(maybe), np.zeros(len(maybe), np.int64)
            for s in range(len(total) - 1, -1, -1):
                bit = ~total[s] if s == len(total) - 1 else total[s]        # of the sign, 0 is the larger
                ones = maybe & bit
                n = found + np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
                full = n >= k
                maybe = np.where(full[:, None], ones, maybe & ~bit)
                sure |= np.where(full[:, None], np.uint64(0), ones)
                found = np.where(full, found, n)
            # Rows of one and the same score are left: the smallest ids, which come first.
            tied = np.unpackbits(maybe.view(np.uint8), axis=1, bitorder="little")
            chosen = np.unpackbits(sure.view(np.uint8), axis=1, bitorder="little")
            chosen |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= (k - found)[:, None])
            q, row = np.nonzero(chosen)
            bits = (total[:, q, row >> 6] >> (row & 63).astype(np.uint64)) & np.uint64(1)
            score = -(bits[-1].astype(np.int64) << (len(total) - 1))
            for s in range(len(total) - 1):
                score += bits[s].astype(np.int64) << s
            yield q + at, self.ids[row], score + plus[q]


def _index(rows: DataFrame) -> DataFrame:
    """The blocks of ``rows`` (id, v) as a written table."""
    def run(batches):
        def block(held):
            b = Block.build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array([b.n], pa.int32()), pa.array([b.width], pa.int32()), pa.array([b.ids.tobytes()], pa.binary()),
                 pa.array([b.offsets.tobytes()], pa.binary()), pa.array([b.slices.tobytes()], pa.binary())],
                names=["n", "width", "ids", "offsets", "slices"])
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if size + part.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, size = [], 0
                held.append((part.column(0).to_numpy(), list_matrix(part.column(1))))
                size += part.num_rows
        if held:
            yield block(held)
    return written(rows.mapInArrow(run, INDEX), "sliced")


def _best(ids: list, scores: list, numbers: list, k: int):
    """The ``k`` best of each query, by score, then id."""
    ids, scores, numbers = (np.concatenate(x) for x in (ids, scores, numbers))
    order = np.lexsort((ids, -scores, numbers))
    numbers = numbers[order]
    rank = np.arange(len(order)) - np.searchsorted(numbers, numbers, "left")
    keep = rank < k
    return ids[order][keep], scores[order][keep], numbers[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the ``k`` rows of ``vectors``
    with the largest inner product of quantised components, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, CLIP, id_col, vec_col).where(F.col("id").isNotNull())
    dim = usual_length(rows)
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = _index(rows.where(F.size("v") == dim))
    asked = quantised(queries, scale, CLIP, id_col, vec_col).where(F.col("id").isNotNull() & (F.size("v") == dim)).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked, "queries")
    rounds = max(1, math.ceil(asked.count() / (QUERY_ROWS // 2)))
    found = None
    for b in range(rounds):
        # A hash deals the queries out, QUERY_ROWS / 2 a round on average.
        q = asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == b).orderBy("id").toArrow()
        if not q.num_rows:
            continue
        sent = spark.sparkContext.broadcast((q["id"].to_numpy(), list_matrix(q["v"])))

        def run(batches, sent=sent):
            asked, weights = sent.value
            ids, scores, numbers, held = [], [], [], 0
            for batch in batches:
                for r in batch.to_pylist():
                    offsets = np.frombuffer(r["offsets"], np.int64)
                    slices = np.frombuffer(r["slices"], np.uint64).reshape(len(offsets), r["width"], -1)
                    block = Block(r["n"], r["width"], np.frombuffer(r["ids"], np.int64), offsets, slices)
                    for number, i, s in block.search(asked, weights, k):
                        ids.append(i), scores.append(s), numbers.append(number)
                        held += len(i)
                        if held > 4 * k * len(asked):
                            ids, scores, numbers = ([x] for x in _best(ids, scores, numbers, k))
                            held = len(ids[0])
            if ids:
                ids, scores, numbers = _best(ids, scores, numbers, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[numbers]), pa.array(ids), pa.array(scores)],
                                                 names=["query_id", "vec_id", "score"])

        part = written(index.mapInArrow(run, RESULT), f"top-{b}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
