"""Vector code compression: product codes by exact k-means whose rescans are spared by bounds.

Components are quantised to floor(scale * x) and cut into parts; each part position has a codebook
and its own Lloyd rounds, in integers throughout.  The entries of a codebook form groups of
neighbours.  A row keeps, for each part and group, a lower bound of the distance to the group's
nearest entry and the round in which it was taken (its stamp).  The history of all codebooks is
retained, so in a later round a bound falls by the true net displacement of the entries since its
stamp, the norm of the sum of their moves, which is at most the sum of the moves' norms that
accumulated drifts would take off.  The row's own group is always scanned; another group is
rescanned, exactly, only if its bound doesn't rule out a nearer or an equally near entry.  Bounds
are rounded down and compared with slack, distances that decide are exact integers; ties go to the
lower index.

Each assignment is one pass that writes rows, codes and bounds; the sums of a round are one row
per task and used entry, added up by Spark; the driver holds codebooks alone (parts x entries, for
each round).

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, as
are those of another length than most; quantised components are clipped at +-``CLIP``; a length
that ``parts`` doesn't divide is filled up with zeros; fewer vectors than entries give smaller
codebooks; repeated rows are rows of their own; rows with a null id are kept and start a codebook
only after all others; equal ids are ordered by vector; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_matrix, quantised, removed, shared_path, usual_length

CLIP = 1 << 26               # squared distances of 256 components fit a long
GROUP_ENTRIES, CHUNK_ROWS = 16, 8192
TOTALS, COPIES = 65_536, 16      # totals that are broadcast; copies of each, beyond
EXACT = 1 << 53


def _groups(book: np.ndarray) -> list[np.ndarray]:
    """Entries in groups of neighbours: halved at the widest component until they are small."""
    todo, out = [np.arange(len(book))], []
    while todo:
        at = todo.pop()
        if len(at) <= GROUP_ENTRIES:
            out.append(np.sort(at))
            continue
        widest = np.ptp(book[at], axis=0).argmax()
        at = at[np.argsort(book[at, widest], kind="stable")]
        todo += [at[:len(at) // 2], at[len(at) // 2:]]
    return sorted(out, key=lambda g: g[0])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b of integers: in doubles where every partial sum is exact, else in longs."""
    if not a.size or not b.size or int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def state_type(parts: int, groups: int) -> np.dtype:
    return np.dtype([("stamp", "u1", (parts, groups)), ("bound", "<f4", (parts, groups))])


class Books:
    """Codebook history of all parts and what follows from it for the present round."""

    def __init__(self, first: list[np.ndarray]):
        self.history, self.groups = [first], [_groups(b) for b in first]

    @property
    def round(self) -> int:
        return len(self.history) - 1

    @property
    def n_groups(self) -> int:
        return max(len(g) for g in self.groups)

    def displacements(self) -> list[np.ndarray]:
        """Per part, (rounds, groups): the farthest that an entry of the group has moved, net, between
        a round and the present one."""
        now = self.history[-1]
        out = []
        for p, groups in enumerate(self.groups):
            net = np.stack([np.sqrt(((now[p] - old[p]).astype(np.float64) ** 2).sum(axis=1)) for old in self.history])
            out.append(np.stack([net[:, g].max(axis=1) for g in groups], axis=1) * (1 + 1e-9))
        return out

    def update(self, sums: dict) -> None:
        """The next codebooks from {(part, entry): (count, component sums)}."""
        book = [b.copy() for b in self.history[-1]]
        for (p, e), (n, s) in sums.items():
            book[p][e] = [int(x) // int(n) for x in s]
        self.history.append(book)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.history[-1] for x in b.ravel().tolist()).encode()).hexdigest()


def assign(x: np.ndarray, code: np.ndarray, stamp: np.ndarray, bound: np.ndarray, book: np.ndarray, groups: list[np.ndarray],
           moved: np.ndarray, now: int) -> tuple[np.ndarray, int]:
    """Nearest entries of the rows of one part, from the entries that they had; ``code``, ``stamp`` and
    ``bound`` are brought up to date.  Returns the squared distances and the number of exact ones taken."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    square, entry_square = (x * x).sum(axis=1), (book * book).sum(axis=1)
    group_of = np.empty(len(book), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    own, new, scanned = group_of[code], np.zeros(len(x), np.int64), 0

    def scan(rows, g):
        members = groups[g]
        d = square[rows, None] - 2 * _dot(x[rows], book[members].T) + entry_square[members]
        j = d.argmin(axis=1)                                                 # members ascend: ties to the lower index
        near, entry = d[np.arange(len(rows)), j], members[j]
        bound[rows, g] = np.nextafter(np.sqrt(near.astype(np.float64)).astype(np.float32), np.float32(-1))
        stamp[rows, g] = now
        better = (near < best[rows]) | ((near == best[rows]) & (entry < new[rows]))
        best[rows[better]], new[rows[better]] = near[better], entry[better]
        return d.size

    for g in range(len(groups)):
        rows = np.flatnonzero(own == g)
        if len(rows):
            scanned += scan(rows, g)
    for g in range(len(groups)):
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-6) + 1e-6
        rows = np.flatnonzero((own != g) & (bound[:, g] - moved[stamp[:, g], g] <= reach))
        if len(rows):
            scanned += scan(rows, g)
    code[:] = new
    return best, scanned


def _binary(records: np.ndarray) -> pa.Array:
    """Rows of a contiguous array as binary values."""
    data, n = np.ascontiguousarray(records), len(records)
    width = data.nbytes // max(1, n)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(data.tobytes())])


def _rows(col: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype)


def _cut(col: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, components), filled up with zeros."""
    x = list_matrix(col)
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def _assigned(rows: DataFrame, books: Books, parts: int, path: str) -> DataFrame:
    """``rows`` with codes, bounds and errors against the present codebooks, written to ``path``."""
    spark, schema = rows.sparkSession, rows.select("id", "kept", "v").schema
    schema = spark.createDataFrame([], schema).select("*", F.lit(b"").alias("code"), F.lit(b"").alias("state"),
                                                      F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scanned")).schema
    form, first = state_type(parts, books.n_groups), "code" not in rows.columns
    sent = spark.sparkContext.broadcast((books.history[-1], books.groups, books.displacements(), books.round))

    def run(batches):
        book, groups, moved, now = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                n, x = batch.num_rows, _cut(batch.column(2), parts)
                if first:
                    code, state = np.zeros((n, parts), np.uint8), np.zeros(n, form)
                    state["bound"] = -np.inf
                else:
                    code, state = _rows(batch.column(3), np.uint8).reshape(n, parts).copy(), _rows(batch.column(4), form).copy()
                error, scanned = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for p in range(parts):
                    index = code[:, p].astype(np.int64)
                    stamp, bound = state["stamp"][:, p], state["bound"][:, p]
                    best, exact = assign(x[:, p], index, stamp, bound, book[p], groups[p], moved[p], now)
                    code[:, p], error = index, error + best
                    scanned[0] += exact
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _binary(code), _binary(state),
                                                  pa.array(error), pa.array(scanned)], names=["id", "kept", "v", "code", "state", "error", "scanned"])

    rows.select("id", "kept", "v", *([] if first else ["code", "state"])).mapInArrow(run, schema).write.parquet(path)
    sent.destroy()
    return spark.read.schema(schema).parquet(path)


def _sums(coded: DataFrame, parts: int, entries: int, width: int) -> dict:
    """{(part, entry): (count, component sums)} of all rows: at most parts x entries."""
    def run(batches):
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                x, code = _cut(batch.column(0), parts), _rows(batch.column(1), np.uint8).reshape(batch.num_rows, parts)
                for p in range(parts):
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    for c in range(width):                                   # 2^26 * 8192 rows: exact in doubles
                        s[p, :, c] += np.bincount(code[:, p], x[:, p, c], minlength=entries).astype(np.int64)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]),
                                              pa.array(list(s[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    each = coded.select("v", "code").mapInArrow(run, "part int, entry int, n long, s array<long>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("s")[c].cast("decimal(38,0)")) for c in range(width)]).alias("s"))
    return {(r["part"], r["entry"]): (r["n"], r["s"]) for r in total.collect()}


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
             id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[Column | str, ...] = ()) -> tuple[DataFrame, Books | None]:
    """(id, kept, v, code, error, scanned) of the vectors that take part, and the codebooks.  ``kept``
    is a struct of the columns ``keep``, ``code`` one byte a part, ``error`` the squared distance
    summed over the parts; ``scanned`` counts exact distances (a total at the first row of a chunk)."""
    if not 1 <= entries <= 256 or rounds > 255:
        raise ValueError("a code has one byte a part: at most 256 entries, and at most 255 rounds")
    spark = vectors.sparkSession
    kept = F.struct(F.lit(0).alias("_"), *keep).alias("kept")
    rows = quantised(vectors, scale, CLIP, id_col, vec_col, kept)
    dim = usual_length(rows)
    if dim is None:
        return spark.createDataFrame([], rows.schema).select("*", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"),
                                                             F.lit(0).cast("long").alias("scanned")), None
    rows = rows.where(F.size("v") == dim)
    start = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    first = _cut(start["v"].combine_chunks(), parts)
    books, path = Books([first[:, p] for p in range(parts)]), None
    for k in range(rounds + 1):
        before, path = path, shared_path(spark, f"codes-{k}")
        rows = _assigned(rows, books, parts, path)
        if before:
            removed(spark, before)                                           # the new table holds all that it held
        if k < rounds:
            books.update(_sums(rows, parts, first.shape[0], first.shape[2]))
    return rows.drop("state"), books


def with_totals(coded: DataFrame, key: Column, value: str, name: str) -> DataFrame:
    """``coded`` with the total of ``value`` over equal ``key`` (nulls together; null if it exceeds a
    long).  Few totals are broadcast; many are joined, every one of them in ``COPIES`` copies, so
    that a key with a large share of the rows is spread."""
    totals = coded.groupBy(key.alias("_key")).agg(F.try_sum(value).alias(name))
    rows = coded.withColumn("_key", key)
    if totals.count() <= TOTALS:
        same = F.broadcast(totals.withColumnRenamed("_key", "_of"))
        return rows.join(same, F.col("_key").eqNullSafe(F.col("_of")), "left").drop("_key", "_of")
    spread = totals.withColumnRenamed("_key", "_of").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(COPIES)).cast("int"))
    return rows.join(spread, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_copy")), "left").drop("_key", "_of", "_salt", "_copy")
