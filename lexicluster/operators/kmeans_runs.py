"""k-means with many restarts advanced together (ML-6 at scale).

Every Lloyd iteration is ONE pass over the rows for all runs (trials × restarts): each task
computes the distances to all R·K broadcast centres in one matrix product per block of rows and
emits per-(run, cluster) partial sums; they are added up in two levels, by (run, cluster, salt) and
by (run, cluster), so that no reducer meets a row of every task.  Where all of them are few (at most
``COLLECTED`` numbers) the driver adds them up, and the pass needs no shuffle.  Where the dense rows
themselves are few (at most ``HELD`` times that) a pass would cost more than its work: then the rows go round
once, and a task takes a run from its draws to its end, with the same draws and steps.

Seeding is k-means|| for every run at once, in a number of passes that doesn't depend on K: after a
first row, each of ``ROUNDS`` passes draws 2·K further rows per run with probability ∝ D² by the
exponential-key method (the smallest −ln(u)/D², u a per-(seed, run, row, step) hash), so the draw
is exact, distributed and reproducible; a last pass weighs the drawn rows by their neighbours, and
weighted k-means++ on these few rows gives the centres to start from.  Rows may be dense
(ARRAY<DOUBLE>) or sparse (index / value arrays); sparse rows cross into Python as their non-zeros only.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

ROUNDS, SALTS, CELLS = 3, 32, 1 << 21
#: Distances (rows × centres of all runs) that are held at once: they stay in a core's cache.
NEAR = 1 << 18
#: Distances of a pass from which on rows that lie in a few partitions are spread over all cores.
SPREAD = 1 << 20
#: Numbers of a pass's partial sums up to which they come to the driver without a shuffle, and how many times as many
#: numbers the rows may have that every task holds whole.
COLLECTED, HELD = 1 << 20, 4


def sparse_parts(df: DataFrame, vec_col: str, idx_col: str = "idx", val_col: str = "val") -> DataFrame:
    """ML vector → non-zero (index, value) arrays, computed JVM-side once."""
    nz = F.filter(F.transform(vector_to_array(F.col(vec_col)), lambda v, i: F.struct(i.alias("i"), v.alias("v"))),
                  lambda s: s["v"] != 0.0)
    return df.withColumn("_nz", nz).withColumn(idx_col, F.col("_nz.i")).withColumn(val_col, F.col("_nz.v")).drop("_nz")


def _uniform(seed: int, run: int, step: int, ids: np.ndarray) -> np.ndarray:
    """Deterministic U(0,1) per (seed, run, step, row id) from a 64-bit mix of the id."""
    salt = int.from_bytes(hashlib.blake2b(f"{seed}-{run}-{step}".encode(), digest_size=8).digest(), "little")
    z = (ids.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class _Rows:
    """Blocks of rows of Arrow batches: dense matrices of at most ``CELLS`` cells, or the non-zeros alone
    where a block of dense rows would be a few rows only."""

    def __init__(self, id_col, x_col, idx_col, val_col, dim):
        self.dim, self.sparse = dim, x_col is None
        self.cols = [id_col] + ([idx_col, val_col] if self.sparse else [x_col])

    def blocks(self, batches):
        """(ids, rows) of every block."""
        for b in batches:
            step = max(1, CELLS // self.dim) if self.dim <= CELLS >> 6 else 4096
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                n, ids = part.num_rows, part.column(0).to_numpy(zero_copy_only=False)
                if not self.sparse:
                    yield ids, _Dense(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))
                    continue
                lens = np.diff(part.column(1).offsets.to_numpy())
                row = np.repeat(np.arange(n), lens)
                col = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                val = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if self.dim <= CELLS >> 6:
                    X = np.zeros((n, self.dim))
                    X[row, col] = val
                    yield ids, _Filled(X, row, col, val)
                else:
                    yield ids, _Sparse(n, self.dim, row, col, val)


class _Dense:
    def __init__(self, X):
        self.X, self.n = X, len(X)

    def sq(self):
        return (self.X * self.X).sum(1)

    def dot(self, C):
        return self.X @ C.T

    def parts(self, step):
        return (_Dense(self.X[a:a + step]) for a in range(0, self.n, step))

    def sums(self, j, K):
        """Per (run, cluster) the sum of the rows: ``j`` holds the cluster of each row in each run."""
        R = j.shape[1]
        out = np.zeros((R * K, self.X.shape[1]))
        step, runs = max(16, NEAR // max(1, R * K)), np.arange(R) * K
        for a in range(0, self.n, step):
            X, at = self.X[a:a + step], j[a:a + step] + runs
            onehot = np.zeros((len(X), R * K))
            onehot[np.arange(len(X))[:, None], at] = 1.0
            out += onehot.T @ X
        return out.reshape(R, K, -1)

    def colsum(self):
        return self.X.sum(0), (self.X * self.X).sum(0)

    def dense(self):
        return self.X


class _Filled(_Dense):
    """Sparse rows written out: one matrix product gives the distances, while the sums take the non-zeros alone."""

    def __init__(self, X, r, c, v):
        super().__init__(X)
        self.d, self.r, self.c, self.v = X.shape[1], r, c, v

    def sums(self, j, K):
        return _cell_sums(self, j, K)


def _cell_sums(X, j, K):
    return np.stack([np.bincount(j[X.r, t] * X.d + X.c, X.v, minlength=K * X.d).reshape(K, X.d) for t in range(j.shape[1])])


class _Sparse:
    def __init__(self, n, d, r, c, v):
        self.n, self.d, self.r, self.c, self.v = n, d, r, c, v

    def parts(self, step):
        return (self,)                                           # a block has few rows as it is

    def sq(self):
        return np.bincount(self.r, self.v * self.v, minlength=self.n)

    def dot(self, C):
        return np.stack([np.bincount(self.r, row[self.c] * self.v, minlength=self.n) for row in C], 1)

    def sums(self, j, K):
        return _cell_sums(self, j, K)

    def colsum(self):
        return np.bincount(self.c, self.v, minlength=self.d), np.bincount(self.c, self.v * self.v, minlength=self.d)

    def dense(self):
        out = np.zeros((self.n, self.d))
        out[self.r, self.c] = self.v
        return out


def _nearest(X, C):
    """Of rows X to the centres C (runs × K × D) of each run: nearest centre and squared distance (n × runs)."""
    R, K, D = C.shape
    flat, base = C.reshape(R * K, D) * -2.0, (C * C).sum(2).ravel()
    j, best, at = np.empty((X.n, R), np.int64), np.empty((X.n, R)), 0
    for part in X.parts(max(16, NEAR // max(1, R * K))):
        d = part.dot(flat)
        d += base
        d = d.reshape(part.n, R, K)
        rows = slice(at, at + part.n)
        j[rows] = d.argmin(2)
        best[rows] = np.take_along_axis(d, j[rows][:, :, None], 2)[:, :, 0]
        at += part.n
    best += X.sq()[:, None]
    return j, np.maximum(best, 0.0, out=best)


def _lists(M: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(M) + 1, dtype=np.int32) * M.shape[1]), pa.array(np.ascontiguousarray(M).ravel()))


def _padded(cands: list[np.ndarray]) -> np.ndarray:
    """Candidates of all runs as one array; a run with fewer repeats its first."""
    most = max(len(c) for c in cands)
    return np.stack([np.concatenate([c, np.repeat(c[:1], most - len(c), axis=0)]) for c in cands])


def _seed(data: DataFrame, dec: _Rows, k: int, R: int, seed: int) -> np.ndarray:
    """Centres to start from (runs × k × D)."""
    spark, id_col = data.sparkSession, dec.cols[0]
    kind = dict(data.dtypes)[id_col]
    cands: list[np.ndarray] = [np.zeros((0, dec.dim))] * R

    def drawn(step: int, take: int) -> None:
        """Add ``take`` rows to the candidates of each run."""
        sent = spark.sparkContext.broadcast(_padded(cands) if step else None)

        def draw(batches):
            best = None                                                      # per run the smallest keys and their ids
            for ids, X in dec.blocks(batches):
                u = np.stack([_uniform(seed, r, step, ids) for r in range(R)], 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    key = u if sent.value is None else -np.log(u) / _nearest(X, sent.value)[1]
                key = np.where(np.isfinite(key), key, np.inf)
                rid = np.repeat(ids[:, None], R, axis=1)
                if best is not None:
                    key, rid = np.concatenate([best[0], key]), np.concatenate([best[1], rid])
                at = np.argsort(key, axis=0, kind="stable")[:take]
                best = np.take_along_axis(key, at, 0), np.take_along_axis(rid, at, 0)
            if best is not None:
                i, run = np.nonzero(np.isfinite(best[0]))
                yield pa.RecordBatch.from_arrays([pa.array(run.astype(np.int32)), pa.array(best[0][i, run]), pa.array(best[1][i, run])],
                                                 names=["run", "key", "rid"])

        rank = F.row_number().over(Window.partitionBy("run").orderBy("key", "rid"))
        picks = data.mapInArrow(draw, f"run int, key double, rid {kind}").withColumn("_r", rank).where(F.col("_r") <= take).select("run", "rid").collect()
        sent.destroy()
        # At most R · take ids; their rows come by a broadcast join.
        wanted = spark.createDataFrame([(p["rid"],) for p in picks], f"`{id_col}` {kind}").distinct()
        found = data.join(F.broadcast(wanted), id_col).select(dec.cols).dropDuplicates([id_col]).toArrow()
        rows = {}
        for ids, X in dec.blocks(found.to_batches()):
            rows |= dict(zip(ids.tolist(), X.dense()))
        for p in sorted(picks):
            cands[p["run"]] = np.concatenate([cands[p["run"]], rows[p["rid"]][None]])

    drawn(0, 1)
    for step in range(1, ROUNDS + 1 if k > 1 else 1):
        drawn(step, 2 * k)
    if not len(cands[0]):
        return np.zeros((R, k, dec.dim))
    every = _padded(cands)
    sent = spark.sparkContext.broadcast(every)

    def weigh(batches):
        n = np.zeros(every.shape[:2], np.int64)
        for _, X in dec.blocks(batches):
            j, _ = _nearest(X, sent.value)
            for r in range(R):
                n[r] += np.bincount(j[:, r], minlength=n.shape[1])
        r, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n[r, c])], names=["run", "c", "n"])

    weight = np.zeros(every.shape[:2])
    for row in data.mapInArrow(weigh, "run int, c int, n long").groupBy("run", "c").agg(F.sum("n").alias("n")).collect():
        weight[row["run"], row["c"]] = row["n"]
    sent.destroy()
    return np.stack([_weighted_start(every[r], weight[r], k, np.random.default_rng([seed, r])) for r in range(R)])


def _weighted_start(X: np.ndarray, w: np.ndarray, k: int, rng, iterations: int = 20) -> np.ndarray:
    """k centres of a few weighted rows: weighted k-means++ and Lloyd iterations."""
    C = [X[rng.choice(len(X), p=w / w.sum())]]
    d = ((X - C[0]) ** 2).sum(1)
    while len(C) < k:
        p = w * d
        # Fewer distinct rows than centres: the last centre is repeated.
        C.append(X[rng.choice(len(X), p=p / p.sum())] if p.sum() > 0 else C[-1])
        d = np.minimum(d, ((X - C[-1]) ** 2).sum(1))
    C = np.array(C)
    for _ in range(iterations):
        j = ((X * X).sum(1)[:, None] - 2 * X @ C.T + (C * C).sum(1)).argmin(1)
        n = np.bincount(j, w, minlength=k)
        total = np.zeros_like(C)
        np.add.at(total, j, X * w[:, None])
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1e-300)[:, None], C)
        if np.allclose(new, C):
            break
        C = new
    return C


def _draws(ids: np.ndarray, X: np.ndarray, sq: np.ndarray, k: int, run: int, seed: int) -> np.ndarray:
    """The start of one run, as ``_seed`` draws it, over rows that are held whole."""
    best, near, cands = np.full(len(X), np.inf), np.zeros(len(X), np.int64), np.zeros((0, X.shape[1]))
    for step in range(ROUNDS + 1 if k > 1 else 1):
        u = _uniform(seed, run, step, ids)
        with np.errstate(divide="ignore", invalid="ignore"):
            key = -np.log(u) / best if step else u
        at, take = np.flatnonzero(np.isfinite(key)), 2 * k if step else 1
        if len(at) > take:
            at = at[key[at] <= np.partition(key[at], take - 1)[take - 1]]
        at = at[np.lexsort((ids[at], key[at]))[:take]]
        new = X[at[np.argsort(ids[at], kind="stable")]]
        for a in range(0, len(X) if len(new) else 0, HELD_ROWS):
            rows = slice(a, a + HELD_ROWS)
            d = X[rows] @ (new.T * -2.0) + (new * new).sum(1)
            j = d.argmin(1)
            d = np.maximum(np.take_along_axis(d, j[:, None], 1)[:, 0] + sq[rows], 0.0)
            closer = d < best[rows]
            best[rows], near[rows] = np.where(closer, d, best[rows]), np.where(closer, len(cands) + j, near[rows])
        cands = np.concatenate([cands, new])
    return _weighted_start(cands, np.bincount(near, minlength=len(cands)).astype(float), k, np.random.default_rng([seed, run]))


#: Rows whose distances are taken together where all rows are held.
HELD_ROWS = 2048


def _whole_run(ids: np.ndarray, X: np.ndarray, sq: np.ndarray, mean: np.ndarray, X32: np.ndarray, sq32: np.ndarray, k: int, run: int, seed: int,
               max_iter: int, tol_abs: float):
    """(centres, inertia, iterations) of one run.  A row keeps how far its centre is at most and any other at least: as
    long as the moves since can't have changed which is nearer, the row is not looked at (Hamerly's bounds).  The
    others are looked at in single precision (``X32``: the rows less their mean); where its rounding leaves open which centre is
    nearest, the distances in double precision decide.  The sums follow the rows that change."""
    C, (n, dim) = _draws(ids, X, sq, k, run, seed), X.shape
    j, up, low = np.full(n, -1), np.full(n, np.inf), np.full(n, -np.inf)
    sums, cnt, it = np.zeros((k, dim)), np.zeros(k, np.int64), 0
    for it in range(1, max_iter + 1):
        flat, base, near = C.T * -2.0, (C * C).sum(1), C - mean
        flat32, base32 = (near.T * -2.0).astype(np.float32), (near * near).sum(1)
        wrong = 1.2e-7 * (dim + 8) * (sq32 + base32.max())                     # a bound of the rounding, twice over
        look = np.flatnonzero(up >= low)
        for a in range(0, len(look), HELD_ROWS):
            at = look[a:a + HELD_ROWS]
            if it > 1:
                d = (X32.take(at, 0) @ flat32).T.copy()
                d += base32[:, None].astype(np.float32)
                own, every = j[at], np.arange(len(at))
                first = d[own, every].astype(np.float64)
                d[own, every] = np.inf
                second = d.min(0).astype(np.float64)
                up[at] = np.sqrt(np.maximum(first + sq32[at] + wrong[at], 0.0))
                low[at] = np.sqrt(np.maximum(second + sq32[at] - wrong[at], 0.0))
                at = at[second - first <= 2.0 * wrong[at]]
            if not len(at):
                continue
            rows, every = X[at], np.arange(len(at))
            d = rows @ flat + base
            now = d.argmin(1)
            near_by = d[every, now]
            d[every, now] = np.inf
            up[at] = np.sqrt(np.maximum(near_by + sq[at], 0.0) + 1e-14 * (sq[at] + base.max()))
            low[at] = np.sqrt(np.maximum(d.min(1) + sq[at] - 1e-14 * (sq[at] + base.max()), 0.0))
            other = np.flatnonzero(now != j[at])
            was, now = j[at[other]], now[other]
            had = np.flatnonzero(was >= 0)
            turn = np.zeros((len(other), k))
            turn[np.arange(len(other)), now] = 1.0
            turn[had, was[had]] -= 1.0
            sums += turn.T @ rows[other]
            cnt += np.bincount(now, minlength=k) - np.bincount(was[had], minlength=k)
            j[at[other]] = now
        new = np.where(cnt[:, None] > 0, sums / np.maximum(cnt, 1)[:, None], C)
        move, C, last = np.sqrt(((new - C) ** 2).sum(1)), new, C
        if (move * move).sum() <= tol_abs:
            break
        up += move[j]
        # The centres that a row does not belong to have moved by the most of all, or of all but its own.
        order = np.argsort(move)
        low -= np.where(j == order[-1], move[order[-2]] if k > 1 else 0.0, move[order[-1]])
    cost = sum(float(((X[a:a + HELD_ROWS] - last[j[a:a + HELD_ROWS]]) ** 2).sum()) for a in range(0, n, HELD_ROWS))
    return C, cost, it


def _held_runs(data: DataFrame, dec: _Rows, k: int, R: int, seed: int, max_iter: int, tol_abs: float):
    """What ``kmeans_runs`` returns, of rows that are few: a task has all of them and takes whole runs."""
    spark, dim = data.sparkSession, dec.dim
    parts = [(ids, X.dense()) for ids, X in dec.blocks(data.select(dec.cols).toArrow().to_batches())]      # at most HELD · COLLECTED numbers
    ids, X = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((X[:, 0], ids))
    sent = spark.sparkContext.broadcast((ids[order], X[order]))

    def solve(batches):
        ids, X = sent.value
        mean = X.mean(0)
        sq, X32, sq32 = (X * X).sum(1), (X - mean).astype(np.float32), ((X - mean) ** 2).sum(1)
        for b in batches:
            for run in b.column(0).to_pylist():
                C, cost, n = _whole_run(ids, X, sq, mean, X32, sq32, k, run, seed, max_iter, tol_abs)
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([cost]), pa.array([n]), _lists(C.reshape(1, -1))], names=["run", "cost", "n", "c"])

    tasks = min(R, 8 * spark.sparkContext.defaultParallelism)
    got = spark.range(0, R, 1, tasks).mapInArrow(solve, "run long, cost double, n long, c array<double>").toArrow().combine_chunks()
    sent.destroy()
    at = np.argsort(got["run"].to_numpy())
    C = got["c"].combine_chunks().flatten().to_numpy().reshape(R, k, dim)[at]
    return C, got["cost"].to_numpy()[at], int(max(got["n"].to_numpy(), default=0))


def kmeans_runs(df: DataFrame, k: int, n_runs: int, id_col: str = "id", x_col: str | None = "x",
                idx_col: str | None = None, val_col: str | None = None, dim: int | None = None,
                seed: int = 0, max_iter: int = 300, tol: float = 1e-4):
    """Run ``n_runs`` independent k-means (k-means|| seeding, Lloyd) over the same rows.
    Returns (centres[R][K][D], inertia[R], iterations)."""
    spark = df.sparkSession
    cols = [id_col] + ([x_col] if x_col else [idx_col, val_col])
    data = df.select(*cols).persist()
    if dim is None:
        # All partitions: the first row alone would make a whole one of them, in one task.
        dim = data.agg(F.max(F.size(x_col))).first()[0]
    dec = _Rows(id_col, x_col, idx_col, val_col, dim)
    R = n_runs

    # tolerance relative to the mean per-feature variance, as in the common k-means definition
    def moments(batches):
        s, s2, n = np.zeros(dim), np.zeros(dim), 0
        for _, X in dec.blocks(batches):
            a, b = X.colsum()
            s += a
            s2 += b
            n += X.n
        yield pa.RecordBatch.from_arrays([_lists(s[None]), _lists(s2[None]), pa.array([n], pa.int64())], names=["s", "s2", "n"])
    mom = data.mapInArrow(moments, "s array<double>, s2 array<double>, n long") \
        .select(array_to_vector("s").alias("s"), array_to_vector("s2").alias("s2"), "n") \
        .agg(Summarizer.sum(F.col("s")).alias("s"), Summarizer.sum(F.col("s2")).alias("s2"), F.sum("n").alias("n"), F.count("*").alias("tasks")).first()
    n_tot, s, s2 = mom["n"], mom["s"].toArray(), mom["s2"].toArray()
    var = s2 / max(n_tot, 1) - (s / max(n_tot, 1)) ** 2
    tol_abs = tol * float(np.mean(var))
    if x_col is not None and R and max_iter and 0 < n_tot * dim <= HELD * COLLECTED:
        out = _held_runs(data, dec, k, R, seed, max_iter, tol_abs)
        data.unpersist()
        return out

    tasks, cores = mom["tasks"], spark.sparkContext.defaultParallelism
    if tasks < cores and n_tot * R * k > SPREAD:
        # Small files hold rows for many seconds of work: they are dealt to all cores once.
        few, data = data, data.repartition(cores).persist()
        tasks = cores
        data.count()
        few.unpersist()
    C = _seed(data, dec, k, R, seed)                  # R × K × D
    active = np.arange(R)
    inertia = np.zeros(R)
    it_done = 0
    for it_done in range(1, max_iter + 1):
        sent = spark.sparkContext.broadcast(C[active])

        def step_fn(batches, sent=sent):
            Cs = sent.value
            sums, cnt, cost = np.zeros_like(Cs), np.zeros(Cs.shape[:2]), np.zeros(len(Cs))
            for _, X in dec.blocks(batches):
                j, d2 = _nearest(X, Cs)
                sums += X.sums(j, k)
                cnt += np.stack([np.bincount(j[:, r], minlength=k) for r in range(len(Cs))])
                cost += d2.sum(0)
            # A row a run: cost, rows of each cluster, their sums.
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(Cs), dtype=np.int32)), _lists(np.hstack([cost[:, None], cnt, sums.reshape(len(Cs), -1)]))],
                                             names=["run", "s"])

        total = data.mapInArrow(step_fn, "run int, s array<double>")
        if tasks * len(active) * (1 + k + k * dim) > COLLECTED:
            total = total.withColumn("s", array_to_vector("s")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
            # With few tasks a run's rows are as few, and one level is enough.
            for keys in (["run", "salt"], ["run"]) if tasks > SALTS else (["run"],):
                total = total.groupBy(*keys).agg(Summarizer.sum(F.col("s")).alias("s"))
            total = total.select("run", vector_to_array("s").alias("s"))
        rows = total.toArrow()                    # a row a run, or one a run and task
        sent.destroy()
        sums = np.zeros((len(active), 1 + k + k * dim))
        for b in rows.to_batches():
            np.add.at(sums, b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
        cost, cnt, at = sums[:, 0], sums[:, 1:k + 1, None], sums[:, k + 1:].reshape(-1, k, dim)
        new = np.where(cnt > 0, at / np.maximum(cnt, 1), C[active])
        shift = ((new - C[active]) ** 2).sum((1, 2))
        inertia[active], C[active] = cost, new
        active = active[shift > tol_abs]
        if not len(active):
            break
    data.unpersist()
    return C, inertia, it_done


def assign_runs(df: DataFrame, centers: np.ndarray, run_ids: list[int], id_col: str = "id", x_col: str | None = "x",
                idx_col=None, val_col=None, dim: int | None = None, keep=()) -> DataFrame:
    """(run, id, keep…, pred) for the given runs' centres: one pass, a matrix product per block of rows."""
    centers, run_ids, keep = np.asarray(centers), list(run_ids), list(keep)
    dec = _Rows(id_col, x_col, idx_col, val_col, dim or centers.shape[2])
    sub = df.select(*dec.cols, *keep)
    kinds = dict(sub.dtypes)
    sent = df.sparkSession.sparkContext.broadcast(centers)

    def fn(batches):
        for b in batches:
            at = 0
            for ids, X in dec.blocks([b]):
                part = b.slice(at, X.n)
                at += X.n
                j, _ = _nearest(X, sent.value)
                for r, run in enumerate(run_ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(X.n, run, np.int32)), part.column(0), *part.columns[len(dec.cols):],
                                                      pa.array(j[:, r].astype(np.int32))], names=["run", id_col, *keep, "pred"])

    fields = ["run int", *(f"`{c}` {kinds[c]}" for c in (id_col, *keep)), "pred int"]
    return sub.mapInArrow(fn, ", ".join(fields))
