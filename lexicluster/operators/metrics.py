"""Cluster evaluation (AGG-1, AGG-16, EVAL-1…5).

Everything sized by N stays in DataFrames; only the per-run K×K contingency table (bounded by
the number of clusters and classes) reaches the driver, for the one-to-one matching.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency_table(df: DataFrame, pred_col: str = "pred", label_col: str = "label", by=()) -> DataFrame:
    """AGG-1: (by…, pred, label, n) for non-empty cells (partial+final hash aggregate).  Rows that are
    cells already bring their counts in ``_cell_n``."""
    n = F.sum("_cell_n") if "_cell_n" in df.columns else F.count(F.lit(1))
    return df.groupBy(*by, F.col(pred_col).alias("pred"), F.col(label_col).alias("label")).agg(n.alias("n"))


def counted_cells(spark: SparkSession, tables: list) -> DataFrame:
    """Contingency tables of several runs as one table of cells, which the scores take in place of rows: ``run`` is a
    table's position, ``_cell_n`` its counts."""
    every = pa.concat_tables([t.append_column("run", pa.array(np.full(t.num_rows, i, np.int32))) for i, t in enumerate(tables)])
    return spark.createDataFrame(every.rename_columns({"n": "_cell_n"}))


def dense_contingency(df: DataFrame, pred_col="pred", label_col="label", by=()) -> DataFrame:
    """AGG-1 densified: D×D cells with D = max(pred, label) + 1, zero-filled (bounded by D²)."""
    ct = contingency_table(df, pred_col, label_col, by)
    d = ct.groupBy(*by).agg(F.greatest(F.max("pred"), F.max("label")).alias("dmax"))
    grid = (d.select(*by, F.explode(F.sequence(F.lit(0), F.col("dmax"))).alias("pred"), "dmax")
             .select(*by, "pred", F.explode(F.sequence(F.lit(0), F.col("dmax"))).alias("label")))
    return (grid.join(ct, [*by, "pred", "label"], "left")
                .select(*by, "pred", "label", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def hungarian_max(w: list[list[float]]) -> tuple[float, list[int]]:
    """Maximum-weight perfect matching on a square matrix (Kuhn–Munkres, O(n³)).
    Returns (total, assignment) where assignment[row] = column."""
    n = len(w)
    if n == 0:
        return 0.0, []
    big = max(max(r) for r in w)
    cost = [[big - v for v in r] for r in w]
    INF = float("inf")
    u, v = [0.0] * (n + 1), [0.0] * (n + 1)
    p, way = [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        p[0] = i
        j0 = 0
        minv = [INF] * (n + 1)
        used = [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], INF, 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < minv[j]:
                        minv[j], way[j] = cur, j0
                    if minv[j] < delta:
                        delta, j1 = minv[j], j
            for j in range(n + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    minv[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while True:
            j1 = way[j0]
            p[j0] = p[j1]
            j0 = j1
            if j0 == 0:
                break
    assign = [0] * n
    for j in range(1, n + 1):
        if p[j]:
            assign[p[j] - 1] = j - 1
    return sum(w[i][assign[i]] for i in range(n)), assign


def _matchings(df: DataFrame, pred_col, label_col, by):
    """Per run: the K×K table to the driver (bounded), Hungarian matching there."""
    ct = contingency_table(df, pred_col, label_col, by).collect()
    runs: dict = {}
    for r in ct:
        key = tuple(r[b] for b in by)
        runs.setdefault(key, []).append((r["pred"], r["label"], r["n"]))
    out = {}
    for key, cells in runs.items():
        d = max(max(p, l) for p, l, _ in cells) + 1
        w = [[0.0] * d for _ in range(d)]
        total = 0
        for p, l, n in cells:
            w[p][l] = float(n)
            total += n
        best, assign = hungarian_max(w)
        out[key] = (best, total, assign)
    return out


def clustering_accuracy(df: DataFrame, pred_col: str = "pred", label_col: str = "label", by=()) -> DataFrame:
    """EVAL-1: best one-to-one cluster↔label matching / N, per run."""
    spark: SparkSession = df.sparkSession
    m = _matchings(df, pred_col, label_col, list(by))
    schema = ", ".join([f"{b} {dict(df.dtypes)[b]}" for b in by] + ["acc double"])
    rows = [(*k, best / total) for k, (best, total, _) in m.items()]
    return spark.createDataFrame(rows, schema)


def align_labels(df: DataFrame, pred_col: str = "pred", label_col: str = "label", by=()) -> DataFrame:
    """EVAL-2: the matched (pred → label) pairs per run, to join back onto predictions."""
    spark: SparkSession = df.sparkSession
    m = _matchings(df, pred_col, label_col, list(by))
    schema = ", ".join([f"{b} {dict(df.dtypes)[b]}" for b in by] + ["pred int", "aligned_label int"])
    rows = [(*k, p, l) for k, (_, _, assign) in m.items() for p, l in enumerate(assign)]
    return spark.createDataFrame(rows, schema)


def _entropy_parts(df: DataFrame, pred_col, label_col, by):
    ct = contingency_table(df, pred_col, label_col, by)
    n = ct.groupBy(*by).agg(F.sum("n").alias("n_total"))
    a = ct.groupBy(*by, "label").agg(F.sum("n").alias("a"))
    b = ct.groupBy(*by, "pred").agg(F.sum("n").alias("b"))
    return ct, n, a, b


def mutual_information_stats(df: DataFrame, pred_col: str = "pred", label_col: str = "label", by=()) -> DataFrame:
    """MI, H(label), H(pred), numbers of classes/clusters and N per run (natural log)."""
    df, by, done = _keyed(df, by)
    ct, n, a, b = _entropy_parts(df, pred_col, label_col, by)
    cells = ct.join(n, by).join(a, by + ["label"]).join(b, by + ["pred"])
    mi = cells.groupBy(*by).agg(F.sum(F.col("n") / F.col("n_total") * F.log(F.col("n_total") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    ha = a.join(n, by).groupBy(*by).agg(
        (-F.sum(F.col("a") / F.col("n_total") * F.log(F.col("a") / F.col("n_total")))).alias("h_label"),
        F.count(F.lit(1)).alias("n_labels"))
    hb = b.join(n, by).groupBy(*by).agg(
        (-F.sum(F.col("b") / F.col("n_total") * F.log(F.col("b") / F.col("n_total")))).alias("h_pred"),
        F.count(F.lit(1)).alias("n_preds"))
    return done(mi.join(ha, by).join(hb, by).join(n, by))


def _keyed(df: DataFrame, by):
    """Metrics are computed per run; without run columns a constant key stands in."""
    by = list(by)
    if by:
        return df, by, lambda out: out
    return df.withColumn("_run", F.lit(0)), ["_run"], lambda out: out.drop("_run")


def normalized_mutual_information(df: DataFrame, pred_col="pred", label_col="label", by=(),
                                  average: str = "geometric") -> DataFrame:
    """EVAL-3: MI / mean(H_label, H_pred); both single-valued → 1."""
    df, by, done = _keyed(df, by)
    s = mutual_information_stats(df, pred_col, label_col, by)
    norm = _average(F.col("h_label"), F.col("h_pred"), average)
    nmi = (F.when((F.col("n_labels") == 1) & (F.col("n_preds") == 1), F.lit(1.0))
             .when(F.col("mi") <= 0, F.lit(0.0))
             .otherwise(F.col("mi") / F.greatest(norm, F.lit(1e-300))))
    return done(s.select(*by, nmi.alias("nmi")))


def _average(h1, h2, how):
    if how == "geometric":
        return F.sqrt(h1 * h2)
    if how == "arithmetic":
        return (h1 + h2) / 2
    if how == "max":
        return F.greatest(h1, h2)
    if how == "min":
        return F.least(h1, h2)
    raise ValueError(how)


def _log_ratio(m: float, d: np.ndarray) -> np.ndarray:
    """ln((m + d)! / m!) − d·ln m by Stirling's series, accurate for |d| much smaller than m."""
    u = d / m
    # (1 + u) ln(1 + u) − u without cancellation
    series = sum((-1.0) ** k * u ** k / (k * (k - 1)) for k in range(2, 12))
    grown = np.where(np.abs(u) < 0.02, series, (1 + u) * np.log1p(u) - u)
    stirling = lambda x: 1 / (12 * x) - 1 / (360 * x ** 3)
    return m * grown + 0.5 * np.log1p(u) + stirling(m + d) - stirling(m)


def expected_cell(a: int, b: int, n: int) -> float:
    """Σ p(x)·x/n·ln(n·x/(a·b)) over the hypergeometric x of two marginals.  Only terms around the mode
    count in double precision: for a narrow distribution all of them, by the recurrence of p; a wide
    one is summed at every (σ/16)th x, which is as exact (the trapezoid rule on a smooth bell), so
    that the cost doesn't grow with n."""
    low, high = max(0, a + b - n), min(a, b)
    if low == high:
        return low / n * math.log(n * low / (a * b)) if low else 0.0
    sigma = math.sqrt(a * b / n * ((n - a) / n) * ((n - b) / max(1, n - 1)))
    mode = min(max((a + 1) * (b + 1) // (n + 2), low), high)
    step, reach = max(1, int(sigma / 16)), int(12 * sigma) + 80
    d = step * np.arange(-(min(reach, mode - low) // step), min(reach, high - mode) // step + 1, dtype=np.float64)
    x = mode + d
    if step == 1:
        y = x[:-1]
        up = np.log((a - y) * (b - y) / ((y + 1) * (n - a - b + y + 1)))           # ln p(x + 1) − ln p(x)
        logp = np.concatenate([[0.0], np.cumsum(up)])
    else:
        rest = n - a - b + mode
        logp = -_log_ratio(mode, d) - _log_ratio(a - mode, -d) - _log_ratio(b - mode, -d) - _log_ratio(rest, d) \
            - d * math.log(mode / (a - mode) * (rest / (b - mode)))
    p = np.exp(logp - logp.max())
    mean = a * b / n
    value = np.where(x > 0, x / n * np.log1p((np.maximum(x, 1) - mean) / mean), 0.0)
    return float((p * value).sum() / p.sum())


def expected_mutual_information(df: DataFrame, pred_col="pred", label_col="label", by=()) -> DataFrame:
    """E[MI] under the hypergeometric model: one term per (class, cluster) pair of marginals, at most
    K² a run, each at a cost that doesn't depend on the number of rows."""
    df, by, done = _keyed(df, by)
    ct, n, a, b = _entropy_parts(df, pred_col, label_col, by)
    ab = a.join(b, by).join(n, by).select(*by, F.col("a").cast("long"), F.col("b").cast("long"), F.col("n_total").cast("long"))

    def cells(it):
        for pdf in it:
            out = pdf[by].copy()
            out["term"] = [expected_cell(int(x), int(y), int(z)) for x, y, z in zip(pdf["a"], pdf["b"], pdf["n_total"])]
            yield out

    kinds = dict(ab.dtypes)
    terms = ab.mapInPandas(cells, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", term double")
    return done(terms.groupBy(*by).agg(F.sum("term").alias("emi")))


def adjusted_mutual_information(df: DataFrame, pred_col="pred", label_col="label", by=(),
                                average: str = "max") -> DataFrame:
    """EVAL-4: (MI − E[MI]) / (mean(H_label, H_pred) − E[MI]); both single-valued → 1."""
    df, by, done = _keyed(df, by)
    s = mutual_information_stats(df, pred_col, label_col, by)
    e = expected_mutual_information(df, pred_col, label_col, by)
    j = s.join(e, by)
    den = _average(F.col("h_label"), F.col("h_pred"), average) - F.col("emi")
    den = F.when(den < 0, F.least(den, F.lit(-2.220446049250313e-16))).otherwise(F.greatest(den, F.lit(2.220446049250313e-16)))
    ami = F.when((F.col("n_labels") == 1) & (F.col("n_preds") == 1), F.lit(1.0)).otherwise((F.col("mi") - F.col("emi")) / den)
    return done(j.select(*by, ami.alias("ami")))


def label_accuracy(df: DataFrame, pred_col="pred", label_col="label", by=()) -> DataFrame:
    """EVAL-5: share of rows with pred == label."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col(pred_col) == F.col(label_col), 1.0).otherwise(0.0)).alias("label_acc"))


def label_change_rate(prev: DataFrame, cur: DataFrame, id_col="id", pred_col="pred") -> DataFrame:
    """AGG-16: share of rows whose assignment changed between two snapshots (join on id)."""
    j = prev.select(id_col, F.col(pred_col).alias("_a")).join(cur.select(id_col, F.col(pred_col).alias("_b")), id_col)
    return j.agg(F.avg(F.when(F.col("_a") != F.col("_b"), 1.0).otherwise(0.0)).alias("change_rate"))


def cluster_scores(df: DataFrame, pred_col="pred", label_col="label", by=()) -> DataFrame:
    """acc, nmi, ami per run (EVAL-1/3/4 together)."""
    df, by, done = _keyed(df, by)
    # The K×K tables of the runs are counted once; the three scores start from them.
    ct = contingency_table(df, pred_col, label_col, by).withColumnRenamed("n", "_cell_n")
    cells = df.sparkSession.createDataFrame(ct.collect(), ct.schema).coalesce(1)
    acc = clustering_accuracy(cells, "pred", "label", by)
    nmi = normalized_mutual_information(cells, "pred", "label", by)
    ami = adjusted_mutual_information(cells, "pred", "label", by)
    return done(acc.join(nmi, by).join(ami, by))
