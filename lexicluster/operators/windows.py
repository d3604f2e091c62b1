"""Window, ranking and ordering operators (WIN-1…7, TOP-1…3, SET-4).

Hot groups.  A class, event type or cluster may hold a third of all rows, so no operator here
sorts a whole group inside one task:
* exact per-class sampling ranks only the rows of one hash bucket per class;
* running aggregates use a distributed prefix scan (range partitioning, per-partition totals,
  offsets for the groups that straddle partition boundaries);
* top-k per group relies on Spark's WindowGroupLimit, which keeps the top k per group in every
  map task before the shuffle.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint

N_BUCKETS_HEX = 4          # hash prefix of 4 hex digits → 65,536 buckets per class


def hash_key(id_col: str, seed: int) -> Column:
    """md5(seed-id): the reproducible pseudo-random order shared with the SQL oracles."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def stratified_sample(df: DataFrame, id_col: str, label_col: str, size, seed: int = 42,
                      strict: bool = True) -> DataFrame:
    """WIN-1: exactly n_c rows per class without replacement, the n_c smallest md5(seed-id)
    (ties by id).  ``size`` is an int or a Column of the label.  ``strict`` fails when a class is
    smaller than its size; otherwise the whole class is taken.

    Plan: (label, bucket) counts → per-class threshold bucket by a cumulative window over at most
    65,536 bucket rows per class → rows below the threshold are kept outright, rows in the
    threshold bucket are ranked (≈ 1/65,536 of the class)."""
    size_col = size if isinstance(size, Column) else F.lit(int(size))
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn(
        "_b", F.conv(F.substring("_h", 1, N_BUCKETS_HEX), 16, 10).cast("int"))
    counts = keyed.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = (counts.withColumn("_cum", F.sum("_cnt").over(w))
                 .withColumn("_tot", F.sum("_cnt").over(Window.partitionBy(label_col)))
                 .withColumn("_n", size_col.cast("long")))
    if strict:
        short = cum.filter(F.col("_tot") < F.col("_n")).select(label_col).limit(1).collect()
        if short:
            raise ValueError(f"class {short[0][0]} has fewer rows than its sample size")
    cum = cum.withColumn("_n", F.least(F.col("_n"), F.col("_tot")))
    thr = (cum.filter(F.col("_cum") >= F.col("_n"))
              .groupBy(label_col).agg(F.min(F.struct("_b", "_cum", "_cnt", "_n")).alias("t"))
              .select(label_col, F.col("t._b").alias("_tb"),
                      (F.col("t._n") - (F.col("t._cum") - F.col("t._cnt"))).alias("_need")))
    j = keyed.join(thr, label_col)   # one row per class: small side, planner broadcasts it
    below = j.filter(F.col("_b") < F.col("_tb"))
    edge = j.filter(F.col("_b") == F.col("_tb"))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy(label_col).orderBy("_h", id_col))) \
               .filter(F.col("_r") <= F.col("_need")).drop("_r")
    drop = ["_h", "_b", "_tb", "_need"]
    return below.drop(*drop).unionByName(edge.drop(*drop))


def select_seeds(df: DataFrame, id_col: str, label_col: str, seed_num: int, seed: int = 42) -> DataFrame:
    """WIN-2: up to ``seed_num`` pseudo-random ids per label (small classes give all)."""
    return stratified_sample(df, id_col, label_col, seed_num, seed, strict=False)


# ---------------------------------------------------------------- distributed prefix scan

def _key_value(v):
    """A group key as a plain value; every kind of missing value is None."""
    if v is None or v != v or v is pd.NaT:
        return None
    return v.item() if hasattr(v, "item") else v


def prefix_scan(df: DataFrame, group_cols, order_cols, value_cols, out_cols=None, op: str = "sum") -> DataFrame:
    """Running sum (or max) of ``value_cols`` per group in (group, order) order, without putting a
    group into one task: range-partition on (group, order), scan each partition in pandas, and
    add the totals of earlier partitions for groups that cross partition boundaries."""
    group_cols, order_cols, value_cols = list(group_cols), list(order_cols), list(value_cols)
    out_cols = list(out_cols or [f"cum_{v}" for v in value_cols])
    keys = group_cols + order_cols
    gk = group_cols or ["_one"]
    if not group_cols:
        df = df.withColumn("_one", F.lit(0))
    # Both passes must see the same partitions: they are written once to the shared directory.
    s = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()))
    vschema = ", ".join(f"`{c}` {dict(s.dtypes)[c]}" for c in gk)
    fold = (lambda a, b: a + b) if op == "sum" else max

    def totals(pdf):
        """(key, totals) of the groups of a batch, in order."""
        change = pd.Series(False, index=pdf.index)
        for c in gk:
            v, before = pdf[c], pdf[c].shift()
            change |= ~((v == before) | (v.isna() & before.isna()))
        run = change.cumsum()
        for _, part in pdf.groupby(run, sort=False):
            yield tuple(_key_value(v) for v in part[gk].iloc[0]), [float(getattr(part[v], op)()) for v in value_cols]

    def edges(it):
        """The totals of the first and the last group of the partition."""
        first = last = pid = None
        for pdf in it:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            for key, vals in totals(pdf):
                if last is not None and last[0] == key:
                    last[1] = [fold(a, b) for a, b in zip(last[1], vals)]
                else:
                    last = [key, vals]
                    first = first or last
        if pid is not None:
            rows = [(*first[0], *first[1], 0, pid)] + ([(*last[0], *last[1], 1, pid)] if last is not first else [])
            yield pd.DataFrame(rows, columns=[*gk, *value_cols, "_pos", "_pid"])

    vtypes = ", ".join(f"`{v}` double" for v in value_cols)
    e = s.select(*gk, *[F.col(v).cast("double").alias(v) for v in value_cols], "_pid").mapInPandas(
        edges, f"{vschema}, {vtypes}, _pos int, _pid int").collect()   # ≤ 2 rows per partition
    offsets = {}          # (pid) -> (group key, offset values) for the partition's first group
    carry_key, carry = None, None
    for r in sorted(e, key=lambda r: (r["_pid"], r["_pos"])):
        key, vals = tuple(_key_value(r[c]) for c in gk), [float(r[v]) for v in value_cols]
        same = carry_key == key
        if r["_pos"] == 0:
            offsets[r["_pid"]] = (key, list(carry) if same else [0.0 if op == "sum" else float("-inf")] * len(value_cols))
        carry_key, carry = key, [fold(a, b) for a, b in zip(carry, vals)] if same else vals
    bc = df.sparkSession.sparkContext.broadcast(offsets)   # ≤ one entry per partition

    out_schema = s.drop("_pid").schema
    from pyspark.sql.types import DoubleType, StructField, StructType
    out_schema = StructType(list(out_schema.fields) + [StructField(c, DoubleType()) for c in out_cols])

    def match(pdf, key):
        m = pd.Series(True, index=pdf.index)
        for c, v in zip(gk, key):
            m &= pdf[c].isna() if v is None else pdf[c] == v
        return m

    def scan(it):
        state_key, state = None, None
        first = True
        for pdf in it:
            if pdf.empty:
                continue
            if first:
                state_key, state = bc.value.get(int(pdf["_pid"].iloc[0]), (None, None))
                first = False
            g = pdf.groupby(gk, sort=False, dropna=False)[value_cols]
            res = (g.cumsum() if op == "sum" else g.cummax()).astype(float)
            if state_key is not None:
                hit = match(pdf, state_key)
                for i, v in enumerate(value_cols):
                    if op == "sum":
                        res.loc[hit, v] = res.loc[hit, v] + state[i]
                    else:
                        res.loc[hit, v] = res.loc[hit, v].clip(lower=state[i])
            state_key = tuple(_key_value(v) for v in pdf[gk].iloc[-1])
            state = [float(res[v].iloc[-1]) for v in value_cols]
            pdf = pdf.drop(columns=["_pid"])
            for v, o in zip(value_cols, out_cols):
                pdf[o] = res[v].values
            yield pdf

    out = s.mapInPandas(scan, out_schema)
    if not group_cols:
        out = out.drop("_one")
    return out


def global_index(df: DataFrame, order_cols, index_col: str = "rn") -> DataFrame:
    """Zero-based position in a global order, computed by a distributed prefix scan."""
    out = prefix_scan(df.withColumn("_unit", F.lit(1.0)), [], order_cols, ["_unit"], ["_cum"])
    return out.withColumn(index_col, (F.col("_cum") - 1).cast("long")).drop("_unit", "_cum")


def assign_minibatches(df: DataFrame, id_col: str, size: int, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """WIN-3: batch = ⌊rank / size⌋ in id order (or in shuffled order); the last batch is short."""
    order = [hash_key(id_col, seed).alias("_h"), id_col] if shuffle else [id_col]
    d = df.withColumn("_h", hash_key(id_col, seed)) if shuffle else df
    out = global_index(d, ["_h", id_col] if shuffle else [id_col], "_rn")
    out = out.withColumn("batch", F.floor(F.col("_rn") / size).cast("long"))
    return out.drop("_rn", "_h") if shuffle else out.drop("_rn")


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """TOP-2: reproducible permutation; ``shuffle_rank`` is the row's position in it."""
    out = global_index(df.withColumn("_h", hash_key(id_col, seed)), ["_h", id_col], "shuffle_rank")
    return out.drop("_h")


def running_weighted_average(df: DataFrame, group_cols, order_cols, value_col: str, weight_col: str,
                             out_col: str = "running_avg") -> DataFrame:
    """WIN-4: Σ v·n / Σ n after every update, per group, as a distributed prefix scan."""
    d = df.withColumn("_vn", F.col(value_col).cast("double") * F.col(weight_col)).withColumn(
        "_n", F.col(weight_col).cast("double"))
    out = prefix_scan(d, group_cols, order_cols, ["_vn", "_n"], ["_cvn", "_cn"])
    return out.withColumn(out_col, F.col("_cvn") / F.col("_cn")).drop("_vn", "_n", "_cvn", "_cn")


def weighted_average(df: DataFrame, value_col: str, weight_col: str, by=()) -> DataFrame:
    """AGG-9: Σ v·n / Σ n."""
    return df.groupBy(*by).agg((F.sum(F.col(value_col) * F.col(weight_col)) / F.sum(weight_col)).alias("weighted_avg"))


def best_trial_so_far(df: DataFrame, run_cols, trial_col: str = "trial", score_col: str = "acc") -> DataFrame:
    """WIN-5: a trial is kept when strictly better than every earlier trial of its run (a score of
    0 is never kept); trials per run are few, so a plain window suffices."""
    w = Window.partitionBy(*run_cols).orderBy(trial_col).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.max(score_col).over(w), F.lit(0.0))
    return df.withColumn("kept", F.col(score_col) > prev)


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """WIN-6 / WIN-7: k best rows per group by a total order (row_number ≤ k; Spark plans a
    WindowGroupLimit so every map task forwards at most k rows per group)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
