"""Experiment bookkeeping: trial summaries and sweep grids (AGG-7, JOIN-12)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trial_summary(metrics: DataFrame, run_cols, trial_col: str = "trial") -> DataFrame:
    """AGG-7: per run, mean / population std / max of acc, nmi, ami, and the best-accuracy trial
    (ties → earliest).  best_nmi and best_ami are independent maxima."""
    aggs = []
    for m in ("acc", "nmi", "ami"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.max(m).alias(f"best_{m}")]
    aggs.append(F.max_by(F.col(trial_col), F.struct(F.col("acc"), -F.col(trial_col))).cast("int").alias("best_trial"))
    return metrics.groupBy(*run_cols).agg(*aggs)


def trial_lists(metrics: DataFrame, run_cols, trial_col: str = "trial") -> DataFrame:
    """The per-trial values as ordered arrays (bounded by the number of trials)."""
    s = F.sort_array(F.collect_list(F.struct(trial_col, "acc", "nmi", "ami")))
    return metrics.groupBy(*run_cols).agg(s.alias("_t")).select(
        *run_cols, F.col("_t.acc").alias("all_acc"), F.col("_t.nmi").alias("all_nmi"), F.col("_t.ami").alias("all_ami"))


def sweep_grid(base: DataFrame, **dims) -> DataFrame:
    """JOIN-12: every row of ``base`` combined with every value of each small parameter list,
    generated in place with ``explode`` (no join)."""
    out = base
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out
