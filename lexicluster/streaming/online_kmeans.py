"""STR-1: online centroid update over a stream of feature batches (Structured Streaming).

Each micro-batch is assigned to the nearest centre and folded into a running mean per centre,
c' = (n·c + Σx) / (n + m).  The centre state is a table under shared storage keyed by batch id:
a replayed batch (after a driver or executor failure) finds its own state already written and
is skipped, so the sink is idempotent; the stream's progress lives in its checkpoint location.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import assign_nearest, cluster_sums

STATE_SCHEMA = "batch_id long, center_id int, n long, center array<double>"


def _latest_state(spark: SparkSession, state_path: str, initial, counts):
    try:
        st = spark.read.schema(STATE_SCHEMA).parquet(state_path)
        last = st.agg(F.max("batch_id")).first()[0]           # a partition column: no file is read
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None                                           # nothing has been written yet
    if last is None:
        return -1, [list(c) for c in initial], list(counts)
    rows = st.filter(F.col("batch_id") == last).collect()              # K rows
    by = {r["center_id"]: r for r in rows}
    return last, [list(by[k]["center"]) for k in range(len(initial))], [by[k]["n"] for k in range(len(initial))]


def online_kmeans_stream(spark: SparkSession, stream: DataFrame, initial, counts, state_path: str, checkpoint_path: str,
                         x_col: str = "x", assign_with: str = "current"):
    """Run the stream to completion (availableNow) and return the final (centres, counts).
    ``assign_with='initial'`` assigns every batch against the initial centres (then the final state
    equals one batch update over all rows); ``'current'`` uses the centres of the previous batch."""
    init = [list(map(float, c)) for c in initial]

    def fold(batch: DataFrame, batch_id: int):
        last, cur, n = _latest_state(spark, state_path, init, counts)
        if batch_id <= last:                          # replay of a batch already folded in
            return
        ref = init if assign_with == "initial" else cur
        sums = {r["center_id"]: r for r in cluster_sums(assign_nearest(batch, ref, x_col, "_p"), x_col, "_p").collect()}
        rows = []
        for k in range(len(cur)):
            if k in sums:
                m, sx = sums[k]["n"], sums[k]["sum"]
                rows.append((batch_id, k, n[k] + m, [(n[k] * c + s) / (n[k] + m) for c, s in zip(cur[k], sx)]))
            else:
                rows.append((batch_id, k, n[k], cur[k]))
        spark.createDataFrame(rows, STATE_SCHEMA).write.mode("append").partitionBy("batch_id").parquet(state_path)

    q = (stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    _, centres, n = _latest_state(spark, state_path, init, counts)
    return centres, n
