"""Session construction and shared-storage helpers.

Lineage is cut with reliable checkpoints or written tables under the directory named by
``spark.checkpoint.dir``.  On a cluster that setting points at shared storage; we only set our
own when it is unset (tests, local runs).
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "lexicluster",
                  extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # A task has one core; its matrix products must not start a thread for every core of the machine.
         .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
         .config("spark.executorEnv.OMP_NUM_THREADS", "1")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting a local one only if none is set."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lexicluster-ckpt-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/lexicluster/{name}-{uuid.uuid4().hex[:12]}"


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and cuts lineage in iterative loops."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a spread table that are worth a task.
SPREAD_ROWS = 1000


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than cores, dealt by ``key``: rows of vectors are few bytes and much work."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    tasks = min(cores, df.count() // SPREAD_ROWS) if splits < cores else 0
    return df.repartition(tasks, key) if tasks > splits else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table, split as the files are."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
