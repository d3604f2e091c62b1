"""Sinks (SNK-1 … SNK-10).  Paths are expected under shared storage (see ``session.shared_path``)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A CSV file whose records may hold line ends can't be split: a reader's task takes a whole one.
FILE_RECORDS = 5000


def _csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = False) -> None:
    (df.write.mode(mode).option("maxRecordsPerFile", FILE_RECORDS).option("quote", '"').option("escape", '"').option("header", str(header).lower())
       .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
       .csv(path))


def write_labeled_csv(df: DataFrame, path: str, label_col: str = "label", text_col: str = "text") -> None:
    """SNK-1: (label, text), CSV-quoted with doubled quotes."""
    _csv(df.select(label_col, text_col), path)


def write_features(df: DataFrame, path: str, x_col: str = "x", label_col: str | None = "label",
                   id_col: str | None = "id") -> None:
    """SNK-2: FLOAT[] features with optional label and id, as parquet."""
    cols = [F.col(x_col).cast("array<float>").alias("features")]
    if label_col:
        cols.append(F.col(label_col).alias("label"))
    if id_col:
        cols.append(F.col(id_col).alias("id"))
    df.select(*cols).write.mode("overwrite").parquet(path)


def write_json_corpus(df: DataFrame, path: str) -> None:
    """SNK-3: one JSON object per line."""
    df.write.mode("overwrite").json(path)


def append_run_result(df: DataFrame, path: str, partition_col: str = "feat_name") -> None:
    """SNK-4: append run summaries, partitioned by feature name."""
    df.write.mode("append").partitionBy(partition_col).json(path)


RESULT_COLUMNS = ["corpora", "feat_name", "n_topics", "best_acc", "best_nmi", "best_ari"]


def write_result_summary(df: DataFrame, path: str) -> None:
    """SNK-5: header + the six report columns."""
    _csv(df.select(*RESULT_COLUMNS), path, header=True)


def write_seeds(df: DataFrame, path: str) -> None:
    """SNK-6: (id, label) sorted by id then label (range-partitioned sort, then one file per range)."""
    _csv(df.select("id", "label").orderBy("id", "label"), path)


def append_interpretation(df: DataFrame, path: str) -> None:
    """SNK-7: {corpora, feat_name, result ARRAY<ARRAY<STRING>>, label} appended as parquet."""
    df.select("corpora", "feat_name", "result", "label").write.mode("append").parquet(path)


def write_word_stats(df: DataFrame, path: str) -> None:
    """SNK-8: word position statistics with a header."""
    _csv(df, path, header=True)


def append_training_metrics(df: DataFrame, path: str) -> None:
    """SNK-9: (run_id, metric, step, value) appended."""
    df.select("run_id", "metric", "step", "value").write.mode("append").parquet(path)


def save_network(weights: DataFrame, path: str) -> None:
    """SNK-10: weights table (stage, layer, kind, rows, cols, values), one directory per stage."""
    weights.write.mode("overwrite").partitionBy("stage").parquet(path)


def load_network(spark, path: str, stage: str):
    return spark.read.parquet(path).filter(F.col("stage") == stage)
