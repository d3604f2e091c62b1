"""Sources (SRC-1 … SRC-11)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint

WS_EDGES = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def _csv(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Quoted CSV.  Only ``multiline`` reads quoted line ends, at the price that a file can't be split."""
    return (spark.read.schema(schema).option("quote", '"').option("escape", '"')
            .option("multiLine", str(multiline).lower()).option("mode", "FAILFAST").csv(path))


def scan_labeled_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """SRC-1: headerless CSV, int label in column 0, trimmed text in column 1, doubled quotes.
    A non-integer label fails the scan (FAILFAST)."""
    df = _csv(spark, path, "label INT, text STRING", multiline)
    return df.select("label", F.regexp_replace("text", WS_EDGES, "").alias("text"))


def scan_raw_class_csv(spark: SparkSession, path: str, n_cols: int, mode: str = "last", multiline: bool = False) -> DataFrame:
    """SRC-2: 1-based class → 0-based label; text = last column, or columns 1..n joined by tab."""
    schema = ", ".join(["c0 INT"] + [f"c{i} STRING" for i in range(1, n_cols)])
    df = _csv(spark, path, schema, multiline)
    text = F.col(f"c{n_cols - 1}") if mode == "last" else F.concat_ws("\t", *[F.col(f"c{i}") for i in range(1, n_cols)])
    return df.select((F.col("c0") - 1).alias("label"), text.alias("text"))


def scan_multi_column_corpus(spark: SparkSession, path: str, n_cols: int, multiline: bool = False) -> DataFrame:
    """SRC-3: label in column 0, text = the remaining columns joined by a space."""
    schema = ", ".join(["c0 INT"] + [f"c{i} STRING" for i in range(1, n_cols)])
    df = _csv(spark, path, schema, multiline)
    return df.select(F.col("c0").alias("label"), F.concat_ws(" ", *[F.col(f"c{i}") for i in range(1, n_cols)]).alias("text"))


def scan_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: JSON lines {text, cluster}; blank lines are skipped by the reader."""
    return spark.read.schema("text STRING, cluster INT").json(path)


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: features FLOAT[] (+ optional label, id) from parquet; math columns in DOUBLE."""
    df = spark.read.parquet(path)
    out = df.withColumn("x", F.col("features").cast("array<double>"))
    for c in ("label", "id"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("int" if c == "label" else "long"))
    return out.select("id", "label", "x")


def scan_constraints(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: pair list (id1, id2)."""
    return _csv(spark, path, "id1 LONG, id2 LONG")


def scan_seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: (id, label) rows → ids per label, sorted; a missing path gives an empty result."""
    empty = spark.createDataFrame([], "label INT, ids ARRAY<LONG>")
    try:
        df = _csv(spark, path, "id LONG, label INT")
        df.schema  # noqa: B018 - resolve the path now
    except Exception as e:  # path absent
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return empty
        raise
    return df.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def scan_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: each line split at the first space into word and vector."""
    t = spark.read.text(path).select(F.regexp_replace("value", WS_EDGES, "").alias("line"))
    parts = F.split(F.col("line"), " ", 2)
    return t.select(F.element_at(parts, 1).alias("word"),
                    F.split(F.regexp_replace(F.element_at(parts, 2), WS_EDGES, ""), "[ \t]+").cast("array<double>").alias("vec"))


def _placed(text_df: DataFrame) -> DataFrame:
    """Lines with their place (file path, byte offset of the split, position in the split): file order,
    even for many files and split files."""
    return text_df.select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"),
                                            F.monotonically_increasing_id().alias("m")).alias("_at"))


def with_line_numbers(text_df: DataFrame, out_col: str = "line_no") -> DataFrame:
    """Zero-based line number in file order."""
    from ..operators.windows import global_index
    t = _placed(text_df).select("value", F.col("_at.f").alias("_f"), F.col("_at.s").alias("_s"), F.col("_at.m").alias("_m"))
    return global_index(t, ["_f", "_s", "_m"], out_col).drop("_f", "_s", "_m")


def scan_word_vectors_top_k(spark: SparkSession, path: str, k: int, sentinels=("<s>", "</s>")) -> DataFrame:
    """SRC-9: the first k lines of the file plus the sentinel words wherever they are, with ``line_no``.
    The first lines are a top-k by place (every task passes on k lines at most); a sentinel behind
    them gets the count of the lines before it, from one pass for all of them."""
    t = _placed(spark.read.text(path))
    # At most k rows: the window over them is one small task.
    first = t.orderBy("_at").limit(k).withColumn("line_no", F.row_number().over(Window.orderBy("_at")).cast("long") - 1)
    first = checkpoint(first)
    word = F.split(F.col("value"), " ", 2).getItem(0)
    last = first.agg(F.max("_at").alias("at")).first()["at"]
    lines = first.select("line_no", "value")
    if last is not None:
        behind = t.where(word.isin(list(sentinels))).where(F.col("_at") > F.struct(*[F.lit(v).alias(n) for n, v in last.asDict().items()])).collect()
        if behind:                                                # a few sentinels
            before = t.agg(*[F.sum((F.col("_at") < F.struct(*[F.lit(v).alias(n) for n, v in r["_at"].asDict().items()])).cast("long")).alias(f"n{i}")
                             for i, r in enumerate(behind)]).first()
            lines = lines.unionByName(spark.createDataFrame([(before[f"n{i}"], r["value"]) for i, r in enumerate(behind)], "line_no long, value string"))
    parts = F.split(F.regexp_replace("value", WS_EDGES, ""), " ", 2)
    return lines.select("line_no", F.element_at(parts, 1).alias("word"),
                        F.split(F.element_at(parts, 2), "[ \t]+").cast("array<double>").alias("vec"))


RESULT_SCHEMA = ("corpora STRING, feat_name STRING, n_topics INT, best_acc DOUBLE, best_nmi DOUBLE, best_ari DOUBLE, "
                 "acc_mean DOUBLE, acc_std DOUBLE, nmi_mean DOUBLE, nmi_std DOUBLE, ari_mean DOUBLE, ari_std DOUBLE, "
                 "_corrupt_record STRING")


def scan_result_files(spark: SparkSession, path_glob: str, required=("corpora", "feat_name", "best_acc"),
                      base_path: str | None = None) -> DataFrame:
    """SRC-10: all run-result JSON lines; unparsable lines and lines lacking a required key are skipped.
    ``base_path`` recovers partition columns (e.g. feat_name=…) of appended result directories."""
    r = spark.read.schema(RESULT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if base_path:
        r = r.option("basePath", base_path)
    df = r.json(path_glob)
    cond = F.col("_corrupt_record").isNull()
    for r in required:
        cond = cond & F.col(r).isNotNull()
    return df.filter(cond).drop("_corrupt_record")


def label_dimension(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """SRC-11: topic → index map (one JSON object) or a class-name list (one per line, position = index)."""
    if kind == "json":
        m = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, INT>").alias("m"))
        return m.select(F.explode("m").alias("name", "label_idx"))
    t = with_line_numbers(spark.read.text(path))
    return t.select(F.col("value").alias("name"), F.col("line_no").cast("int").alias("label_idx"))
