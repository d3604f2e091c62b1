"""Corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, BPE ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its
result is written as Parquet and read again.  All stages but the last return the columns of
``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexicluster.llm import bpe, mixing, quality_model, quality_rules, simhash
from lexicluster.llm.common import documents, table, written
from lexicluster.llm.queries import tokenizer_path

# The classifier is trained and the mix is drawn, which SQL cannot express.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The rules leave hardly a document of label 0: the model is fitted on the whole table, with all labels.
    return quality_model.keep_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3, train=documents(spark, sf_dir), held=-1)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_distance=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


STAGES = [("quality rules", rules_stage), ("quality classifier", classifier_stage), ("SimHash near-dedup", near_duplicates_stage),
          ("mixing sources", mixing_stage), ("BPE encoding", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
