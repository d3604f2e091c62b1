"""Queries: sampling, ordering, running aggregates and top-k (WIN-*, TOP-*, AGG-9, SET-4)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..session import table
from . import fixtures as fx
from .registry import register
from .sqlparts import corpus_cte, feat_cte, shuffle_key, with_


def _sample_size(label_col="label"):
    return F.lit(500) + F.lit(500) * F.col(label_col)


@register("stratified_sample", lambda: with_(corpus_cte()) +
          "SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY "
          f"{shuffle_key('doc_id')}, doc_id) AS rn FROM corpus) WHERE rn <= 500 + 500 * label")
def q_stratified(spark, sf_dir):
    c = fx.corpus(spark, sf_dir).select("doc_id", "label")
    return W.stratified_sample(c, "doc_id", "label", _sample_size(), seed=42, strict=False)


@register("union_selections", lambda: with_(corpus_cte()) +
          "SELECT label, count(*) AS n FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY "
          f"{shuffle_key('doc_id')}, doc_id) AS rn FROM corpus) WHERE rn <= 500 + 500 * label GROUP BY label")
def q_union_selections(spark, sf_dir):
    """SET-4: per-class selections concatenated (one window plan gives the union directly)."""
    c = fx.corpus(spark, sf_dir).select("doc_id", "label")
    s = W.stratified_sample(c, "doc_id", "label", _sample_size(), seed=42, strict=False)
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _seeds_sql():
    return ("seeds AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label "
            f"ORDER BY {shuffle_key('vec_id')}, vec_id) AS rn FROM feat) WHERE rn <= 10)")


@register("select_seeds", lambda: with_(feat_cte(), _seeds_sql()) + "SELECT vec_id, label FROM seeds")
def q_select_seeds(spark, sf_dir):
    return W.select_seeds(fx.feat(spark, sf_dir).select("vec_id", "label"), "vec_id", "label", 10, seed=42)


@register("sort_seeds", lambda: with_(feat_cte(), _seeds_sql()) +
          "SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, label) - 1 AS rn FROM seeds")
def q_sort_seeds(spark, sf_dir):
    s = W.select_seeds(fx.feat(spark, sf_dir).select("vec_id", "label"), "vec_id", "label", 10, seed=42)
    return W.global_index(s, ["vec_id", "label"], "rn")


@register("assign_minibatches", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY "
          f"{shuffle_key('doc_id')}, doc_id) - 1) / 64) AS BIGINT) AS batch FROM documents")
def q_minibatches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return W.assign_minibatches(d, "doc_id", 64, shuffle=True, seed=42)


@register("shuffle_rows", "SELECT doc_id, row_number() OVER (ORDER BY "
          f"{shuffle_key('doc_id')}, doc_id) - 1 AS shuffle_rank FROM documents")
def q_shuffle_rows(spark, sf_dir):
    return W.shuffle_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=42)


@register("running_weighted_average",
          "SELECT event_id, round(sum(value * (1 + event_id % 7)) OVER w / sum(1 + event_id % 7) OVER w, 6) AS running_avg "
          "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_running_wavg(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value",
                                              (F.lit(1) + F.col("event_id") % 7).alias("w"))
    r = W.running_weighted_average(e, ["event_type"], ["ts", "event_id"], "value", "w")
    return r.select("event_id", F.round("running_avg", 6).alias("running_avg"))


@register("weighted_average",
          "SELECT event_type, round(sum(value * (1 + event_id % 7)) / sum(1 + event_id % 7), 6) AS weighted_avg "
          "FROM events GROUP BY event_type")
def q_wavg(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", F.lit(1) + F.col("event_id") % 7)
    r = W.weighted_average(e, "value", "w", ["event_type"])
    return r.select("event_type", F.round("weighted_avg", 6).alias("weighted_avg"))
