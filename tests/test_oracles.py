"""Registered queries against their DuckDB oracles on the smallest fixture (fast subset)."""
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FAST = ["tfidf_features", "top_vocabulary", "clean_news", "split_sentences", "layer_norm", "nearest_center",
        "stratified_sample", "running_weighted_average", "adjusted_mutual_information", "clustering_accuracy",
        "describe_values", "compactness_medoid", "dec_gradient", "scan_labeled_csv", "group_ids",
        "word_position_stats", "write_word_stats", "feature_word_vectors", "gsdmm_sweep", "unescape_entities", "assigned_center",
        "compactness_nearest_neighbor", "scan_word_vectors_top_k", "corpus_build", "append_training_metrics"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return v


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages events labels conversations benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    a = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    idx = [rel.columns.index(c) for c in order]
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert a == b


def test_registry_complete():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
