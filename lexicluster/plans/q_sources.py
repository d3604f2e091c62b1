"""Queries: sources and sinks.  Each query derives its input from the driver tables, writes it
with a sink under the shared checkpoint directory, and scans it back with the matching source."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import features as feats
from ..operators import windows as W
from ..session import shared_path, table
from ..sources import readers as R
from ..sources import writers as S
from . import fixtures as fx
from .registry import register
from .sqlparts import corpus_cte, feat_cte, shuffle_key, tokens_cte, with_

TRIM_SQL = "regexp_replace({}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"


@register("scan_labeled_csv", lambda: with_(corpus_cte()) + f"SELECT label, {TRIM_SQL.format('text')} AS text FROM corpus")
def q_scan_labeled_csv(spark, sf_dir):
    p = shared_path(spark, "labeled_csv")
    S.write_labeled_csv(fx.corpus(spark, sf_dir), p)
    return R.scan_labeled_csv(spark, p, multiline=True)


@register("write_labeled_csv", lambda: with_(corpus_cte()) + "SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM corpus GROUP BY label")
def q_write_labeled_csv(spark, sf_dir):
    p = shared_path(spark, "labeled_csv")
    S.write_labeled_csv(fx.corpus(spark, sf_dir), p)
    back = spark.read.schema("label INT, text STRING").option("escape", '"').option("multiLine", "true").csv(p)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@register("scan_raw_class_csv", lambda: with_(corpus_cte()) +
          "SELECT d.label, d.source || chr(9) || d.text AS text FROM (SELECT c.label, s.source, c.text FROM corpus c "
          "JOIN documents s USING (doc_id)) d")
def q_scan_raw(spark, sf_dir):
    c = fx.corpus(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    p = shared_path(spark, "raw_class")
    S._csv(c.select((F.col("label") + 1).alias("c0"), "source", "text"), p)
    return R.scan_raw_class_csv(spark, p, 3, mode="join", multiline=True)


@register("scan_multi_column_corpus", "SELECT CAST(turn % 4 AS INTEGER) AS label, role || ' ' || text AS text FROM conversations")
def q_scan_multi(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = shared_path(spark, "multi_col")
    S._csv(c.select((F.col("turn") % 4).cast("int").alias("c0"), "role", "text"), p)
    return R.scan_multi_column_corpus(spark, p, 3, multiline=True)


@register("scan_json_corpus", lambda: with_(corpus_cte()) + "SELECT text, label AS cluster FROM corpus")
def q_scan_json(spark, sf_dir):
    p = shared_path(spark, "json_corpus")
    S.write_json_corpus(fx.corpus(spark, sf_dir).select("text", F.col("label").alias("cluster")), p)
    return R.scan_json_corpus(spark, p)


@register("write_json_corpus", lambda: with_(corpus_cte(), tokens_cte()) +
          "SELECT array_to_string(tokens, ' ') AS text, label AS cluster FROM tokens WHERE len(tokens) > 0")
def q_write_json(spark, sf_dir):
    t = fx.tokens(spark, sf_dir).filter(F.size("tokens") > 0)
    p = shared_path(spark, "json_tokens")
    S.write_json_corpus(t.select(F.array_join("tokens", " ").alias("text"), F.col("label").alias("cluster")), p)
    return R.scan_json_corpus(spark, p)


def _feat_long_sql():
    return (with_(feat_cte()) + "SELECT id, label, CAST(dim AS INTEGER) AS dim, round(v, 6) AS value FROM (SELECT vec_id AS id, label, "
            "unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM feat)")


@register("scan_features", _feat_long_sql)
def q_scan_features(spark, sf_dir):
    p = shared_path(spark, "features")
    S.write_features(fx.feat(spark, sf_dir), p, "x", "label", "vec_id")
    f = R.scan_features(spark, p)
    return f.select("id", "label", F.posexplode("x").alias("dim", "v")).select(
        "id", "label", F.col("dim").cast("int"), F.round("v", 6).alias("value"))


@register("write_features", lambda: with_(feat_cte()) + "SELECT vec_id AS id, label, CAST(len(x) AS INTEGER) AS n_dims, round(list_sum(x), 6) AS total FROM feat")
def q_write_features(spark, sf_dir):
    p = shared_path(spark, "features")
    S.write_features(fx.feat(spark, sf_dir), p, "x", "label", "vec_id")
    f = R.scan_features(spark, p)
    from ..functions.vectors import vsum
    return f.select("id", "label", F.size("x").alias("n_dims"), F.round(vsum("x"), 6).alias("total"))


def _seeds_sql():
    return ("seeds AS (SELECT vec_id AS id, label, rn FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label "
            f"ORDER BY {shuffle_key('vec_id')}, vec_id) AS rn FROM feat) WHERE rn <= 10)")


def _seeds(spark, sf_dir):
    s = W.select_seeds(fx.feat(spark, sf_dir).select("vec_id", "label"), "vec_id", "label", 10, seed=42)
    return s.select(F.col("vec_id").alias("id"), "label")


@register("scan_seeds", lambda: with_(feat_cte(), _seeds_sql()) +
          "SELECT label, array_to_string(list(id ORDER BY id), ',') AS ids FROM seeds GROUP BY label")
def q_scan_seeds(spark, sf_dir):
    p = shared_path(spark, "seeds")
    S.write_seeds(_seeds(spark, sf_dir), p)
    r = R.scan_seeds(spark, p)
    return r.select("label", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@register("write_seeds", lambda: with_(feat_cte(), _seeds_sql()) + "SELECT id, label FROM seeds")
def q_write_seeds(spark, sf_dir):
    p = shared_path(spark, "seeds")
    S.write_seeds(_seeds(spark, sf_dir), p)
    return spark.read.schema("id LONG, label INT").csv(p)


@register("scan_constraints", lambda: with_(feat_cte(), _seeds_sql()) +
          "SELECT a.id AS id1, b.id AS id2 FROM seeds a JOIN seeds b ON a.label = b.label AND b.rn = a.rn + 1")
def q_scan_constraints(spark, sf_dir):
    f = fx.feat(spark, sf_dir).select("vec_id", "label")
    s = W.select_seeds(f, "vec_id", "label", 10, seed=42).withColumn("_h", W.hash_key("vec_id", 42))
    w = Window.partitionBy("label").orderBy("_h", "vec_id")     # ≤ 10 rows per label
    pairs = s.withColumn("id2", F.lead("vec_id").over(w)).filter(F.col("id2").isNotNull()).select(
        F.col("vec_id").alias("id1"), "id2")
    p = shared_path(spark, "constraints")
    S._csv(pairs, p)
    return R.scan_constraints(spark, p)


def _word_vectors(spark, sf_dir):
    tok = fx.tokens(spark, sf_dir)
    vocab = feats.top_vocabulary(feats.term_statistics(tok), 2000)
    emb = fx.feat(spark, sf_dir)
    n = emb.count()
    return vocab.join(emb.select("vec_id", "x"), F.col("vec_id") == F.col("idx") % F.lit(n)) \
                .select(F.col("term").alias("word"), "idx", "x")


def _vocab_sql():
    return ("pairs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY doc_id, term),\n"
            "stats AS (SELECT term, sum(tf) AS total FROM pairs GROUP BY term),\n"
            "vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM (SELECT * FROM stats ORDER BY total DESC, term LIMIT 2000)),\n"
            "wv AS (SELECT v.term AS word, v.idx, f.x FROM vocab v JOIN feat f ON f.vec_id = v.idx % (SELECT count(*) FROM embeddings))")


def _write_vectors(wv, p):
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.col("x").cast("array<string>"), " "))
    wv.orderBy("idx").select(line.alias("value")).write.mode("overwrite").text(p)


@register("scan_word_vectors", lambda: with_(corpus_cte(), tokens_cte(), feat_cte(), _vocab_sql()) +
          "SELECT word, CAST(len(x) AS INTEGER) AS n_dims, round(list_sum(x), 6) AS total FROM wv")
def q_scan_wv(spark, sf_dir):
    from ..functions.vectors import vsum
    p = shared_path(spark, "word_vectors")
    _write_vectors(_word_vectors(spark, sf_dir), p)
    v = R.scan_word_vectors(spark, p)
    return v.select("word", F.size("vec").alias("n_dims"), F.round(vsum("vec"), 6).alias("total"))


@register("scan_word_vectors_top_k", lambda: with_(corpus_cte(), tokens_cte(), feat_cte(), _vocab_sql()) +
          "SELECT CAST(idx AS BIGINT) AS line_no, word FROM wv WHERE idx < 100 UNION ALL SELECT CAST(2000 + i AS BIGINT) AS line_no, w AS word "
          "FROM (VALUES (0, '<s>'), (1, '</s>')) t(i, w) WHERE (SELECT count(*) FROM vocab) = 2000")
def q_scan_wv_top_k(spark, sf_dir):
    p = shared_path(spark, "word_vectors_k")
    wv = _word_vectors(spark, sf_dir)
    sent = wv.filter(F.col("idx") < 2).select(F.when(F.col("idx") == 0, "<s>").otherwise("</s>").alias("word"),
                                              (F.col("idx") + 2000).alias("idx"), "x")
    _write_vectors(wv.unionByName(sent), p)
    v = R.scan_word_vectors_top_k(spark, p, 100)
    return v.select(F.col("line_no").cast("bigint"), "word")


def _summary_rows(spark, sf_dir):
    from ..operators import metrics as M
    from ..operators.experiments import trial_summary
    t = fx.trials(spark, sf_dir).persist()
    s = trial_summary(M.cluster_scores(t, by=["trial"]), [])
    return s.select(F.lit("embeddings").alias("corpora"), F.lit("fixed").alias("feat_name"), F.lit(10).alias("n_topics"),
                    "best_acc", "best_nmi", F.col("best_ami").alias("best_ari"), "acc_mean", "acc_std",
                    "nmi_mean", "nmi_std", F.col("ami_mean").alias("ari_mean"), F.col("ami_std").alias("ari_std"))


def _summary_sql():
    from .q_metrics import _trial_metrics_sql
    return with_(*_trial_metrics_sql()) + (
        "SELECT 'embeddings' AS corpora, 'fixed' AS feat_name, 10 AS n_topics, round(max(acc), 6) AS best_acc, "
        "round(max(nmi), 6) AS best_nmi, round(max(ami), 6) AS best_ari FROM tm")


@register("scan_result_files", _summary_sql)
def q_scan_results(spark, sf_dir):
    p = shared_path(spark, "results")
    rows = _summary_rows(spark, sf_dir)
    good = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    junk = spark.createDataFrame([("",), ("{not json",), ('{"corpora": "x"}',)], "value string")
    good.unionByName(junk).write.mode("overwrite").text(p)
    r = R.scan_result_files(spark, p + "/*.txt")
    return r.select("corpora", "feat_name", "n_topics", *[F.round(c, 6).alias(c) for c in ("best_acc", "best_nmi", "best_ari")])


@register("write_result_summary", _summary_sql)
def q_write_summary(spark, sf_dir):
    p = shared_path(spark, "result_csv")
    S.write_result_summary(_summary_rows(spark, sf_dir), p)
    r = spark.read.option("header", "true").schema(
        "corpora STRING, feat_name STRING, n_topics INT, best_acc DOUBLE, best_nmi DOUBLE, best_ari DOUBLE").csv(p)
    return r.select("corpora", "feat_name", "n_topics", *[F.round(c, 6).alias(c) for c in ("best_acc", "best_nmi", "best_ari")])


@register("append_run_result", _summary_sql)
def q_append_result(spark, sf_dir):
    p = shared_path(spark, "run_results")
    S.append_run_result(_summary_rows(spark, sf_dir), p)
    r = spark.read.schema(R.RESULT_SCHEMA.replace(", _corrupt_record STRING", "")).json(p)
    return r.select("corpora", "feat_name", "n_topics", *[F.round(c, 6).alias(c) for c in ("best_acc", "best_nmi", "best_ari")])


@register("label_dimension", "SELECT source AS name, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx "
          "FROM (SELECT DISTINCT source FROM documents)")
def q_label_dimension(spark, sf_dir):
    src = table(spark, sf_dir, "documents").select("source").distinct()
    ranked = src.withColumn("i", F.dense_rank().over(Window.orderBy("source")) - 1)   # distinct names: a dimension
    js = ranked.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", F.col("i").cast("int"))))).alias("value"))
    p = shared_path(spark, "topic2idx")
    js.write.mode("overwrite").text(p)
    return R.label_dimension(spark, p, "json")


@register("class_names", "SELECT source AS name, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx "
          "FROM (SELECT DISTINCT source FROM documents)")
def q_class_names(spark, sf_dir):
    src = table(spark, sf_dir, "documents").select("source").distinct()
    p = shared_path(spark, "classes")
    src.orderBy("source").write.mode("overwrite").text(p)
    return R.label_dimension(spark, p, "lines")


@register("append_interpretation", lambda: with_(corpus_cte(), __import__("lexicluster.plans.sqlparts", fromlist=["x"]).explain_tokens_cte(),
          __import__("lexicluster.plans.q_relational", fromlist=["x"])._top_words_sql(5)) +
          "SELECT 'documents' AS corpora, 'lang' AS feat_name, 'count' AS label, cluster, array_to_string(list(word ORDER BY rank), ' ') AS words "
          "FROM tw GROUP BY cluster")
def q_append_interpretation(spark, sf_dir):
    """SNK-7: per-cluster word lists (EVAL-11, k = 5) stored as ARRAY<ARRAY<STRING>> and re-read."""
    from ..operators.explain import explain_by_count
    r = explain_by_count(fx.explain_tokens(spark, sf_dir), 5, "tokens", "label")
    lists = r.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("words"))
    rec = lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "words"))), lambda s: s["words"]).alias("result")) \
               .select(F.lit("documents").alias("corpora"), F.lit("lang").alias("feat_name"), "result", F.lit("count").alias("label"))
    p = shared_path(spark, "interpretation")
    S.append_interpretation(rec, p)
    back = spark.read.parquet(p)
    return back.select("corpora", "feat_name", "label", F.posexplode("result").alias("cluster", "w")).select(
        "corpora", "feat_name", "label", F.col("cluster").cast("int"), F.array_join("w", " ").alias("words"))


@register("write_word_stats", lambda: __import__("lexicluster.plans.q_relational", fromlist=["x"])._positions_sql(True))
def q_write_word_stats(spark, sf_dir):
    """SNK-8: word position statistics written as CSV with a header and re-read."""
    from .q_relational import _positions
    st = _positions(spark, sf_dir, True)
    p = shared_path(spark, "word_stats")
    S.write_word_stats(st, p)
    back = spark.read.option("header", "true").schema(st.schema).csv(p)
    return back


@register("append_training_metrics", "SELECT 'dec-' || CAST(range AS VARCHAR) AS run_id, 'bce_loss' AS metric, CAST(5 AS BIGINT) AS n, "
          "CAST(0 AS INTEGER) AS first_step, CAST(4 AS INTEGER) AS last_step FROM range(2)")
def q_training_metrics(spark, sf_dir):
    """SNK-9: DEC loss per step appended as (run_id, metric, step, value), re-read: step count and
    monotone step ids."""
    from ..operators import deep as DP
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    m = []
    DP.dec_refine(f, fx.fixed_centers(spark, sf_dir), max_steps=5, update_interval=5, tol=0.0, metrics=m)
    df = spark.createDataFrame([("dec-0", k, s, float(v)) for k, s, v in m], "run_id string, metric string, step int, value double")
    p = shared_path(spark, "metrics")
    S.append_training_metrics(df, p)
    S.append_training_metrics(df.withColumn("run_id", F.lit("dec-1")), p)
    back = spark.read.parquet(p)
    return back.groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@register("save_network")
def q_save_network(spark, sf_dir):
    """SNK-10: a trained network is written per stage and loaded back; encoding with the loaded
    weights reproduces the original hidden vectors exactly."""
    import numpy as np
    from ..operators import deep as DP
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    net, _ = DP.autoencoder_fit(f, [64, 16], epochs=3, lr=0.5, seed=3)
    p = shared_path(spark, "network")
    S.save_network(DP.network_table(spark, net, "final"), p)
    net2 = DP.network_from_table(S.load_network(spark, p, "final"))
    h1 = DP.autoencoder_encode(f, net, "x", "h", ["id"]).withColumnRenamed("h", "h1")
    h2 = DP.autoencoder_encode(f, net2, "x", "h", ["id"]).withColumnRenamed("h", "h2")
    diff = h1.join(h2, "id").select(F.aggregate(F.zip_with("h1", "h2", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: F.greatest(a, v)).alias("d"))
    r = diff.agg(F.count(F.lit(1)).alias("rows"), F.max("d").alias("max_abs_diff")).first()
    same = all(np.array_equal(a, b) for a, b in zip(DP._params(net), DP._params(net2)))
    return spark.createDataFrame([("rows", float(r["rows"])), ("max_abs_diff", float(r["max_abs_diff"])), ("weights_equal", float(same))],
                                 "property string, value double")
