"""Queries: experiment compositions (PIPE-2…4, PIPE-9, PIPE-12…15)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import aggregates as A
from ..operators import clustering as C
from ..operators import features as feats
from ..operators import metrics as M
from ..operators import windows as W
from ..operators.experiments import trial_summary
from ..operators.explain import explain_by_count, explain_by_weight
from ..operators.filters import lookup_run
from ..operators.joins import token_vectors
from ..session import shared_path, table
from ..sources import readers as R
from ..sources import writers as S
from . import fixtures as fx
from .flagship import kmeans_trials
from .q_features import MAX_FEATURES, _tfidf_sql
from .q_sources import TRIM_SQL, _summary_rows, _summary_sql
from .q_text import sql_clean_answers, sql_tokenize_rejoin
from .registry import register
from .sqlparts import corpus_cte, with_


def _corpus_build_sql():
    body = sql_tokenize_rejoin(f"regexp_replace({sql_clean_answers('text')}, '[^\\x00-\\x7F]', '', 'g')")
    return (with_(corpus_cte(), "raw AS (SELECT c.label, d.source || chr(9) || c.text AS text FROM corpus c JOIN documents d USING (doc_id))",
                  "s AS (SELECT label, text FROM (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || text), text) AS rn "
                  "FROM raw) WHERE rn <= 500 + 500 * label)")
            + f"SELECT label, {TRIM_SQL.format(body)} AS text FROM s")


@register("corpus_build", _corpus_build_sql)
def q_corpus_build(spark, sf_dir):
    """PIPE-12: raw 1-based class CSV → SRC-2 (columns joined by tab) → WIN-1 exact per-class sample →
    TXT-4 cleaning → TXT-5 ASCII → TXT-6/7 sentence tokens → SNK-1 → SRC-1."""
    c = fx.corpus(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    raw_p = shared_path(spark, "raw_corpus")
    S._csv(c.select((F.col("label") + 1).alias("c0"), "source", "text"), raw_p)
    raw = R.scan_raw_class_csv(spark, raw_p, 3, mode="join", multiline=True)
    sample = W.stratified_sample(raw, "text", "label", F.lit(500) + F.lit(500) * F.col("label"), seed=42, strict=False)
    processed = sample.select("label", T.tokenize_rejoin(T.keep_ascii(T.clean_answers("text"))).alias("text"))
    out_p = shared_path(spark, "p_train")
    S.write_labeled_csv(processed, out_p)
    return R.scan_labeled_csv(spark, out_p)


@register("result_report", lambda: _summary_sql())
def q_result_report(spark, sf_dir):
    """PIPE-15: trial summaries appended as result lines → SRC-10 → PRJ-1 → SNK-5 → re-read."""
    p = shared_path(spark, "report_lines")
    S.append_run_result(_summary_rows(spark, sf_dir), p)
    lines = R.scan_result_files(spark, p + "/*/*.json", base_path=p)
    csv_p = shared_path(spark, "report_csv")
    S.write_result_summary(lines, csv_p)
    back = spark.read.option("header", "true").schema(
        "corpora STRING, feat_name STRING, n_topics INT, best_acc DOUBLE, best_nmi DOUBLE, best_ari DOUBLE").csv(csv_p)
    return back.select("corpora", "feat_name", "n_topics", *[F.round(c, 6).alias(c) for c in ("best_acc", "best_nmi", "best_ari")])


TRANSFORMS = {"i": V.identity_transform, "ln": V.layer_norm, "norm": V.l2_normalize}


def _trials(d, k=4, n_trials=10, n_init=10):
    """Counts of ``n_trials`` k-means trials (best of ``n_init`` each) on (id, label, x), for ``_summaries``."""
    preds = kmeans_trials(d, k, n_trials, n_init, "id", "x", seed=11)
    cells = M.contingency_table(preds, by=["trial"]).toArrow()                 # at most K² cells a trial
    preds.unpersist()
    d.unpersist()
    return cells


def _summaries(spark, cells):
    """Summary row of the trials of each run, all runs scored together."""
    s = trial_summary(M.cluster_scores(M.counted_cells(spark, cells), by=["run", "trial"]), ["run"])
    return [r for _, r in sorted((r["run"], r) for r in s.collect())]


@register("pooled_embedding_kmeans")
def q_pooled_kmeans(spark, sf_dir):
    """PIPE-2: token vectors pooled per document (mean / max) × transform (identity / layer norm /
    L2) → k-means (k = 4, 10 trials × 10 restarts, all runs in shared passes) → scores vs labels."""
    tv = token_vectors(fx.token_rows(spark, sf_dir, by_document=True), fx.word_vectors(spark, sf_dir), "token")
    labels = fx.corpus(spark, sf_dir).select("doc_id", "label")
    runs, cells = [], []
    for pool in ("mean", "max"):
        pooled = A.pool_tokens(tv, pool, "doc_id", "pos", "vec", together=True).join(labels, "doc_id").persist()
        for name, fn in TRANSFORMS.items():
            d = pooled.select(F.col("doc_id").alias("id"), "label", fn("vec").alias("x")).filter(F.col("x").isNotNull()).persist()
            cells.append(_trials(d))
            runs.append((pool, name))
        pooled.unpersist()
    out = [(*run, float(s["acc_mean"]), float(s["nmi_mean"]), float(s["ami_mean"])) for run, s in zip(runs, _summaries(spark, cells))]
    return spark.createDataFrame(out, "pool string, transform string, acc_mean double, nmi_mean double, ami_mean double")


@register("pca_sweep")
def q_pca_sweep(spark, sf_dir):
    """PIPE-4: transform (identity / layer norm / L2) → PCA with n components, n > D being skipped →
    k-means (k = 10, 10 trials × 10 restarts) → accuracy, NMI and AMI.  The survey's 50, 100, 200, 300
    and 16, as the embeddings have 64 dimensions."""
    f = fx.feat(spark, sf_dir)
    runs, cells = [], []
    for name, fn in TRANSFORMS.items():
        d = f.select(F.col("vec_id").alias("id"), "label", fn("x").alias("x")).filter(F.col("x").isNotNull()).persist()
        for n in (16, 50, 100, 200, 300):
            z = C.pca(d, n, "x", "z")
            runs.append((name, n, z is not None))
            if z is not None:
                cells.append(_trials(z.select("id", "label", F.col("z").alias("x")).persist(), k=10))
        d.unpersist()
    scores = iter(_summaries(spark, cells) if cells else [])
    rows = [(*run, *[float(s[c]) for c in ("acc_mean", "nmi_mean", "ami_mean")]) if run[2] else (*run, None, None, None)
            for run in runs for s in ([next(scores)] if run[2] else [None])]
    return spark.createDataFrame(rows, "transform string, n_components int, feasible boolean, acc_mean double, nmi_mean double, ami_mean double")


def _sentence_vectors(spark, sf_dir, docs=None):
    """(doc_id, vec): mean of the sentence means of the word vectors (ML-4)."""
    c = fx.corpus(spark, sf_dir) if docs is None else docs
    sent = fx.together(c.select("doc_id", "text")).select("doc_id", F.posexplode(T.split_sentences("text")).alias("sent_no", "s"))
    tok = sent.select("doc_id", "sent_no", F.posexplode(T.vectorizer_tokens("s")).alias("pos", "token"))
    tv = token_vectors(tok, fx.word_vectors(spark, sf_dir), "token")
    return A.pool_sentences(tv, "doc_id", "sent_no", "vec", together=True)


def _sentence_trials(spark, sf_dir, docs):
    pooled = _sentence_vectors(spark, sf_dir, docs).join(docs.select("doc_id", "label"), "doc_id").persist()
    runs, cells = [], []
    for name, fn in TRANSFORMS.items():
        d = pooled.select(F.col("doc_id").alias("id"), "label", fn("vec").alias("x")).filter(F.col("x").isNotNull()).persist()
        runs.append((name, d.count()))
        cells.append(_trials(d))
    pooled.unpersist()
    out = [(*run, *[float(s[c]) for c in ("acc_mean", "nmi_mean", "ami_mean", "best_acc")]) for run, s in zip(runs, _summaries(spark, cells))]
    return spark.createDataFrame(out, "transform string, rows long, acc_mean double, nmi_mean double, ami_mean double, best_acc double")


@register("sentence_embedding_kmeans")
def q_sentence_kmeans(spark, sf_dir):
    """PIPE-3: sentence embeddings × transform → k-means (10 trials × 10 restarts) → scores."""
    return _sentence_trials(spark, sf_dir, fx.corpus(spark, sf_dir))


@register("unequal_class_kmeans")
def q_unequal_kmeans(spark, sf_dir):
    """PIPE-9: the sample with 500 + 500·c rows of class c (classes smaller than that give all their
    rows) → the run of PIPE-3."""
    sample = W.stratified_sample(fx.corpus(spark, sf_dir), "doc_id", "label", F.lit(500) + F.lit(500) * F.col("label"), seed=42, strict=False)
    return _sentence_trials(spark, sf_dir, sample.persist())


@register("feature_dump", _tfidf_sql)
def q_feature_dump(spark, sf_dir):
    """PIPE-13: TF-IDF fitted on the corpus, one dump for each half of the ids (train, test), read
    back together."""
    long = feats.tfidf_long(fx.tokens(spark, sf_dir), MAX_FEATURES)
    p = shared_path(spark, "feature_dump")
    for name, part in (("train", F.col("doc_id") % 2 == 0), ("test", F.col("doc_id") % 2 != 0)):
        long.where(part).write.mode("overwrite").parquet(f"{p}/{name}")
    back = spark.read.schema(long.schema).parquet(f"{p}/train", f"{p}/test")
    return back.withColumn("tfidf", F.round("tfidf", 6))


def _report_sql():
    from .q_relational import _top_words_sql
    from .sqlparts import explain_tokens_cte
    return (with_(corpus_cte(), explain_tokens_cte(), _top_words_sql(30)) +
            "SELECT 'embeddings' AS corpora, 'fixed' AS feat_name, cluster, array_to_string(list(word ORDER BY rank), ' ') AS words "
            "FROM tw GROUP BY cluster")


def _report(spark, sf_dir, label):
    """The record of one kind of word list (SNK-7) of the first stored run of a feature (FLT-8), re-read."""
    runs = shared_path(spark, "runs")
    S.append_run_result(_summary_rows(spark, sf_dir), runs)
    run = lookup_run(spark.read.schema(R.RESULT_SCHEMA.replace(", _corrupt_record STRING", "")).json(runs), "corpora", feat_name="fixed")
    et = fx.explain_tokens(spark, sf_dir)
    if label == "count":
        r = explain_by_count(et, 30, "tokens", "label")
    else:
        r = explain_by_weight(et.select("doc_id", "label", "tokens"), 30, feats.fit_vocabulary(et, 2000, "tokens"), "tokens", "label")
    lists = r.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("words"))
    # One record a run: at most 30 words for each of the clusters.
    rec = lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "words"))), lambda s: s["words"]).alias("result")) \
        .withColumn("feat_name", F.lit("fixed")).join(run.select("corpora", "feat_name"), "feat_name").withColumn("label", F.lit(label))
    p = shared_path(spark, "report")
    S.append_interpretation(rec, p)
    return spark.read.parquet(p).select("corpora", "feat_name", F.posexplode("result").alias("cluster", "w")) \
        .select("corpora", "feat_name", F.col("cluster").cast("int"), "w")


@register("explanation_report", _report_sql)
def q_explanation_report(spark, sf_dir):
    """PIPE-14, count branch: the clusters' 30 most frequent words (EVAL-11)."""
    return _report(spark, sf_dir, "count").select("corpora", "feat_name", "cluster", F.array_join("w", " ").alias("words"))


@register("explanation_report_by_weight")
def q_explanation_report_by_weight(spark, sf_dir):
    """PIPE-14, weight branch: the 30 words of each cluster with the largest weights (EVAL-10)."""
    return _report(spark, sf_dir, "weight").select("corpora", "feat_name", "cluster", F.size("w").alias("n_words"))
