"""Queries: clustering, topic models, networks and deep-clustering objectives (ML-*, EVAL-10/13).

Seed- or partition-dependent operators are registered without an oracle and return a small
property table computed by Spark (violations = 0, conservation, monotone loss …).  Their
deterministic cores (one Lloyd step, one DEC gradient, the fixed network) have SQL oracles.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import argmax, student_t_assignment
from ..operators import clustering as C
from ..operators import deep as DP
from ..operators import features as feats
from ..operators import training as TR
from ..operators.common import literal_matrix
from ..operators.kmeans_runs import kmeans_runs
from ..operators.topics import gsdmm
from . import fixtures as fx
from .registry import register
from .sqlparts import centers_cte, feat_cte, pred_cte, shuffle_key, sq_dist, with_

R6 = lambda c: F.round(c, 6)


def _props(spark, items):
    return spark.createDataFrame([(k, float(v)) for k, v in items], "property string, value double")


def _tfidf_data(spark, sf_dir):
    tok = fx.tokens(spark, sf_dir)
    vocab = feats.fit_vocabulary(tok, 2000)
    return feats.tfidf_sparse(tok, vocab, ["doc_id", "label"]).persist(), vocab


@register("kmeans")
def q_kmeans(spark, sf_dir):
    """ML-6 on TF-IDF documents, k = 4, best of 10 restarts: every row sits at its nearest centre."""
    data, vocab = _tfidf_data(spark, sf_dir)
    Cs, inertia, its = kmeans_runs(data, 4, 10, "doc_id", None, "idx", "val", len(vocab.terms), seed=0)
    from ..operators.kmeans_runs import assign_runs
    pred = assign_runs(data, Cs, [int(np.argmin(inertia))], "doc_id", None, "idx", "val", len(vocab.terms)).persist()
    n = pred.count()
    sizes = pred.groupBy("pred").count().collect()
    return _props(spark, [("rows", n), ("sizes_sum", sum(r["count"] for r in sizes)), ("clusters", len(sizes)),
                          ("iterations", its), ("inertia", round(float(inertia.min()), 6))])


@register("kmeans_embeddings")
def q_kmeans_emb(spark, sf_dir):
    """ML-6 (best of 10) on embeddings with k = 10; nearest-centre violations must be 0."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    Cs, inertia, _ = kmeans_runs(f, 10, 10, "id", "x", seed=1)
    best = Cs[int(np.argmin(inertia))]
    a = C.assign_nearest(f, best.tolist(), "x", "pred", with_distance=True)
    cost = a.agg(F.sum("dist2")).first()[0]
    return _props(spark, [("rows", a.count()), ("cost_matches_inertia", abs(cost - float(inertia.min())) < 1e-6 * max(1.0, cost))])


def _lloyd_sql():
    return (with_(feat_cte(), centers_cte(), pred_cte()) +
            "SELECT pred AS center_id, CAST(d - 1 AS INTEGER) AS dim, round(avg(v), 6) AS value FROM "
            "(SELECT pred, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM pred) GROUP BY pred, d")


@register("kmeans_from_centers_step", _lloyd_sql)
def q_lloyd_step(spark, sf_dir):
    new, _ = C.lloyd_step(fx.feat(spark, sf_dir), fx.fixed_centers(spark, sf_dir), "x")
    rows = [(k, d, round(v, 6)) for k, c in enumerate(new) for d, v in enumerate(c)]
    return spark.createDataFrame(rows, "center_id int, dim int, value double")


@register("kmeans_from_centers")
def q_lloyd(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    c0 = fx.fixed_centers(spark, sf_dir)
    before = C.kmeans_cost(f, c0)
    c1, its = C.kmeans_from_centers(f, c0, "x", max_iter=50)
    after = C.kmeans_cost(f, c1)
    return _props(spark, [("iterations", its), ("cost_not_increased", after <= before + 1e-9)])


@register("pca")
def q_pca(spark, sf_dir):
    """ML-5, 8 components: variances non-increasing, components centred."""
    z = C.pca(fx.feat(spark, sf_dir), 8, "x", "z")
    st = z.select(*[F.col("z")[i].alias(f"c{i}") for i in range(8)])
    v = st.agg(*[F.var_pop(f"c{i}").alias(f"v{i}") for i in range(8)], *[F.avg(f"c{i}").alias(f"m{i}") for i in range(8)]).first()
    var = [v[f"v{i}"] for i in range(8)]
    return _props(spark, [("components", 8), ("variance_ordered", all(a >= b - 1e-9 for a, b in zip(var, var[1:]))),
                          ("max_abs_mean", round(max(abs(v[f"m{i}"]) for i in range(8)), 6) < 1e-9)])


def _count_data(spark, sf_dir):
    tok = fx.tokens(spark, sf_dir)
    vocab = feats.fit_vocabulary(tok, 2000)
    return feats.count_vectors(tok, vocab, "tokens", "counts"), vocab


def _lda_data(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    from ..functions.vectors import vsum
    data, vocab = _count_data(spark, sf_dir)
    return data.filter(vsum(vector_to_array("counts")) > 0), vocab          # FLT-4: documents with a known word


@register("lda_cluster")
def q_lda(spark, sf_dir):
    """ML-8, 30 topics, 50 iterations: each theta row sums to 1, clusters within range."""
    from ..functions.vectors import vsum
    data, _ = _lda_data(spark, sf_dir)
    out = C.lda_cluster(data.select("doc_id", "counts"), 30, "counts", seed=0, max_iter=50)
    r = out.agg(F.max(F.abs(vsum("theta") - 1)).alias("e"), F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    return _props(spark, [("rows", r["n"]), ("rows_sum_to_one", r["e"] < 1e-6), ("pred_in_range", 0 <= r["lo"] and r["hi"] < 30)])


@register("lda_kmeans_cluster")
def q_lda_kmeans(spark, sf_dir):
    """ML-9: k-means with k = 4, best of 10 restarts, on the distributions over 30 topics; every document
    is at the centroid of its cluster or nearer to it than to any other."""
    data, _ = _lda_data(spark, sf_dir)
    out = C.lda_kmeans_cluster(data.select("doc_id", "counts"), 30, 4, n_init=10)
    means = C.centers_to_list(C.label_centroids(out, 4, "theta", "pred"), 4)
    off = C.assign_nearest(out.select("doc_id", "theta", F.col("pred").alias("was")), means, "theta", "pred").where("pred <> was").count()
    n = out.count()
    return _props(spark, [("rows", n), ("clusters", out.select("pred").distinct().count()), ("off_centre_share_small", off <= 0.01 * n)])


@register("logistic_regression")
def q_logistic(spark, sf_dir):
    """ML-11: multinomial regression of the language on binary word features: one row of coefficients a
    class, and a training accuracy above the largest class."""
    et = fx.explain_tokens(spark, sf_dir)
    vocab = feats.fit_vocabulary(et, 2000, "tokens")
    v = feats.count_vectors(et.select("doc_id", "label", "tokens"), vocab, "tokens", "counts", binary=True).select("doc_id", "label", "counts").persist()
    m = C.logistic_regression(v, "counts", "label")
    r = m.transform(v.withColumn("label", F.col("label").cast("double"))).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc")).first()
    largest = v.groupBy("label").count().agg(F.max("count")).first()[0] / v.count()
    v.unpersist()
    return _props(spark, [("classes", m.coefficientMatrix.numRows), ("terms", m.coefficientMatrix.numCols), ("above_largest_class", r["acc"] > largest)])


def _gsdmm_docs(spark, sf_dir):
    tok = fx.tokens(spark, sf_dir)
    vocab = feats.fit_vocabulary(tok, 2000)
    return feats.word_indices(tok, vocab, ["doc_id", "label"]).filter(F.size("words") > 0), len(vocab.terms)


@register("gsdmm")
def q_gsdmm(spark, sf_dir):
    """ML-10, K = 8, 10 sweeps: document and word counts conserved, cluster ids in range."""
    docs, V = _gsdmm_docs(spark, sf_dir)
    docs = docs.persist()
    z = gsdmm(docs, 8, V, 0.1, 0.1, 10, seed=0)
    j = z.join(docs, "doc_id")
    r = j.agg(F.count(F.lit(1)).alias("d"), F.sum(F.size("words")).alias("w"), F.max("z").alias("zmax")).first()
    tot = docs.agg(F.count(F.lit(1)).alias("d"), F.sum(F.size("words")).alias("w")).first()
    docs.unpersist()
    return _props(spark, [("docs_conserved", r["d"] == tot["d"]), ("words_conserved", r["w"] == tot["w"]), ("z_in_range", r["zmax"] < 8)])


def _gsdmm_sweep_sql():
    from .q_features import _pairs_sql, _vocab_sql
    from .sqlparts import corpus_cte, tokens_cte
    return (with_(corpus_cte(), tokens_cte(), _pairs_sql(), _vocab_sql(),
                  "dw AS MATERIALIZED (SELECT p.doc_id, v.idx AS w, p.tf AS n, p.doc_id % 8 AS z FROM pairs p JOIN vocab v USING (term))",
                  "d AS MATERIALIZED (SELECT doc_id, any_value(z) AS z, sum(n) AS len FROM dw GROUP BY doc_id)",
                  "k AS (SELECT range AS k FROM range(8))",
                  "mk AS (SELECT k, count(doc_id) AS m, coalesce(sum(len), 0) AS nk FROM k LEFT JOIN d ON d.z = k GROUP BY k)",
                  "nkw AS MATERIALIZED (SELECT z AS k, w, sum(n) AS n FROM dw GROUP BY z, w)",
                  "top AS (SELECT dw.doc_id, k.k, sum(list_sum(list_transform(range(dw.n::BIGINT), lambda j: ln(coalesce(nkw.n, 0) - "
                  "CASE WHEN k.k = dw.z THEN dw.n ELSE 0 END + 0.1 + j)))) AS lp FROM dw CROSS JOIN k LEFT JOIN nkw ON nkw.k = k.k AND nkw.w = dw.w GROUP BY dw.doc_id, k.k)",
                  "bot AS (SELECT d.doc_id, mk.k, ln(mk.m - CASE WHEN mk.k = d.z THEN 1 ELSE 0 END + 0.1) - list_sum(list_transform(range(d.len::BIGINT), "
                  "lambda i: ln(mk.nk - CASE WHEN mk.k = d.z THEN d.len ELSE 0 END + vs.v * 0.1 + i))) AS lp FROM d, mk, (SELECT count(*) AS v FROM vocab) vs)",
                  "p AS (SELECT doc_id, k, exp(top.lp + bot.lp - max(top.lp + bot.lp) OVER (PARTITION BY doc_id)) AS p FROM top JOIN bot USING (doc_id, k))",
                  "c AS (SELECT doc_id, k, sum(p) OVER (PARTITION BY doc_id ORDER BY k) / sum(p) OVER (PARTITION BY doc_id) AS c, "
                  "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p)")
            + "SELECT doc_id, CAST(least(count(*) FILTER (c < u), 7) AS INTEGER) AS z FROM c GROUP BY doc_id")


@register("gsdmm_sweep", _gsdmm_sweep_sql)
def q_gsdmm_sweep(spark, sf_dir):
    """ML-10, one sweep with fixed draws (from the md5 of the id) and the start doc_id mod 8."""
    docs, V = _gsdmm_docs(spark, sf_dir)
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return gsdmm(docs.select("doc_id", "words"), 8, V, 0.1, 0.1, 1, start=(F.col("doc_id") % 8).cast("int"), draw=lambda sweep: u)


def _tiny_net():
    net = DP.tiny_network([64, 8])
    dec = DP.tiny_network([8, 64])
    return {"enc": net, "dec": dec}


def _tiny_sql():
    return ("h AS (SELECT f.vec_id, f.label, w.j, sum(f.v * w.wt) AS h FROM (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM feat) f "
            "JOIN (SELECT a.range AS i, b.range AS j, ((a.range * 31 + b.range * 17) % 13 - 6) / 10.0 AS wt FROM range(64) a, range(8) b) w ON w.i = f.i "
            "GROUP BY f.vec_id, f.label, w.j)")


@register("autoencoder_encode", lambda: with_(feat_cte(), _tiny_sql()) + "SELECT vec_id AS id, CAST(j AS INTEGER) AS dim, round(h, 6) AS value FROM h")
def q_encode(spark, sf_dir):
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    h = DP.autoencoder_encode(f, _tiny_net(), "x", "h", ["id"])
    return h.select("id", F.posexplode("h").alias("dim", "v")).select("id", F.col("dim").cast("int"), R6(F.col("v")).alias("value"))


def _loss_sql():
    return (with_(feat_cte(), _tiny_sql(),
                  "hv AS (SELECT vec_id, label, list(h ORDER BY j) AS hv FROM h GROUP BY vec_id, label)",
                  "rec AS (SELECT h.vec_id, w.i, sum(h.h * w.wt) AS r FROM h JOIN (SELECT a.range AS j, b.range AS i, ((a.range * 31 + b.range * 17) % 13 - 6) / 10.0 AS wt "
                  "FROM range(8) a, range(64) b) w ON w.j = h.j GROUP BY h.vec_id, w.i)",
                  "rmse AS (SELECT avg(m) AS recons_mse FROM (SELECT r.vec_id, avg((r.r - f.x[r.i + 1]) * (r.r - f.x[r.i + 1])) AS m FROM rec r JOIN feat f USING (vec_id) GROUP BY r.vec_id))",
                  "cl AS (SELECT label AS center_id, j, avg(h) AS c FROM h GROUP BY label, j)",
                  "cc AS (SELECT center_id, list(c ORDER BY j) AS center FROM cl GROUP BY center_id)",
                  f"d AS (SELECT v.vec_id, v.hv, c.center_id, c.center, {sq_dist('v.hv', 'c.center')} AS d2 FROM hv v, cc c)",
                  "nn AS (SELECT vec_id, arg_min(center, struct_pack(d := d2, c := center_id)) AS center, any_value(hv) AS hv FROM d GROUP BY vec_id)",
                  f"cmse AS (SELECT avg({sq_dist('hv', 'center')} / 8.0) AS cluster_mse FROM nn)",
                  "q AS (SELECT vec_id, center_id, (1.0 / (1.0 + d2)) / sum(1.0 / (1.0 + d2)) OVER (PARTITION BY vec_id) AS q FROM d)",
                  "fm AS (SELECT center_id, sum(q) AS f FROM q GROUP BY center_id)",
                  "w AS (SELECT q.vec_id, q.center_id, q.q, q.q * q.q / fm.f AS w FROM q JOIN fm USING (center_id))",
                  "p AS (SELECT vec_id, center_id, q, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w)",
                  "bce AS (SELECT avg(b) AS bce FROM (SELECT vec_id, avg(-(p * ln(q) + (1 - p) * ln(1 - q))) AS b FROM p GROUP BY vec_id))")
            + "SELECT round(recons_mse, 6) AS recons_mse, round(cluster_mse, 6) AS cluster_mse, round(bce, 6) AS bce FROM rmse, cmse, bce")


@register("clustering_loss_values", _loss_sql)
def q_loss_values(spark, sf_dir):
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    net = _tiny_net()
    h = DP.autoencoder_encode(f.select("id", "label", "x"), net, "x", "h", ["id", "label"])
    centers = C.centers_to_list(C.label_centroids(h, fx.N_LABELS, "h", "label"), fx.N_LABELS)
    r = DP.clustering_loss_values(f, net, centers, "x", "id")
    return r.select(*[R6(F.col(c)).alias(c) for c in ("recons_mse", "cluster_mse", "bce")])


def _dec_grad_sql():
    return (with_(feat_cte(), centers_cte(),
                  f"u AS (SELECT f.vec_id, c.center_id, 1.0 / (1.0 + {sq_dist('f.x', 'c.center')}) AS u FROM feat f, centers c)",
                  "q AS (SELECT vec_id, center_id, u, sum(u) OVER (PARTITION BY vec_id) AS s, u / sum(u) OVER (PARTITION BY vec_id) AS q FROM u)",
                  "fm AS (SELECT center_id, sum(q) AS f FROM q GROUP BY center_id)",
                  "w AS (SELECT q.*, q.q * q.q / fm.f AS w FROM q JOIN fm USING (center_id))",
                  "p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w)",
                  "g AS (SELECT *, (q - p) / (q * (1 - q)) / ((SELECT count(*) FROM feat) * 10.0) AS g FROM p)",
                  "cf AS (SELECT vec_id, center_id, (g - sum(g * q) OVER (PARTITION BY vec_id)) / s * 2.0 * u * u AS coef FROM g)",
                  "gx AS (SELECT cf.center_id, d, sum(cf.coef * v) AS sx, sum(cf.coef) AS sc FROM cf JOIN (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM feat) fx USING (vec_id) GROUP BY cf.center_id, d)")
            + "SELECT gx.center_id, CAST(gx.d - 1 AS INTEGER) AS dim, round((gx.sx - gx.sc * c.v) * 1e6, 6) AS grad_e6 FROM gx JOIN centers_long c ON c.center_id = gx.center_id AND c.d = gx.d")


@register("dec_gradient", _dec_grad_sql)
def q_dec_gradient(spark, sf_dir):
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    g, _ = DP.dec_gradient(f, fx.fixed_centers(spark, sf_dir), "x", "id")
    rows = [(k, d, round(float(v) * 1e6, 6)) for k in range(g.shape[0]) for d, v in enumerate(g[k])]
    return spark.createDataFrame(rows, "center_id int, dim int, grad_e6 double")


@register("dec_refine")
def q_dec_refine(spark, sf_dir):
    """ML-14, up to 20 steps from k-means centres: the BCE loss does not increase overall."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    m = []
    DP.dec_refine(f, _kmeans_start(f, "x"), max_steps=20, update_interval=10, tol=1e-3, lr=1e-3, metrics=m)
    losses = [v for k, _, v in m if k == "bce_loss"]
    return _props(spark, [("steps", len(losses)), ("loss_first", round(losses[0], 9)), ("loss_last", round(losses[-1], 9)),
                          ("loss_not_increased", losses[-1] <= losses[0] + 1e-12)])


@register("autoencoder_fit")
def q_ae_fit(spark, sf_dir):
    """ML-13: reconstruction loss falls over 15 full-batch epochs of [64, 32, 8]."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    net, losses = DP.autoencoder_fit(f, [64, 32, 8], epochs=15, lr=0.5, momentum=0.9, seed=0)
    return _props(spark, [("epochs", len(losses)), ("loss_first", round(losses[0], 9)), ("loss_last", round(losses[-1], 9)),
                          ("loss_fell", losses[-1] < losses[0])])


@register("idec_fit")
def q_idec(spark, sf_dir):
    """ML-15 (IDEC, use_ae) for up to 10 steps from the tiny network and k-means on its codes."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    net = _tiny_net()
    c0 = _kmeans_start(DP.autoencoder_encode(f.select("id", "x"), net, "x", "h", ["id"]), "h")
    m = []
    net2, c1 = DP.idec_fit(f, net, c0, max_steps=10, update_interval=5, lr=1e-3, metrics=m)
    losses = [v for k, _, v in m if k == "loss"]
    return _props(spark, [("steps", len(losses)), ("loss_not_increased", losses[-1] <= losses[0] + 1e-12)])


@register("constraint_loss", lambda: with_(feat_cte(), centers_cte(),
          "seeds AS (SELECT vec_id, label, rn FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label "
          f"ORDER BY {shuffle_key('vec_id')}, vec_id) AS rn FROM feat) WHERE rn <= 10)",
          "pr AS (SELECT a.vec_id AS id1, b.vec_id AS id2 FROM seeds a JOIN seeds b ON a.label = b.label AND b.rn = a.rn + 1)",
          f"u AS (SELECT f.vec_id, c.center_id, 1.0 / (1.0 + {sq_dist('f.x', 'c.center')}) AS u FROM feat f, centers c)",
          "q AS (SELECT vec_id, center_id, u / sum(u) OVER (PARTITION BY vec_id) AS q FROM u)") +
          "SELECT round(avg(-(q2.q * ln(q1.q) + (1 - q2.q) * ln(1 - q1.q))), 6) AS constraint_bce FROM pr "
          "JOIN q q1 ON q1.vec_id = pr.id1 JOIN q q2 ON q2.vec_id = pr.id2 AND q2.center_id = q1.center_id")
def q_constraint_loss(spark, sf_dir):
    from pyspark.sql.window import Window
    from ..operators import windows as W
    from ..operators.joins import constraint_pair_features
    from ..operators.deep import constraint_loss
    f = fx.feat(spark, sf_dir)
    s = W.select_seeds(f.select("vec_id", "label"), "vec_id", "label", 10, 42).withColumn("_h", W.hash_key("vec_id", 42))
    pairs = s.withColumn("id2", F.lead("vec_id").over(Window.partitionBy("label").orderBy("_h", "vec_id"))) \
             .filter(F.col("id2").isNotNull()).select(F.col("vec_id").alias("id1"), "id2")
    pf = constraint_pair_features(pairs, f.withColumnRenamed("vec_id", "id"), "id", "x")
    return constraint_loss(pf, fx.fixed_centers(spark, sf_dir)).select(R6(F.col("constraint_bce")).alias("constraint_bce"))


@register("explain_by_weight")
def q_explain_weight(spark, sf_dir):
    """EVAL-10: binary features → logistic regression on the clusters → 5 words per cluster."""
    from ..operators.explain import explain_by_weight
    et = fx.explain_tokens(spark, sf_dir)
    vocab = feats.fit_vocabulary(et, 2000, "tokens")
    r = explain_by_weight(et.select("doc_id", "label", "tokens"), 5, vocab, "tokens", "label")
    return r.select("cluster", "word", F.col("rank").cast("int"))


def _weights_sql():
    from .q_features import _pairs_sql, _vocab_sql
    from .sqlparts import corpus_cte, tokens_cte
    return (with_(corpus_cte(), tokens_cte(), _pairs_sql(), _vocab_sql(),
                  "w AS (SELECT p.doc_id, p.term, p.tf * (ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + v.df)) + 1.0) AS raw FROM pairs p JOIN vocab v USING (term))",
                  "tw AS (SELECT w.doc_id, w.term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY w.doc_id)) AS tfidf FROM w)",
                  "cw AS (SELECT c.label AS cluster, tw.term AS word, sum(tw.tfidf) AS weight FROM tw JOIN corpus c USING (doc_id) GROUP BY c.label, tw.term)")
            + "SELECT cluster, word, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(weight) DESC, word) AS rank FROM cw) WHERE rank <= 30")


@register("top_features_by_weight", _weights_sql)
def q_top_weight(spark, sf_dir):
    from ..operators.windows import top_k_per_group
    tok = fx.tokens(spark, sf_dir)
    long = feats.tfidf_long(tok, 2000).join(fx.corpus(spark, sf_dir).select("doc_id", "label"), "doc_id")
    w = long.groupBy(F.col("label").alias("cluster"), F.col("term").alias("word")).agg(F.sum("tfidf").alias("weight"))
    r = top_k_per_group(w, ["cluster"], [F.abs("weight").desc(), F.col("word").asc()], 30)
    return r.select("cluster", "word", R6(F.col("weight")).alias("weight"), F.col("rank").cast("bigint"))


@register("tfidf_kmeans")
def q_tfidf_kmeans(spark, sf_dir):
    """PIPE-1 (flagship): 10 trials × 10 restarts, scored against the language labels."""
    from .flagship import tfidf_kmeans
    return tfidf_kmeans(spark, sf_dir)


@register("streaming_online_kmeans", lambda: __import__("lexicluster.plans.q_vectors", fromlist=["x"])._online_sql(False))
def q_stream_kmeans(spark, sf_dir):
    """STR-1: feat split into 4 parquet files (vec_id mod 4), streamed one file per trigger and
    folded into the fixed label centres (prior counts = label sizes), assignment against the
    initial centres; the final state equals one update over all rows."""
    from ..session import shared_path
    from ..streaming.online_kmeans import online_kmeans_stream
    f = fx.feat(spark, sf_dir)
    src = shared_path(spark, "stream_src")
    f.repartition(4, F.col("vec_id") % 4).write.mode("overwrite").parquet(src)
    counts_rows = {r["label"]: r["n"] for r in f.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [counts_rows.get(k, 0) for k in range(fx.N_LABELS)]
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(src)
    centres, _ = online_kmeans_stream(spark, stream, fx.fixed_centers(spark, sf_dir), counts,
                                      shared_path(spark, "stream_state"), shared_path(spark, "stream_ckpt"), "x", "initial")
    rows = [(k, d, round(v, 6)) for k, c in enumerate(centres) for d, v in enumerate(c)]
    return spark.createDataFrame(rows, "center_id int, dim int, value double")


def _kmeans_start(h, x_col, n_init: int = 20):
    """Centres of the best of ``n_init`` k-means restarts (no label is read)."""
    Cs, inertia, _ = kmeans_runs(h.select("id", x_col), fx.N_LABELS, n_init, "id", x_col, seed=0)
    return Cs[int(np.argmin(inertia))].tolist()


def _hidden_start(spark, sf_dir, seeds=None):
    """Features, network and centres: of k-means, or the seeds' own centroids."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    net = DP.autoencoder([64, 32, 8], seed=0)
    h = DP.autoencoder_encode(f.select("id", "x"), net, "x", "h", ["id"])
    if seeds is None:
        return f, net, _kmeans_start(h, "h")
    seeded = h.join(seeds.select("id", "label"), "id")
    return f, net, C.centers_to_list(C.label_centroids(seeded, fx.N_LABELS, "h", "label"), fx.N_LABELS)


def _dcn_props(spark, sf_dir, **kw):
    f, net, c0 = _hidden_start(spark, sf_dir, kw.get("seeds"))
    m = []
    net2, c1, pred = TR.dcn_fit(f, net, c0, epochs=4, lr=0.05, metrics=m, **kw)
    losses = [v for k, _, v in m if k == "loss"]
    r = pred.agg(F.count(F.lit(1)).alias("n"), F.min("pred").alias("lo"), F.max("pred").alias("hi")).first()
    off = [] if kw.get("seeds") is None else [
        ("seeds_off_label", pred.join(kw["seeds"], "id").where("pred <> label").count())]
    return _props(spark, [*off, ("epochs", len(losses)), ("rows", r["n"]), ("pred_in_range", 0 <= r["lo"] and r["hi"] < fx.N_LABELS),
                          ("loss_first", round(losses[0], 9)), ("loss_last", round(losses[-1], 9)), ("loss_fell", losses[-1] < losses[0])])


@register("dcn_fit")
def q_dcn(spark, sf_dir):
    """ML-18: mini-batches of 256 in id order, each with a network step and a running-mean centre
    update; a Lloyd refresh per epoch."""
    return _dcn_props(spark, sf_dir)


@register("dcn_fit_shuffled")
def q_dcn_shuffled(spark, sf_dir):
    """ML-19: a new permutation of the rows in each epoch; centre updates from epoch 1 on, with the
    cluster sizes as counts (init_num < 0)."""
    return _dcn_props(spark, sf_dir, shuffle=True, count_epoch=1, init_num=-1)


@register("seeded_dcn_fit")
def q_seeded_dcn(spark, sf_dir):
    """ML-20: ten seeds per label pinned to their label during centre updates, with the seed loss."""
    from ..operators import windows as W
    seeds = W.select_seeds(fx.feat(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), "id", "label", 10, 42)
    return _dcn_props(spark, sf_dir, seeds=seeds, seed_lam=1.0)


@register("virtual_adversarial_loss")
def q_vat(spark, sf_dir):
    """ML-22 through the encoder [64, 32, 8] at the label centres of its codes: one power iteration
    raises the loss over that of the random directions it starts from."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    net = DP.autoencoder([64, 32, 8], seed=0)
    h = DP.autoencoder_encode(f, net, "x", "h", ["id", "label"])
    centers = C.centers_to_list(C.label_centroids(h, fx.N_LABELS, "h", "label"), fx.N_LABELS)
    start, after = (TR.virtual_adversarial_loss(f, centers, net, 0.1, ip, 0).first()[0] for ip in (0, 1))
    return _props(spark, [("vat_loss", round(after, 9)), ("non_negative", after >= 0), ("above_random_direction", after >= start)])


@register("constrained_fit")
def q_constrained(spark, sf_dir):
    """ML-21 training: pairs of seeds of one label, a third of the steps on pairs, VAT loss on the
    others; the pairs agree better afterwards."""
    from pyspark.sql.window import Window
    from ..operators import windows as W
    from ..operators.joins import constraint_pair_features
    f, net, c0 = _hidden_start(spark, sf_dir)
    s = W.select_seeds(f.select("id", "label"), "id", "label", 10, 42).withColumn("_h", W.hash_key("id", 42))
    pairs = s.select(F.col("id").alias("id1"), F.lead("id").over(Window.partitionBy("label").orderBy("_h", "id")).alias("id2")) \
        .where("id2 IS NOT NULL")

    def agree(net, centers):
        h = DP.autoencoder_encode(f, net, "x", "h", ["id"])
        return DP.constraint_loss(constraint_pair_features(pairs, h, "id", "h"), np.asarray(centers).tolist()).first()[0]

    m = []
    net2, c1 = TR.constrained_fit(f, pairs, net, c0, max_steps=12, update_interval=6, tol=0.0, pair_share=0.35, use_vat=True, metrics=m)
    return _props(spark, [("ordinary_steps", sum(k == "loss" for k, _, _ in m)), ("pair_steps", sum(k == "pair_loss" for k, _, _ in m)),
                          ("pairs_agree_better", agree(net2, c1) < agree(net, c0))])


@register("autoencoder_pretrain")
def q_pretrain(spark, sf_dir):
    """ML-13: stages [64, 32], [32, 8] and the final joint fit; the loss falls in each, and a second
    run over the stored stages gives the same weights without training."""
    from ..session import shared_path
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    m, again, path = [], [], shared_path(spark, "pretraining")
    fit = dict(epochs=5, final_epochs=6, lr=1.0, decay_every=4, path=path)
    net = TR.autoencoder_pretrain(f, [64, 32, 8], metrics=m, **fit)
    same = TR.autoencoder_pretrain(f, [64, 32, 8], metrics=again, **fit)
    loss = {}
    for k, _, v in m:
        loss.setdefault(k, []).append(v)
    return _props(spark, [("stages", len(loss)), *((f"{k}_fell", v[-1] < v[0]) for k, v in sorted(loss.items())),
                          ("resumed_equal", all(np.array_equal(a, b) for a, b in zip(DP._params(net), DP._params(same)))),
                          ("epochs_when_resumed", len(again))])


@register("pseudo_label_finetune")
def q_pseudo(spark, sf_dir):
    """ML-23: three joint epochs on k-means pseudo labels; accuracy on the pseudo labels."""
    f, net, _ = _hidden_start(spark, sf_dir)
    _, _, acc = DP.pseudo_label_finetune(f, net, 4, epochs=3)
    return _props(spark, [("pseudo_label_acc", round(acc, 6)), ("acc_in_range", 0.0 <= acc <= 1.0)])
