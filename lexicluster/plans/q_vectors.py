"""Queries: vector functions, assignment, centroids and online centre updates on `embeddings`."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering as C
from ..operators.common import literal_matrix, literal_vector
from . import fixtures as fx
from .registry import register
from .sqlparts import centers_cte, dot, feat_cte, long_form, pred_cte, shuffle_key, sq_dist, with_


def _long(df, id_cols, arr_col, value="value"):
    return df.select(*id_cols, F.posexplode(arr_col).alias("dim", "v")).select(
        *id_cols, F.col("dim").cast("int").alias("dim"), F.round("v", 6).alias(value))


@register("l2_normalize", lambda: with_(feat_cte(), "n AS (SELECT vec_id, list_transform(x, lambda v: v / sqrt("
          "list_sum(list_transform(x, lambda w: w * w)))) AS y FROM feat)") + long_form("vec_id", "y", "n"))
def q_l2(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    return _long(f.select("vec_id", V.l2_normalize("x").alias("y")), ["vec_id"], "y")


def _ln_sql(eps: float, ddof: int) -> str:
    return ("ln AS (SELECT vec_id, list_transform(x, lambda v: (v - m) / (sqrt(s / (len(x) - " + str(ddof) + ")) + " + repr(eps) + ")) AS y "
            "FROM (SELECT vec_id, x, list_avg(x) AS m, list_sum(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x)))) AS s FROM feat))")


@register("layer_norm", lambda: with_(feat_cte(), _ln_sql(0.0, 0)) + long_form("vec_id", "y", "ln"))
def q_layer_norm(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    return _long(f.select("vec_id", V.layer_norm("x").alias("y")), ["vec_id"], "y")


@register("layer_norm_eps", lambda: with_(feat_cte(), _ln_sql(1e-6, 1)) + long_form("vec_id", "y", "ln"))
def q_layer_norm_eps(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    return _long(f.select("vec_id", V.layer_norm("x", eps=1e-6, ddof=1).alias("y")), ["vec_id"], "y")


@register("identity_transform", lambda: with_(feat_cte()) + long_form("vec_id", "x", "feat"))
def q_identity(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    return _long(f.select("vec_id", V.identity_transform("x").alias("y")), ["vec_id"], "y")


@register("label_centroids", lambda: with_(feat_cte(), centers_cte()) + long_form("center_id", "center", "centers"))
def q_label_centroids(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    return _long(C.label_centroids(f, fx.N_LABELS), ["center_id"], "center")


@register("nearest_center", lambda: with_(feat_cte(), centers_cte(), pred_cte()) +
          "SELECT vec_id, pred, round(sqrt(dist2), 6) AS dist FROM pred")
def q_nearest(spark, sf_dir):
    p = C.assign_nearest(fx.feat(spark, sf_dir), fx.fixed_centers(spark, sf_dir), "x", "pred", with_distance=True)
    return p.select("vec_id", "pred", F.round(F.sqrt("dist2"), 6).alias("dist"))


@register("predict_cluster", lambda: with_(feat_cte(), centers_cte(), pred_cte()) +
          "SELECT vec_id, pred FROM pred")
def q_predict(spark, sf_dir):
    return C.predict_cluster(fx.feat(spark, sf_dir), fx.fixed_centers(spark, sf_dir)).select("vec_id", "pred")


@register("assigned_center", lambda: with_(feat_cte(), centers_cte(), pred_cte(),
          "ac AS (SELECT p.vec_id, c.center FROM pred p JOIN centers c ON p.pred = c.center_id)") +
          long_form("vec_id", "center", "ac"))
def q_assigned_center(spark, sf_dir):
    spark_ = spark
    p = fx.pred(spark_, sf_dir)
    cdf = C.label_centroids(fx.feat(spark_, sf_dir), fx.N_LABELS)
    j = C.assigned_center(p, cdf, "pred")
    return _long(j.select("vec_id", "center"), ["vec_id"], "center")


@register("euclidean_distance", lambda: with_(feat_cte(), centers_cte()) +
          f"SELECT f.vec_id, round(sqrt({sq_dist('f.x', 'c.center')}), 6) AS dist FROM feat f JOIN centers c ON f.label = c.center_id")
def q_euclid(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    cs = literal_matrix(fx.fixed_centers(spark, sf_dir))
    return f.select("vec_id", F.round(V.euclidean_distance("x", F.element_at(cs, F.col("label") + 1)), 6).alias("dist"))


@register("cosine_similarity", lambda: with_(feat_cte(), centers_cte()) +
          f"SELECT f.vec_id, round({dot('f.x', 'c.center')} / sqrt({dot('f.x', 'f.x')} * {dot('c.center', 'c.center')}), 6) AS cos "
          "FROM feat f JOIN centers c ON f.label = c.center_id")
def q_cosine(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    cs = literal_matrix(fx.fixed_centers(spark, sf_dir))
    return f.select("vec_id", F.round(V.cosine_similarity("x", F.element_at(cs, F.col("label") + 1)), 6).alias("cos"))


def _q_sql() -> str:
    return (f"u AS (SELECT f.vec_id, c.center_id, 1.0 / (1.0 + {sq_dist('f.x', 'c.center')}) AS u FROM feat f, centers c),\n"
            "q AS (SELECT vec_id, center_id, u / sum(u) OVER (PARTITION BY vec_id) AS q FROM u)")


@register("student_t_assignment", lambda: with_(feat_cte(), centers_cte(), _q_sql()) +
          "SELECT vec_id, center_id, round(q, 6) AS q FROM q")
def q_student_t(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    q = f.select("vec_id", V.student_t_assignment("x", literal_matrix(fx.fixed_centers(spark, sf_dir))).alias("q"))
    return q.select("vec_id", F.posexplode("q").alias("center_id", "q")).select(
        "vec_id", F.col("center_id").cast("int").alias("center_id"), F.round("q", 6).alias("q"))


def _soft_q(spark, sf_dir):
    f = fx.feat(spark, sf_dir)
    return f.select("vec_id", V.student_t_assignment("x", literal_matrix(fx.fixed_centers(spark, sf_dir))).alias("q"))


@register("soft_cluster_mass", lambda: with_(feat_cte(), centers_cte(), _q_sql()) +
          "SELECT center_id, round(sum(q), 6) AS mass FROM q GROUP BY center_id")
def q_soft_mass(spark, sf_dir):
    from ..operators.deep import soft_cluster_mass
    q = _soft_q(spark, sf_dir)
    m = soft_cluster_mass(q, "q")
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(m)], "center_id int, mass double")


@register("target_distribution", lambda: with_(feat_cte(), centers_cte(), _q_sql(),
          "f AS (SELECT center_id, sum(q) AS f FROM q GROUP BY center_id)",
          "w AS (SELECT q.vec_id, q.center_id, q.q * q.q / f.f AS w FROM q JOIN f USING (center_id))") +
          "SELECT vec_id, center_id, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM w")
def q_target(spark, sf_dir):
    from ..operators.deep import soft_cluster_mass
    q = _soft_q(spark, sf_dir).persist()
    mass = soft_cluster_mass(q, "q")
    p = q.select("vec_id", V.target_distribution("q", literal_vector(mass)).alias("p"))
    return p.select("vec_id", F.posexplode("p").alias("center_id", "p")).select(
        "vec_id", F.col("center_id").cast("int").alias("center_id"), F.round("p", 6).alias("p"))


@register("argmax_cluster", lambda: with_(feat_cte(), centers_cte(), _q_sql()) +
          "SELECT vec_id, CAST(arg_max(center_id, struct_pack(q := q, c := -center_id)) AS INTEGER) AS pred FROM q GROUP BY vec_id")
def q_argmax(spark, sf_dir):
    return _soft_q(spark, sf_dir).select("vec_id", V.argmax("q").alias("pred"))


@register("cluster_sizes", lambda: with_(feat_cte(), centers_cte(), pred_cte()) +
          "SELECT r.center_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT CAST(range AS INTEGER) AS center_id FROM range(10)) r "
          "LEFT JOIN (SELECT pred AS center_id, count(*) AS n FROM pred GROUP BY pred) c USING (center_id)")
def q_cluster_sizes(spark, sf_dir):
    return C.cluster_sizes(fx.pred(spark, sf_dir), fx.N_LABELS)


def _online_sql(seeded: bool) -> str:
    target = "coalesce(s.label, p.pred)" if seeded else "p.pred"
    seeds = (f"seeds AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label "
             f"ORDER BY {shuffle_key('vec_id')}, vec_id) AS rn FROM feat) WHERE rn <= 10)")
    return (with_(feat_cte(), centers_cte(), pred_cte(), seeds,
                  "n0 AS (SELECT label AS center_id, count(*) AS n0 FROM feat GROUP BY label)",
                  f"asg AS (SELECT {target} AS center_id, p.x FROM pred p LEFT JOIN seeds s USING (vec_id))",
                  "agg AS (SELECT center_id, d, sum(v) AS sx, count(*) AS m FROM (SELECT center_id, unnest(x) AS v, "
                  "generate_subscripts(x, 1) AS d FROM asg) GROUP BY center_id, d)")
            + "SELECT c.center_id, CAST(c.d - 1 AS INTEGER) AS dim, round(CASE WHEN a.m IS NULL THEN c.v "
              "ELSE (n0.n0 * c.v + a.sx) / (n0.n0 + a.m) END, 6) AS value "
              "FROM centers_long c JOIN n0 USING (center_id) LEFT JOIN agg a ON a.center_id = c.center_id AND a.d = c.d")


def _online(spark, sf_dir, seeded: bool):
    from pyspark.sql.window import Window
    f = fx.feat(spark, sf_dir)
    centers = fx.fixed_centers(spark, sf_dir)
    counts_rows = {r["label"]: r["n"] for r in f.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [counts_rows.get(k, 0) for k in range(fx.N_LABELS)]
    batch = f
    pinned = None
    if seeded:
        from ..operators.windows import select_seeds
        seeds = select_seeds(f, "vec_id", "label", 10, seed=42).select("vec_id", F.col("label").alias("seed_label"))
        batch = f.join(seeds, "vec_id", "left")
        pinned = "seed_label"
    new_c, _ = C.online_centroid_update(batch, centers, counts, "x", pinned)
    rows = [(k, d, round(v, 6)) for k, c in enumerate(new_c) for d, v in enumerate(c)]
    return spark.createDataFrame(rows, "center_id int, dim int, value double")


@register("online_centroid_update", lambda: _online_sql(False))
def q_online(spark, sf_dir):
    return _online(spark, sf_dir, False)


@register("online_centroid_update_seeded", lambda: _online_sql(True))
def q_online_seeded(spark, sf_dir):
    return _online(spark, sf_dir, True)
