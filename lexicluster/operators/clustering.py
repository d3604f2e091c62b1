"""Clustering operators (JOIN-7/8, AGG-10/12, ML-5…9, ML-11, ML-16, ML-17, ML-24).

Model state (centres K×D, topic-word counts, coefficients) is small and lives on the driver;
every step over the rows is one distributed pass: row-local assignment by a matrix product in Arrow
batches, then one partial+final aggregation keyed by cluster (a cluster holding a third of the
rows is pre-reduced in every task by the map-side combine).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import argmax
from ..session import checkpoint


# ---------------------------------------------------------------- assignment / centres

def nearest_rows(X: np.ndarray, C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance) of every row, ties → lowest centre id.  A matrix product finds
    the centres that may be nearest within its rounding; the distances that decide are summed from the
    differences themselves."""
    approx = (X * X).sum(1)[:, None] - 2.0 * (X @ C.T) + (C * C).sum(1)[None, :]
    slack = 1e-9 * ((X * X).sum(1) + (C * C).sum(1).max(initial=0.0)) + 1e-300
    row, center = np.nonzero(approx <= (approx.min(1) + slack)[:, None])
    d = np.concatenate([((X[row[a:a + 65_536]] - C[center[a:a + 65_536]]) ** 2).sum(1) for a in range(0, len(row), 65_536)] or [np.zeros(0)])
    order = np.lexsort((center, d, row))
    first = order[np.searchsorted(row[order], np.arange(len(X)))]
    return center[first].astype(np.int32), d[first]


def assign_nearest(df: DataFrame, centers: list[list[float]], x_col: str = "x", out_col: str = "pred",
                   with_distance: bool = False) -> DataFrame:
    """JOIN-7: nearest centre per row, ties → lowest centre id; a null vector has none.  The centres go
    round as one matrix; the rows pass in Arrow batches, blocks of them through one matrix product."""
    C = np.asarray(centers, dtype=np.float64)
    new = [StructField(out_col, IntegerType())] + ([StructField("dist2", DoubleType())] if with_distance else [])
    rest = df.drop(*[f.name for f in new])
    at = rest.columns.index(x_col)

    def run(batches):
        block = max(1, 4_000_000 // max(1, C.size))
        for whole in batches:
            for a in range(0, whole.num_rows, block):
                b = whole.slice(a, block)
                x = b.column(at)
                have = x.is_valid().to_numpy(zero_copy_only=False)
                X = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(have.sum()), -1)
                j, d = nearest_rows(X, C) if len(X) else (np.zeros(0, np.int32), np.zeros(0))
                place = pa.array(np.where(have, np.cumsum(have) - 1, 0), mask=~have)
                out = [pa.array(v).take(place) for v in ((j, d) if with_distance else (j,))]
                yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *[f.name for f in new]])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, *new]))


def assigned_center(df: DataFrame, centers: DataFrame, pred_col: str = "pred") -> DataFrame:
    """JOIN-8: each row's assigned centre vector (equi-join; centres bounded by K)."""
    c = centers.select(F.col("center_id").alias(pred_col), F.col("center"))
    return df.join(c, pred_col)


def cluster_sums(df: DataFrame, x_col: str = "x", pred_col: str = "pred") -> DataFrame:
    """Per cluster: count and vector sum (Summarizer = one vectorised partial aggregate)."""
    v = df.select(F.col(pred_col).alias("center_id"), array_to_vector(F.col(x_col)).alias("_v"))
    s = v.groupBy("center_id").agg(Summarizer.metrics("sum", "count").summary(F.col("_v")).alias("s"))
    return s.select("center_id", F.col("s.count").alias("n"), vector_to_array(F.col("s.sum")).alias("sum"))


def label_centroids(df: DataFrame, n_clusters: int, x_col: str = "x", label_col: str = "label") -> DataFrame:
    """AGG-12: mean vector per label; labels without rows get the zero vector."""
    s = cluster_sums(df, x_col, label_col)
    dim = df.select(F.size(x_col).alias("d")).first()["d"]
    spark = df.sparkSession
    ids = spark.range(n_clusters).select(F.col("id").cast("int").alias("center_id"))
    return (ids.join(s, "center_id", "left")
               .select("center_id", F.when(F.col("n") > 0, F.transform("sum", lambda v: v / F.col("n")))
                       .otherwise(F.array_repeat(F.lit(0.0), dim)).alias("center")))


def centers_to_list(centers: DataFrame, n_clusters: int) -> list[list[float]]:
    rows = {r["center_id"]: list(r["center"]) for r in centers.collect()}  # K rows
    return [rows[k] for k in range(n_clusters)]


def cluster_sizes(df: DataFrame, n_clusters: int, pred_col: str = "pred") -> DataFrame:
    """AGG-10: rows per cluster, zero-filled over 0..K-1."""
    c = df.groupBy(F.col(pred_col).cast("int").alias("center_id")).agg(F.count(F.lit(1)).alias("n"))
    ids = df.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias("center_id"))
    return ids.join(c, "center_id", "left").select("center_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---------------------------------------------------------------- k-means

def to_vector(df: DataFrame, x_col: str = "x", out_col: str = "features") -> DataFrame:
    return df.withColumn(out_col, array_to_vector(F.col(x_col)))


@dataclass
class KMeansResult:
    centers: list[list[float]]
    cost: float
    seed: int
    predictions: DataFrame


def kmeans(df: DataFrame, k: int, n_init: int = 10, seed: int = 0, features_col: str = "features",
           max_iter: int = 300, tol: float = 1e-4, pred_col: str = "pred") -> KMeansResult:
    """ML-6: best of ``n_init`` k-means restarts by inertia.  The input is persisted once; every
    restart is a sequence of distributed Lloyd steps inside Spark ML."""
    data = df.persist()
    best = None
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=tol, featuresCol=features_col,
                   predictionCol=pred_col).fit(data)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m, seed + i)
    cost, model, s = best
    preds = model.transform(data).withColumn(pred_col, F.col(pred_col).cast("int"))
    return KMeansResult([list(map(float, c)) for c in model.clusterCenters()], cost, s, preds)


def assign_pinned(df: DataFrame, centers, x_col: str = "x", pred_col: str = "pred", pinned_col: str | None = None) -> DataFrame:
    """The nearest centre, or for a seeded row its seed."""
    a = assign_nearest(df, centers, x_col, pred_col)
    return a if pinned_col is None else a.withColumn(pred_col, F.coalesce(F.col(pinned_col).cast("int"), F.col(pred_col)))


def lloyd_step(df: DataFrame, centers: list[list[float]], x_col: str = "x",
               pinned_col: str | None = None) -> tuple[list[list[float]], int]:
    """One Lloyd iteration: assign row-locally, aggregate per centre; empty centres stay put."""
    s = cluster_sums(assign_pinned(df, centers, x_col, "_p", pinned_col), x_col, "_p").collect()  # ≤ K rows
    new = [list(c) for c in centers]
    for r in s:
        if r["n"] > 0:
            new[r["center_id"]] = [v / r["n"] for v in r["sum"]]
    return new, len(s)


def kmeans_from_centers(df: DataFrame, centers: list[list[float]], x_col: str = "x", max_iter: int = 300,
                        tol: float = 1e-4, pinned_col: str | None = None) -> tuple[list[list[float]], int]:
    """ML-7: Lloyd iterations from given centres until the largest centre shift² ≤ tol."""
    data = df.select(x_col, *([pinned_col] if pinned_col else [])).persist()
    cur = [list(c) for c in centers]
    it = 0
    for it in range(1, max_iter + 1):
        new, _ = lloyd_step(data, cur, x_col, pinned_col)
        shift = max(sum((a - b) ** 2 for a, b in zip(c0, c1)) for c0, c1 in zip(cur, new))
        cur = new
        if shift <= tol:
            break
    data.unpersist()
    return cur, it


def kmeans_cost(df: DataFrame, centers: list[list[float]], x_col: str = "x") -> float:
    """Inertia: Σ squared distance to the nearest centre."""
    a = assign_nearest(df, centers, x_col, "_p", with_distance=True)
    return a.agg(F.sum("dist2")).first()[0]


# ---------------------------------------------------------------- online centre update

def online_centroid_update(batch: DataFrame, centers: list[list[float]], counts: list[int],
                           x_col: str = "x", pinned_col: str | None = None) -> tuple[list[list[float]], list[int]]:
    """ML-16 / ML-17: assign a batch to the nearest centre (or to its pinned seed label) and move
    each centre to the running mean c' = (n₀c + Σx)/(n₀ + m).  Order-free, so one aggregation."""
    a = assign_nearest(batch, centers, x_col, "_p")
    if pinned_col is not None:
        a = a.withColumn("_p", F.coalesce(F.col(pinned_col).cast("int"), F.col("_p")))
    s = cluster_sums(a, x_col, "_p").collect()  # ≤ K rows
    new_c = [list(c) for c in centers]
    new_n = list(counts)
    for r in s:
        k, m = r["center_id"], r["n"]
        n0 = counts[k]
        new_c[k] = [(n0 * c + sx) / (n0 + m) for c, sx in zip(centers[k], r["sum"])]
        new_n[k] = n0 + m
    return new_c, new_n


def predict_cluster(df: DataFrame, centers: list[list[float]], x_col: str = "x", encoder=None) -> DataFrame:
    """ML-24: optional encoder (ML-12) then nearest stored centre."""
    if encoder is not None:
        df = encoder(df)
    return assign_nearest(df, centers, x_col, "pred")


# ---------------------------------------------------------------- PCA, LDA, logistic regression

def pca(df: DataFrame, n_components: int, x_col: str = "x", out_col: str = "z") -> DataFrame | None:
    """ML-5: mean-centred projection on the top components; sign fixed so the largest-magnitude
    loading of each component is positive.  Returns None when n_components exceeds the dimension
    or the number of rows (the sweep skips it)."""
    dim = df.select(F.size(x_col).alias("d")).first()["d"]
    n = df.count()
    if n_components > min(dim, n):
        return None
    v = df.withColumn("_v", array_to_vector(F.col(x_col)))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v).transform(v)
    model = PCA(k=n_components, inputCol="_c", outputCol="_z").fit(centred)
    pc = model.pc.toArray()                      # D × k on the driver (bounded by D·k)
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    z = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_z", outputCol="_zs").transform(model.transform(centred))
    return z.withColumn(out_col, vector_to_array(F.col("_zs"))).drop("_v", "_c", "_z", "_zs")


def lda_cluster(df: DataFrame, n_topics: int, features_col: str = "counts", seed: int = 0,
                max_iter: int = 50, pred_col: str = "pred") -> DataFrame:
    """ML-8: LDA with alpha = n_topics/50 and eta = 0.1; cluster = most likely topic.
    Online variational LDA (EM needs alpha > 1)."""
    return lda_cluster_runs(df, n_topics, features_col, [seed], max_iter, pred_col)[0]


def lda_cluster_runs(df: DataFrame, n_topics: int, features_col: str = "counts", seeds=(0,), max_iter: int = 50, pred_col: str = "pred") -> list[DataFrame]:
    """``lda_cluster`` for several seeds, whose fits share the passes."""
    from .topics import lda_topics_runs, topic_shares
    # Every iteration draws from all documents: they are counted once, not made anew from their texts.
    df = df.persist()
    fits = lda_topics_runs(df, n_topics, features_col, n_topics / 50.0, 0.1, list(seeds), max_iter)
    return [topic_shares(df, topics, features_col, n_topics / 50.0).withColumn(pred_col, argmax("theta")) for topics in fits]


def lda_kmeans_cluster(df: DataFrame, n_topics: int, k: int, features_col: str = "counts", seed: int = 0, n_init: int = 10,
                       max_iter: int = 50, id_col: str = "doc_id") -> DataFrame:
    """ML-9: k-means (best of ``n_init`` restarts) on the LDA topic distributions: (id, theta, pred)."""
    from .kmeans_runs import kmeans_runs
    t = lda_cluster(df, n_topics, features_col, seed, max_iter).select(id_col, "theta").persist()
    Cs, inertia, _ = kmeans_runs(t, k, n_init, id_col, "theta", dim=n_topics, seed=seed)
    out = checkpoint(assign_nearest(t, Cs[int(np.argmin(inertia))].tolist(), "theta", "pred"))
    t.unpersist()
    return out


def logistic_regression(df: DataFrame, features_col: str = "counts", label_col: str = "pred",
                        max_iter: int = 100):
    """ML-11: L2-regularised (C = 1 ⇒ regParam = 1/N) multinomial logistic regression."""
    n = df.count()
    lr = LogisticRegression(featuresCol=features_col, labelCol=label_col, regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=max_iter)
    return lr.fit(df.withColumn(label_col, F.col(label_col).cast("double")))
