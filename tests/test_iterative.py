import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexicluster.operators import clustering as C
from lexicluster.operators import deep as DP
from lexicluster.operators.kmeans_runs import assign_runs, kmeans_runs
from lexicluster.operators.topics import gsdmm


def _planted(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0]], dtype=float)
    lab = rng.integers(0, 3, n)
    X = centres[lab] + rng.normal(0, 0.3, (n, 3))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "label": lab, "x": list(X)})), lab


def test_kmeans_runs_recovers_planted_clusters(spark):
    df, lab = _planted(spark)
    Cs, inertia, _ = kmeans_runs(df, 3, 4, "id", "x", seed=1)
    best = int(np.argmin(inertia))
    pred = assign_runs(df, Cs[[best]], [0], "id", "x").toPandas().sort_values("id")
    from lexicluster.operators.metrics import clustering_accuracy
    acc = clustering_accuracy(spark.createDataFrame(pd.DataFrame({"pred": pred["pred"].to_numpy(), "label": lab}))).first()["acc"]
    assert acc == 1.0


def test_lloyd_cost_non_increasing(spark):
    df, _ = _planted(spark)
    c0 = [[1.0, 1.0, 1.0], [5.0, 5.0, 0.0], [0.0, 3.0, 0.0]]
    before = C.kmeans_cost(df, c0)
    c1, _ = C.kmeans_from_centers(df, c0, "x", max_iter=20)
    assert C.kmeans_cost(df, c1) <= before


def test_online_update_equals_running_mean(spark):
    df, _ = _planted(spark, 60)
    centres = [[0.0, 0.0, 0.0], [10.0, 0.0, 0.0], [0.0, 10.0, 0.0]]
    new, n = C.online_centroid_update(df, centres, [5, 5, 5], "x")
    X = np.vstack(df.toPandas()["x"])
    j = ((X[:, None, :] - np.array(centres)[None]) ** 2).sum(2).argmin(1)
    c, cnt = np.array(centres), np.array([5.0, 5.0, 5.0])
    for i in range(len(X)):                    # the sequential per-row update (bug B1 fixed)
        cnt[j[i]] += 1
        c[j[i]] += (X[i] - c[j[i]]) / cnt[j[i]]
    assert np.allclose(np.array(new), c) and list(n) == list(cnt)


def test_dec_gradient_matches_finite_difference(spark):
    df, _ = _planted(spark, 80)
    C0 = np.array([[1.0, 1.0, 0.5], [8.0, 1.0, 0.0], [0.5, 7.0, 1.0]])
    g, _ = DP.dec_gradient(df, C0, "x", "id")
    X = np.vstack(df.toPandas()["x"])
    mass = DP.soft_assign(X, C0)[2].sum(0)

    def loss(Cc):
        _, _, q = DP.soft_assign(X, Cc)
        p = DP.target_from_q(DP.soft_assign(X, C0)[2], mass)
        return -(p * np.log(q) + (1 - p) * np.log(1 - q)).mean()
    eps = 1e-6
    for k, d in [(0, 0), (1, 2), (2, 1)]:
        Cp, Cm = C0.copy(), C0.copy()
        Cp[k, d] += eps
        Cm[k, d] -= eps
        assert abs((loss(Cp) - loss(Cm)) / (2 * eps) - g[k, d]) < 1e-7


def test_autoencoder_gradient_and_partition_invariance(spark):
    df, _ = _planted(spark, 50)
    net = DP.autoencoder([3, 4, 2], seed=0)
    X = np.vstack(df.toPandas()["x"])
    g1, l1, _ = DP.distributed_gradient(df.repartition(1), "x", (net, 50, 0, 0, 0.0), DP._ae_batch, "id")
    g4, l4, _ = DP.distributed_gradient(df.repartition(4), "x", (net, 50, 0, 0, 0.0), DP._ae_batch, "id")
    assert np.allclose(g1, g4) and abs(l1 - l4) < 1e-12
    W = net["enc"][0][0]

    def loss(Wm):
        n2 = {"enc": [(Wm, net["enc"][0][1])] + net["enc"][1:], "dec": net["dec"]}
        R = DP._forward(n2["dec"], DP.encode_matrix(n2, X))[-1]
        return ((R - X) ** 2).mean()
    eps = 1e-6
    Wp, Wm = W.copy(), W.copy()
    Wp[1, 2] += eps
    Wm[1, 2] -= eps
    num = (loss(Wp) - loss(Wm)) / (2 * eps)
    assert abs(num - g1[1 * 3 + 2]) < 1e-6


def test_gsdmm_conserves_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(w) for w in rng.integers(0, 20, rng.integers(1, 8))]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, words array<int>")
    z = gsdmm(docs, 5, 20, iters=3, seed=1)
    j = z.join(docs, "doc_id")
    assert j.count() == 100
    assert j.agg(F.sum(F.size("words"))).first()[0] == sum(len(w) for _, w in rows)
    assert j.agg(F.max("z")).first()[0] < 5
