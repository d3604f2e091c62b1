"""LDA in blocks of documents."""
import numpy as np
import pyarrow as pa

from lexicluster.operators import clustering as C
from lexicluster.operators import topics as T

VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def psi(x):
    """Digamma of one number, by recurrence up to 60."""
    low = 0.0
    while x < 60:
        low, x = low + 1 / x, x + 1
    return np.log(x) - 1 / (2 * x) - 1 / (12 * x * x) - low


def test_digamma():
    x = np.array([0.01, 0.1, 0.6, 1.0, 3.7, 50.0, 1e6])
    assert np.allclose(T.digamma(x), [psi(float(v)) for v in x], atol=1e-8)


def test_topics_of_blocks_are_those_of_single_documents():
    rng, V, K, alpha = np.random.default_rng(0), 30, 4, 0.6
    beta = rng.dirichlet(np.full(V, 0.2), K).T
    docs = rng.poisson(0.4, (60, V)).astype(float)
    docs[0], docs[1], docs[2] = 0, 9, np.eye(V)[3]
    rows = [{"type": 1, "size": None, "indices": None, "values": d} if i % 3 == 0 else
            {"type": 0, "size": V, "indices": np.flatnonzero(d), "values": d[d > 0]} for i, d in enumerate(docs)]
    texts = T._Texts(pa.array([{}, *rows], VECTOR).slice(1), beta, alpha)
    got, times, sums = texts.weights(), rng.integers(1, 4, len(docs)).astype(float), np.zeros((K, V))
    texts.add_sums(times, sums)
    want = np.zeros((K, V))
    for i, d in enumerate(docs):
        g = np.ones(K)
        e = lambda: np.exp([psi(v) - psi(g.sum()) for v in g])
        for _ in range(400 if d.any() else 0):
            g = alpha + e() * (beta.T @ (d / (beta @ e() + 1e-100)))
        assert np.abs(got[i] - g).max() < 0.05, i
        want += times[i] * np.outer(e(), d / (beta @ e() + 1e-100)) if d.any() else 0
    assert np.allclose(sums, want, rtol=0.05, atol=0.5)


def test_lda_finds_planted_topics(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(i, Vectors.sparse(6, [(i % 2) * 3 + j for j in range(3)], [2.0, 1.0, 3.0])) for i in range(200)] + [(200, Vectors.sparse(6, {}))]
    df = spark.createDataFrame(rows, ["doc_id", "counts"]).repartition(3)
    out = C.lda_cluster(df, 2, max_iter=20)
    assert out.columns == ["doc_id", "counts", "theta", "pred"]
    got = {r["doc_id"]: (r["theta"], r["pred"]) for r in out.collect()}
    assert got.pop(200)[0] == [0.0, 0.0]
    assert len({(d % 2, p) for d, (_, p) in got.items()}) == 2
    assert all(abs(sum(t) - 1) < 1e-9 and max(t) > 0.7 for t, _ in got.values())
    df.unpersist()
