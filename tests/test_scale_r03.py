"""Steps that didn't scale: pooling, mini-batches, many k-means runs, CSV files."""
import numpy as np
import pytest

from lexicluster.operators import aggregates as A
from lexicluster.plans.fixtures import together

DOCS = [(1, 30), (2, 1), (None, 5), (3, 2000), (1, 7)]            # (id, tokens); an id comes twice, one is null


@pytest.fixture(scope="module")
def tokens(spark):
    rng, rows = np.random.default_rng(0), []
    for i, n in DOCS:
        rows += [(i, int(p), int(p) // 4, np.round(rng.normal(size=3), 1).tolist()) for p in rng.permutation(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, pos int, sent_no int, vec array<double>").repartition(5)


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[1:])
    return out


@pytest.mark.parametrize("near", [False, True])
def test_pooling_folds_documents_without_a_shuffle_of_vectors(spark, tokens, near):
    rows, df = tokens
    if near:                                                      # documents spread by id before their tokens are made
        df = together(df.groupBy("doc_id").agg(A.F.collect_list(A.F.struct("pos", "sent_no", "vec")).alias("t"))).select("doc_id", A.F.inline("t"))
    want = by_doc(rows)

    def got(out):
        return {r[0]: r[1] for r in out.collect()}

    for mode, fn in (("max", np.max), ("mean", np.mean)):
        out = A.pool_tokens(df, mode, together=near)
        assert {k: pytest.approx(fn([v for _, _, v in x], axis=0)) for k, x in want.items()} == got(out)
    for mode, fn in (("first", min), ("last", max)):
        some = got(A.pool_tokens(df, mode, together=near))
        assert set(some) == set(want)
        assert all(some[k] in [v for p, _, v in x if p == fn(p for p, _, _ in x)] for k, x in want.items())
    sentences = {k: np.mean([np.mean([v for _, s, v in x if s == t], axis=0) for t in {s for _, s, _ in x}], axis=0) for k, x in want.items()}
    assert {k: pytest.approx(v) for k, v in sentences.items()} == got(A.pool_sentences(df, together=near))
    shares = {}
    for k, x in want.items():
        for d in range(3):
            p = min((-v[d], p) for p, _, v in x)[1]
            shares[k, p] = shares.get((k, p), 0) + 100 / 3
    assert {(r.doc_id, r.pos): pytest.approx(r.pct) for r in A.maxpool_attribution(df, together=near).collect()} == shares


def test_pooling_keeps_the_partitions_of_documents_that_lie_together(spark):
    rows = spark.range(100).selectExpr("id AS doc_id", "CAST(id AS INT) AS pos", "0 AS sent_no", "array(1.0D, 2.0D) AS vec")
    for out in (A.pool_tokens(rows, "mean", together=True), A.pool_tokens(rows, "first", together=True),
                A.pool_sentences(rows, together=True), A.maxpool_attribution(rows, together=True)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pinned", [False, True])
def test_dcn_takes_small_batches_in_stretches(spark, monkeypatch, pinned):
    from lexicluster.operators import deep as DP
    from lexicluster.operators import training as TR
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(m, 0.3, (30, 5)) for m in (-1, 1)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>").repartition(3)
    seeds = spark.createDataFrame([(0, 1), (40, 0)], "id long, label int") if pinned else None
    net, c0 = DP.autoencoder([5, 4, 2], seed=0), [[-0.1, 0.0], [0.1, 0.1]]

    def fit():
        m = []
        out = TR.dcn_fit(df, net, c0, epochs=2, batch_size=7, lr=0.05, tol=-1.0, shuffle=True, count_epoch=1, init_num=-1, seeds=seeds,
                         seed_lam=1.0, metrics=m)
        return out, [v for _, _, v in m]

    with monkeypatch.context() as mp:
        mp.setattr(TR, "STRETCH", 1)                              # a job for each batch
        (net1, c1, p1), m1 = fit()
    monkeypatch.setattr(TR, "STRETCH", 21)                        # three batches a task
    monkeypatch.setattr(TR, "distributed_gradient", None)
    (net2, c2, p2), m2 = fit()
    assert m1 == pytest.approx(m2) and c1 == pytest.approx(c2)
    assert all(np.allclose(a, b) for a, b in zip(DP._params(net1), DP._params(net2)))
    assert sorted(p1.collect()) == sorted(p2.collect())


def test_distances_of_many_runs_are_held_in_blocks(monkeypatch):
    from lexicluster.operators import kmeans_runs as K
    rng = np.random.default_rng(2)
    X, C = rng.normal(size=(700, 6)), rng.normal(size=(9, 5, 6))
    monkeypatch.setattr(K, "NEAR", 2000)
    seen, dot = [], K._Dense.dot

    def watched(self, centres):
        seen.append(self.n * len(centres))
        return dot(self, centres)
    monkeypatch.setattr(K._Dense, "dot", watched)
    j, d = K._nearest(K._Dense(X), C)
    far = ((X[:, None, None, :] - C[None]) ** 2).sum(3)
    assert np.array_equal(j, far.argmin(2)) and d == pytest.approx(far.min(2)) and max(seen) <= 2000
    row, col = np.nonzero(X > 0.5)
    Y = np.where(X > 0.5, X, 0.0)
    want = np.stack([[Y[j[:, r] == k].sum(0) for k in range(5)] for r in range(9)])
    for rows in (K._Dense(Y), K._Filled(Y, row, col, Y[row, col]), K._Sparse(700, 6, row, col, Y[row, col])):
        assert rows.sums(j, 5) == pytest.approx(want)


def test_few_partitions_are_spread(spark, monkeypatch, tmp_path):
    from lexicluster import session
    from lexicluster.operators import kmeans_runs as K
    rows = spark.range(0, 900, 1, 1).selectExpr("id", "array(CAST(id % 7 AS DOUBLE), 1.0D) AS x")
    rows.write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t")).coalesce(1)
    assert session.spread(one, "id").rdd.getNumPartitions() == 1   # too few rows to be worth it
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    dealt = session.spread(one, "id")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(one.collect())
    plain = K.kmeans_runs(one, 3, 4, seed=1)
    monkeypatch.setattr(K, "SPREAD", 0)
    assert [np.allclose(a, b) for a, b in zip(plain, K.kmeans_runs(one, 3, 4, seed=1))] == [True] * 3


def test_long_documents_are_looked_up_in_slices(monkeypatch):
    import pyarrow as pa
    from lexicluster.operators import features as feats
    monkeypatch.setattr(feats, "SLICE_TOKENS", 10)
    docs = [["a"] * n for n in (3, 25, 0, 4, 5, 9, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(docs)], names=["id", "tokens"])
    parts = list(feats.token_slices(batch, 1))
    assert [t for p in parts for t in p.column(1).to_pylist()] == docs
    assert len(parts) > 3 and all(sum(map(len, filter(None, p.column(1).to_pylist()[1:]))) <= 10 for p in parts)


def test_csv_files_hold_few_records(spark, monkeypatch, tmp_path):
    from lexicluster.sources import writers as S
    monkeypatch.setattr(S, "FILE_RECORDS", 10)
    S.write_labeled_csv(spark.range(0, 95, 1, 1).selectExpr("1 AS label", "CONCAT('a\\n', id) AS text"), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 10
    back = spark.read.option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.count() == 95


def test_lda_reads_its_documents_from_the_cache(spark):
    from pyspark.ml.linalg import Vectors
    from lexicluster.operators import clustering as C
    df = spark.createDataFrame([(i, Vectors.sparse(4, {i % 4: 2.0, (i + 1) % 4: 1.0})) for i in range(40)], ["doc_id", "counts"])
    out = C.lda_cluster(df, 2, max_iter=2)
    assert "InMemoryTableScan" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 40
    df.unpersist()


@pytest.mark.parametrize("K", [2, 5])
def test_gibbs_runs_share_the_turns_of_words(K):
    from lexicluster.operators import topics as T
    rng, V, lens = np.random.default_rng(K), 6, np.array([3, 0, 40, 1, 7])
    docs = [np.sort(rng.integers(0, V, n)) for n in lens]
    words, z, u = np.concatenate(docs), rng.integers(0, K, 5), rng.random(5)
    m, nkw = np.bincount(z, minlength=K).astype(float), np.zeros((K, V))
    np.add.at(nkw, (np.repeat(z, lens), words), 1)
    got = T.resampled(words, lens, z, u, m, nkw, 5, 0.1, 0.1, T.word_turns(words, lens))
    for d, w in enumerate(docs):
        p = []
        for k in range(K):
            own = k == z[d]
            n = nkw[k] - (np.bincount(w, minlength=V) if own else 0)
            lp = np.log(m[k] - own + 0.1)
            for i, x in enumerate(w):
                lp += np.log(n[x] + 0.1 + (w[:i] == x).sum()) - np.log(n.sum() + V * 0.1 + i)
            p.append(lp)
        c = np.cumsum(np.exp(np.array(p) - max(p)))
        assert got[d] == min((c / c[-1] < u[d]).sum(), K - 1)


def test_few_partial_sums_need_no_shuffle(spark, monkeypatch):
    """A k-means pass whose partial sums are few has no aggregation, and gives what one with it gives."""
    from lexicluster.operators import kmeans_runs as K
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) + 4 * (i % 3)).tolist()) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, x array<double>").repartition(3).persist()
    calls, real = [], K.Summarizer.sum
    monkeypatch.setattr(K.Summarizer, "sum", lambda *a: calls.append(1) or real(*a))
    C, inertia, n = K.kmeans_runs(d, 3, 4, seed=2)
    assert n > 1 and len(calls) == 2                                    # the moments alone
    monkeypatch.setattr(K, "COLLECTED", 0)
    C2, inertia2, n2 = K.kmeans_runs(d, 3, 4, seed=2)
    assert n2 == n and len(calls) > 4
    np.testing.assert_allclose(C, C2, rtol=1e-9)
    np.testing.assert_allclose(inertia, inertia2, rtol=1e-9)
    d.unpersist()
