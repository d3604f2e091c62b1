"""Findings of round 4."""
import numpy as np
import pandas as pd
import pytest

from lexicluster.operators import deep as DP
from lexicluster.operators import kmeans_runs as K
from lexicluster.operators import metrics as M


@pytest.mark.parametrize("offset", [0.0, 1000.0])
def test_runs_over_held_rows_are_those_of_passes(spark, monkeypatch, offset):
    """F1-F4: where the rows are few a task takes whole runs, with the draws, centres and inertia of the passes."""
    rng = np.random.default_rng(4)
    X = rng.normal(size=(1500, 6)) + offset
    X[1400:1450], X[1450:] = X[50:100], X[:50]                     # equal rows under other ids, and rows that come twice
    ids = np.r_[np.arange(1450), np.arange(50)]
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "x": list(X)})).repartition(5).persist()
    held, real = [], K._held_runs
    monkeypatch.setattr(K, "_held_runs", lambda *a: held.append(1) or real(*a))
    got = [K.kmeans_runs(df, k, 8, seed=3) for k in (1, 7)]
    assert held == [1, 1]
    monkeypatch.setattr(K, "HELD", 0)
    want = [K.kmeans_runs(df, k, 8, seed=3) for k in (1, 7)]
    assert held == [1, 1]
    for (C, cost, n), (C2, cost2, n2) in zip(got, want):
        assert n == n2 and C == pytest.approx(C2, rel=1e-9) and cost == pytest.approx(cost2, rel=1e-6)
    df.unpersist()


def test_bounds_leave_out_no_row_that_changes():
    """A run with bounds and single precision takes the steps of plain Lloyd iterations, equal centres and rows included."""
    rng = np.random.default_rng(9)
    for X in (rng.normal(size=(3000, 5)), np.repeat(rng.normal(size=(4, 3)), 50, axis=0), rng.integers(0, 3, (500, 2)) * 1e5 + 0.5):
        sq, mean, ids = (X * X).sum(1), X.mean(0), np.arange(len(X))
        X32, sq32 = (X - mean).astype(np.float32), ((X - mean) ** 2).sum(1)
        for k in (1, 2, 9):
            C, cost, n = K._whole_run(ids, X, sq, mean, X32, sq32, k, 0, 1, 300, 1e-9)
            want = K._draws(ids, X, sq, k, 0, 1)
            for it in range(1, 301):
                j, d = K._nearest(K._Dense(X), want[None])
                new = np.stack([X[j[:, 0] == c].mean(0) if (j[:, 0] == c).any() else want[c] for c in range(k)])
                far, want = ((new - want) ** 2).sum(), new
                if far <= 1e-9:
                    break
            assert n == it and C == pytest.approx(want, rel=1e-9, abs=1e-9) and cost == pytest.approx(d.sum(), rel=1e-6, abs=1e-3)


def test_runs_of_a_sweep_are_scored_together(spark, monkeypatch):
    """one scoring for all runs, and the lines that single runs give."""
    from lexicluster.operators.experiments import trial_summary
    from lexicluster.plans import q_sweeps
    rng = np.random.default_rng(1)
    runs = [pd.DataFrame({"trial": np.repeat(range(3), 40), "label": rng.integers(0, 3, 120), "pred": rng.integers(0, 4, 120)}) for _ in range(2)]
    calls, real = [], M.cluster_scores
    monkeypatch.setattr(M, "cluster_scores", lambda *a, **k: calls.append(1) or real(*a, **k))
    out = q_sweeps.Results(spark, "c")
    for i, p in enumerate(runs):
        out.add(spark.createDataFrame(p, "trial int, label int, pred int"), f"f{i}", i + 4)
    got = {r.feat_name: r for r in out.lines().collect()}
    assert len(calls) == 1 and [got[f"f{i}"].n_topics for i in range(2)] == [4, 5]
    for i in range(2):
        want = trial_summary(real(spark.createDataFrame(runs[i]), by=["trial"]), []).first()
        assert got[f"f{i}"].acc_mean == pytest.approx(want.acc_mean, abs=1e-6) and got[f"f{i}"].best_ari == pytest.approx(want.best_ami, abs=1e-6)


def test_trials_of_idec_share_passes(spark, monkeypatch):
    """several starts in the same passes train as each does alone, also where one ends early."""
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 5)) + 3 * rng.normal(size=(3, 5))[np.arange(300) % 3]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "x": list(X)})).repartition(3).persist()
    net = DP.autoencoder([5, 4, 2], seed=1)
    H = DP.encode_matrix(net, X)
    starts = [H[:3], H[10:13] + 0.5, H[20:23]]
    passes, real = [], DP.distributed_gradient
    monkeypatch.setattr(DP, "distributed_gradient", lambda *a, **k: passes.append(1) or real(*a, **k))
    for use_ae in (True, False):
        passes.clear()
        seen, tol = [], 0.02
        both = DP.idec_runs(df, net, starts, max_steps=9, update_interval=3, tol=tol, lr=0.05, use_ae=use_ae, metrics=seen)
        assert len(passes) <= 9
        for r, c in enumerate(starts):
            own = []
            n1, c1 = DP.idec_fit(df, net, c, max_steps=9, update_interval=3, tol=tol, lr=0.05, use_ae=use_ae, metrics=own)
            assert both[r][1] == pytest.approx(c1) and all(np.allclose(a, b) for a, b in zip(DP._params(both[r][0]), DP._params(n1)))
            assert [m[:2] for m in own] == [m[1:3] for m in seen if m[0] == r]
    df.unpersist()


def test_dec_against_idec_is_registered_whole(spark, monkeypatch):
    """all trials and steps of the operator."""
    import inspect
    from lexicluster.plans import q_sweeps
    whole, got = inspect.signature(q_sweeps.dec_against_idec), []
    monkeypatch.setattr(q_sweeps, "dec_against_idec", lambda *a, **k: got.append((a, k)))
    q_sweeps.q_dec_against_idec(spark, "d")
    bound = whole.bind(*got[0][0], **got[0][1])
    bound.apply_defaults()
    assert {n: bound.arguments[n] for n in ("n_trials", "max_steps", "update_interval")} == {"n_trials": 10, "max_steps": 20, "update_interval": 10}


def test_topic_model_clustering_is_registered_whole(spark, monkeypatch):
    """all trials and iterations of the operator."""
    import inspect
    from lexicluster.plans import q_sweeps
    whole, got = inspect.signature(q_sweeps.topic_model_clustering), []
    monkeypatch.setattr(q_sweeps, "topic_model_clustering", lambda *a, **k: got.append((a, k)))
    q_sweeps.q_topic_models(spark, "d")
    bound = whole.bind(*got[0][0], **got[0][1])
    bound.apply_defaults()
    assert bound.arguments["topics"] == (30, 40, 50) and bound.arguments["n_trials"] == 10 and bound.arguments["max_iter"] == 50


@pytest.mark.parametrize("collected", [0, 1 << 20])
def test_trials_of_lda_share_passes(spark, monkeypatch, collected):
    """several seeds in the same passes give the topics that each gives alone."""
    from pyspark.ml.linalg import Vectors
    from lexicluster.operators import topics as T
    monkeypatch.setattr(T, "COLLECTED", collected)
    rng = np.random.default_rng(3)
    docs = [(i, Vectors.dense(rng.poisson(1.0, 8) * (np.arange(8) % 2 == i % 2).astype(float))) for i in range(200)]
    df = spark.createDataFrame(docs, ["doc_id", "v"]).repartition(3).persist()
    got = T.lda_topics_runs(df, 3, "v", 0.1, 0.1, [5, 6, 7], 4)
    for seed, topics in zip((5, 6, 7), got):
        assert np.allclose(topics, T.lda_topics(df, 3, "v", 0.1, 0.1, seed, 4), rtol=1e-6)
    assert not np.allclose(got[0], got[1])
    df.unpersist()


@pytest.mark.parametrize("dense,cells", [(2, 3), (1, 2048), (10**9, 5)])
def test_gibbs_runs_take_logarithms_once(monkeypatch, dense, cells):
    """several runs in one call give the clusters that each word's own logarithms give, in blocks of any size."""
    from lexicluster.operators import topics as T
    monkeypatch.setattr(T, "GIBBS_DENSE", dense)
    monkeypatch.setattr(T, "GIBBS_CELLS", cells)
    seen, real = [], T._cell_logs
    monkeypatch.setattr(T, "_cell_logs", lambda word, *a: seen.append(len(word)) or real(word, *a))
    rng, V, lens, Ks = np.random.default_rng(0), 9, np.array([4, 0, 60, 1, 7, 30, 0]), [2, 5, 3]
    docs = [np.sort(rng.integers(0, V, x)) for x in lens]
    words, z, u = np.concatenate(docs), np.stack([rng.integers(0, K, 7) for K in Ks], 1), rng.random((7, 3))
    counts = []
    for r, K in enumerate(Ks):
        nkw = np.zeros((K, V))
        np.add.at(nkw, (np.repeat(z[:, r], lens), words), 1)
        counts.append((np.bincount(z[:, r], minlength=K), nkw))
    got = T.resampled_runs(words, lens, z, u, counts, 0.1, 0.1)
    assert sum(seen) == len({(w, i) for d in docs for w in d for i in range((d == w).sum())})        # once each, for all documents and runs
    for r, (m, nkw) in enumerate(counts):
        for d, w in enumerate(docs):
            p = []
            for k in range(Ks[r]):
                own = k == z[d, r]
                n = nkw[k] - (np.bincount(w, minlength=V) if own else 0)
                lp = np.log(m[k] - own + 0.1)
                for i, x in enumerate(w):
                    lp += np.log(n[x] + 0.1 + (w[:i] == x).sum()) - np.log(n.sum() + V * 0.1 + i)
                p.append(lp)
            c = np.cumsum(np.exp(np.array(p) - max(p)))
            assert got[d, r] == min((c / c[-1] < u[d, r]).sum(), Ks[r] - 1)
