"""Single-pass entities, matrix-product assignment, sparse cells, expected mutual information, Gibbs sweeps."""
import html
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexicluster.constants import named_entities
from lexicluster.functions.text import unescape_entities
from lexicluster.operators import clustering as C
from lexicluster.operators import features as feats
from lexicluster.operators import topics
from lexicluster.operators.metrics import expected_cell


def test_entities_in_one_pass(spark):
    texts = ["", None, "plain", "&", "a & b", "&amp;lt; &lt;&gt;", "&#65;&#x41;&#x1F600;", "&#0000065; &#12345678;", "&#xD800;&#55296;",
             "&unknown; &eacute;&eacute&copy;", "&amp;amp;", "&&lt;;&;", "line\n&nbsp;&hellip;\n&#10;", "&#1114112;&#1114111;", "&#38;lt;", "&#x26;amp;",
             "x" * 50_000 + "&euro;" * 20_000]
    names = dict(named_entities())

    def want(t):
        import re

        def one(m):
            r = m.group(1)
            if r[0] != "#":
                return names.get(r, m.group(0))
            n = int(r[2:], 16) if r[1] == "x" else int(r[1:])
            return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m.group(0)
        return re.sub(r"&([A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});", one, t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", unescape_entities("t").alias("u"))
    got = {r.i: r.u for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else want(t))
    assert html.unescape("&amp;lt;") == got[5].split()[0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 0


def test_assignment_is_exact_and_keeps_columns(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(500, 7))
    cs = np.vstack([rng.normal(size=(9, 7)), X[3], X[3], X[8]])                # centres on rows, and twice
    rows = [(i, [float(v) for v in x], f"t{i}", None if i % 5 else 1.5) for i, x in enumerate(X)] + [(500, None, "none", None)]
    df = spark.createDataFrame(rows, "id int, x array<double>, t string, dist2 double").repartition(3)
    got = {r.id: r for r in C.assign_nearest(df, cs.tolist(), "x", "pred", with_distance=True).collect()}
    d = ((X[:, None] - cs[None]) ** 2).sum(2)
    for i in range(500):
        assert got[i].pred == d[i].argmin() and got[i].dist2 == pytest.approx(d[i].min(), abs=1e-15) and got[i].t == f"t{i}"
    assert got[3].pred == 9 and got[3].dist2 == 0.0 and got[500].pred is None and got[500].dist2 is None
    wide = spark.createDataFrame([(i, rng.normal(size=4096).tolist()) for i in range(40)], "id int, x array<double>")
    big = C.assign_nearest(wide, rng.normal(size=(30, 4096)).tolist())
    assert len(big._jdf.queryExecution().optimizedPlan().toString()) < 5000 and big.where("pred BETWEEN 0 AND 29").count() == 40


def test_sparse_cells(spark):
    docs = [(0, "a b a c z".split()), (1, []), (2, None), (3, ["z", "z"]), (4, "b b b".split()), (5, [None, "a"])]
    df = spark.createDataFrame(docs, "doc_id int, tokens array<string>").repartition(3)
    vocab = feats.fit_vocabulary(df, 3)
    assert vocab.n_docs == 6 and vocab.terms == ["a", "b", "z"] and vocab.total == [3, 4, 3] and vocab.df == [2, 2, 2]
    long = {(r.doc_id, r.term): (r.tf, r.tfidf) for r in feats.tfidf_long(df, 3).collect()}
    idf = math.log(7 / 3) + 1
    assert set(long) == {(0, "a"), (0, "b"), (0, "z"), (3, "z"), (4, "b"), (5, "a")}
    assert long[0, "a"] == (2, pytest.approx(2 * idf / math.sqrt(6 * idf * idf))) and long[4, "b"] == (3, pytest.approx(1.0))
    sparse = {r.doc_id: (r.idx, r.val) for r in feats.tfidf_sparse(df, vocab).collect()}
    assert sparse[0][0] == [0, 1, 2] and sparse[1] == ([], []) == sparse[2] and sparse[3] == ([2], [1.0])
    assert {r.doc_id: r.words for r in feats.word_indices(df, vocab).collect()} == {0: [0, 0, 1, 2], 1: [], 2: [], 3: [2, 2], 4: [1, 1, 1], 5: [0]}
    assert feats.count_long(df, vocab, binary=True).agg(F.sum("value")).first()[0] == 6


def test_expected_cells():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 300))
        a, b = int(rng.integers(1, n + 1)), int(rng.integers(1, n + 1))
        total = math.comb(n, b)
        want = math.fsum(float(Fraction(math.comb(a, x) * math.comb(n - a, b - x), total)) * x / n * math.log(n * x / (a * b))
                         for x in range(max(1, a + b - n), min(a, b) + 1))
        assert abs(expected_cell(a, b, n) - want) < 1e-12
    a, b, n = 300_000, 400_000, 1_000_000                                      # summed at every 16th of σ: against all terms
    x = np.arange(100_000, 140_001).astype(np.longdouble)
    logp = np.concatenate([[0], np.cumsum(np.log((a - x) * (b - x) / ((x + 1) * (n - a - b + x + 1)))[:-1])])
    p = np.exp(logp - logp.max())
    want = float((p * x / n * np.log(n * x / (np.longdouble(a) * b))).sum() / p.sum())
    assert expected_cell(a, b, n) == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert expected_cell(3 * 10 ** 11, 5 * 10 ** 11, 10 ** 12) == pytest.approx(0.7 * 0.5 / (2 * 10 ** 12), rel=1e-6)


def test_gibbs_batches_equal_a_loop():
    rng = np.random.default_rng(1)
    K, V, alpha, beta = 4, 12, 0.1, 0.2
    docs = [sorted(rng.integers(0, V, rng.integers(0, 9)).tolist()) for _ in range(60)]
    z = rng.integers(0, K, 60)
    m, nkw = np.bincount(z, minlength=K).astype(float), np.zeros((K, V))
    for d, k in zip(docs, z):
        np.add.at(nkw[k], d, 1)
    u = rng.random(60)
    want = []
    for d, k0, x in zip(docs, z, u):
        lp = []
        for k in range(K):
            mk, n = m[k] - (k == k0), nkw[k].copy()
            if k == k0:
                np.subtract.at(n, d, 1)
            s, seen = math.log(mk + alpha), {}
            for i, w in enumerate(d):
                s += math.log(n[w] + beta + seen.get(w, 0)) - math.log(n.sum() + V * beta + i)
                seen[w] = seen.get(w, 0) + 1
            lp.append(s)
        p = np.exp(np.array(lp) - max(lp))
        want.append(min(int(np.searchsorted(np.cumsum(p / p.sum()), x)), K - 1))
    got = topics.resampled(np.concatenate(docs).astype(int), np.array([len(d) for d in docs]), z, u, m, nkw, 60, alpha, beta)
    assert got.tolist() == want


def test_gibbs_runs_share_passes_and_ignore_partitions(spark):
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 3, 150)
    rows = [(i, [int(t * 10 + w) for w in rng.integers(0, 10, 8)]) for i, t in enumerate(topic)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "words"]))
    runs = [{r.doc_id: r.z for r in topics.gsdmm_runs(df.repartition(n), [3, 6], 30, iters=8, seed=4).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]
    for r in (0, 1):                                                           # planted topics are found
        groups = {}
        for i, t in enumerate(topic):
            groups.setdefault(runs[0][i][r], []).append(t)
        pure = sum(max(np.bincount(g)) for g in groups.values()) / 150
        assert pure > 0.9
    alone = {r.doc_id: r.z for r in topics.gsdmm(df, 3, 30, iters=8, seed=4).collect()}
    assert alone == {i: z[0] for i, z in runs[0].items()}


def plus_plus(X, k, rng):
    """Cost of Lloyd iterations from k-means++."""
    c = [X[rng.integers(len(X))]]
    while len(c) < k:
        d = ((X[:, None] - np.array(c)[None]) ** 2).sum(2).min(1)
        c.append(X[rng.choice(len(X), p=d / d.sum())])
    c = np.array(c)
    for _ in range(100):
        j = ((X[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([X[j == i].mean(0) if (j == i).any() else c[i] for i in range(k)])
    return ((X[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_parallel_seeding_costs_no_more(spark):
    from lexicluster.operators.kmeans_runs import assign_runs, kmeans_runs
    rng = np.random.default_rng(7)
    X = rng.normal(size=(900, 5)) + np.repeat(rng.normal(size=(12, 5)) * 4, 75, axis=0)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(900), "x": list(X)}))
    best = min(plus_plus(X, 12, rng) for _ in range(10))
    runs = [kmeans_runs(df.repartition(n), 12, 10, "id", "x", seed=3) for n in (1, 6)]
    assert runs[0][1].min() <= 1.02 * best
    assert np.allclose(np.sort(runs[0][1]), np.sort(runs[1][1])) and np.allclose(runs[0][0], runs[1][0])
    sparse = df.select("id", F.array(*[F.lit(i) for i in range(5)]).alias("i"), F.col("x").alias("v"))
    again = kmeans_runs(sparse, 12, 10, "id", None, "i", "v", 5, seed=3)
    assert np.allclose(again[0], runs[0][0])
    high = kmeans_runs(sparse, 12, 2, "id", None, "i", "v", 50_000, seed=3)      # too wide for dense blocks
    assert np.allclose(high[0][:, :, :5], runs[0][0][:2]) and not high[0][:, :, 5:].any()
    pred = assign_runs(sparse, high[0], [0, 1], "id", None, "i", "v", 50_000)
    assert pred.count() == 1800


def test_fewer_rows_than_clusters(spark):
    from lexicluster.operators.kmeans_runs import kmeans_runs
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])], "id long, x array<double>")
    C3, inertia, _ = kmeans_runs(df, 4, 3, "id", "x", seed=0)
    assert C3.shape == (3, 4, 2) and np.allclose(inertia, 0)


def test_first_lines_and_sentinels(spark, tmp_path):
    from lexicluster.sources.readers import scan_word_vectors_top_k
    for part, lines in enumerate([[f"w{i} {i} 0.5" for i in range(50)], ["</s> 7 7", "v 1 1", "<s> 8 8"]]):
        (tmp_path / f"part-{part}.txt").write_text("\n".join(lines) + "\n")
    got = {r.word: (r.line_no, r.vec) for r in scan_word_vectors_top_k(spark, str(tmp_path), 10).collect()}
    assert got == {**{f"w{i}": (i, [float(i), 0.5]) for i in range(10)}, "</s>": (50, [7.0, 7.0]), "<s>": (52, [8.0, 8.0])}
    every = scan_word_vectors_top_k(spark, str(tmp_path), 100).collect()
    assert sorted(r.line_no for r in every) == list(range(53))


def test_quoted_line_ends_need_multiline(spark, tmp_path):
    from lexicluster.sources.readers import scan_labeled_csv
    (tmp_path / "a.csv").write_text('1,"say ""hi"""\n2, plain \n')
    assert [tuple(r) for r in scan_labeled_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1, 'say "hi"'), (2, "plain")]
    (tmp_path / "b.csv").write_text('1,"two\nlines"\n')
    assert [tuple(r) for r in scan_labeled_csv(spark, str(tmp_path / "b.csv"), multiline=True).collect()] == [(1, "two\nlines")]


def test_nearest_neighbour_lists_of_any_length(spark):
    from lexicluster.operators.explain import compactness_nearest_neighbor
    X = np.random.default_rng(0).normal(size=(1500, 4))
    df = spark.createDataFrame(pd.DataFrame({"cluster": 1, "vec": list(X)}))
    N = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = N @ N.T - 2 * np.eye(1500)
    assert compactness_nearest_neighbor(df).first()["compactness"] == pytest.approx(S.max(1).sum())


def test_unequal_classes_follow_the_schedule(spark, monkeypatch):
    """500 + 500 c rows of class c, or the whole class where it is smaller."""
    from lexicluster.plans import fixtures, q_pipelines
    monkeypatch.setattr(q_pipelines, "_sentence_trials", lambda spark, sf_dir, docs: docs)
    sf = "/root/testdata/sf0.1"
    sizes = {r.label: r["count"] for r in fixtures.corpus(spark, sf).where("label IS NOT NULL").groupBy("label").count().collect()}
    got = {r.label: r["count"] for r in q_pipelines.q_unequal_kmeans(spark, sf).groupBy("label").count().collect()}
    assert len(sizes) == 4 and got == {c: min(500 + 500 * c, n) for c, n in sizes.items()}
