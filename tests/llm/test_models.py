"""Trained and searching operators against brute force and held-out quality."""
import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicluster.llm import ann, html_extraction, lm_scoring, quality_model

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, k int"
ODD = [None, "", "the cat sat", "The cat sat on the mat", "zebra  quartz\n\tthe", "éé ü the", "a" * 400, "the cat the cat", "mat", " "]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("hot", [1 << 17, 2])
def test_lm_scores_match_a_sequential_trie(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", hot)
    monkeypatch.setattr(lm_scoring, "HOT_WINDOWS", hot)
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    texts = ODD + [t[:600] for t in real]
    ids = list(range(len(texts))) + [None, 4]
    texts = texts + ["the null id", "the cat sat"]
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    words = [(t or "").encode().lower().split() for t in texts]
    trie, c = lm_scoring.AdaptiveTrie(), collections.Counter()
    for i, w in zip(ids, words):
        if not held(i):
            for context, symbol in trie.symbols(w):
                trie.learn(context, symbol)
            c.update(w)
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n,
                   sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]),
                   sum(trie.lp(a, s) for a, s in trie.symbols(w))) for i, w in zip(ids, words))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in lm_scoring.score(d).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert lm_scoring.score(d.limit(0)).collect() == []
    lone = lm_scoring.score_adaptive(d).collect()
    assert len(lone) == len(texts) and all(r.score < 0 for r in lone)


def test_probabilities_sum_to_one():
    trie = lm_scoring.AdaptiveTrie()
    for context, symbol in trie.symbols(b"the then them that other".split()):
        trie.learn(context, symbol)
    alphabet = [b for b in range(256) if not (9 <= b <= 13) and b != 32] + [32, 10]
    for context in (b" ", b" th", b"the", b"zz", b" othe"):
        assert sum(10 ** trie.lp(context, s) for s in alphabet) == pytest.approx(1)


def test_lm_on_held_out(spark):
    """The base gives every unseen word a share of its own and so sums to more than one; a proper
    byte model stays within a fifth of it, and longer contexts help."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = [F.sum("score").alias("s"), F.sum("base_score").alias("b")]
    r = lm_scoring.score(d).where("held_out").agg(*total).first()
    short = lm_scoring.score(d, order=2).where("held_out").agg(*total).first()
    assert r.s > 1.2 * r.b and r.s > short.s


def brute(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float64))
    out = {}
    for q in ok:
        if q % 100 == 0:
            a = np.array(min(map(list, ok[q])))
            out[q] = sorted((min(math.sqrt(((a - x) ** 2).sum()) for x in vs), i) for i, vs in ok.items() if i != q)[:k]
    return out


def test_nearest(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = [(900000, None), (900001, [0.0] * 64), (900002, [float("nan")] + [1.0] * 63), (None, [1.0] * 64), (900100, [1.0] * 64),
           (900101, [1.0] * 64), (900102, [1.0] * 64), (900101, [1.0] * 64), (900200, [1.0, None] * 32), (900300, [1.0] * 3)]
    d = v.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    want = brute([(r.vec_id, r.embedding) for r in d.collect() if r.embedding is None or len(r.embedding) == 64])
    got = collections.defaultdict(list)
    for r in ann.nearest(d, d.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    assert [i for _, i in got[900100][:2]] == [900101, 900102]
    few = ann.nearest(d.where("vec_id < 4"), d.where("vec_id = 0")).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]
    assert ann.nearest(d.limit(0), d.limit(0)).collect() == []


def test_nearest_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in v.collect()])
    got = collections.defaultdict(set)
    for r in ann.nearest(v, v.where("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.95 * 10 * len(want)


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><div class="cookie-notice">We use cookies &amp; more.</div>
%s<div id="comments"><div class="comment"><p>I think this is a very good text with many words in it, really.</p></div></div>
<form><p>Subscribe</p><input name=x></form><footer>&copy; 2024 nobody</footer></body></html>"""
BODY = ("<h1>A heading</h1><p>First   paragraph &eacute;t&#233; of the <b>main</b> text,\n with several words.<br>After a break.</p>"
        "<div class=ad>Buy this now.</div><p>Second paragraph, unclosed, with some words as well.<ul><li>One item of a list.</li></ul>")
TEXT = ("A heading First paragraph été of the main text, with several words. After a break. "
        "Second paragraph, unclosed, with some words as well. One item of a list.")


def test_html_extraction(spark):
    d = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(10 ** 6 + i, "u", h) for i, h in enumerate([
        PAGE % f"<article>{BODY}</article>", PAGE % f"<main>{BODY}</main>", PAGE % f"<div class='content'>{BODY}</div>", None, "",
        "<nav><a href=x>only</a></nav>", "<<<>>&&&;</p></b>"])]
    got = {r.page_id: r for r in html_extraction.extract(d.unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    for k in range(3):
        assert got[10 ** 6 + k].text == TEXT, k
    assert [got[10 ** 6 + k].text for k in (3, 4, 5)] == ["", "", ""]
    for r in d.collect():
        inner = r.html[r.html.index("<article>"):r.html.index("</article>")]
        want = html_extraction.parse(inner)
        assert got[r.page_id].text == " ".join(" ".join("".join(p) for _, p, _ in want.runs).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert html_extraction.extract(d.limit(0)).collect() == []


def test_marginals_match_enumeration():
    import random
    rng = random.Random(1)
    pages = []
    for _ in range(60):
        html, y = html_extraction.made_page(rng)
        tree = html_extraction.parse(html)
        assert len(tree.tags) == len(y)
        pages.append((tree, np.array(y, float)))
    model = html_extraction.Model(pages)
    tree = html_extraction.parse("<body><nav><a>x</a></nav><div><h1>a b</h1><p>Some words are here.</p><aside>z</aside></div></body>")
    z = html_extraction.features(tree) @ model.weights
    n = len(tree.tags)
    total, on = 0.0, np.zeros(n)
    for s in range(2 ** n):
        y = [s >> i & 1 for i in range(n)]
        w = math.exp(sum(z[i] for i in range(n) if y[i]))
        for i in range(1, n):
            up = tree.parents[i]
            w *= model.pair[model.boxed(tree, up)][model.boxed(tree, i)][y[up]][y[i]]
        total += w
        on += w * np.array(y)
    assert model.marginals(tree) == pytest.approx((on / total).tolist())


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10 ** 7, "", "en", "s", 0), (10 ** 7, "", "en", "s", 0)], d.schema)
    s = quality_model.score(d.unionByName(odd), labels)
    got = s.join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in got)
    low = [r.score for r in got if r.quality == 0]
    high = [r.score for r in got if r.quality == 1]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])
    assert right >= 0.93 * len(got) and auc > 0.95, (right, len(got), auc)
    assert s.count() == d.count() + 3 and all(0 <= r.score <= 1 for r in s.collect())
    kept = quality_model.keep_documents(d, labels)
    assert kept.columns == d.columns and kept.count() == s.where("score >= 0.3").join(d.select(F.col("doc_id").alias("id")), "id").count()
    assert {r.score for r in quality_model.score(d, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score(d.limit(0), labels).collect() == []


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    assert 0 < len(ids) <= docs.count() and all(r.token_ids for r in out)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).collect() == [], name


def test_lm_contexts_cross_spaces(spark):
    """A held-out copy of a trained passage scores above its words in another order."""
    passage = "every good judge of wine knows that old red casks leak on long cold nights"
    held_ids = [i for i in range(200) if held(i)][:3]
    trained = [i for i in range(200) if not held(i)][:5]
    shuffled = [" ".join(sorted(passage.split())), " ".join(reversed(passage.split()))]
    rows = [(i, passage, "x", 0) for i in trained] + [(i, t, "x", 0) for i, t in zip(held_ids, [passage, *shuffled])]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, SCHEMA)).where("held_out").collect()}
    assert len({r.n_known for r in got.values()}) == 1 and len({round(r.base_score, 9) for r in got.values()}) == 1
    copy, *others = (got[i].score for i in held_ids)
    assert all(copy > x + 3 for x in others)


def test_lm_windows_of_long_texts():
    """Windows don't depend on the pieces in which a text is packed."""
    texts = [b"the cat sat".split(), [], b"a".split(), (b"on the mat " * 9).split()]
    whole = [np.concatenate(x) for x in zip(*lm_scoring.windows_of(texts, 5))]
    for piece in (1, 3, 7):
        got = [np.concatenate(x) for x in zip(*lm_scoring.windows_of(texts, 5, piece))]
        assert all((a == b).all() for a, b in zip(whole, got))
    want = [int.from_bytes(b"\1" + c + bytes([s]), "big") for w in texts for c, s in lm_scoring.AdaptiveTrie(5).symbols(w)]
    assert whole[0].tolist() == want


def test_lm_window_table_needs_no_package():
    """Broadcasts are pickled plainly: executors without the package must be able to read them."""
    import pickle
    rng = np.random.default_rng(3)
    win, lp = np.unique(rng.integers(1, 1 << 56, 5000)), rng.normal(size=5000)
    table = lm_scoring.window_table(win[::2], lp[:len(win)][::2])
    assert b"lexicluster" not in pickle.dumps(table)
    got, cold = lm_scoring.find_windows(table, win)
    assert (cold == np.arange(1, len(win), 2)).all() and (got[::2] == lp[:len(win)][::2]).all()
