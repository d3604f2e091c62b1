"""Cases of the second advice: whole jobs against brute force."""
import collections
import re

from pyspark.sql import functions as F

from lexicluster.llm import html_extraction, quality_model, quality_rules, simhash

SF = "/root/testdata/sf0.01"


def test_pipeline_classifier_learns_from_the_whole_table(spark, tmp_path):
    """A label-0 document that passes the rules is rejected as by a model of all labelled documents,
    though the rules leave no other label-0 document to train on."""
    import corpus_pipeline
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    low = d.join(labels.where("quality = 0"), "doc_id").orderBy("doc_id").select(*d.columns).collect()

    def milder(text):
        return " ".join(w if i % 10 == 0 else re.sub(r"[^\w\s]+", "", w).lower() or "is" for i, w in enumerate(text.split()))
    made = spark.createDataFrame([(10 ** 6 + i, milder(r.text), r.lang, r.source, r.n_chars) for i, r in enumerate(low)], d.schema)
    one = quality_rules.keep_documents(made).orderBy("doc_id").limit(1).collect()
    label = spark.createDataFrame([(one[0].doc_id, 0)], "doc_id long, quality int")
    path = str(tmp_path)
    d.unionByName(spark.createDataFrame(one, d.schema)).write.parquet(f"{path}/documents.parquet")
    labels.select("doc_id", F.col("quality").cast("int")).unionByName(label).write.parquet(f"{path}/labels.parquet")
    whole, known = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))

    kept = corpus_pipeline.rules_stage(spark, whole, path)
    got = corpus_pipeline.classifier_stage(spark, kept, path)
    scores = {r.id: r.score for r in quality_model.score(whole, known, held=-1).collect()}
    passed = {r.doc_id for r in kept.collect()}
    assert one[0].doc_id in passed and scores[one[0].doc_id] < 0.3
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in passed if scores[i] >= 0.3)
    assert got.columns == whole.columns


def test_links_of_a_root(spark):
    """``n_links`` of every fingerprint, the smallest of its component included."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = " ".join(f"w{i}" for i in range(80))
    near = [(10 ** 6 + i, words + t) for i, t in enumerate(["", "", " a", " b", " c", " d", " e a"])]
    got = simhash.near_duplicates(d.unionByName(spark.createDataFrame(near, d.schema))).collect()
    fps = {r.fp & (2 ** 64 - 1) for r in got}
    want = {a: sum(0 < (a ^ b).bit_count() <= 3 for b in fps) for a in fps}
    assert all(r.n_links == want[r.fp & (2 ** 64 - 1)] for r in got)
    linked = collections.Counter(r.component for r in got if r.n_links)
    assert linked and min(want.values()) == 0 < max(want.values())


def test_html_open_head_and_math(spark):
    """A head ends at the first tag that can't stand in it, and formulas are text of their block."""
    body = ("<article><h1>A heading</h1><p>First paragraph of the main text, where <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> "
            "holds, with several words.</p><p>Second paragraph, with some more words as well.</p></article>")
    want = ("A heading First paragraph of the main text, where x=2 holds, with several words. "
            "Second paragraph, with some more words as well.")
    head = "<head><title>T</title><meta name=a><style>p{}</style>"
    pages = [f"<html>{head}</head><body>{body}</body></html>", f"<html>{head}{body}", f"{head}{body}</html>",
             f"<html>{head}<img src=x>{body}"]
    d = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    d = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").withColumn("page_id", F.col("page_id") + 100).unionByName(d)
    got = {r.page_id: r.text for r in html_extraction.extract(d).collect()}
    assert [got[i] for i in range(len(pages))] == [want] * len(pages)


def test_keep_one_keeps_a_row_of_each_component(spark):
    """Ids that repeat in two components, and components without ids: one row of each stays."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "one text here and more"), (1, "another text that is unlike it"), (2, "another text that is unlike it"),
            (3, "one text here and more"), *[(None, words + t) for t in ["", " a", " b"]], (None, "quite alone")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(d.repartition(3)).collect()), key=repr)
    first = min((words + t for t in ["", " a", " b"]), key=lambda t: simhash.fingerprint(t.encode()))
    want = [(1, "one text here and more"), (1, "another text that is unlike it"), (None, first), (None, "quite alone")]
    assert got == sorted(want, key=repr)
