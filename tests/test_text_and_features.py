import math

from pyspark.sql import functions as F

from lexicluster.functions import text as T
from lexicluster.operators import features as feats


def test_unescape_and_clean(spark):
    df = spark.createDataFrame([("&quot;The C&quot; &amp;lt; &#65;&#x42; &bogus; &#X41;",)], "t string")
    r = df.select(T.unescape_entities("t").alias("u")).first()["u"]
    assert r == '"The C" &lt; AB &bogus; &#X41;'
    df = spark.createDataFrame([("a\\nb <b>x</b>  <!-- c -->  y #12; z",)], "t string")
    assert df.select(T.clean_news("t")).first()[0] == "a b x y z"
    assert df.select(T.strip_html("t", comments=True)).first()[0] == "a\\nb x     y #12; z"


def test_tokenisation(spark):
    df = spark.createDataFrame([("Hello, World! It's 2 a.m. Ok?\tNext line",)], "t string")
    row = df.select(T.split_sentences("t").alias("s"), T.tokenize_rejoin("t").alias("r"),
                    T.vectorizer_tokens("t").alias("v"), T.whitespace_tokens("t").alias("w")).first()
    assert row["s"] == ["Hello, World!", "It's 2 a.m.", "Ok?", "Next line"]
    assert row["r"].split("\t")[0] == "Hello , World !"
    assert row["v"] == ["hello", "world", "ok", "next", "line"]    # "it" is a stop word; "s", "2", "a", "m" too short
    assert row["w"][:2] == ["hello,", "world!"]


def test_tfidf_three_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b", "c"]), (3, ["c", "c", "c"])], "doc_id long, tokens array<string>")
    out = {(r["doc_id"], r["term"]): (r["tf"], r["tfidf"]) for r in feats.tfidf_long(docs, 10).collect()}
    idf = {"a": math.log(4 / 2) + 1, "b": math.log(4 / 3) + 1, "c": math.log(4 / 3) + 1}
    raw1 = {"a": 1 * idf["a"], "b": 2 * idf["b"]}
    n1 = math.sqrt(sum(v * v for v in raw1.values()))
    assert out[(1, "b")][0] == 2
    assert abs(out[(1, "a")][1] - raw1["a"] / n1) < 1e-12
    assert abs(out[(3, "c")][1] - 1.0) < 1e-12
    voc = feats.fit_vocabulary(docs, 2)
    assert voc.terms == ["b", "c"]                                # top-2 by total count, then alphabetical
