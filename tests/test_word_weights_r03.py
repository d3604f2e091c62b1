"""Word weights make their rows once, the vocabulary is counted in slices."""
from lexicluster.operators import explain as E
from lexicluster.operators import features as feats


def counted_rows(spark, rows, schema):
    """The rows, and how many were made so far."""
    made = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    return spark.createDataFrame(rows, schema).repartition(4).mapInArrow(each, schema), made


def test_word_weights_make_their_rows_once(spark):
    rows = [(i, i % 2, ["a", "b"] if i % 2 else ["c", None, "c"]) for i in range(40)]
    df, made = counted_rows(spark, rows, "doc_id long, label int, tokens array<string>")
    vocab = feats.Vocabulary(["a", "b", "c"], [1, 1, 1], [1, 1, 1], 40)
    got = E.explain_by_weight(df, 1, vocab, "tokens", "label").collect()
    assert sorted(r["cluster"] for r in got) == [0, 1]
    assert made.value == 40


def test_vocabulary_counts_in_slices(spark, monkeypatch):
    rows = [(["b", "a", "b"],), ([],), (None,), (["", None, "c", "b"],), (["a"],)]
    monkeypatch.setattr(feats, "COUNTED_TOKENS", 2)
    v = feats.fit_vocabulary(spark.createDataFrame(rows, "tokens array<string>").coalesce(1), 3)
    assert (v.terms, v.df, v.total, v.n_docs) == (["", "a", "b"], [1, 2, 2], [1, 2, 3], 5)
    empty = feats.fit_vocabulary(spark.createDataFrame([], "tokens array<string>"), 3)
    assert (empty.terms, empty.n_docs) == ([], 0)
