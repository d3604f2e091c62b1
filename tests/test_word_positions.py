"""EVAL-12 against a loop over words, for short and for long word lists."""
import collections

import pytest

from lexicluster.operators.explain import word_position_stats, word_positions

DOCS = [(1, 0, "a b a c".split()), (2, 0, "b b".split()), (3, 0, ["c"]), (4, 1, "a x y z a".split()), (5, 1, []), (6, 1, None),
        (7, None, ["a"]), (8, 2, ["q"] * 5000 + ["a"]), (9, 2, ["a"]), (10, 2, ["a", "a"])]
WORDS = [(0, "a"), (0, "b"), (0, "zz"), (1, "z"), (1, "a"), (2, "a"), (2, "a"), (3, "a")]


@pytest.mark.parametrize("max_listed", [10_000, 0])
def test_first_positions(spark, max_listed):
    docs = spark.createDataFrame(DOCS, "doc_id int, label int, toks array<string>").repartition(3)
    words = spark.createDataFrame(WORDS, "label int, word string")
    got = word_positions(docs, words, max_listed=max_listed)
    assert got.columns == ["label", "word", "position"]
    want = [(c, w, t.index(w) / len(t)) for c, w in set(WORDS) for _, label, t in DOCS if label == c and t and w in t]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array<array" not in plan
    stats = {(r["label"], r["word"]): r for r in word_position_stats(docs, words, max_listed=max_listed).collect()}
    groups = collections.defaultdict(list)
    for c, w, p in want:
        groups[c, w].append(p)
    assert set(stats) == {k for k, v in groups.items() if len(v) > 1}          # one value has no deviation: incomplete
    assert stats[2, "a"]["count"] == 3 and stats[2, "a"]["max"] == 5000 / 5001
    assert abs(stats[2, "a"]["75%"] - 2500 / 5001) < 1e-12
