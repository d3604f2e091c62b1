"""Exact top-k search, vector codes and the Merkle manifest against brute force."""
import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicluster.llm import bitsliced, merkle, queries, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, score string, code int, query_id int, kept int, error string"


def vector_rows(n=700, dim=10, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(dim) * (1 + i % 3)], int(i % 4) if i % 9 else None) for i in range(n)]
    rows[40] = (40, rows[20][1], 1)                        # ties
    rows[41] = (41, rows[20][1], 1)
    rows += [rows[60], rows[61], (None, rows[5][1], None)]  # repeated rows, no id
    rows += [(n, None, 1), (n + 20, [], 1), (n + 40, [float("nan")] * dim, 1), (n + 60, [None] * dim, 2), (n + 80, [float("inf")] * dim, 2),
             (n + 100, [0.0] * dim, 0), (n + 120, [1.0] * (dim + 1), 0), (n + 140, [3e30] + [-1e-20] * (dim - 1), 3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 1, 2, 3, "z") for r in rows], VECTORS).repartition(5)


def kept(rows, scale, clip, with_null_id):
    out = []
    for i, v, label in rows:
        if not v or any(x is None or not math.isfinite(x) for x in v) or (i is None and not with_null_id):
            continue
        out.append((i, [math.floor(max(min(float(np.float32(x)) * scale, clip), -clip)) for x in v], label))
    usual = sorted(collections.Counter(len(v) for _, v, _ in out).items(), key=lambda c: (-c[1], c[0]))[0][0]
    return [r for r in out if len(r[1]) == usual]


@pytest.mark.parametrize("block", [128, 8192])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", block)
    rows = vector_rows()
    df = frame(spark, rows)
    got = bitsliced.top_k(df, df.where("vec_id % 20 = 0"), k=20).collect()
    have = kept(rows, 64, bitsliced.CLIP, False)
    asked = {}
    for i, v, _ in have:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(asked)
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w, _ in have if i != q)[:20]
        assert by[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_few_and_empty(spark):
    df = frame(spark, [(0, [1.0, -2.0], 1), (20, [0.5, 0.25], 1), (3, [-1.0, 0.0], None)])
    got = bitsliced.top_k(df, df.where("vec_id % 20 = 0"), k=20)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == [
        (0, 1, 20, 64 * 32 - 128 * 16), (0, 2, 3, -64 * 64), (20, 1, 0, 0), (20, 2, 3, -32 * 64)]
    none = frame(spark, [])
    assert bitsliced.top_k(none, none).collect() == [] == bitsliced.top_k(df, none).collect()
    assert bitsliced.top_k(df, none).columns == ["query_id", "rank", "vec_id", "score"]


def brute_codes(have, parts=4, entries=256, rounds=4):
    have = sorted(have, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(have[0][1]) // parts)
    x = np.array([v + [0] * (width * parts - len(v)) for _, v, _ in have], dtype=object).reshape(len(have), parts, width)
    books = [[list(row) for row in x[:entries, p]] for p in range(parts)]

    def nearest(p):
        d = ((x[:, p][:, None, :] - np.array(books[p], dtype=object)[None]) ** 2).sum(axis=2)
        j = [min(range(len(books[p])), key=lambda e: (row[e], e)) for row in d]
        return j, [row[e] for row, e in zip(d, j)]
    for _ in range(rounds):
        for p in range(parts):
            j, _d = nearest(p)
            for e in set(j):
                mine = [x[i, p] for i in range(len(x)) if j[i] == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [nearest(p) for p in range(parts)]
    out = [(have[i][0], "".join(f"{final[p][0][i]:02x}" for p in range(parts)), sum(final[p][1][i] for p in range(parts)), have[i][2]) for i in range(len(have))]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("n,entries,group", [(700, 256, 16), (700, 40, 4), (30, 256, 16)])
def test_codes(spark, monkeypatch, n, entries, group):
    monkeypatch.setattr(vector_codes, "GROUP_ENTRIES", group)
    rows = vector_rows(n if n > 100 else 70)[-n:]
    coded, books = vector_codes.compress(frame(spark, rows), entries=entries, keep=("label",))
    got = vector_codes.with_totals(coded, F.col("kept")["label"], "error", "total").collect()
    want, digest = brute_codes(kept(rows, 1024, vector_codes.CLIP, True), entries=entries)
    assert books.digest() == digest
    assert sorted(((r.id, bytes(r.code).hex(), r.error, r.kept.label) for r in got), key=repr) == sorted(want, key=repr)
    totals = collections.Counter()
    for w in want:
        totals[w[3]] += w[2]
    assert all(r.total == totals[r.kept.label] for r in got)


def test_codes_spare_scans(spark):
    """Neighbouring entries: the bounds rule out most of the distances after the first round."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((20, 16)) * 10
    rows = [(i, [float(x) for x in centre[i % 20] + rng.standard_normal(16) * 0.1], 0) for i in range(3000)]
    coded, _ = vector_codes.compress(frame(spark, rows), keep=("label",))
    assert coded.agg(F.sum("scanned")).first()[0] < 0.5 * 3000 * 4 * 256
    want, _ = brute_codes(kept(rows[:400], 1024, vector_codes.CLIP, True))
    got = vector_codes.compress(frame(spark, rows[:400]), keep=("label",))[0].collect()
    assert sorted((r.id, bytes(r.code).hex(), r.error) for r in got) == sorted(w[:3] for w in want)


def test_codes_empty(spark):
    coded, books = vector_codes.compress(frame(spark, []), keep=("label",))
    assert coded.collect() == [] and books is None
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, []), entries=300)


def test_totals_of_many_keys(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50, bytes([i % 7]), i) for i in range(300)], "id int, k int, code binary, error long")
    want = sorted((r.id, r.t) for r in vector_codes.with_totals(df, F.col("k"), "error", "t").collect())
    monkeypatch.setattr(vector_codes, "TOTALS", 0)
    assert sorted((r.id, r.t) for r in vector_codes.with_totals(df, F.col("k"), "error", "t").collect()) == want
    assert dict(want)[0] == sum(range(0, 300, 3))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, `group` string, digest string, tree int, carried int"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (r[0], r[3], r[2], r[4], text)))


def levels(nodes):
    """All levels of a list of digests up to the single one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
            fold, proof = leaf(r, low), ""
            for tree, at in ((trees[g], i), (top, n)):
                for nodes in tree[:-1]:
                    run = nodes[at // 16 * 16:at // 16 * 16 + 16]
                    left, right = "".join(run[:at % 16]), "".join(run[at % 16 + 1:])
                    fold, proof, at = digest(left + fold + right), proof + left + right, at // 16
            out.append((r[0], own, trees[g][-1][0], top[-1][0], digest(proof), fold, fold == top[-1][0]))
    return out


def manifest(spark, rows, tmp_path, parts=6):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(*r, 1, "g", "d", 2, 3) for r in rows], DOCS).repartition(parts)
    df.write.parquet(path + "/documents.parquet")
    return queries.queries()["op13_merkle_manifest"](spark, path)


def check(spark, rows, tmp_path):
    got = manifest(spark, rows, tmp_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_manifest(rows), key=repr)


TEXTS = [None, "", " ", "Mixed CASE Text", "é" * 40 + "ÀB", "日本語 ABC", "x" * 400_000 + "Z", "a:b-", "\n\tA"]


def test_manifest_odd_rows(spark, tmp_path):
    rows = [(i * 7 % 400, TEXTS[i % len(TEXTS)] if i % 11 else f"Doc {i}", "en" if i % 5 else None,
             ["hot", "hot", f"s{i % 40:02d}", None, "é", ""][i % 6], i if i % 4 else None) for i in range(330)]
    rows += [rows[3], rows[3], (None, "No ID", "en", "hot", 1), (None, None, None, None, None), (10 ** 12, "A lone Leaf", "x", "lone", 3)]
    check(spark, rows, tmp_path)


def test_manifest_deep_tree(spark, tmp_path):
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"src{i % 300}", i) for i in range(9000)]
    check(spark, rows, tmp_path)


def test_manifest_deep_tree_without_broadcasts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "PIECES", 0)
    monkeypatch.setattr(merkle, "NODES", 0)
    check(spark, [(i, f"Text {i}", "en", f"s{i % 3}", i) for i in range(900)], tmp_path)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 300])
def test_manifest_one_source(spark, tmp_path, n):
    if not n:
        assert manifest(spark, [], tmp_path).collect() == []
        return
    check(spark, [(i, f"Text {i}", "en", "s", i) for i in range(n)], tmp_path)


def test_manifest_lone_leaves(spark, tmp_path):
    check(spark, [(i, f"Text {i}", "en", f"s{i}", i) for i in range(20)], tmp_path)
