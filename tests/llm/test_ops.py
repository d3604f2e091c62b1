"""Operators against brute force on small tables with nulls, empties, ties and repeated rows."""
import collections
import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from lexicluster.llm import bpe, mixing, quality_rules, sharding, simhash, token_files
from lexicluster.session import shared_path

TOK = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, words int"
ODD = [None, "", " ", "\n\n", "one", "Two words", "a b \x1c c d", "don't  stop\n\n  'twas", "日本語 テキスト　です",
       "x<|endoftext|>y <|endoftext|>", "tab\there\r\nnew", "!!! ??? ...", "é" * 50, " lead", "trail ", "a b c a b c a b c",
       "w" * 3000, "\u0085next line"]


def rows(texts, sources=("s1", "s2", None)):
    return [(i, t, "en", sources[i % len(sources)], 0, "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(None, "no id at all", None, None, None, None, None), (0, None, "en", "s1", 0, "x", 1), (3, "\n\n", "en", "s1", 0, "x", 1)]
    return spark.createDataFrame(rows(ODD) + extra, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOK)


def test_bpe_round_trip(spark, odd, docs, empty):
    tok = reference()
    for d in (odd, docs):
        got = bpe.encode(d, TOK, keep=("doc_id", "text"), decoded=True).collect()
        assert len(got) == d.count()
        for r in got:
            assert r.token_ids == tok.encode(r.text or "", add_special_tokens=False).ids
            assert r.decoded == tok.decode(r.token_ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(empty, TOK).collect() == []


def test_bpe_small_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(bpe, "TABLE_WORDS", 10)
    tok = reference()
    for r in bpe.encode(docs.limit(60), TOK, keep=("text",)).collect():
        assert r.token_ids == tok.encode(r.text, add_special_tokens=False).ids


def test_bpe_of_a_shuffled_input_and_many_splits(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "SALT_PARTS", 2)
    tok = reference()
    mixed = docs.withColumn("r", F.rand()).repartition(7, "r").orderBy("r").limit(150)
    got = bpe.encode(mixed, TOK, keep=("doc_id", "text"), decoded=True).collect()
    assert len(got) == 150 and len({r.doc_id for r in got}) == 150
    for r in got:
        assert r.token_ids == tok.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text


def test_token_files(spark, odd, docs, empty, monkeypatch):
    tok = reference()
    for d, small in ((odd, True), (docs, False), (empty, False)):
        if small:
            monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
            monkeypatch.setattr(token_files, "FILE_IDS", 200)
        else:
            monkeypatch.undo()
        path = shared_path(spark, "t")
        token_files.write_files(d, TOK, path)
        got = sorted(token_files.read_files(spark, path).collect(), key=lambda r: r.start)
        texts = collections.defaultdict(list)
        for r in d.collect():
            texts[r.doc_id].append(tok.encode(r.text or "", add_special_tokens=False).ids + [0])
        at = 0
        for r in got:
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert r.start == at and r.n_tokens == len(ids)
            texts[r.doc_id].remove(ids)
            at += len(ids)
        assert not any(texts.values())
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert keys == sorted(keys)


def test_rans_checkpoints():
    ids = (np.random.default_rng(3).zipf(1.3, 300_000) % 50000).astype(np.uint32)
    t = token_files.Table.of(ids)
    b = token_files.encode_block(ids, token_files.Table.read(t.pack()))
    assert (token_files.decode_block(b, t) == ids).all() and len(b["mark_steps"]) > 2
    for k, s in enumerate(b["mark_steps"]):
        assert (token_files.decode_block(b, t, k) == ids[s * b["lanes"]:]).all()
    with pytest.raises(ValueError):
        token_files.decode_block(b | {"crc32": b["crc32"] ^ 1}, t)


def brute_fingerprint(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, odd, docs, empty):
    near = [(1000 + i, "alpha beta gamma delta " * 3 + t, "en", "s", 0, "x", 1) for i, t in enumerate(["", "", "eps", "zeta", "alpha"])]
    for d in (odd, docs.unionByName(spark.createDataFrame(near, SCHEMA).select(*docs.columns)), empty):
        src = d.collect()
        fps = [brute_fingerprint(r.text) for r in src]
        root = list(range(len(src)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i in range(len(src)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[find(i)] = find(j)
        comp = collections.defaultdict(list)
        for i, r in enumerate(src):
            comp[find(i)].append(r.doc_id)
        least = {k: min((x for x in v if x is not None), default=None) for k, v in comp.items()}
        want = collections.Counter((r.doc_id, fps[i], least[find(i)]) for i, r in enumerate(src))
        got = collections.Counter((r.id, r.fp & (2 ** 64 - 1), r.component) for r in simhash.near_duplicates(d).collect())
        assert got == want
        kept = simhash.keep_one(d).collect()
        assert len(kept) == len(comp) and sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(x for x in least.values() if x is not None)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(e).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[101] == got[102] == 100


def test_mixing(spark, odd, docs, empty):
    for d in (odd, docs):
        got = mixing.mix(d).collect()
        again = mixing.mix(d.repartition(5)).collect()
        assert sorted(got, key=repr) == sorted(again, key=repr)
        assert sum(r.m for r in got) == d.count()
        by = collections.defaultdict(list)
        for r in got:
            assert 0 <= r.copies <= 3
            by[r.source].append(r)
        total = sum(r.m * r.size for r in got)
        order = sorted(by, key=lambda s: (s is None, s))
        size = {s: sum(r.m * r.size for r in by[s]) for s in order}
        w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        free, want = set(order), {}
        while True:
            level = (total - sum(want.values())) / max(1, sum(w[s] for s in free))
            over = [s for s in free if w[s] * level > 3 * size[s]]
            if not over:
                break
            for s in over:
                want[s] = 3.0 * size[s]
                free.remove(s)
        want |= {s: w[s] * level for s in free}
        for s in order:
            assert by[s][0].target == pytest.approx(want[s]) and by[s][0].source_size == size[s]
            assert abs(sum(r.m * r.size * r.copies for r in by[s]) - want[s]) <= max(r.m * r.size for r in by[s]) + 1e-6
        mixed = collections.Counter(r.doc_id for r in mixing.mixed_documents(d).collect())
        assert mixed == collections.Counter({k: v for k, v in sum((collections.Counter({r.id: r.copies * r.m}) for r in got), collections.Counter()).items() if v})
        assert mixing.mixed_documents(d).columns == d.columns
    assert mixing.mix(empty).collect() == []


def test_mixing_expectation_and_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "ab"[i % 3 > 0], 0, "x", 1) for i in range(600)], SCHEMA)
    for s in (1, 2):
        got = mixing.mix(d, seed=s).collect()
        for k in "ab":
            r = [x for x in got if x.source == k]
            assert abs(sum(x.size * x.copies for x in r) - r[0].target) <= 7


def test_sharding(spark, odd, docs, empty):
    copies = spark.createDataFrame([(5000 + i, "same text", "en", "s", 0, "x", 1) for i in range(90)], SCHEMA)
    for d in (odd, docs.unionByName(copies.select(*docs.columns)), empty):
        s = sharding.shard_documents(d, shards=24)
        got = s.collect()
        src = d.collect()
        assert collections.Counter((r.id, r.size, r.text_crc32) for r in got) == collections.Counter(
            (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in src)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        n = [len(slots[k]) for k in range(24)]
        assert set(slots) <= set(range(24)) and max(n) - min(n) <= 1
        cut = sharding.cut_links(s).first()
        assert cut.cut <= 0.75 * cut.linked or cut.linked < 40


def test_quality_rules_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in quality_rules.apply_rules(odd).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert (got[15].n_words, got[15].n_repeat_words) == (9, 9)
    assert quality_rules.apply_rules(empty).collect() == []
    kept = quality_rules.keep_documents(odd.withColumn("text", F.concat(F.lit("the " * 3), F.repeat(F.lit("and of w1 w2 x"), 1), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("the w"), i.cast("string"))), " "))))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_digest_queries(spark):
    from lexicluster.llm import queries as Q
    tok = reference()
    src = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in Q.queries()["op9_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = tok.encode(src[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(src[r.doc_id].encode()).hexdigest()
    for r in Q.queries()["op7_token_files"](spark, "/root/testdata/sf0.001").collect():
        ids = tok.encode(src[r.doc_id], add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
