"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified links, components.

Fingerprints that differ in at most ``max_distance`` bits agree in at least three of
``max_distance + 3`` blocks.  Every three blocks are one key; distinct fingerprints meet in the
buckets of equal keys, where all Hamming distances are checked, and a bucket yields links to a
representative instead of pairs.  Equal fingerprints never meet: one row stands for all their
documents.  Components come from alternating large-star / small-star rounds over the links, whose state is
written to the shared directory after each round.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of
fewer than ``shingle`` words is one shingle; a null id joins a component but never names it;
repeated rows give repeated output rows; an empty table gives an empty result.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_rows, text_bytes, written

SEED, BITS = 42, 64
#: Blocks beyond the distance, i.e. blocks that a key is made of; members of a bucket that are compared
#: with one another, and how often larger buckets are split; keys of such buckets that are broadcast.
AGREE, BUCKET, SPLITS, HOT_BUCKETS = 3, 1024, 2, 100_000


def fingerprint(text: bytes, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """Majority bit by bit of the XXH64 values of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = max(1, len(words) - shingle + 1)
    ends = (starts[min(shingle, len(words)):] - 1).tolist()
    starts = starts.tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, chunk):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:min(at + chunk, n)], ends[at:at + chunk])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    def rows(batches):
        for b in batches:
            yield {"id": b["id"], "fp": [fingerprint(t, shingle) for t in b["t"]]}

    d = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    return map_rows(d, "id long, fp long", rows)


def _masks(bits: list[int], max_distance: int) -> list[int]:
    """Masks over ``bits`` (their numbers), cut into blocks: values that differ in at most
    ``max_distance`` of these bits agree under at least one mask."""
    n = min(max_distance + AGREE, len(bits))
    cuts = [len(bits) * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, n - max_distance)] if n > max_distance else [0]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _finer(nodes: dict[int, tuple], parents: list[int], max_distance: int) -> list[tuple[int, int, int]]:
    """(parent, node, mask) of the masks that split the buckets of ``parents``.  ``nodes`` holds for
    each node its mask and its rivals: the masks that are tried before it, on all levels."""
    out = []
    for p in parents:
        mask, rivals = nodes[p]
        masks = [mask | x for x in _masks([b for b in range(BITS) if not mask >> b & 1], max_distance)]
        for k, m in enumerate(masks):
            nodes[len(nodes)] = (m, rivals + masks[:k])
            out.append((p, len(nodes) - 1, _signed(m)))
    return out


def _bucket_links(fps: np.ndarray, rivals: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted fingerprints of one bucket: the place of the smallest one that each reaches inside
    the bucket, and the number of its links that no rival finds as well."""
    xor = fps[:, None] ^ fps[None, :]
    i, j = np.nonzero(np.triu(np.bitwise_count(xor) <= max_distance, 1))
    apart, own = xor[i, j], np.ones(len(i), bool)
    for m in rivals:
        own &= (apart & m) != 0
    degree = np.bincount(i[own], minlength=len(fps)) + np.bincount(j[own], minlength=len(fps))
    label = np.arange(len(fps))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label, degree
        label = low


def _buckets(batches, rivals: dict[int, np.ndarray], max_distance: int):
    """Edges (u, v, 0) and degrees (fp, fp, n) of the buckets of rows (fp, node, part) sorted by (node, part)."""
    def found(fp, node, starts, ends):
        rows = []
        size = ends - starts
        two = starts[size == 2]                                              # most buckets: all at once
        for k in np.unique(node[two]):
            at = two[node[two] == k]
            a, b = np.minimum(fp[at], fp[at + 1]), np.maximum(fp[at], fp[at + 1])
            apart = (a ^ b).view(np.uint64)
            near = np.bitwise_count(apart) <= max_distance
            own = near.copy()
            for m in rivals[int(k)]:
                own &= (apart & m) != 0
            rows.append((b[near], a[near], np.zeros(near.sum(), np.int64)))
            rows += [(x[own], x[own], np.ones(own.sum(), np.int64)) for x in (a, b)]
        for s, e in zip(starts[size > 2], ends[size > 2]):
            fps = np.sort(fp[s:e])
            label, degree = _bucket_links(fps.view(np.uint64), rivals[int(node[s])], max_distance)
            moved, some = np.flatnonzero(label != np.arange(len(fps))), np.flatnonzero(degree)
            rows += [(fps[moved], fps[label[moved]], np.zeros(len(moved), np.int64)), (fps[some], fps[some], degree[some])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["u", "v", "n"])

    held = None                                                              # the bucket that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        fp, node, part = cols if held is None else [np.concatenate([h, c]) for h, c in zip(held, cols)]
        starts = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (node[1:] != node[:-1])) + 1])
        held = [c[starts[-1]:] for c in (fp, node, part)]
        yield from found(fp, node, starts[:-1], starts[1:])
    if held is not None:
        yield from found(held[0], held[1], np.array([0]), np.array([len(held[0])]))


def links(distinct: DataFrame, max_distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that connect all that links connect, and degrees (fp, n): the number of links of a
    fingerprint, in parts that add up.

    A fingerprint goes to one bucket per mask.  A bucket yields an edge from each member to the smallest
    one that it reaches inside, not its pairs, so there are at most as many edges as members.  A bucket
    of more than ``BUCKET`` members is split by finer masks over the bits in which they may differ,
    which loses no link; two splits leave at most some 2^9 members."""
    spark, edges, degrees = distinct.sparkSession, None, None
    nodes, level = {0: (0, [])}, 0
    rows, parents = distinct.select("fp", F.lit(0).alias("parent")), [0]
    while True:
        finer = _finer(nodes, parents, max_distance)                         # 20 masks a parent
        dealt = F.broadcast(spark.createDataFrame(finer, "parent int, node int, mask long"))
        keyed = rows.join(dealt, "parent").select("fp", "node", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
        last = level == SPLITS
        if not last:
            hot = written(keyed.groupBy("node", "part").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).drop("n"), "hot-buckets")
            n_hot = hot.count()
        if not last and n_hot:
            few = F.broadcast(hot) if n_hot <= HOT_BUCKETS else hot
            rows = written(keyed.join(few, ["node", "part"], "left_semi").select("fp", F.col("node").alias("parent")), "split-buckets")
            keyed = keyed.join(few, ["node", "part"], "left_anti").select("fp", "node", "part")
        rivals = {n: np.array(nodes[n][1], np.uint64) for _, n, _ in finer}
        got = written(keyed.repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(
            lambda batches, rivals=rivals: _buckets(batches, rivals, max_distance), "u long, v long, n long"), "bucket-links")
        e, d = got.where("n = 0").select("u", "v").distinct(), got.where("n > 0").select(F.col("u").alias("fp"), "n")
        edges, degrees = (e, d) if edges is None else (edges.union(e), degrees.union(d))
        if last or not n_hot:
            return edges, degrees
        parents, level = [n for _, n, _ in finer], level + 1


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root): the smallest vertex reachable from every vertex of the edges, by large-star and
    small-star rounds (each edge stays inside its component; the rounds end when nothing moves)."""
    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
            low = near.groupBy("u").agg(F.min("v").alias("m"))
            moved = near.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            return moved.union(low.select("u", F.col("m").alias("v"))).distinct()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    total = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
    e = written(edges.toDF("u", "v").where("u <> v"), "links")
    last = None
    for _ in range(max_rounds):
        e = written(star(star(e, False), True), "stars")
        now = tuple(e.agg(*total).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return e.select("u", F.col("v").alias("root")).withColumnRenamed("u", "v")


def _classes(fp: DataFrame, max_distance: int) -> DataFrame:
    """(fp, least, root, n_links) of every distinct fingerprint: its smallest id, the smallest
    fingerprint of its component and the number of fingerprints linked to it."""
    distinct = fp.groupBy("fp").agg(F.min("id").alias("least"))
    edges, parts = links(written(distinct.select("fp"), "distinct"), max_distance)
    degree = parts.groupBy("fp").agg(F.sum("n").alias("n_links"))
    # A root is no vertex of its own star: its links come by a join of their own.
    roots = components(edges).withColumnsRenamed({"v": "fp"})
    return distinct.join(roots, "fp", "left").join(degree, "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_distance: int = 3) -> DataFrame:
    """(id, fp, component, n_links): one row per document; ``component`` is the smallest id
    reachable over links, ``n_links`` the number of other fingerprints linked to this one."""
    fp = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _classes(fp, max_distance)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(least, "root").select("fp", "component", "n_links")
    return fp.join(classes, "fp").select("id", "fp", "component", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the first by (id, nulls last, then fingerprint); one
    of them, if rows agree in both."""
    fp = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("x")
    # ``least`` is null only where all ids of a fingerprint are.
    firsts = _classes(fp, max_distance).groupBy("root").agg(first).select(F.col("x.least").alias("__first_id"), F.col("x.fp").alias("__first_fp"))
    tagged = _with_fingerprint(docs, text_col, shingle)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__first_id")) & (F.col("__fp") == F.col("__first_fp"))
    return tagged.join(firsts, same, "left_semi").dropDuplicates(["__fp"]).drop("__fp")


def _with_fingerprint(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` and the fingerprint ``__fp`` of each row."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                fps = [fingerprint(str(t if t is not None else "").encode(), shingle) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps, pa.int64())], names=[*part.schema.names, "__fp"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__fp", LongType())]))
