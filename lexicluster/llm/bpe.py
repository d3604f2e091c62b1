"""BPE encoding and decoding through a distinct-word table.

Documents are read in chunks of bounded text.  A chunk keeps the positions of its words as numbers
into its list of distinct words; the words go to their hash bucket, where each distinct word is
encoded once for all chunks, and the ids come back to the chunk, where they are joined to the
positions.  Decoding joins every id to its piece.

The chunks are made twice by the same code over the same file splits, once for the words and once
for the positions, so that nothing but compressed words, ids and positions is shuffled; the number
and a checksum of a chunk's words guard the join.  An input whose rows don't come straight from
files is written first.  The tasks that encode grow with the splits of the input: every
``SALT_PARTS`` splits have their own tasks for the buckets.

Defined results: a null or empty text has no ids and decodes to the empty text; a text longer than
a chunk is a chunk of its own; repeated rows are rows of their own; an empty table gives an empty
result; columns in ``keep`` travel as they are.
"""
from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import gather, loaded, read_tokenizer

BUCKETS, CHUNK_BYTES, TABLE_WORDS = 256, 16 << 20, 1 << 20
#: Input splits whose chunks share the tables of the buckets; more splits get further tasks.
SALT_PARTS = 64
_PARTS = "chunk long, bucket int, blob binary"


def _pack(numbers: np.ndarray) -> bytes:
    """uint32 numbers as byte planes."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _squeeze(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _expand(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:8], "<u8")[0])
    cuts = np.cumsum([8 * (n + 1), *np.frombuffer(raw[8:8 * (n + 1)], "<u8").tolist()]).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _words_blob(words: list[bytes]) -> bytes:
    return _squeeze(_pack(np.array([len(w) for w in words], np.uint32)), b"".join(words))


def _read_words(blob: bytes) -> list[bytes]:
    lens, data = _expand(blob)
    ends = np.cumsum(_unpack(lens), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class _Chunk:
    def __init__(self):
        self.bytes, self.kept, self.lens, self.at = 0, [], [], []
        self.table = defaultdict(itertools.count().__next__)

    def add(self, words: list[str], kept: pa.RecordBatch, size: int) -> None:
        self.at.append(np.fromiter(map(self.table.__getitem__, words), np.uint32, len(words)))
        self.lens.append(len(words))
        self.kept.append(kept)
        self.bytes += size

    def rows(self, number: int, heads: bool) -> Iterator[tuple]:
        words = [w.encode() for w in self.table]
        bucket = np.array([zlib.crc32(w) % BUCKETS for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        if heads:
            kept = pa.Table.from_batches(self.kept).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_table(kept)
            # Words are numbered in bucket order: the order in which their ids come back.
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            check = zlib.crc32(b"\0".join([words[i] for i in order]))
            yield number, -1, _squeeze(sink.getvalue().to_pybytes(), _pack(np.array(self.lens, np.uint32)),
                                       _pack(rank[np.concatenate(self.at)] if words else np.array([], np.uint32)),
                                       np.array([len(words), check], "<u8").tobytes())
            return
        cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        for b in range(BUCKETS):
            if cuts[b] < cuts[b + 1]:
                yield number, b, _words_blob([words[i] for i in order[cuts[b]:cuts[b + 1]]])


def _batches(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of chunk parts as record batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c, b, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(b, pa.int32()), pa.array(x, pa.binary())],
                                      names=["chunk", "bucket", "blob"])


def _chunks(docs: DataFrame, tokenizer, keep: list[str], text_col: str, heads: bool) -> DataFrame:
    def run(batches):
        split = loaded(tokenizer.value).split

        def parts():
            chunk, number = _Chunk(), 0
            for b in batches:
                texts = b.column(len(keep))
                for i in range(b.num_rows):
                    t = texts[i].as_py()
                    # A chunk's number is its split of the input and its turn in it.
                    where = b.column(len(keep) + 1)[0].as_py() << 32
                    chunk.add(split(t), b.slice(i, 1).select(range(len(keep))), len(t))
                    if chunk.bytes >= CHUNK_BYTES:
                        yield from chunk.rows(where + number, heads)
                        chunk, number = _Chunk(), number + 1
            if chunk.lens:
                yield from chunk.rows(where + number, heads)
        yield from _batches(parts())

    d = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
                    F.spark_partition_id().cast("long").alias("p"))
    return d.mapInArrow(run, _PARTS)


def _encoded(parts: DataFrame, tokenizer, salts: int) -> DataFrame:
    """Word blobs to id blobs: in its bucket a distinct word is encoded once, as long as the bucket's
    table has fewer than ``TABLE_WORDS`` words (it then starts anew).  ``salts`` deals the chunks of a
    bucket out to more tasks, each of which has a table of its own."""
    def run(batches):
        enc = loaded(tokenizer.value)
        table: dict[bytes, bytes] = {}
        now = None

        def out():
            nonlocal table, now
            for b in batches:
                rows = zip(*[b.column(i).to_pylist() for i in range(4)])
                # The rows of one bucket in a batch are encoded together.
                for key, group in itertools.groupby(rows, key=lambda r: (r[1], r[3])):
                    if key != now or len(table) > TABLE_WORDS:
                        table, now = {}, key
                    group = [(chunk, bucket, _read_words(blob)) for chunk, bucket, blob, _ in group]
                    new = list({w for _, _, words in group for w in words if w not in table})
                    ids, counts = enc.encode([w.decode() for w in new])
                    raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                    table.update(zip(new, [raw[x:y] for x, y in zip([0, *ends], ends)]))
                    for chunk, bucket, words in group:
                        got = [table[w] for w in words]
                        yield chunk, bucket, _squeeze(_pack(np.array([len(x) // 4 for x in got], np.uint32)),
                                                      _pack(np.frombuffer(b"".join(got), "<u4")))
        yield from _batches(out())

    tasks = min(BUCKETS, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if salts == 1 else BUCKETS * salts
    salted = parts.withColumn("salt", F.pmod(F.shiftright("chunk", 32), F.lit(salts)).cast("int"))
    return salted.repartition(max(1, tasks), "bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(run, _PARTS)


def _settled(docs: DataFrame) -> DataFrame:
    """``docs``, written once if its rows come from a shuffle: the two passes over the texts must see the
    same rows in the same places, which files guarantee."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return written(docs, "texts") if any(x in plan for x in ("Exchange", "MapInArrow", "MapInPandas", "Python", "InMemoryTableScan")) else docs


def encode(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``keep`` columns and ``token_ids`` ARRAY<INT> of every row; with ``decoded`` also the text
    that the ids stand for, put together from the pieces of the ids."""
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))      # one vocabulary file
    keep = list(keep)
    docs = _settled(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])]))
    last = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    ids = _encoded(_chunks(docs, tokenizer, keep, text_col, False), tokenizer, last // SALT_PARTS + 1)
    heads = _chunks(docs, tokenizer, keep, text_col, True)
    schema = docs.select(*keep).withColumn("token_ids", F.lit(None).cast("array<int>"))
    if decoded:
        schema = schema.withColumn("decoded", F.lit("").cast("string"))
    names = schema.columns

    def assemble(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(documents(t)))

    def documents(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.argsort(t.column("bucket").to_numpy())
        blobs = t.column("blob").to_pylist()
        ipc, lens, at, guard = _expand(blobs[order[0]])
        kept = pa.ipc.open_stream(ipc).read_all()
        lens, at = _unpack(lens).astype(np.int64), _unpack(at)
        counts, flat = [], []
        for i in order[1:]:
            c, f = _expand(blobs[i])
            counts.append(_unpack(c))
            flat.append(_unpack(f))
        blobs = None
        counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        starts = np.cumsum(counts) - counts
        enc = loaded(tokenizer.value)
        n, check = np.frombuffer(guard, "<u8").tolist()
        pieces = list(map(enc.pieces.__getitem__, flat.tolist()))
        cut = np.cumsum(counts).tolist()
        texts = [b"".join(pieces[a:b]) for a, b in zip([0, *cut], cut)]
        if len(counts) != n or zlib.crc32(b"\0".join(texts)) != check:
            raise RuntimeError("the words of a chunk and its positions don't agree")
        word_ends = np.cumsum(lens)
        step = 256                                               # documents at a time
        for a in range(0, len(lens), step):
            b = min(a + step, len(lens))
            lo, hi = int(word_ends[a] - lens[a]), int(word_ends[b - 1])
            w = at[lo:hi]
            got = flat[gather(starts[w], counts[w])].astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(counts[w])])[np.concatenate([[0], word_ends[a:b] - lo])]
            cols = [c.combine_chunks() for c in kept.slice(a, b - a).columns]
            cols.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(got, pa.int32())))
            if decoded:
                stops = (word_ends[a:b] - lo).tolist()
                w = w.tolist()
                cols.append(pa.array([b"".join(map(texts.__getitem__, w[x:y])) for x, y in zip([0, *stops], stops)],
                                     pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return heads.unionByName(ids).groupBy("chunk").applyInArrow(assemble, schema.schema)
