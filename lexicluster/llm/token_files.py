"""Token files: ids in document order, entropy-coded by a static range asymmetric numeral system.

Format: a directory with one Parquet row per file.  A file holds up to ``FILE_IDS`` ids (whole
documents): one frequency table that all its blocks share, and the blocks.  A block holds whole
documents; its ids are dealt over interleaved lanes (id i goes to lane i mod lanes), each lane a
64-bit state renewed by 32-bit words.  A block can be decoded alone, and from each of its
checkpoints (lane states and place in the words) onwards; a crc32 of its ids guards it.

Defined results: a null or empty text holds the end id alone; null ids come first; rows with equal
ids are ordered by a hash of their text; a text longer than a block is a block of its own; an
empty table makes no file and reads back empty.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import loaded, read_tokenizer, worker_cache

SCALE, LANES, BLOCK_IDS, FILE_IDS, CHECKPOINT_STEPS, SLICE_BYTES = 18, 1024, 1 << 18, 1 << 21, 64, 2 << 20
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


class Table:
    """Frequencies of the symbols of a file, scaled to sum to 2**SCALE, every seen symbol > 0."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.at = np.repeat(np.arange(len(symbols), dtype=np.uint32), freq.astype(np.int64))
        self.place = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.int32)
        self.place[symbols] = np.arange(len(symbols), dtype=np.int32)

    @classmethod
    def of(cls, ids: np.ndarray) -> "Table":
        counts = np.bincount(ids)                                 # at most the vocabulary's size
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        if len(symbols) > 1 << SCALE:
            raise ValueError(f"a file has {len(symbols)} symbols; the table has room for {1 << SCALE}")
        # Room beyond one slot a symbol is shared by count; the largest symbol takes what is left.
        freq = 1 + (counts * ((1 << SCALE) - len(symbols)) // counts.sum())
        freq[np.argmax(counts)] += (1 << SCALE) - freq.sum()
        return cls(symbols, freq)

    def pack(self) -> bytes:
        return zlib.compress(np.array([self.symbols, self.freq], "<u4").tobytes(), 1)

    @classmethod
    def read(cls, raw: bytes) -> "Table":
        return cls(*np.frombuffer(zlib.decompress(raw), "<u4").reshape(2, -1))


def encode_block(ids: np.ndarray, table: Table) -> dict:
    sym = table.place[ids]
    freq, cum = table.freq[sym], table.cum[sym]
    full_at = freq << np.uint64(63 - SCALE)
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    words, sizes, marks = [], np.zeros(steps, np.int64), []
    for s in range(steps - 1, -1, -1):
        part = slice(s * lanes, (s + 1) * lanes)
        f, c = freq[part], cum[part]
        y = x[:len(f)]
        full = y >= full_at[part]
        words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        sizes[s] = len(words[-1])
        y = np.where(full, y >> _WORD, y)
        q = y // f
        x[:len(f)] = (q << np.uint64(SCALE)) + (y - q * f) + c
        if s % CHECKPOINT_STEPS == 0:
            marks.append((s, x.copy()))
    places = np.concatenate([[0], np.cumsum(sizes)])
    marks.reverse()
    return {"n_ids": len(ids), "lanes": lanes, "crc32": zlib.crc32(ids.astype("<u4").tobytes()),
            "mark_steps": [s for s, _ in marks], "mark_places": [int(places[s]) for s, _ in marks],
            "mark_states": b"".join(m.astype("<u8").tobytes() for _, m in marks),
            "words": b"".join(w.tobytes() for w in reversed(words))}


def decode_block(block: dict, table: Table, mark: int = 0) -> np.ndarray:
    """Ids of the block from checkpoint ``mark`` on; from the first one they are verified."""
    n, lanes = block["n_ids"], block["lanes"]
    states = np.frombuffer(block["mark_states"], "<u8").reshape(-1, lanes)
    words = np.frombuffer(block["words"], "<u4")
    first, place, x = block["mark_steps"][mark], block["mark_places"][mark], states[mark].copy()
    out, at, low = np.empty(n - first * lanes, np.uint32), 0, np.uint64((1 << SCALE) - 1)
    while at < len(out):
        k = min(lanes, len(out) - at)
        y = x[:k]
        slot = y & low
        sym = table.at[slot.astype(np.int64)]
        out[at:at + k] = table.symbols[sym]
        y = table.freq[sym] * (y >> np.uint64(SCALE)) + slot - table.cum[sym]
        more = np.flatnonzero(y < _LOW)
        y[more] = (y[more] << _WORD) | words[place:place + len(more)].astype(np.uint64)
        x[:k] = y
        place, at = place + len(more), at + k
    if mark == 0 and zlib.crc32(out.astype("<u4").tobytes()) != block["crc32"]:
        raise ValueError("a block's checksum doesn't match its ids")
    return out


_BLOCK = ("struct<n_ids:long,lanes:int,crc32:long,mark_steps:array<int>,mark_places:array<long>,"
          "mark_states:binary,words:binary,doc_ids:array<long>,n_tokens:array<long>>")
_FILE = f"part long, file int, start_in_part long, n_ids long, freq binary, blocks array<{_BLOCK}>"


def write_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id",
                text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the files in ascending id order."""
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))      # one vocabulary file
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = spark.createDataFrame([], _FILE).schema
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = loaded(tokenizer.value)
        part, number, start = 0, 0, 0
        blocks: list[tuple[list, list]] = []                      # (doc ids, ids of each document)
        held = 0

        def flush():
            nonlocal number, start, blocks, held
            arrays = [np.frombuffer(b"".join(raw), "<u4") for _, raw in blocks]
            every = np.concatenate(arrays)
            freq = Table.of(every)
            rows = [encode_block(a, freq) | {"doc_ids": d, "n_tokens": [len(r) // 4 for r in raw]}
                    for a, (d, raw) in zip(arrays, blocks)]
            cols = [[part], [number], [start], [len(every)], [freq.pack()], [rows]]
            number, start, blocks, held = number + 1, start + len(every), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

        filled = BLOCK_IDS
        for b in batches:
            part = b.column(2)[0].as_py()
            rows = max(1, int(b.num_rows * SLICE_BYTES / max(1, b.nbytes)))
            for at in range(0, b.num_rows, rows):
                piece = b.slice(at, rows)
                for doc, raw in zip(piece.column(0).to_pylist(), enc.lines(piece.column(1).to_pylist(), SLICE_BYTES)):
                    if filled >= BLOCK_IDS:
                        if held >= FILE_IDS:
                            yield flush()
                        blocks.append(([], []))
                        filled = 0
                    blocks[-1][0].append(doc)
                    blocks[-1][1].append(raw + end)
                    filled += len(raw) // 4 + 1
                    held += len(raw) // 4 + 1
                pa.default_memory_pool().release_unused()
        if held:
            yield flush()

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("h", F.xxhash64("t")).repartitionByRange(F.col("id").asc_nulls_first(), "h") \
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    d.select("id", "t", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, schema) \
        .write.option("compression", "uncompressed").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's place and its ids as little-endian uint32,
    block by block."""
    files = spark.read.schema(spark.createDataFrame([], _FILE).schema).parquet(path)
    # One row per range partition of the writer.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    blocks = files.select("part", "file", "start_in_part", "freq",
                          F.explode(F.arrays_zip("blocks", F.transform("blocks", lambda b, i: F.aggregate(
                              F.slice("blocks", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n_ids"])))).alias("z")) \
        .select("part", "file", "freq", (F.col("start_in_part") + F.col("z")["1"]).alias("start"), F.col("z")["blocks"].alias("b"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        for batch in batches:
            for r in batch.to_pylist():
                if cache.get("freq") != r["freq"]:
                    cache["freq"], cache["table"] = r["freq"], Table.read(r["freq"])
                raw = decode_block(r["b"], cache["table"]).astype("<u4").tobytes()
                n = np.array(r["b"]["n_tokens"], np.int64)
                ends = np.cumsum(n)
                cuts = np.concatenate([[0], 4 * ends])
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(n), pa.int64()), pa.array(r["b"]["doc_ids"], pa.int64()),
                     pa.array(r["start"] + ends - n), pa.array(n), ids], names=["part", "doc_id", "start", "n_tokens", "ids"])

    out = blocks.mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids binary")
    return out.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
