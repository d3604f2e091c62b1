"""Helpers shared by the operators of this subpackage: scans, written tables, words, hot keys."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicluster.session import shared_path

# Words are maximal runs of bytes other than ASCII white space.  ``bytes.split()`` splits at
# exactly these six bytes, and ``bytes.lower()`` changes A-Z alone.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared directory and read back: cuts the lineage, is
    computed once however often it is used, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(col: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, a null being empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def quantised(vectors: DataFrame, scale: int, clip: int, id_col: str, vec_col: str, *keep: Column) -> DataFrame:
    """(id, v, kept columns): floor(scale * x) of the components in double precision, clipped at
    +-``clip``, of the vectors that are neither null nor empty and hold finite components alone."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(clip))), F.lit(float(-clip)))).cast("long"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), *keep)


def list_matrix(col) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def usual_length(rows: DataFrame) -> int | None:
    """The length that most ``v`` have (the smaller, if as many), None without rows."""
    first = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return first and first["d"]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_bucket(col: str, n: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]],
             flush_rows: int = 1024, flush_bytes: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` with column dictionaries: ``rows`` takes an iterator of ``{column: list}``
    batches and yields ``{column: sequence}`` batches."""
    empty = df.sparkSession.createDataFrame([], schema)
    names = empty.columns
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(empty.schema)

    def run(batches):
        def dicts():
            for b in batches:
                # A batch may hold long texts; it is taken in slices of bounded size.
                step = max(1, min(b.num_rows, int(flush_bytes * b.num_rows / max(1, b.nbytes)) + 1, flush_rows))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        for out in rows(dicts()):
            arrays = [pa.array(out[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, empty.schema)


def count_cut(df: DataFrame, count: str, most: int) -> int:
    """Smallest count ``t`` (from a geometric grid) such that at most ``most`` rows have
    ``count >= t``.  Reads a histogram of some hundred rows, never the keys."""
    grid = F.floor(F.log2(F.col(count).cast("double")) * 4)
    hist = {r["g"]: r["n"] for r in df.where(F.col(count) > 0).groupBy(grid.alias("g")).agg(F.count("*").alias("n")).collect()}
    total, cut = 0, None
    for g in sorted(hist, reverse=True):
        if total + hist[g] > most:
            break
        total, cut = total + hist[g], g
    if cut is None:
        return (1 << 62) if hist else 1
    # Every count on the kept side of the grid line satisfies this bound.
    return int(np.ceil(2 ** (cut / 4) - 1e-9))
