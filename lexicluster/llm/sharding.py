"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a link key (equal texts, by default) are neighbours.  In each round a join
tells every linked document which shard holds most of its neighbours; those that want to move are
admitted while the target shard has room, by a hash of the document against the share of wishes
that fits.  Unlinked documents are the filler.  At the end each shard gives back what exceeds its
quota and the pool fills the gaps, so the shard sizes are exact under the law ``rows``: counts
differ by one at most.

A neighbourhood is kept as counts per (link, shard): a link with thousands of documents is a few
rows, pre-aggregated before its shuffle.  Ranks inside a shard come from fixed hash cells and the
running totals of the cells (at most ``CELLS`` a shard), never from one window over a shard.

Defined results: a null text is empty, has no bytes and links with the other empty texts; a null
id hashes as the empty text; repeated rows are rows of their own; fewer rows than shards leave
shards empty; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELLS = 4096


def _cell(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(CELLS))


def _ranked(df: DataFrame, group: list[str], cell: str, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 0 inside each group by (cell, order): row numbers inside a cell
    plus the running total of the cells before it.  Both windows have small partitions: a cell,
    or the at most ``CELLS`` totals of a group."""
    inside = Window.partitionBy(*group, cell).orderBy(*order)
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, cell).agg(F.count("*").alias("_n")) \
        .select(*group, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.withColumn("_in", F.row_number().over(inside) - 1).join(totals, [*group, cell]) \
        .withColumn("rank", (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before")


def _quotas(n: int, shards: int) -> Column:
    """Rows of shard ``shard``: n / shards, one more in the first n % shards."""
    return F.lit(n // shards) + F.when(F.col("shard") < n % shards, F.lit(1)).otherwise(F.lit(0))


def propagate(linked: DataFrame, quota: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``linked`` (row, link, h, shard) after the rounds.  ``quota`` has one row per shard."""
    for k in range(max_rounds):
        held = linked.groupBy("link", "shard").agg(F.count("*").alias("n"))
        load = quota.join(linked.groupBy("shard").agg(F.count("*").alias("load")), "shard", "left") \
            .select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("free"))
        # The shard that a link's documents want: of those with room, the one with most of them.
        open_ = load.where("free > 0")
        best = held.join(F.broadcast(open_), "shard").groupBy("link").agg(
            F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("want"))
        spread = held.groupBy("link").agg(F.count("*").alias("parts")).where("parts > 1")
        # Written, as ``many`` below: a join of two plain exchanges is one that Spark splits where a
        # link has many documents.
        goal = written(best.join(spread, "link", "left_semi"), "goals")
        full = F.broadcast(load.where("free <= 0").select(F.col("shard").alias("_full")))
        # A shard that is already full keeps what it has.
        wish = linked.join(goal, "link").where("shard <> want") \
            .join(full, F.col("shard") == F.col("_full"), "left_anti")
        wish = wish.select("row", "h", "want")
        share = wish.groupBy("want").agg(F.count("*").alias("asked")) \
            .join(F.broadcast(open_.withColumnRenamed("shard", "want")), "want") \
            .select("want", F.least(F.lit(1.0), F.col("free") / F.col("asked")).alias("share"))
        draw = F.pmod(F.xxhash64("h", F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moves = wish.join(F.broadcast(share), "want").where(draw < F.col("share")).select("row", "want")
        moves = written(moves, "moves")
        if moves.isEmpty():
            return linked
        linked = written(linked.join(moves, "row", "left").select(
            "row", "link", "h", F.coalesce("want", "shard").alias("shard")), "labels")
    return linked


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, link, shard, slot) under the law ``rows``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.unhex(F.md5(text.cast("binary"))).alias("link"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("h", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(17))), "rows")
    n = rows.count()
    spark = docs.sparkSession
    quota = spark.range(shards).select(F.col("id").cast("int").alias("shard")) \
        .withColumn("quota", _quotas(n, shards).cast("long"))
    many = written(rows.groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link"), "links")
    linked = rows.join(many, "link", "left_semi").select(
        "row", "link", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    linked = propagate(written(linked, "linked"), quota)

    # Linked documents keep their shard up to its quota; the surplus and the unlinked are the pool.
    labelled = linked.withColumn("cell", _cell(F.xxhash64("link", F.pmod("h", F.lit(64)))))
    ranked = _ranked(labelled, ["shard"], "cell", ["link", "h", "row"]).join(F.broadcast(quota), "shard")
    ranked = written(ranked.select("row", "shard", (F.col("rank") < F.col("quota")).alias("stays")), "ranked")
    stays = ranked.where("stays").select("row", "shard")
    pool = rows.join(stays, "row", "left_anti") \
        .select("row", "link", "h", F.lit(0).alias("g"), _cell(F.xxhash64("link", F.pmod("h", F.lit(64)))).alias("cell"))
    gaps = quota.join(stays.groupBy("shard").agg(F.count("*").alias("held")), "shard", "left") \
        .withColumn("gap", F.col("quota") - F.coalesce("held", F.lit(0)))
    ends, total = [], 0                                      # one number a shard
    for g in sorted(gaps.select("shard", "gap").collect()):
        total += g["gap"]
        ends.append(total)
    ends = F.array(*[F.lit(x).cast("long") for x in ends])
    filled = _ranked(pool, ["g"], "cell", ["link", "h", "row"]) \
        .select("row", F.size(F.filter(ends, lambda x: x <= F.col("rank"))).alias("shard"))
    placed = rows.join(stays.unionByName(filled), "row").withColumn("cell", _cell(F.col("h")))
    return _ranked(placed, ["shard"], "cell", ["h", "id", "row"]).select(
        "id", "size", "text_crc32", "link", "shard", F.col("rank").alias("slot"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: linked documents, and those of them outside the largest part of their link."""
    parts = sharded.groupBy("link", "shard").agg(F.count("*").alias("n"))
    links = parts.groupBy("link").agg(F.sum("n").alias("n"), F.max("n").alias("top")).where("n > 1")
    return links.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"),
                     F.coalesce(F.sum(F.col("n") - F.col("top")), F.lit(0)).alias("cut"))
