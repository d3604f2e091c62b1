"""Merkle manifest of a table, with a proof for every row, by pointer jumping.

A leaf is the SHA-256 of a row's fields.  Per group (source) the leaves ascend by id and every
``FAN`` consecutive nodes become their hash until one is left, the subroot; the subroots, ordered
by group, are hashed into the root in the same way.

Every node below the root holds a pointer to an ancestor and the segment of siblings on the way
to it, at first its parent and its own siblings.  A self-join appends the segment of the node
pointed at and takes over its pointer, which doubles the distance, until all pointers have reached
the root.  The leaves of one run share their way from the parent on: a run is one row with its
leaves, takes the finished segment of the parent in one last join and is then opened into a proof
per leaf, so that no long segment is ever shuffled for a leaf.

Ranks inside a group come from a range partitioning by (group, id) and the counts of its pieces, so
a group with a third of all rows is spread over many tasks.  Everything is DataFrame functions.

Defined results: a null group is a group of its own, before all others; null ids come first in
their group; equal ids are ordered by leaf; repeated rows are leaves of their own; a group with a
single row has its leaf as subroot; a single group's subroot is the root; an empty table gives an
empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN = 16
#: At most so many rows are broadcast: pieces of a ranking (some 100 bytes each), and nodes that many
#: others point at (a segment has 2 KB a level).
PIECES, NODES = 100_000, 2_048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POWERS = [FAN ** i for i in range(1, 16)]


def leaf_digest(fields: dict[str, Column] | tuple[str, ...] = FIELDS) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for a null, else UTF-8 byte count, ``:``, value."""
    cols = [F.col(f) for f in fields] if not isinstance(fields, dict) else list(fields.values())
    strings = [c.cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` give."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return _hash(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def _levels(n: Column) -> Column:
    """Levels above the nodes until one is left: the least power of FAN that holds ``n``."""
    return F.when(n <= 1, 0).otherwise(F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n)) + 1)


def _ranked(df: DataFrame, group: str, order: list[str], more=lambda pieces: pieces) -> DataFrame:
    """``df`` with rank (from 0, by ``order``) and total inside its group.  Rows are sorted by range and
    written, which fixes their places; a piece is the part of a group in one partition.  ``more`` may
    add columns that a group determines to the pieces."""
    placed = written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                     .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))            # the partition; the low bits are the row in it
    pieces = placed.groupBy(group, "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    in_group = Window.partitionBy(group)                                     # at most one row a partition
    before = in_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))) \
        .withColumn("total", F.sum("_n").over(in_group)).drop("_n")
    pieces = written(more(pieces), "pieces")
    small = F.broadcast(pieces) if pieces.count() <= PIECES else pieces
    return placed.join(small, [group, "_piece"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")) \
        .drop("_at", "_piece", "_first", "_before")


def _node(tree, level, index) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), index.cast("long").alias("index"))


def _siblings(children: Column, c: Column) -> Column:
    """What stands left and right of child ``c`` in its run."""
    def joined(keep):
        return F.array_join(F.transform(F.filter(children, keep), lambda o: o["digest"]), "")
    return F.struct(joined(lambda o: o["pos"] < c["pos"]).alias("left"), joined(lambda o: o["pos"] > c["pos"]).alias("right"))


def _climb(nodes: DataFrame, level: int, top_level: int, sub: bool, above: Column) -> tuple[list[DataFrame], DataFrame | None]:
    """Hash ``nodes`` (tree, index, digest, levels) of one level upwards.  Returns the links (node, up,
    segment, subroot) of all nodes below the tops, and the tops (tree, digest).  ``above`` is what
    stands for a tree's top in the tree over it; ``sub``: the nodes are subroots."""
    links, tops = [], None
    while True:
        done = nodes.where(F.col("levels") == level).select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        if level >= top_level:
            return links, tops
        run = nodes.where(F.col("levels") > level).groupBy("tree", F.floor(F.col("index") / FAN).cast("long").alias("run"))
        run = written(run.agg(F.first("levels").alias("levels"), F.sort_array(F.collect_list(F.struct(
            F.pmod("index", F.lit(FAN)).cast("int").alias("pos"), "index", "digest"))).alias("children")), f"level-{level}")
        up = F.when(F.col("levels") == level + 1, above).otherwise(_node(F.col("tree"), F.lit(level + 1), F.col("run")))
        subroot = F.col("c")["digest"] if sub and level == 0 else F.lit(None).cast("string")
        links.append(run.select("tree", "children", up.alias("up"), F.explode("children").alias("c")).select(
            _node(F.col("tree"), F.lit(level), F.col("c")["index"]).alias("node"), "up",
            F.array(_siblings(F.col("children"), F.col("c"))).alias("segment"), subroot.alias("subroot")))
        nodes = run.select("tree", F.col("run").alias("index"), _hash(F.transform("children", lambda o: o["digest"])).alias("digest"), "levels")
        level += 1


def _jump(links: DataFrame) -> DataFrame:
    """Pointer jumping: ``links`` with every pointer at the root (null)."""
    hops = written(links, "links")
    while True:
        aimed = hops.where("up is not null").select("up").distinct()
        few = aimed.limit(NODES + 1).count()
        if not few:
            return hops
        ahead = hops.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("segment").alias("segment2"), F.col("subroot").alias("subroot2"))
        if few <= NODES:                                                     # few nodes that very many may point at
            ahead = F.broadcast(ahead.join(F.broadcast(aimed), "up", "left_semi"))
        hops = written(hops.join(ahead, "up", "left").select(
            "node", F.col("up2").alias("up"), F.when(F.col("segment2").isNull(), F.col("segment"))
            .otherwise(F.concat("segment", "segment2")).alias("segment"), F.coalesce("subroot", "subroot2").alias("subroot")), "hops")


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
          carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, carried columns) of every row of ``docs``.  ``proof`` lists, from
    the leaf's run up to the root's, the digests left and right of the way, each joined to a text."""
    spark, carry = docs.sparkSession, carry or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))      # null sorts first
    leaves = written(docs.select(F.col(id_col).alias("id"), group.alias("group"), leaf_digest(fields).alias("digest"),
                                 F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carried")), "leaves")
    trees = leaves.groupBy("group").agg(F.count("*").alias("n"))
    trees = _ranked(trees.withColumn("_all", F.lit(0)), "_all", ["group"]).select(
        "group", F.col("rank").alias("tree"), F.col("total").alias("trees"), _levels(F.col("n")).alias("levels"))
    trees = written(trees, "trees")
    size = trees.agg(F.max("trees").alias("n"), F.max("levels").alias("levels")).first()
    if size["n"] is None:
        return leaves.select("id", F.col("digest").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"),
                             F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))).alias("proof"),
                             *[F.col("carried")[n].alias(n) for n in carry]).limit(0)
    ranked = _ranked(leaves, "group", ["id", "digest"], lambda pieces: pieces.join(trees, "group"))
    runs = ranked.groupBy("tree", F.floor(F.col("rank") / FAN).cast("long").alias("run")).agg(
        F.first("levels").alias("levels"), F.sort_array(F.collect_list(F.struct(
            F.pmod("rank", F.lit(FAN)).cast("int").alias("pos"), "digest", "id", "carried"))).alias("children"))
    runs = written(runs, "runs")
    # A tree's top is a leaf of the tree over all groups; a single tree's top is the root itself.
    above = _node(F.lit(-1), F.lit(0), F.col("tree")) if size["n"] > 1 else F.lit(None).cast("struct<tree:bigint,level:int,index:bigint>")
    first = runs.where("levels > 0").select("tree", F.col("run").alias("index"), _hash(F.transform("children", lambda c: c["digest"])).alias("digest"), "levels")
    links, subroots = _climb(first, 1, size["levels"], False, above)
    lone = runs.where("levels = 0").select("tree", F.col("children")[0]["digest"].alias("digest"))
    subroots = written(subroots.unionByName(lone), "subroots")
    over = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("index"), "digest",
                           _levels(F.lit(size["n"])).alias("levels"))
    top = _levels_of(size["n"])
    more, tops = _climb(over, 0, top, True, F.lit(None).cast("struct<tree:bigint,level:int,index:bigint>"))
    root = tops.first()["digest"]
    links = links + more
    up = F.when(F.col("levels") <= 1, above).otherwise(_node(F.col("tree"), F.lit(1), F.col("run")))
    runs = runs.withColumn("up", up)
    if links:
        every = links[0]
        for part in links[1:]:
            every = every.unionByName(part)
        way = _jump(every).select(F.col("node").alias("up"), "segment", "subroot")
        runs = runs.join(way, "up", "left")
    else:
        runs = runs.withColumn("segment", F.lit(None)).withColumn("subroot", F.lit(None).cast("string"))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    rest = F.coalesce(F.col("segment").cast("array<struct<left:string,right:string>>"), empty)
    opened = runs.select("levels", "children", rest.alias("rest"), "subroot", F.explode("children").alias("c"))
    own = F.when(F.col("levels") > 0, F.array(_siblings(F.col("children"), F.col("c")))).otherwise(empty)
    return opened.select(F.col("c")["id"].alias("id"), F.col("c")["digest"].alias("leaf"), F.coalesce("subroot", F.lit(root)).alias("subroot"),
                         F.lit(root).alias("root"), F.concat(own, "rest").alias("proof"), *[F.col("c")["carried"][n].alias(n) for n in carry])


def _levels_of(n: int) -> int:
    return 0 if n <= 1 else 1 + sum(p < n for p in _POWERS)
