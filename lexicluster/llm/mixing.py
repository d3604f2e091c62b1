"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants target / size copies.  The whole part is taken; the rest is a
probability.  Two documents with fractional probabilities trade words at random until one of them
is integral: the trade keeps the words the pair takes, and each probability in expectation.  The
trades run inside groups of some thousand documents of a source, the one document that a group
leaves over goes on to the next level of a reduction tree, and the last one is drawn.

Groups and draws come from hashes of the rows alone, so reruns and other partitionings agree.

Defined results: a null or empty text has size 0 and takes 0; a null source is one source, the
last; rows that agree in id, source and size are one unit and take the same number of copies; an
empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS, MOST_COPIES, GROUP_ROWS, FAN_IN = (5, 2, 1), 3, 4096, 64


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): words of every text."""
    return docs.select(*_key(id_col, text_col, source_col))


def _key(id_col: str, text_col: str, source_col: str) -> list[Column]:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0))
    return [F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
            size.cast("long").alias("size")]


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, units, target): the sources' shares of all words.  A share stops at
    ``most`` times its source's size; the excess is shared again until no share is above."""
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    # Ranks by code point, null last: places inside the sorted partitions plus what lies before.
    s = written(s.orderBy(F.col("source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("at")), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)    # one row a partition
    parts = s.groupBy(part.alias("part")).agg(F.count("*").alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    s = s.withColumn("part", part).join(F.broadcast(parts), "part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place + F.col("before")) % len(weights) + 1).cast("int"))
    s = written(s.select("source", "source_size", "units", weight.alias("weight")), "weights")
    cap = F.col("source_size") * float(most)
    level, last = 0.0, None
    while level != last:
        last = level
        above = F.col("weight") * level > cap
        r = s.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("capped"),
                  F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if not r["w"]:
            break
        level = (float(r["all"]) - r["capped"]) / r["w"]
    return s.select("source", "source_size", "units", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _uniform(seed: int, *keys) -> np.random.Generator:
    return np.random.default_rng([seed, *[int(k) & 0xFFFFFFFFFFFFFFFF for k in keys]])


def _rounding(seed: int, level: int, last: bool):
    return lambda pdf: _round_group(pdf, seed, level, last)


def _round_group(pdf: pd.DataFrame, seed: int, level: int, last: bool) -> pd.DataFrame:
    """Trades among the rows of one group; at most one stays fractional."""
    pdf = pdf.sort_values(["words", "h", "id"], ascending=[False, True, True], kind="stable")
    p, u = pdf["p"].to_numpy(np.float64).copy(), pdf["words"].to_numpy(np.float64)
    draw = _uniform(seed, level, pdf["h"].iloc[0]).random(len(p) + 1)
    open_ = -1
    for j in np.flatnonzero((p > 0) & (p < 1)):
        if open_ < 0:
            open_ = j
            continue
        i = open_
        up = min((1 - p[i]) * u[i], p[j] * u[j])                 # words that may move from j to i
        down = min(p[i] * u[i], (1 - p[j]) * u[j])               # words that may move from i to j
        if draw[j] * (up + down) < down:
            p[i], p[j] = p[i] + up / u[i], p[j] - up / u[j]
        else:
            p[i], p[j] = p[i] - down / u[i], p[j] + down / u[j]
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        left = [k for k in (i, j) if 0 < p[k] < 1]
        open_ = left[0] if left else -1
        if len(left) == 2:                                       # numerically both still open
            p[left[1]] = float(draw[-1] < p[left[1]])
    if last and open_ >= 0:
        p[open_] = float(draw[-1] < p[open_])
    pdf["p"] = p
    return pdf


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 20240607,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, m, source_size, target, copies): a row per unit, ``m`` its input rows."""
    units = written(sizes(docs, id_col, text_col, source_col).groupBy("id", "source", "size").agg(F.count("*").alias("m")), "units")
    t = targets(units, weights, most).withColumn("groups", F.ceil(F.col("units") / GROUP_ROWS))
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round("want", 9)
    d = units.join(t, units.source.eqNullSafe(t.source)).drop(t.source).withColumn("want", want)
    d = d.withColumn("want", F.when((F.col("size") == 0), F.lit(0.0)).when(F.abs(near - F.round("want")) < 1e-8, F.round("want")).otherwise(F.col("want")))
    h = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "size", F.lit(seed))
    d = d.select("id", "source", "size", "m", "source_size", "target", F.floor("want").cast("long").alias("whole"),
                 (F.col("want") - F.floor("want")).alias("p"), (F.col("size") * F.col("m")).alias("words"), h.alias("h"),
                 F.pmod(h, F.col("groups")).alias("g"), "groups")
    done, level, rest = [], 0, d
    deepest = t.agg(F.coalesce(F.max("groups"), F.lit(1)).alias("g")).first()["g"]
    while True:
        last = deepest <= FAN_IN ** level
        out = rest.groupBy("source", "g").applyInPandas(_rounding(seed, level, last), d.schema)
        out = written(out, f"rounded-{level}")
        done.append(out if last else out.where("p = 0 OR p = 1"))
        if last:
            break
        rest = out.where("p > 0 AND p < 1").withColumn("g", F.floor(F.col("g") / FAN_IN).cast("long"))
        level += 1
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every.select("id", "source", "size", "m", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0") \
        .select("id", "source", "size", "copies")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*_key(id_col, text_col, source_col)).alias("key"))
    same = [row["key"][c].eqNullSafe(taken[c]) for c in ("id", "source", "size")]
    return row.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
