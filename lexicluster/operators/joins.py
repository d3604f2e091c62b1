"""Joins (JOIN-1…6, JOIN-9…12) and vocabulary set operations (SET-1…3)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def constraint_pair_features(pairs: DataFrame, feat: DataFrame, id_col: str = "id", x_col: str = "x") -> DataFrame:
    """JOIN-1: (id1, id2) → both feature vectors (two equi-joins)."""
    f = feat.select(F.col(id_col), F.col(x_col))
    return (pairs.join(f.withColumnRenamed(id_col, "id1").withColumnRenamed(x_col, "x1"), "id1")
                 .join(f.withColumnRenamed(id_col, "id2").withColumnRenamed(x_col, "x2"), "id2"))


def seed_features(feat: DataFrame, seeds: DataFrame, id_col: str = "id") -> DataFrame:
    """JOIN-2: features of the seed rows."""
    return feat.join(seeds, id_col)


def known_tokens(tokens: DataFrame, word_vectors: DataFrame, token_col: str = "token") -> DataFrame:
    """JOIN-3: token rows that have a word vector (left semi-join)."""
    wv = word_vectors.select(F.col("word").alias(token_col))
    return tokens.join(wv, token_col, "left_semi")


def new_vocabulary(asked: DataFrame, known: DataFrame, word_col: str = "word") -> DataFrame:
    """JOIN-4 / SET-2: asked words that are not yet known (anti-join on distinct words)."""
    return asked.select(word_col).distinct().join(known.select(word_col), word_col, "left_anti")


def vocab_except(asked: DataFrame, known: DataFrame, word_col: str = "word") -> DataFrame:
    """SET-2: distinct asked words minus known words (EXCEPT DISTINCT)."""
    return asked.select(word_col).subtract(known.select(word_col))


def vocab_union(known: DataFrame, new: DataFrame, word_col: str = "word", sentinels=("<s>", "</s>")) -> DataFrame:
    """SET-1: known ∪ new ∪ sentinels, one row per word; on a clash the new entry wins."""
    spark = known.sparkSession
    parts = [known.select(word_col).withColumn("_prio", F.lit(1)).withColumn("origin", F.lit("known")),
             new.select(word_col).withColumn("_prio", F.lit(0)).withColumn("origin", F.lit("new"))]
    if sentinels:
        parts.append(spark.createDataFrame([(s,) for s in sentinels], f"{word_col} string")
                     .withColumn("_prio", F.lit(2)).withColumn("origin", F.lit("sentinel")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    best = u.groupBy(word_col).agg(F.min(F.struct("_prio", "origin")).alias("_b"))
    return best.select(word_col, F.col("_b.origin").alias("origin"))


def vocab_intersect(asked: DataFrame, available: DataFrame, word_col: str = "word") -> DataFrame:
    """SET-3: asked ∩ available (distinct)."""
    return asked.select(word_col).intersect(available.select(word_col))


def token_vectors(tokens: DataFrame, word_vectors: DataFrame, token_col: str = "token", max_broadcast: int = 20_000) -> DataFrame:
    """JOIN-5: token → vector, position kept.  A word table of at most ``max_broadcast`` words is
    broadcast; a larger one is joined by a shuffle, where AQE splits frequent words."""
    wv = word_vectors.select(F.col("word").alias(token_col), F.col("vec"))
    few = wv.limit(max_broadcast + 1).count() <= max_broadcast
    return tokens.join(F.broadcast(wv) if few else wv.hint("merge"), token_col)


def feature_word_vectors(words: DataFrame, word_vectors: DataFrame, word_col: str = "word") -> DataFrame:
    """JOIN-6: vectors of listed words; raises if any listed word has none (completeness guard)."""
    missing = words.select(word_col).join(word_vectors.select(word_col), word_col, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no vector for word {missing[0][0]!r}")
    return words.join(word_vectors, word_col)


def align_predictions(preds: DataFrame, labels: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """JOIN-9: predictions, labels and texts aligned by id (never by position)."""
    return preds.join(labels, id_col).join(texts, id_col)


def batch_target_lookup(batch_ids: DataFrame, targets: DataFrame, id_col: str = "id") -> DataFrame:
    """JOIN-10: each batch row's stored target distribution."""
    return batch_ids.join(targets, id_col)
