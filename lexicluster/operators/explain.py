"""Cluster explanation: important words and their semantic compactness (EVAL-6…12, TOP-5,
WIN-6/7 compositions).

Word lists are per cluster and bounded by the list length k.  Summed cosines use the identity
Σ_j cos(x_i, x_j) = x̂_i · Σ_j x̂_j, so no operator emits all pairs of a list; the nearest-neighbour
score needs a per-list k×k product, done per cluster on at most k rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import relative_position
from ..functions.vectors import dot, l2_normalize
from ..session import checkpoint
from .aggregates import cluster_word_frequency, describe_values
from .windows import top_k_per_group


def _cluster_vector(df: DataFrame, col: str, how: str, cluster_col: str = "cluster") -> DataFrame:
    v = df.select(cluster_col, array_to_vector(F.col(col)).alias("_v"))
    agg = getattr(Summarizer, how)(F.col("_v"))
    return v.groupBy(cluster_col).agg(agg.alias("_c")).select(cluster_col, vector_to_array("_c").alias("_center"))


def compactness_centroid(words: DataFrame, normalized: bool = False, cluster_col: str = "cluster",
                         vec_col: str = "vec") -> DataFrame:
    """EVAL-6 (centre = mean of raw vectors) / EVAL-7 (centre = mean of normalised vectors):
    mean cosine of the words to the centre.  Centres are one row per cluster."""
    w = words.withColumn("_n", l2_normalize(vec_col))
    c = _cluster_vector(w, "_n" if normalized else vec_col, "mean", cluster_col)
    j = w.join(c, cluster_col).withColumn("_cn", l2_normalize("_center"))
    return j.groupBy(cluster_col).agg(F.avg(dot("_n", "_cn")).alias("compactness"))


def summed_cosines(words: DataFrame, cluster_col: str = "cluster", vec_col: str = "vec") -> DataFrame:
    """JOIN-11 re-aimed: per word, Σ_j cos(x_i, x_j) over its list (including itself) and the list
    size, from the list's sum of normalised vectors (no pair rows)."""
    w = words.withColumn("_n", l2_normalize(vec_col))
    s = _cluster_vector(w, "_n", "sum", cluster_col)
    n = w.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n_words"))
    return w.join(s, cluster_col).join(n, cluster_col).withColumn("sum_cos", dot("_n", "_center")).drop("_n", "_center")


def compactness_medoid(words: DataFrame, cluster_col: str = "cluster", vec_col: str = "vec") -> DataFrame:
    """EVAL-8: max_i (Σ_j cos_ij − 1) / (n − 1)."""
    s = summed_cosines(words, cluster_col, vec_col)
    return s.groupBy(cluster_col).agg(F.max((F.col("sum_cos") - 1) / (F.col("n_words") - 1)).alias("compactness"))


def medoid_of_words(words: DataFrame, cluster_col: str = "cluster", vec_col: str = "vec", word_col: str = "word") -> DataFrame:
    """TOP-5: the word with the greatest summed cosine to the others (ties → smallest word)."""
    s = summed_cosines(words, cluster_col, vec_col)
    best = s.groupBy(cluster_col).agg(F.max("sum_cos").alias("_best"))
    return (s.join(best, cluster_col).filter(F.col("sum_cos") == F.col("_best"))
             .groupBy(cluster_col).agg(F.min(word_col).alias("medoid")))


def compactness_nearest_neighbor(words: DataFrame, cluster_col: str = "cluster", vec_col: str = "vec", block: int = 1024) -> DataFrame:
    """EVAL-9: Σ_i max_{j≠i} cos_ij, per cluster on the vectors of its word list (bounded by the length
    of an explanation), ``block`` rows of the similarity matrix at a time."""
    ctype = dict(words.dtypes)[cluster_col]

    def nn(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.vstack(pdf[vec_col].to_numpy()).astype(float)
        X = X / np.linalg.norm(X, axis=1, keepdims=True)
        total = 0.0
        for at in range(0, len(X), block):
            S = X[at:at + block] @ X.T
            S[np.arange(len(S)), np.arange(at, at + len(S))] -= 2.0
            total += float(S.max(1).sum())
        return pd.DataFrame({cluster_col: [pdf[cluster_col].iloc[0]], "compactness": [total]})

    return words.select(cluster_col, vec_col).groupBy(cluster_col).applyInPandas(nn, f"{cluster_col} {ctype}, compactness double")


def explain_by_count(df: DataFrame, k: int, tokens_col: str = "tokens", cluster_col: str = "pred") -> DataFrame:
    """EVAL-11: AGG-6 then WIN-7: per cluster the k most frequent words (ties → word ascending)."""
    f = cluster_word_frequency(df, tokens_col, cluster_col)
    return top_k_per_group(f, ["cluster"], [F.col("count").desc(), F.col("word").asc()], k)


def explain_by_weight(df: DataFrame, k: int, vocab, tokens_col: str = "tokens", cluster_col: str = "pred") -> DataFrame:
    """EVAL-10: binary bag of words → multinomial logistic regression on the predicted clusters →
    per class the k terms with the largest |coefficient| (WIN-6)."""
    from .clustering import logistic_regression
    from .features import count_vectors
    # The regression passes over its rows several times: they are made of their tokens once.
    v = count_vectors(df, vocab, tokens_col, "counts", binary=True).select(cluster_col, "counts").persist()
    m = logistic_regression(v, "counts", cluster_col)
    v.unpersist()
    coef = m.coefficientMatrix.toArray()                 # classes × V on the driver (model-sized)
    spark = df.sparkSession
    rows = [(int(c), vocab.terms[j], float(coef[c, j])) for c in range(coef.shape[0]) for j in range(coef.shape[1])]
    w = spark.createDataFrame(rows, "cluster int, word string, weight double")
    return top_k_per_group(w, ["cluster"], [F.abs("weight").desc(), F.col("word").asc()], k)


def word_positions(docs: DataFrame, words: DataFrame, tokens_col: str = "toks", class_col: str = "label",
                   max_listed: int = 10_000) -> DataFrame:
    """FLT-5 + TXT-11: (class, word, position) for every document of the class whose tokens contain
    the word; the position is the word's first one, relative to the number of tokens.

    Positions are taken inside the row, so no token array leaves it.  Up to ``max_listed`` words go
    round as one list per class, and a row looks up only the words that it has; a longer list is
    joined with the first positions of each document's distinct tokens, both sides shuffled."""
    words = checkpoint(words.select(class_col, "word").distinct())
    toks = F.col(tokens_col)
    if words.count() <= max_listed:
        lists = F.broadcast(words.groupBy(class_col).agg(F.collect_list("word").alias("_words")))
        found = docs.select(class_col, toks.alias("_toks")).join(lists, class_col) \
            .withColumn("_found", F.array_intersect("_toks", "_words"))
        pairs = F.transform("_found", lambda w: F.struct(w.alias("word"), relative_position("_toks", w).alias("position")))
        return found.select(class_col, F.explode(pairs).alias("_p")).select(class_col, "_p.word", "_p.position")
    # Sorted by (token, place), the first of each token is its first position; the one-element array
    # binds the sorted tokens, so that they are sorted once a row.
    placed = F.array_sort(F.transform(toks, lambda t, i: F.struct(t.alias("word"), i.alias("place"))))
    firsts = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["word"] != x["word"])))[0]
    each = docs.select(class_col, F.size(toks).alias("_n"), F.explode(firsts).alias("_p")) \
        .select(class_col, F.col("_p.word").alias("word"), (F.col("_p.place") / F.col("_n")).alias("position"))
    return each.join(words.hint("merge"), [class_col, "word"])


def word_position_stats(docs: DataFrame, words: DataFrame, tokens_col: str = "toks", class_col: str = "label",
                        max_listed: int = 10_000) -> DataFrame:
    """EVAL-12: for each (class, word) the relative first positions of the word in the documents of the
    class that contain it → describe → drop incomplete rows."""
    from .filters import drop_incomplete_rows
    return drop_incomplete_rows(describe_values(word_positions(docs, words, tokens_col, class_col, max_listed), [class_col, "word"], "position"))
