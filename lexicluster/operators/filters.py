"""Projections, filters and predicates (PRJ-1…3, FLT-1…9)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def project_columns(df: DataFrame, cols) -> DataFrame:
    """PRJ-1: fixed column subset in fixed order (pruned down to the scan by Catalyst)."""
    return df.select(*cols)


def seed_mask_and_label(df: DataFrame, seeds: DataFrame, id_col: str = "id") -> DataFrame:
    """PRJ-2: per row a 0/1 seed mask and the seed label (0 when not seeded)."""
    s = seeds.select(F.col(id_col), F.col("label").alias("_seed_label"))
    j = df.join(s, id_col, "left")
    return (j.withColumn("mask", F.when(F.col("_seed_label").isNotNull(), 1).otherwise(0))
             .withColumn("seed_label", F.coalesce(F.col("_seed_label"), F.lit(0)))
             .drop("_seed_label"))


def override_with_seed(df: DataFrame, pred_col: str = "pred") -> DataFrame:
    """PRJ-3: seeded rows take their seed label as cluster."""
    return df.withColumn(pred_col, F.when(F.col("mask") == 1, F.col("seed_label")).otherwise(F.col(pred_col)))


def filter_cluster(df: DataFrame, i: int, pred_col: str = "pred") -> DataFrame:
    """FLT-1."""
    return df.filter(F.col(pred_col) == i)


def filter_vocab_tokens(df: DataFrame, tokens_col: str, vocab_words, out_col: str | None = None) -> DataFrame:
    """FLT-3 for a bounded vocabulary: row-local InSet filter, order and duplicates kept."""
    words = list(vocab_words)
    return df.withColumn(out_col or tokens_col, F.filter(F.col(tokens_col), lambda t: t.isin(words)))


def filter_vocab_tokens_join(df: DataFrame, doc_col: str, tokens_col: str, vocab: DataFrame,
                             word_col: str = "word") -> DataFrame:
    """FLT-3 for a vocabulary of any size: explode with positions, semi-join, regroup in order.
    Output: (doc, tokens) with only known tokens; documents with none keep an empty array."""
    ex = df.select(doc_col, F.posexplode(tokens_col).alias("pos", "tok"))
    kept = ex.join(vocab.select(F.col(word_col).alias("tok")), "tok", "left_semi")
    regrouped = kept.groupBy(doc_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]).alias("_kept"))
    return (df.join(regrouped, doc_col, "left")
              .withColumn(tokens_col, F.coalesce(F.col("_kept"), F.array().cast("array<string>")))
              .drop("_kept"))


def drop_empty_docs(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """FLT-4."""
    return df.filter(F.size(tokens_col) > 0)


def docs_containing_tokens(df: DataFrame, words: DataFrame, tokens_col: str,
                           word_col: str = "word") -> DataFrame:
    """FLT-5 for a list of words at once: whole-token equality (not substring) via one equi-join of each
    document's distinct tokens with the word list."""
    ex = df.withColumn("_tok", F.explode(F.array_distinct(F.col(tokens_col))))
    w = words.select(F.col(word_col).alias("_tok")).distinct()
    return ex.join(w, "_tok").withColumnRenamed("_tok", word_col)


def drop_incomplete_rows(df: DataFrame, cols=None) -> DataFrame:
    """FLT-6: drop rows with a null or NaN in any (listed) column."""
    cols = cols or df.columns
    cond = F.lit(True)
    for c in cols:
        dt = dict(df.dtypes)[c]
        ok = F.col(c).isNotNull()
        if dt in ("double", "float"):
            ok = ok & ~F.isnan(F.col(c))
        cond = cond & ok
    return df.filter(cond)


def mask_padding_vectors(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """FLT-7: keep token vectors with at least one positive component."""
    return df.filter(F.exists(F.col(vec_col), lambda x: x > 0))


def lookup_run(df: DataFrame, order_col: str = "run_id", **eq) -> DataFrame:
    """FLT-8: first run matching equality conditions (TakeOrdered, a one-row result)."""
    cond = F.lit(True)
    for k, v in eq.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond).orderBy(order_col).limit(1)


def filter_available_variants(grid: DataFrame, registry: DataFrame, keys) -> DataFrame:
    """FLT-9: keep sweep rows that have a trained network in the model registry."""
    return grid.join(registry.select(*keys).distinct(), list(keys), "left_semi")
