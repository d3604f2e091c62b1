"""Document features: term statistics, vocabulary, count / binary / TF-IDF vectors
(AGG-3, AGG-4, AGG-5, TOP-1, ML-1, ML-2, ML-3).

Plan shape.  Term statistics are one aggregation keyed by term with map-side combine, so a
term that holds a third of all tokens is pre-reduced in every task.  The vocabulary is bounded
by ``max_features`` and is the only thing that reaches the driver.  Per-document vectors are
built row-locally, without a shuffle: as ML vectors by ``CountVectorizerModel`` and JVM transformers,
as sparse cells by one vectorised lookup of all tokens of an Arrow batch.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def term_occurrences(df: DataFrame, doc_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """AGG-3 (long form): (doc, term, tf).  Pairs of one document are already in one task, so the
    partial aggregate is final and only distinct pairs are shuffled."""
    return (df.select(doc_col, F.explode(tokens_col).alias("term"))
              .groupBy(doc_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def term_statistics(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """AGG-4 + total counts: (term, total, df) in one aggregation.  Each token contributes to the
    total, each distinct token of a document to the document frequency; no (doc, term) shuffle."""
    occ = F.transform(F.col(tokens_col), lambda t: F.struct(t.alias("term"), F.lit(1).alias("o"), F.lit(0).alias("d")))
    dis = F.transform(F.array_distinct(F.col(tokens_col)),
                      lambda t: F.struct(t.alias("term"), F.lit(0).alias("o"), F.lit(1).alias("d")))
    return (df.select(F.explode(F.concat(occ, dis)).alias("e"))
              .groupBy(F.col("e.term").alias("term"))
              .agg(F.sum("e.o").cast("long").alias("total"), F.sum("e.d").cast("long").alias("df")))


def distinct_vocabulary(df: DataFrame, tokens_col: str = "tokens", sentinels=("<s>", "</s>")) -> DataFrame:
    """AGG-5: distinct words of the corpus plus sentence sentinels."""
    words = df.select(F.explode(tokens_col).alias("word")).distinct()
    if sentinels:
        spark = df.sparkSession
        words = words.unionByName(spark.createDataFrame([(s,) for s in sentinels], "word string")).distinct()
    return words


def top_vocabulary(stats: DataFrame, max_features: int) -> DataFrame:
    """TOP-1: the ``max_features`` terms with the highest total count (ties: term ascending);
    ``idx`` = alphabetical rank among the kept terms.  Plans as TakeOrderedAndProject (per-task
    top-n, then one bounded merge)."""
    top = stats.orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features)
    # bounded by max_features rows: a global window over it is one small task
    from pyspark.sql.window import Window
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


@dataclass
class Vocabulary:
    terms: list[str]          # alphabetical; position = column index
    df: list[int]
    total: list[int]
    n_docs: int

    def idf(self) -> list[float]:
        """Smoothed IDF with the +1 of the reference's vectoriser: ln((1+N)/(1+df)) + 1."""
        return [math.log((1.0 + self.n_docs) / (1.0 + d)) + 1.0 for d in self.df]


def fit_vocabulary(df: DataFrame, max_features: int, tokens_col: str = "tokens") -> Vocabulary:
    """Distributed statistics → bounded vocabulary on the driver (≤ max_features rows).  The tasks count the
    terms of slices of Arrow batches, so only distinct terms are aggregated.  The number of documents comes
    from the same pass, as the document frequency of a null term."""
    def counted(batches):
        for b in (part for whole in batches for part in token_slices(whole, 0, COUNTED_TOKENS)):
            lens = pc.fill_null(pc.list_value_length(b.column(0)), 0).to_numpy(zero_copy_only=False)
            coded = b.column(0).flatten().dictionary_encode()
            known, n = coded.indices.is_valid().to_numpy(zero_copy_only=False), len(coded.dictionary)
            code = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            pairs = np.unique(np.repeat(np.arange(len(lens)), lens)[known] * max(1, n) + code) % max(1, n)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]),
                                              pa.array(np.append(np.bincount(code, minlength=n), 0)),
                                              pa.array(np.append(np.bincount(pairs, minlength=n), b.num_rows))], names=["term", "total", "df"])

    stats = checkpoint(df.select(tokens_col).mapInArrow(counted, "term string, total long, df long")
                       .groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")))
    n_docs = (stats.where("term IS NULL").first() or {"df": 0})["df"]
    rows = top_vocabulary(stats.where("term IS NOT NULL"), max_features).orderBy("idx").collect()
    return Vocabulary([r["term"] for r in rows], [r["df"] for r in rows],
                      [r["total"] for r in rows], n_docs)


def count_vectors(df: DataFrame, vocab: Vocabulary, tokens_col: str = "tokens",
                  out_col: str = "counts", binary: bool = False) -> DataFrame:
    """ML-1 / ML-2: bag of words over the vocabulary as a SparseVector (row-local)."""
    m = CountVectorizerModel.from_vocabulary(vocab.terms, inputCol=tokens_col, outputCol=out_col)
    m.setBinary(binary)
    return m.transform(df)


def tfidf_vectors(df: DataFrame, vocab: Vocabulary, tokens_col: str = "tokens",
                  out_col: str = "features", normalize: bool = True) -> DataFrame:
    """ML-3: tf·(ln((1+N)/(1+df))+1), then L2 row normalisation, all JVM transformers."""
    cv = count_vectors(df, vocab, tokens_col, "_tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense(vocab.idf()), inputCol="_tf",
                            outputCol="_tfidf" if normalize else out_col)
    out = ep.transform(cv)
    if normalize:
        out = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out_col).transform(out).drop("_tfidf")
    return out.drop("_tf")


def vocabulary_cells(tokens, terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, count) of the non-zero cells of an Arrow batch of token lists, by row and index."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    lens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    at = pc.index_in(tokens.flatten(), value_set=terms)
    row = np.repeat(np.arange(len(tokens)), lens)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    cell, n = np.unique(row[known] * max(1, len(terms)) + pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64), return_counts=True)
    return cell // max(1, len(terms)), cell % max(1, len(terms)), n


#: Tokens of a slice of an Arrow batch: 10,000 long documents at once would fill a worker's memory.
SLICE_TOKENS = 1 << 18
#: Tokens whose terms are counted together.
COUNTED_TOKENS = 1 << 20


def token_slices(batch, at: int, tokens: int | None = None):
    """The batch in slices of some ``tokens`` (``SLICE_TOKENS``) tokens of its column ``at``, a whole document at least."""
    lens = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lens, dtype=np.int64) // (tokens or SLICE_TOKENS)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def _cells(df: DataFrame, vocab: Vocabulary, keep, tokens_col: str, schema: str, fn) -> DataFrame:
    """``fn(batch, row, index, count)`` gives the columns of ``schema`` for each Arrow batch; the tokens
    of a batch are looked up in the vocabulary in one vectorised pass."""
    keep, terms = list(keep), list(vocab.terms)
    sub = df.select(*keep, tokens_col)
    kinds = dict(sub.dtypes)
    names = [*keep, *[f.split()[0] for f in schema.split(", ")]]

    def run(batches):
        listed = None
        for b in (part for whole in batches for part in token_slices(whole, len(keep))):
            col = b.column(len(keep))
            if listed is None:
                listed = pa.array(terms, col.type.value_type)
            out = fn(b, *vocabulary_cells(col, listed), listed)
            yield pa.RecordBatch.from_arrays(out, names=names)

    return sub.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema]))


def count_long(df: DataFrame, vocab: Vocabulary, tokens_col: str = "tokens", keep=("doc_id",), binary: bool = False) -> DataFrame:
    """ML-1 / ML-2 in long form: (doc, idx, term, value) of the non-zero cells."""
    def rows(b, row, idx, n, listed):
        take = pa.array(row)
        return [*(b.column(i).take(take) for i in range(b.num_columns - 1)), pa.array(idx.astype(np.int32)), listed.take(pa.array(idx)),
                pa.array(np.ones(len(n)) if binary else n.astype(np.float64))]
    return _cells(df, vocab, keep, tokens_col, "idx int, term string, value double", rows)


def _tfidf(row, idx, n, idf, n_rows):
    raw = n * idf[idx]
    norm = np.sqrt(np.bincount(row, raw * raw, minlength=n_rows))
    return raw / norm[row]


def tfidf_long(df: DataFrame, max_features: int = 2000, tokens_col: str = "tokens", doc_col: str = "doc_id") -> DataFrame:
    """ML-3 in long form: (doc_id, term, tf, tfidf) of the non-zero cells."""
    vocab = fit_vocabulary(df, max_features, tokens_col)
    idf = np.array(vocab.idf())

    def rows(b, row, idx, n, listed):
        return [b.column(0).take(pa.array(row)), listed.take(pa.array(idx)), pa.array(n), pa.array(_tfidf(row, idx, n, idf, b.num_rows))]
    return _cells(df, vocab, [doc_col], tokens_col, "term string, tf bigint, tfidf double", rows)


def tfidf_sparse(df: DataFrame, vocab: Vocabulary, keep=("doc_id",), tokens_col: str = "tokens") -> DataFrame:
    """ML-3 as rows (keep…, idx, val): the indices and values of a document's non-zero cells."""
    idf = np.array(vocab.idf())

    def rows(b, row, idx, n, listed):
        cuts = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
        val = _tfidf(row, idx, n, idf, b.num_rows)
        return [*b.columns[:-1], pa.ListArray.from_arrays(cuts, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(val))]
    return _cells(df, vocab, keep, tokens_col, "idx array<int>, val array<double>", rows)


def word_indices(df: DataFrame, vocab: Vocabulary, keep=("doc_id",), tokens_col: str = "tokens", out_col: str = "words") -> DataFrame:
    """Rows (keep…, words): the vocabulary indices of a document's known tokens, repeats included, in
    index order."""
    def rows(b, row, idx, n, listed):
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, n, minlength=b.num_rows))]).astype(np.int32)
        return [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.repeat(idx, n).astype(np.int32)))]
    return _cells(df, vocab, keep, tokens_col, f"{out_col} array<int>", rows)
