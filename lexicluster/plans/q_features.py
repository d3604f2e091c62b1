"""Queries: term statistics, vocabulary, count / binary / TF-IDF features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feats
from . import fixtures as fx
from .registry import register
from .sqlparts import corpus_cte, tokens_cte, with_

MAX_FEATURES = 2000


def _pairs_sql() -> str:
    return ("pairs AS (SELECT doc_id, term, count(*) AS tf FROM "
            "(SELECT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY doc_id, term)")


def _vocab_sql(n: int = MAX_FEATURES) -> str:
    return (f"stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM pairs GROUP BY term),\n"
            f"vocab AS (SELECT term, total, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx "
            f"FROM (SELECT * FROM stats ORDER BY total DESC, term LIMIT {n}))")


@register("term_counts", lambda: with_(corpus_cte(), tokens_cte(), _pairs_sql()) +
          "SELECT doc_id, term, tf FROM pairs")
def q_term_counts(spark, sf_dir):
    return feats.term_occurrences(fx.tokens(spark, sf_dir))


@register("document_frequency", lambda: with_(corpus_cte(), tokens_cte(), _pairs_sql()) +
          "SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df, (SELECT count(*) FROM corpus) AS n_docs "
          "FROM pairs GROUP BY term")
def q_document_frequency(spark, sf_dir):
    tok = fx.tokens(spark, sf_dir)
    n_docs = fx.corpus(spark, sf_dir).count()   # one scalar to the driver
    return feats.term_statistics(tok).withColumn("n_docs", F.lit(n_docs).cast("long"))


@register("top_vocabulary", lambda: with_(corpus_cte(), tokens_cte(), _pairs_sql(), _vocab_sql()) +
          "SELECT term, total, df, idx FROM vocab")
def q_top_vocabulary(spark, sf_dir):
    return feats.top_vocabulary(feats.term_statistics(fx.tokens(spark, sf_dir)), MAX_FEATURES)


@register("distinct_vocabulary", lambda: with_(corpus_cte(), tokens_cte()) +
          "SELECT DISTINCT word FROM (SELECT unnest(tokens) AS word FROM tokens "
          "UNION ALL SELECT '<s>' UNION ALL SELECT '</s>')")
def q_distinct_vocabulary(spark, sf_dir):
    return feats.distinct_vocabulary(fx.tokens(spark, sf_dir))


def _tfidf_sql() -> str:
    return (with_(corpus_cte(), tokens_cte(), _pairs_sql(), _vocab_sql(),
                  "w AS (SELECT p.doc_id, p.term, p.tf, p.tf * (ln((1.0 + (SELECT count(*) FROM corpus)) "
                  "/ (1.0 + v.df)) + 1.0) AS raw FROM pairs p JOIN vocab v USING (term))")
            + "SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w")


@register("tfidf_features", _tfidf_sql)
def q_tfidf(spark, sf_dir):
    out = feats.tfidf_long(fx.tokens(spark, sf_dir), MAX_FEATURES)
    return out.withColumn("tfidf", F.round("tfidf", 6))


def _count_sql(binary: bool) -> str:
    val = "CAST(1 AS DOUBLE)" if binary else "CAST(tf AS DOUBLE)"
    return (with_(corpus_cte(), tokens_cte(), _pairs_sql(), _vocab_sql())
            + f"SELECT p.doc_id, v.idx, p.term, {val} AS value FROM pairs p JOIN vocab v USING (term)")


def _count_query(spark, sf_dir, binary):
    tok = fx.tokens(spark, sf_dir)
    vocab = feats.fit_vocabulary(tok, MAX_FEATURES)
    return feats.count_long(tok, vocab, binary=binary)


@register("count_features", lambda: _count_sql(False))
def q_count_features(spark, sf_dir):
    return _count_query(spark, sf_dir, False)


@register("binary_features", lambda: _count_sql(True))
def q_binary_features(spark, sf_dir):
    return _count_query(spark, sf_dir, True)
