"""Derived fixtures computed from the driver tables by Spark (the same rules appear as SQL CTEs
in ``oracle.py``).  Every fixture is a lazy DataFrame over the given parquet tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LANG_LABELS
from ..functions.text import vectorizer_tokens
from ..session import checkpoint, spread, table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label (alphabetical rank of lang), text."""
    m = F.create_map(*[x for k, v in sorted(LANG_LABELS.items()) for x in (F.lit(k), F.lit(v))])
    return (table(spark, sf_dir, "documents")
            .select("doc_id", F.element_at(m, F.col("lang")).cast("int").alias("label"), "text"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, tokens: vectoriser tokens minus stop words."""
    return corpus(spark, sf_dir).select("doc_id", "label", vectorizer_tokens("text").alias("tokens"))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x ARRAY<DOUBLE> from embeddings (FLOAT → DOUBLE first)."""
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def shuffle_key(id_col: str, seed: int = 42):
    """Reproducible pseudo-random order key, same digest in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


# ------------------------------------------------------------------ embedding fixtures

N_LABELS = 10


def fixed_centers(spark: SparkSession, sf_dir: str, max_label: int = N_LABELS) -> list[list[float]]:
    """Per-label mean of feat for labels < max_label (K×D, collected: bounded by K·D)."""
    from ..operators.clustering import centers_to_list, label_centroids
    f = feat(spark, sf_dir).filter(F.col("label") < max_label)
    return centers_to_list(label_centroids(f, max_label), max_label)


def pred(spark: SparkSession, sf_dir: str, max_label: int = N_LABELS) -> DataFrame:
    """feat (labels < max_label) with pred = nearest fixed centre (ties → lowest id)."""
    from ..operators.clustering import assign_nearest
    f = feat(spark, sf_dir).filter(F.col("label") < max_label)
    return assign_nearest(f, fixed_centers(spark, sf_dir, max_label), "x", "pred")


def trial_centers(spark: SparkSession, sf_dir: str, k: int, n_trials: int = 10, max_label: int | None = None):
    """Trial t uses the embeddings ranked t·k+1 … (t+1)·k in shuffle order as centres.
    TakeOrdered of n_trials·k rows (bounded by the parameters)."""
    f = feat(spark, sf_dir)
    if max_label is not None:
        f = f.filter(F.col("label") < max_label)
    rows = (f.select(shuffle_key("vec_id").alias("h"), "vec_id", "x")
             .orderBy("h", "vec_id").limit(n_trials * k).collect())
    return [[list(rows[t * k + j]["x"]) for j in range(k)] for t in range(n_trials)]


def trials(spark: SparkSession, sf_dir: str, k: int = 10, n_trials: int = 10, max_label: int | None = None) -> DataFrame:
    """(trial, vec_id, label, pred): each row assigned to the nearest centre of every trial.
    The trial index is a small generated column (bounded by n_trials), not a join."""
    from ..functions.vectors import nearest_center
    from ..operators.common import literal_matrix
    cs = trial_centers(spark, sf_dir, k, n_trials, max_label)
    allc = F.array(*[literal_matrix(c) for c in cs])
    f = feat(spark, sf_dir)
    if max_label is not None:
        f = f.filter(F.col("label") < max_label)
    t = f.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))
    return t.select("trial", "vec_id", "label",
                    nearest_center(F.col("x"), F.element_at(allc, F.col("trial") + 1))["center_id"].cast("int").alias("pred"))


# ------------------------------------------------------------------ word-vector fixtures

VOCAB_SIZE = 2000


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, idx, vec): vocabulary rank r joined to embeddings on vec_id = r mod count(embeddings)."""
    from ..operators import features as feats
    vocab = feats.top_vocabulary(feats.term_statistics(tokens(spark, sf_dir)), VOCAB_SIZE)
    emb = feat(spark, sf_dir)
    n = emb.count()
    # At most VOCAB_SIZE rows, computed once however often they are used.
    return checkpoint(vocab.join(emb.select("vec_id", "x"), F.col("vec_id") == F.col("idx") % F.lit(n))
                      .select(F.col("term").alias("word"), "idx", F.col("x").alias("vec")))


def together(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents spread by their id and sorted, so that the rows made of a document stay together, also
    where an id comes twice.  The texts are shuffled here, once, instead of what is made of them."""
    return docs.repartition(id_col).sortWithinPartitions(id_col)


def token_rows(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """(doc_id, label, pos, token) from the vectoriser tokens; ``by_document``: a document's rows together."""
    docs = corpus(spark, sf_dir)
    docs = together(docs) if by_document else docs
    return docs.select("doc_id", "label", F.posexplode(vectorizer_tokens("text")).alias("pos", "token"))


def cluster_words(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(cluster, word, count, rank, vec): per label the k most frequent tokens that have a vector."""
    from ..operators.windows import top_k_per_group
    wv = word_vectors(spark, sf_dir)
    t = token_rows(spark, sf_dir).join(F.broadcast(wv.select(F.col("word").alias("token"))), "token", "left_semi")
    c = t.groupBy(F.col("label").alias("cluster"), F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("count"))
    top = top_k_per_group(c, ["cluster"], [F.col("count").desc(), F.col("word").asc()], k)
    return checkpoint(top.join(F.broadcast(wv.select("word", "vec")), "word"))          # k words a cluster


def explain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, toks, tokens): whitespace tokens, and the same minus stop words / punctuation."""
    from ..constants import PUNCTUATION, english_stop_words
    from ..functions.text import remove_words, whitespace_tokens
    c = corpus(spark, sf_dir).select("doc_id", "label", whitespace_tokens("text").alias("toks"))
    return c.withColumn("tokens", remove_words("toks", list(english_stop_words()) + list(PUNCTUATION)))
