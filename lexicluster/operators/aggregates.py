"""Aggregations over documents, tokens and vectors (AGG-2, AGG-6, AGG-8, AGG-13…15, AGG-17)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import prefix_scan


def group_ids(df: DataFrame, label_col: str = "label", id_col: str = "id") -> DataFrame:
    """AGG-2 in long form: (label, id, pos) with pos the id's rank inside its label (a distributed
    prefix scan, so a label with a third of the rows is not ranked in one task).  Fails if the
    labels are not contiguous 0..max."""
    st = df.agg(F.countDistinct(label_col).alias("n"), F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).first()
    if st["n"] and (st["lo"] != 0 or st["hi"] != st["n"] - 1):
        raise ValueError("labels are not contiguous from 0")
    out = prefix_scan(df.select(label_col, id_col).withColumn("_one", F.lit(1.0)), [label_col], [id_col], ["_one"], ["_pos"])
    return out.select(label_col, id_col, (F.col("_pos") - 1).cast("long").alias("pos"))


def cluster_word_frequency(df: DataFrame, tokens_col: str = "tokens", cluster_col: str = "pred") -> DataFrame:
    """AGG-6: (cluster, word, count) — explode + partial/final hash aggregate."""
    return (df.select(F.col(cluster_col).alias("cluster"), F.explode(tokens_col).alias("word"))
              .groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("count")))


def exact_quantiles(df: DataFrame, group_cols, value_col: str, qs, prefix: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles per group without sorting a group in one task: value
    histogram (aggregate), cumulative counts by a distributed prefix scan, then the values at
    ranks ⌊q(n−1)⌋ and ⌈q(n−1)⌉ by conditional minima."""
    group_cols = list(group_cols)
    hist = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    cum = prefix_scan(hist, group_cols, [value_col], ["_c"], ["_cum"])
    tot = hist.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
    j = cum.join(tot, group_cols)
    aggs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("_cum") > lo, F.col(value_col))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_cum") > hi, F.col(value_col))).alias(f"_hi{i}"),
                 F.first(pos - lo).alias(f"_fr{i}")]
    r = j.groupBy(*group_cols).agg(*aggs)
    return r.select(*group_cols, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}"))
                                   .alias(f"{prefix}{int(round(q * 100))}") for i, q in enumerate(qs)])


def describe_values(df: DataFrame, group_cols, value_col: str) -> DataFrame:
    """AGG-8: count, mean, sample std, min, 25/50/75 % (linear interpolation), max per group."""
    group_cols = list(group_cols)
    base = df.groupBy(*group_cols).agg(
        F.count(value_col).cast("double").alias("count"), F.avg(value_col).alias("mean"),
        F.stddev_samp(value_col).alias("std"), F.min(value_col).alias("min"), F.max(value_col).alias("max"))
    q = exact_quantiles(df.filter(F.col(value_col).isNotNull()), group_cols, value_col, [0.25, 0.5, 0.75], "p")
    return base.join(q, group_cols).withColumnsRenamed({"p25": "25%", "p50": "50%", "p75": "75%"})


# ---------------------------------------------------------------- pooling of token vectors
#
# A token row is a word's vector, some hundred times its token: shuffled, the rows would be many times the
# texts.  The pooling operators fold the rows of a document while they stream by.  A caller that has spread
# the documents by their id and sorted them before it made tokens of them says ``together``: the rows of a
# document are in one partition, one after another, and nothing is shuffled.  Otherwise the rows are.

def _per_document(df: DataFrame, cols, start, fold, finish, out: str, together: bool) -> DataFrame:
    """One pass over the rows of each document, ``cols[0]`` being its id.  ``start(batch, run)`` gives
    (run, states) of a batch, ``run`` numbering its documents; ``fold`` reduces them to few rows a document,
    in the order of ``run``; ``finish(documents, run, states)`` gives the columns of ``out``, the id first."""
    rows = df.select(*cols)
    if not together:
        rows = rows.repartition(cols[0]).sortWithinPartitions(cols[0])
    names = [cols[0], *[f.split()[0] for f in out.split(", ")]]

    def run_batches(batches):
        held = None                                              # the last document and its states
        for b in batches:
            if not b.num_rows:
                continue
            code = pc.fill_null(b.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            opens = np.concatenate([[True], code[1:] != code[:-1]])
            docs = b.column(0).take(pa.array(np.flatnonzero(opens)))
            run, states = start(b, np.cumsum(opens) - 1)
            if held is not None:
                other = int(not docs[0].equals(held[0][0]))
                docs = pa.concat_arrays([held[0], docs]) if other else docs
                run = np.concatenate([np.zeros(len(held[1][0]), np.int64), run + other])
                states = [np.concatenate([h, s]) for h, s in zip(held[1], states)]
            run, states = fold(run, states)
            cut = np.searchsorted(run, len(docs) - 1)
            if cut:
                yield pa.RecordBatch.from_arrays(finish(docs.slice(0, len(docs) - 1), run[:cut], [s[:cut] for s in states]), names=names)
            held = docs.slice(len(docs) - 1), [s[cut:] for s in states]
        if held is not None:
            yield pa.RecordBatch.from_arrays(finish(held[0], np.zeros(len(held[1][0]), np.int64), held[1]), names=names)

    return rows.mapInArrow(run_batches, f"`{cols[0]}` {dict(rows.dtypes)[cols[0]]}, {out}")


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def _vector_lists(X: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1, dtype=np.int32) * X.shape[1]), pa.array(np.ascontiguousarray(X).ravel()))


def _first_of(run: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))


def pool_tokens(df: DataFrame, mode: str, doc_col: str = "doc_id", pos_col: str = "pos", vec_col: str = "vec", together: bool = False) -> DataFrame:
    """AGG-13: document vector = max / mean / first / last over its token vectors."""
    if mode in ("max", "mean"):
        def start(b, run):
            return run, [_matrix(b.column(1)), np.ones((b.num_rows, 1))]

        def fold(run, states):
            at = _first_of(run)
            return run[at], [(np.maximum if mode == "max" else np.add).reduceat(states[0], at), np.add.reduceat(states[1], at)]

        def finish(docs, run, states):
            return [docs, _vector_lists(states[0] if mode == "max" else states[0] / states[1])]
        return _per_document(df.where(F.col(vec_col).isNotNull()), [doc_col, vec_col], start, fold, finish, f"{vec_col} array<double>", together)
    if mode not in ("first", "last"):
        raise ValueError(mode)

    def best(run, pos):
        """The row of each document with the smallest (or largest) position."""
        order = np.lexsort((pos if mode == "first" else -pos, run))
        return order[_first_of(run[order])]

    def start_place(b, run):
        pos = b.column(1).to_numpy(zero_copy_only=False)
        at = best(run, pos)
        vecs = np.empty(len(at), object)                         # a row a document
        vecs[:] = b.column(2).take(pa.array(at)).to_pylist()
        return run[at], [pos[at], vecs]

    def fold_place(run, states):
        at = best(run, states[0])
        return run[at], [s[at] for s in states]

    return _per_document(df.where(F.col(pos_col).isNotNull()), [doc_col, pos_col, vec_col], start_place, fold_place,
                         lambda docs, run, states: [docs, pa.array(states[1].tolist(), pa.list_(pa.float64()))], f"{vec_col} array<double>", together)


def pool_sentences(df: DataFrame, doc_col: str = "doc_id", sent_col: str = "sent_no", vec_col: str = "vec", together: bool = False) -> DataFrame:
    """AGG-14: mean of token vectors per sentence, then the unweighted mean of sentence vectors."""
    def start(b, run):
        return fold(run, [b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2)), np.ones((b.num_rows, 1))])

    def fold(run, states):
        sent = states[0]
        if len(run) > 1 and not np.all((run[1:] > run[:-1]) | ((run[1:] == run[:-1]) & (sent[1:] >= sent[:-1]))):
            order = np.lexsort((sent, run))
            run, states = run[order], [s[order] for s in states]
            sent = states[0]
        at = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (sent[1:] != sent[:-1])]))
        return run[at], [sent[at], np.add.reduceat(states[1], at), np.add.reduceat(states[2], at)]

    def finish(docs, run, states):
        at = _first_of(run)
        total = np.add.reduceat(states[1] / states[2], at)
        return [docs, _vector_lists(total / np.diff(np.append(at, len(run)))[:, None])]

    return _per_document(df.where(F.col(vec_col).isNotNull()), [doc_col, sent_col, vec_col], start, fold, finish, f"{vec_col} array<double>", together)


def vocabulary_coverage(tokens: DataFrame, known_flag_col: str = "known") -> DataFrame:
    """AGG-15: kept / total tokens in %."""
    return tokens.agg(F.sum(F.when(F.col(known_flag_col), 1).otherwise(0)).cast("long").alias("kept"),
                      F.count(F.lit(1)).alias("total")).withColumn("pct", F.col("kept") * 100.0 / F.col("total"))


def maxpool_attribution(df: DataFrame, doc_col: str = "doc_id", pos_col: str = "pos", vec_col: str = "vec", together: bool = False) -> DataFrame:
    """AGG-17: per token, the % of vector dimensions whose max over the document is at that token
    (ties → earliest token)."""
    late = np.iinfo(np.int64).max

    def start(b, run):
        X = _matrix(b.column(2))
        return run, [X, np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[:, None], X.shape[1], axis=1)]

    def fold(run, states):
        X, pos = states
        at = _first_of(run)
        top = np.maximum.reduceat(X, at)
        mine = np.repeat(top, np.diff(np.append(at, len(run))), axis=0)
        hit = (X == mine) | (np.isnan(X) & np.isnan(mine))
        return run[at], [top, np.minimum.reduceat(np.where(hit, pos, late), at)]

    def finish(docs, run, states):
        pos = np.sort(states[1], axis=1)
        n, d = pos.shape
        flat, row = pos.ravel(), np.repeat(np.arange(n), d)
        at = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]))
        return [docs.take(pa.array(row[at])), pa.array(flat[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(flat))) * 100.0 / d)]

    return _per_document(df.where(F.col(vec_col).isNotNull() & F.col(pos_col).isNotNull()), [doc_col, pos_col, vec_col],
                         start, fold, finish, f"{pos_col} int, pct double", together)
