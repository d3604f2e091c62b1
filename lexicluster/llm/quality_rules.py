"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure (length, symbols, stop words, lines, repetition) is a column expression over the
whole text; no user function runs.  The rules are data: (measure, least, most).

Defined results: a null or empty text has no words, no lines and ``n_words`` 0, and fails the
base rules; a measure whose denominator is zero is 0; repeated input rows give repeated output
rows; an empty table gives an empty result; further input columns, whatever their names, are not
read (``measures``) or pass through untouched (``keep_documents``).
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES


class Rule(NamedTuple):
    measure: str
    least: float | None
    most: float | None


# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was were with "
    "au dans de des du elle est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der die ein eine er ist mit nicht sich sie und von werden wie zu "
    "al como con del el en es las lo los no para por se su una y").split()

RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("mark_ratio", None, 1.0),
    Rule("upper_ratio", None, 0.6),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS, MARKS = "#*$%&|<>", "!?"


def _removed(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text and every measure.  Repeated three-word windows are found by
    sorting the hashes of a text's windows with their positions, so that equal windows become
    neighbours, whose words are then compared.  (A repeat could be missed only where two different
    windows of one text had the same 64-bit hash and stood between each other.)"""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    d = d.select("*", F.filter(F.split("_t", r"[ \t-\r]+"), lambda w: w != "").alias("_w"),
                 F.split(F.lower("_t"), r"[ \t-\r]+").alias("_low"),
                 F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"))
    d = d.withColumn("_n", F.size("_w").cast("long"))
    windows = F.when(F.col("_n") < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
        F.transform(F.slice(F.col("_w"), F.lit(1), F.greatest(F.col("_n") - 2, F.lit(1)).cast("int")),
                    lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p"))))
    d = d.withColumn("_win", F.sort_array(windows))

    def equal(x, y):
        words = [F.get("_w", x["p"] + k) == F.get("_w", y["p"] + k) for k in range(3)]
        return F.coalesce((x["h"] == y["h"]) & words[0] & words[1] & words[2], F.lit(False))

    d = d.withColumn("_pos", F.sort_array(F.transform(
        F.filter("_win", lambda x, i: equal(x, F.get("_win", i - 1)) | equal(x, F.get("_win", i + 1))), lambda x: x["p"])))
    # A window at p covers p, p+1, p+2; up to the next found window it adds min(3, gap) words.
    covered = F.aggregate(F.transform("_pos", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_pos", i + 1) - p, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    d = d.select(
        "_id", "_raw", F.col("_n").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        _removed(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _removed(F.col("_t"), MARKS).alias("n_marks"),
        F.size(F.filter("_w", lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))).cast("long").alias("n_upper"),
        F.size(F.filter("_low", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipses"))
    n, lines = F.col("n_words"), F.col("n_lines")
    ratios = {"mean_word_length": ("word_chars", n), "symbol_ratio": ("n_symbols", n), "mark_ratio": ("n_marks", n),
              "upper_ratio": ("n_upper", n), "stop_word_ratio": ("n_stop", n), "dup_line_ratio": ("n_dup_lines", lines),
              "bullet_line_ratio": ("n_bullets", lines), "ellipsis_line_ratio": ("n_ellipses", lines)}
    return d.select("*", *[_ratio(F.col(a), b).alias(k) for k, (a, b) in ratios.items()])


def verdict(rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS,
            most_repeated_percent: int = MOST_REPEATED_PERCENT) -> tuple[Column, Column]:
    """(base_failed, kept): the table compiled into two boolean columns over ``measures``."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))
    passed = ~base
    for r in rules:
        if r.least is not None:
            passed = passed & (F.col(r.measure) >= r.least)
        if r.most is not None:
            passed = passed & (F.col(r.measure) <= r.most)
    return base, passed


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document."""
    base, passed = verdict(rules)
    m = measures(docs, id_col, text_col).drop("_raw").withColumnRenamed("_id", id_col)
    return m.select("*", base.alias("base_failed"), passed.alias("kept"))


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Documents that pass, with the columns they came with.  The row travels as one struct and the
    verdict is applied by a generator: a filter would be pushed down through the projections and
    copy their expressions into itself."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    m = measures(row.select("_row", F.col("_row")[text_col].alias("_text")), "_row", "_text")
    return m.select(F.explode(F.when(verdict(rules)[1], F.array("_id"))).alias("_row")).select("_row.*")
