"""Language-model scores by prediction by partial matching over bytes.

Model.  A text is its words (ASCII lower case), each followed by one space, and an end symbol.
Each symbol is predicted from the ``order`` bytes of the running text before it, across spaces and
words; only the start of the text, a space, bounds them.  The longest context that the training texts
have seen predicts first; an unseen symbol escapes to the context without its oldest byte, with the
escape mass of method C (distinct symbols against occurrences), and symbols that a longer context
has already offered are excluded below it.  After the empty context all other symbols are equally
likely.

The trie lives in tables: windows (context and symbol packed into a long) of all texts, counted in
every task first, cells (every suffix of a window's context, with counts) and context totals.  A
distinct window is scored once.  Documents add up the windows of their running text: frequent ones
from a broadcast table of at most ``HOT_WINDOWS`` entries, all others by a join, which also brings
the counts of the words that aren't among the ``HOT_WORDS`` broadcast ones.

Defined results: a null or empty text is the end symbol alone; a null id counts as the empty text
in the hold-out rule; repeated rows are rows of their own; without training documents every symbol
is equally likely; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_cut, id_bucket, map_rows, text_bytes, written

ORDER, HOT_WORDS, HOT_WINDOWS, HOT_WORD_BYTES, TABLE_WORDS, TABLE_WINDOWS = 5, 1 << 17, 1 << 20, 64, 250_000, 1 << 20
#: 250 bytes that can be in a word, the space and the end.
ALPHABET = 252
#: Symbols that are packed at once, however long a text is.
PIECE = 1 << 17


def running_text(words: list[bytes]) -> bytes:
    """A space, the words, each followed by a space, and the end."""
    return b" ".join([b"", *words, b"\n"])


def windows_of(texts: list[list[bytes]], order: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, context length, number of the text) for every symbol of the running texts (lists of
    words), ``piece`` symbols at a time.  A window is the context's bytes and the symbol's, most
    significant first, behind a byte 1; the context is what precedes the symbol in its text."""
    texts = [running_text(words) for words in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    buf = np.frombuffer(b"\0" * order + b"".join(texts), np.uint8)
    for lo in range(0, int(bounds[-1]), piece):
        hi = min(lo + piece, int(bounds[-1]))
        text = np.repeat(np.arange(len(texts)), np.diff(np.clip(bounds, lo, hi)))
        place = np.arange(lo, hi) - bounds[text]
        key = np.zeros(hi - lo, np.int64)
        for j in range(order + 1):
            key |= buf[lo + order - j:hi + order - j].astype(np.int64) << (8 * j)
        depth = np.minimum(place, order)
        top = np.int64(1) << (8 * (depth + 1))
        symbol = place > 0                                        # the first space is context alone
        yield ((key & (top - 1)) | top)[symbol], depth[symbol], text[symbol]


def count_words(docs: DataFrame, held_out, text_col: str = "text") -> DataFrame:
    """(word, n, k): occurrences in all documents and in the training documents."""
    def rows(batches):
        seen = (Counter(), Counter())

        def out():
            for trained, c in zip((False, True), seen):
                if c:
                    n = list(c.values())
                    yield {"word": list(c), "n": n, "k": n if trained else [0] * len(n)}
                c.clear()
        for b in batches:
            for t, h in zip(b["t"], b["h"]):
                seen[not h].update(t.lower().split())
            if len(seen[0]) + len(seen[1]) > TABLE_WORDS:
                yield from out()
        yield from out()

    parts = map_rows(docs.select(text_bytes(text_col).alias("t"), held_out.alias("h")), "word binary, n long, k long", rows)
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return [distinct, *[np.bincount(at, weights=c, minlength=len(distinct)).astype(np.int64) for c in counts]]


def count_windows(docs: DataFrame, held_out, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(win, m, n, k): windows of all running texts with their context lengths and occurrences, in all
    documents and in the training documents."""
    def rows(batches):
        parts: list[list[np.ndarray]] = []

        def out():
            win, n, k = _summed(*map(np.concatenate, zip(*parts)))
            if len(win) <= TABLE_WINDOWS * 3 // 4:
                parts[:] = [[win, n, k]]
                return
            parts.clear()
            yield from tables(win, n, k)

        def tables(win, n, k):
            for at in range(0, len(win), 1 << 16):
                w = win[at:at + (1 << 16)]
                # Windows of m + 2 bytes, the first of which is 1: exact in double precision.
                yield {"win": w, "m": (np.frexp(w.astype(np.float64))[1] - 1) // 8 - 1, "n": n[at:at + (1 << 16)], "k": k[at:at + (1 << 16)]}

        for b in batches:
            held = np.array(b["h"], bool)
            for win, _, text in windows_of([t.lower().split() for t in b["t"]], order):
                out_of = held[text]
                for trained, w in ((True, win[~out_of]), (False, win[out_of])):
                    w, n = np.unique(w, return_counts=True)
                    parts.append([w, n, n if trained else np.zeros(len(w), np.int64)])
                if sum(len(p[0]) for p in parts) > TABLE_WINDOWS:
                    yield from out()
        if parts:
            yield from tables(*_summed(*map(np.concatenate, zip(*parts))))

    parts = map_rows(docs.select(text_bytes(text_col).alias("t"), held_out.alias("h")), "win long, m int, n long, k long", rows)
    return parts.groupBy("win", "m").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _levels(windows: DataFrame) -> DataFrame:
    """Every window at each of its context lengths j: the cell is its last j + 1 bytes."""
    low = F.expr("shiftleft(1L, 8 * (j + 1))")
    return windows.withColumn("j", F.explode(F.sequence(F.lit(0), "m"))) \
        .withColumn("cell", F.col("win").bitwiseAND(low - 1).bitwiseOR(low))


def trie(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, contexts): counts ``c`` of (context, symbol), and for every context its occurrences
    ``t``, its distinct symbols ``d`` and ``e``, what its symbols count in the context without the
    oldest byte (the mass that exclusion takes away there)."""
    cells = written(_levels(windows.where("k > 0")).groupBy("cell", "j").agg(F.sum("k").alias("c")), "cells")
    low = F.expr("shiftleft(1L, 8 * j)")
    shorter = cells.select(F.col("cell").alias("suffix"), F.col("c").alias("below"))
    own = cells.withColumn("suffix", F.when(F.col("j") > 0, F.col("cell").bitwiseAND(low - 1).bitwiseOR(low)))
    contexts = own.join(shorter, "suffix", "left").groupBy(F.shiftright("cell", 8).alias("ctx")).agg(
        F.sum("c").alias("t"), F.count("*").alias("d"), F.coalesce(F.sum("below"), F.lit(0)).alias("e"))
    return cells, written(contexts, "contexts")


def score_windows(windows: DataFrame, cells: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """(win, n, lp): the log10 probability of every window's symbol after its context.  A window of the
    training texts is a hit in its longest context; only the others escape downward."""
    trained = windows.where("k > 0").withColumn("ctx", F.shiftright("win", 8)) \
        .join(cells.select(F.col("cell").alias("win"), "c"), "win").join(contexts.select("ctx", "t", "d"), "ctx") \
        .select("win", "n", F.log10(F.col("c") / (F.col("t") + F.col("d"))).alias("lp"))
    each = _levels(windows.where("k = 0").select("win", "m", "n")).withColumn("ctx", F.shiftright("cell", 8))
    each = each.join(cells.select("cell", "c"), "cell", "left").join(contexts, "ctx", "left")
    wide = each.groupBy("win", "n").agg(*[F.max(F.when(F.col("j") == j, F.col(c)).cast("double")).alias(f"{c}{j}")
                                          for j in range(order + 1) for c in "ctde"])

    def rows(batches):
        for b in batches:
            x = {k: np.array(v, np.float64) for k, v in b.items() if k not in ("win", "n")}
            lp, open_ = np.zeros(len(b["win"])), np.ones(len(b["win"]), bool)
            gone, mass = np.zeros(len(lp)), np.zeros(len(lp))
            for j in range(order, -1, -1):
                c, t, d = x[f"c{j}"], x[f"t{j}"], x[f"d{j}"]
                seen = open_ & ~np.isnan(t)
                left = d - gone                                   # symbols that are not excluded
                total = t - mass + left
                hit, escape = seen & ~np.isnan(c), seen & np.isnan(c) & (left > 0)
                lp[hit] += np.log10(c[hit] / total[hit])
                lp[escape] += np.log10(left[escape] / total[escape])
                open_ &= ~hit
                gone, mass = np.where(seen, d, gone), np.where(seen, x[f"e{j}"], mass)
            lp[open_] -= np.log10(np.maximum(1, ALPHABET - gone[open_]))
            yield {"win": b["win"], "n": b["n"], "lp": lp}

    return trained.unionByName(map_rows(wide, "win long, n long, lp double", rows, flush_rows=8192))


def _slots(win: np.ndarray, multiplier: int, shift: int) -> np.ndarray:
    return ((win.astype(np.uint64) * np.uint64(multiplier)) >> np.uint64(shift)).astype(np.int64)


def window_table(win: np.ndarray, lp: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Windows and their values for ``find_windows``, by multiplicative hashing: a slot holds one
    window, and what finds its slot taken goes to a further table under another multiplier.  Plain
    tuples, as a broadcast's classes are pickled by name, which executors may not have."""
    levels, multiplier = [], 0x9E3779B97F4A7C15
    while len(win):
        shift = 64 - max(4, int(2 * len(win)).bit_length())
        slot = _slots(win, multiplier, shift)
        _, first = np.unique(slot, return_index=True)
        keys, values = np.zeros(1 << (64 - shift), np.int64), np.zeros(1 << (64 - shift))
        keys[slot[first]], values[slot[first]] = win[first], lp[first]
        levels.append((multiplier, shift, keys, values))
        rest = np.ones(len(win), bool)
        rest[first] = False
        win, lp, multiplier = win[rest], lp[rest], (multiplier * 0xD1342543DE82EF95 + 2) % (1 << 64)
    return levels


def find_windows(levels: list[tuple[int, int, np.ndarray, np.ndarray]], win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where unknown) and the places of the unknown windows."""
    lp, todo = np.zeros(len(win)), np.arange(len(win))
    for multiplier, shift, keys, values in levels:
        sought = win[todo]
        slot = _slots(sought, multiplier, shift)
        hit = keys[slot] == sought
        lp[todo[hit]] = values[slot[hit]]
        todo = todo[~hit]
    return lp, todo


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1,
          order: int = ORDER) -> DataFrame:
    """Scores of all documents under the model of those whose crc32(id) mod ``folds`` is not
    ``held``: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).  ``base_score``
    is the add-a-half unigram score of the same words and end."""
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6: a window is packed into a long")
    spark = docs.sparkSession
    held_out = id_bucket(id_col, folds) == held
    vocabulary = written(count_words(docs, held_out, text_col), "vocabulary")
    ends = docs.where(~held_out).count()
    r = vocabulary.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count_if(F.col("k") > 0).alias("v")).first()
    tokens, distinct = r["n"] + ends, r["v"] + (ends > 0)
    windows = written(count_windows(docs, held_out, order, text_col), "windows")
    cells, contexts = trie(windows)
    scored = written(score_windows(windows, cells, contexts, order), "window-scores")
    share = tokens + 0.5 * (distinct + 1)
    base = lambda c: math.log10((c + 0.5) / share)
    end_base = base(ends)

    # At most HOT_WORDS words of at most HOT_WORD_BYTES bytes, and at most HOT_WINDOWS windows.
    short = vocabulary.where(F.octet_length("word") <= HOT_WORD_BYTES)
    hot = short.where(F.col("n") >= count_cut(short, "n", HOT_WORDS)).select("word", "k").toArrow().to_pydict()
    table = spark.sparkContext.broadcast({w: (base(k), k > 0) for w, k in zip(hot["word"], hot["k"])})
    often = count_cut(scored, "n", HOT_WINDOWS)
    hot = scored.where(F.col("n") >= often).select("win", "lp").toArrow()
    sent = spark.sparkContext.broadcast(window_table(hot["win"].to_numpy(), hot["lp"].to_numpy()))

    def rows(batches):
        frequent, known_windows = table.value, sent.value
        names = ("rid", "key", "c", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp")
        for b in batches:
            texts = [t.lower().split() for t in b["t"]]
            lps, rid = np.zeros(len(texts)), np.array(b["rid"], np.int64)
            for win, _, text in windows_of(texts, order):
                lp, cold = find_windows(known_windows, win)
                lps += np.bincount(text, weights=lp, minlength=len(texts))
                if len(cold):
                    packed, none = win[cold].astype(">i8").tobytes(), [None] * len(cold)
                    yield {"rid": rid[text[cold]], "key": [b" " + packed[i:i + 8] for i in range(0, len(packed), 8)], "c": np.ones(len(cold), np.int64),
                           **dict.fromkeys(names[3:], none)}
            out: list[tuple] = []
            for text, r, doc, h, lp in zip(texts, b["rid"], b["doc_id"], b["h"], lps.tolist()):
                low, known = end_base, int(ends > 0)
                for w, c in Counter(text).items():
                    x = frequent.get(w)
                    if x is None:
                        out.append((r, w, c, None, None, None, None, None, None))
                    else:
                        low, known = low + c * x[0], known + c * x[1]
                # A document's own row goes through the join under a key that is neither word nor window.
                out.append((r, b"  " + struct.pack(">q", r), 0, doc, h, len(text) + 1, known, low, lp))
            if out:
                yield dict(zip(names, zip(*out)))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"), held_out.alias("h"),
                    F.monotonically_increasing_id().alias("rid"))
    parts = map_rows(d, "rid long, key binary, c long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double", rows)
    # The other words bring their base score, the other windows their probability.
    packed = F.concat(F.lit(bytearray(b" ")), F.unhex(F.lpad(F.hex("win"), 16, "0")))
    rare = vocabulary.select(F.col("word").alias("key"), (F.col("k") > 0).cast("long").alias("known"),
                             F.log10((F.col("k") + 0.5) / F.lit(float(share))).alias("low"), F.lit(0.0).alias("wlp"))
    rare = rare.unionByName(scored.where(F.col("n") < often).select(packed.alias("key"), F.lit(0).cast("long").alias("known"),
                                                                     F.lit(0.0).alias("low"), F.col("lp").alias("wlp")))
    c = F.col("c")
    return parts.join(rare, "key", "left").groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", c * F.col("known"))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.sum(F.coalesce("base", c * F.col("low"))).alias("base_score"), F.sum(F.coalesce("lp", c * F.col("wlp"))).alias("score")).drop("rid")


class AdaptiveTrie:
    """The same model learnt symbol by symbol: a dict of contexts, for single documents."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def symbols(self, words: list[bytes]):
        s = running_text(words)
        for i in range(1, len(s)):
            yield s[max(0, i - self.order):i], s[i]

    def lp(self, context: bytes, symbol: int) -> float:
        lp, gone = 0.0, set()
        for i in range(len(context) + 1):
            seen = self.counts.get(context[i:])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return lp + math.log10(left[symbol] / total)
            if left:
                lp += math.log10(len(left) / total)
            gone |= left.keys()
        return lp - math.log10(max(1, ALPHABET - len(gone)))

    def learn(self, context: bytes, symbol: int, count: int = 1) -> None:
        for i in range(len(context) + 1):
            seen = self.counts.setdefault(context[i:], {})
            seen[symbol] = seen.get(symbol, 0) + count

    def adaptive(self, text: bytes) -> float:
        lp = 0.0
        for context, symbol in self.symbols(text.lower().split()):
            lp += self.lp(context, symbol)
            self.learn(context, symbol)
        return lp


def score_adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, score): each document under a model that learns from the document alone."""
    def rows(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [AdaptiveTrie(order).adaptive(t) for t in b["t"]]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t")),
                    "doc_id long, score double", rows)
