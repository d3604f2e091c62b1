"""Byte-level BPE words: splitting a text at the tokenizer's word boundaries, and encoding many
distinct words with few calls.

A word is `` ?`` and a run of non-space characters, or a run of white space less the one that
belongs to the next word.  The pre-tokenizer's own boundaries are a refinement of these, so the
ids of a text are the ids of its words one after another.  Added tokens are words of their own.
"""
from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters of the Unicode property White_Space.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SPACE = re.compile(f"[{_WS}]")
# The same characters but for the space and the line end; those in ASCII come first.
_ODD = "\t\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def even(text: str) -> bool:
    """All white space is single spaces and single line ends between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    return not any(c in text for c in (_ODD[:4] if text.isascii() else _ODD))



def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over all its tasks.  (Functions of this
    package reach the workers by value, so their module's globals are new in every task.)"""
    return sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__


def loaded(tokenizer: str) -> "WordEncoder":
    """The encoder of a tokenizer file's contents, built once in a worker."""
    cache = worker_cache()
    if cache.get("tokenizer") != tokenizer:
        cache["encoder"], cache["tokenizer"] = WordEncoder(tokenizer), tokenizer
    return cache["encoder"]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Merges:
    """Byte-pair merges of many plain words at once.  A plain word has ASCII and Latin letters, digits and
    ASCII marks other than the apostrophe, behind a space, a line end or nothing.  The pre-tokenizer's
    pieces are then its runs of one class; the space goes with the first, the line end stays alone."""

    PLAIN = "\\A[ \\n]?(?:[!-&(-~]|[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])+\\z"
    NONE = np.int32(2 ** 31 - 1)
    SLOTS = 18                                                    # bits of a slot of the pair table

    def __init__(self, model: dict, byte_of: dict[str, int], size: int):
        vocab, self.size = model["vocab"], np.int64(size)
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in byte_of.items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank = {vocab[a] * size + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.slots = max(self.SLOTS, len(rank).bit_length() + 2)
        self.keys, self.ranks = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, self.NONE, np.int32)
        for key, at in zip(rank, self._slot(np.array(list(rank), np.int64)).tolist()):
            while self.keys[at] >= 0:                             # the next free slot
                at = (at + 1) & ((1 << self.slots) - 1)
            self.keys[at], self.ranks[at] = key, rank[key]
        self.first = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        kind = np.full(256, 3, np.uint8)                          # marks
        kind[[*range(65, 91), *range(97, 123), *range(128, 256)]], kind[48:58], kind[32], kind[10] = 1, 2, 0, 4
        self.kind = kind

    @staticmethod
    def of(spec: dict, byte_of: dict[str, int], size: int) -> "Merges | None":
        """None where a tokenizer does more than cut at the usual pattern and merge."""
        m, pre = spec["model"], spec.get("pre_tokenizer") or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        odd = any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        return Merges(m, byte_of, size) if m["type"] == "BPE" and usual and not odd and all(c in m["vocab"] for c in byte_of) else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = self._slot(key)
        have = self.keys[at]
        out = np.where(have == key, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((have != key) & (have >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.slots) - 1)
            have = self.keys[at[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return out

    def encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, number of ids of each) of bytes cut at ``starts``."""
        kind = self.kind[raw]
        opens = np.empty(len(raw), bool)
        opens[0], opens[1:] = True, (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        opens[starts] = True
        pos, run, tok = np.arange(len(raw), dtype=np.int32), np.cumsum(opens, dtype=np.int32), self.byte_ids[raw]
        rank = np.full(len(raw), self.NONE)
        rank[:-1] = np.where(run[1:] == run[:-1], self.first[raw[:-1].astype(np.int32) * 256 + raw[1:]], self.NONE)
        out = np.full(len(raw), -1, np.int32)
        while len(pos):
            begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            low = np.minimum.reduceat(rank, begin)
            low = np.repeat(low, np.diff(np.append(begin, len(run))))
            left = low != self.NONE
            if not left.all():                                    # runs with nothing left to merge
                out[pos[~left]] = tok[~left]
                pos, run, tok, rank, low = pos[left], run[left], tok[left], rank[left], low[left]
                if not len(pos):
                    break
            hit = np.flatnonzero(rank == low)
            hit = hit[np.concatenate([[True], run[hit][1:] != run[hit][:-1]])]      # the leftmost of a run
            tok[hit] = self.made[rank[hit]]
            stay = np.ones(len(pos), bool)
            stay[hit + 1] = False
            pos, run, tok, rank = pos[stay], run[stay], tok[stay], rank[stay]
            at = hit - np.arange(len(hit))                        # where the merged ones are now
            for p in (at, at[at > 0] - 1):
                q = np.minimum(p + 1, len(run) - 1)
                rank[p] = np.where((q > p) & (run[q] == run[p]), self.rank(tok[p], tok[q]), self.NONE)
        have = out >= 0
        return out[have].view(np.uint32), np.add.reduceat(have, starts, dtype=np.int64)


class WordEncoder:
    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = set(added)
        self.added_re = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        # Byte-level BPE writes a byte as one printable character.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.pieces = [b""] * self.size
        for piece, i in vocab.items():
            self.pieces[i] = piece.encode() if piece in self.added else bytes(byte_of[c] for c in piece)
        self.opens = np.array([p[:1] == b" " and p.decode("utf-8", "replace") not in self.added for p in self.pieces])
        self.newline = vocab[chr(256 + rest.index(10))]
        self.merges = Merges.of(json.loads(tokenizer), byte_of, self.size)
        self._batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)

    def split(self, text: str) -> list[str]:
        if self.added_re is None or not self.added_re.search(text):
            return _WORDS.findall(text)
        out: list[str] = []
        for part in self.added_re.split(text):
            out += [part] if part in self.added else _WORDS.findall(part)
        return out

    def encode(self, words: list[str] | pa.Array, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another as uint32, number of ids of each word)."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []          # positions of words, their ids in order
        rest = np.arange(len(words))
        if self.merges is not None and len(words):
            plain = pc.match_substring_regex(words, Merges.PLAIN)
            if self.added_re is not None:
                plain = pc.and_(plain, pc.invert(pc.match_substring_regex(words, self.added_re.pattern)))
            plain = plain.to_numpy(zero_copy_only=False)
            rest, plain = np.flatnonzero(~plain), np.flatnonzero(plain)
            for at in range(0, len(plain), chunk):
                part = plain[at:at + chunk]
                some = words.take(pa.array(part))
                ends = np.frombuffer(some.buffers()[1], np.int64)[some.offset:some.offset + len(some) + 1]
                raw = np.frombuffer(some.buffers()[2], np.uint8)[ends[0]:ends[-1]]
                ids, counts[part] = self.merges.encode(raw, ends[:-1] - ends[0])
                found.append((part, ids))
        if len(rest):
            ids, counts[rest] = self._others(words.take(pa.array(rest)).to_pylist())
            found.append((rest, ids))
        if len(found) == 1:
            return found[0][1], counts
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for part, got in found:
            out[gather(starts[part], counts[part])] = got
        return out, counts

    def _others(self, words: list[str], step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The same through the tokenizer, many words a call."""
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        led, bare, other = [], [], []
        for i, w in enumerate(words):
            body = w[1:] if w[:1] == " " else w
            kind = other if not body or w in self.added or (self.added_re and self.added_re.search(w)) or _SPACE.search(body) else led if body is not w else bare
            kind.append(i)
        ids = lambda s: np.array(self.tok.encode(s, add_special_tokens=False).ids, np.uint32)
        if led:
            got, n = self._library([words[i][1:] for i in led])
            led = np.array(led)
            counts[led] = n
            found.append((led, got))
        for at in range(0, len(bare), step):                     # a line each
            part = np.array(bare[at:at + step])
            got = ids("\n".join([words[i] for i in part]))
            line = np.cumsum(got == self.newline)
            inside = got != self.newline
            counts[part] = np.bincount(line[inside], minlength=len(part))
            found.append((part, got[inside]))
        for i in other:
            got = ids(words[i])
            counts[i] = len(got)
            found.append((np.array([i]), got))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for part, got in found:
            out[gather(starts[part], counts[part])] = got
        return out, counts

    def _library(self, words: list[str], step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words without white space, a space in front of each: the
        piece that opens a word holds the only space in it."""
        parts, counts = [], []
        for at in range(0, len(words), step):
            part = words[at:at + step]
            got = np.array(self._batch([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            counts.append(np.bincount(np.cumsum(self.opens[got]) - 1, minlength=len(part)))
            parts.append(got)
        return np.concatenate(parts or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def lines(self, texts: list[str], step: int = 8 << 20) -> list[bytes]:
        """Ids of whole texts as little-endian uint32.  Texts with even white space are taken together,
        some ``step`` characters at a time, and cut at their spaces, and each distinct word is encoded
        once; others go one by one."""
        out: list[bytes] = [b""] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            if not even(t) or (self.added_re is not None and self.added_re.search(t)):
                words = pa.array(self.split(t), pa.large_string()).dictionary_encode()
                out[i] = self._joined(words, *self.encode(words.dictionary))[0].tobytes()
                continue
            group.append(i)
            size += len(t)
            if size >= step:
                self._even([texts[k] for k in group], group, out)
                group, size = [], 0
        if group:
            self._even([texts[k] for k in group], group, out)
        return out

    @staticmethod
    def _joined(words: pa.DictionaryArray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = words.indices.to_numpy()
        starts, n = np.cumsum(counts) - counts, counts[at]
        return ids[gather(starts[at], n)].astype("<u4"), n

    def _even(self, texts: list[str], places: list[int], out: list[bytes]) -> None:
        """A word at the start of a line keeps the line end, any other one its space."""
        marked = [("\n" + t).replace("\n", " \n")[1:] for t in texts]
        words = pc.split_pattern(pa.array([" ".join(marked)], pa.large_string()), " ").flatten().dictionary_encode()
        keys = words.dictionary
        keys = pc.if_else(pc.starts_with(keys, "\n"), keys, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), keys, pa.scalar("", pa.large_string())))
        every, n = self._joined(words, *self.encode(keys))
        last = np.cumsum([m.count(" ") + 1 for m in marked])
        raw, ends = every.tobytes(), 4 * np.cumsum(n)[last - 1]
        for place, a, b in zip(places, [0, *ends[:-1].tolist()], ends.tolist()):
            out[place] = raw[a + 4:b]                             # without the line end before the first word


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the runs (start, count) one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total, dtype=np.int64)
