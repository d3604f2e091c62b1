"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network
with calibrated probabilities.

Word vectors.  Words (and runs of digits and symbols; a word in capitals is one and the same word)
are hashed to ``BUCKETS`` buckets.  A bucket has a sparse ternary index vector; its context vector
is the sum of the index vectors of its neighbours, two to each side, over all documents.  The sums
are integers, so they don't depend on the order of the tasks; the table has BUCKETS x DIM numbers
whatever the corpus, and is broadcast.

A document is the mean of its context vectors and of its index vectors, the squared lengths of the
two means (words that repeat don't cancel out) and the logarithm of its number of words.  The
network is trained on at most ``TRAIN_ROWS`` labelled documents (the smallest hashes of the id);
a fifth of them sets the temperature of the probabilities.

Defined results: a null or empty text has zero features and a score like any other; labels that
are null are not used, of several labels of a document the largest counts; without labels of both
kinds every score is the share of label 1 (0.5 without any); repeated rows are rows of their own;
an empty table gives an empty result.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, map_rows, text_bytes

BUCKETS, DIM, NONZERO, REACH, SEED = 1 << 14, 32, 4, 2, 5
TRAIN_ROWS, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 20_000, 32, 30, 256, 3e-3, 1e-4
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x09-\x0d\x20]+")


def index_vectors() -> np.ndarray:
    """BUCKETS + 1 ternary vectors; the last, for places between documents, is zero."""
    rng = np.random.default_rng(SEED)
    r = np.zeros((BUCKETS + 1, DIM), np.int8)
    at = rng.random((BUCKETS, DIM)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(r[:-1], at, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return r


class _Buckets(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        word = b"\x01" if len(token) > 1 and token.isupper() else token.lower()
        self[token] = b = zlib.crc32(word) % BUCKETS
        return b


def _numbers(texts: list[bytes], buckets: dict) -> Iterator[np.ndarray]:
    for t in texts:
        yield np.array(list(map(buckets.__getitem__, _TOKEN.findall(t))), np.int64)


def context_vectors(docs: DataFrame, text_col: str = "text", slice_tokens: int = 1 << 17) -> np.ndarray:
    """(BUCKETS, DIM) context sums over all documents, scaled to unit length."""
    cols = [f"x{i}" for i in range(DIM)]

    def rows(batches):
        index, buckets = index_vectors().astype(np.int16), _Buckets()
        sums = np.zeros((BUCKETS + 1, DIM), np.int64)

        def add(held):
            b = np.concatenate(held)
            for at in range(0, len(b), slice_tokens):
                lo, hi = max(0, at - REACH), min(len(b), at + slice_tokens + REACH)
                x = index[b[lo:hi]]
                near = np.zeros_like(x)
                for j in range(1, REACH + 1):
                    near[j:] += x[:-j]
                    near[:-j] += x[j:]
                own = b[at:at + slice_tokens]
                near = near[at - lo:at - lo + len(own)]
                order = np.argsort(own.astype(np.uint16), kind="stable")
                keys, first = np.unique(own[order], return_index=True)
                sums[keys] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)

        gap = np.full(REACH, BUCKETS, np.int64)
        held, size = [], 0
        for batch in batches:
            for n in _numbers(batch["t"], buckets):
                held += [n, gap]
                size += len(n) + REACH
                if size > 4 * slice_tokens:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        used = np.flatnonzero(sums[:-1].any(axis=1))
        if len(used):
            yield {"b": used} | {c: sums[used, i] for i, c in enumerate(cols)}

    parts = map_rows(docs.select(text_bytes(text_col).alias("t")), "b int, " + ", ".join(f"{c} long" for c in cols), rows)
    total = parts.groupBy("b").agg(*[F.sum(c).cast("double").alias(c) for c in cols]).toArrow()     # at most BUCKETS rows
    out = np.zeros((BUCKETS + 1, DIM))
    if total.num_rows:
        out[total["b"].to_numpy()] = np.stack([total[c].to_numpy() for c in cols], axis=1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _features(texts: list[bytes], vectors: np.ndarray, buckets: dict) -> np.ndarray:
    out = np.zeros((len(texts), 2 * DIM + 3))
    for i, b in enumerate(_numbers(texts, buckets)):
        if len(b):
            mean = np.bincount(b, minlength=0)
            used = np.flatnonzero(mean)
            mean = mean[used] @ vectors[used] / len(b)
            out[i, :2 * DIM] = mean
            out[i, 2 * DIM:] = (mean[:DIM] ** 2).sum(), (mean[DIM:] ** 2).sum(), np.log1p(len(b))
    return out


class Network:
    """tanh layer and a logit, trained by Adam on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.trained = len(set(y.tolist())) == 2
        if not self.trained:
            return
        rng = np.random.default_rng(seed)
        held = np.arange(len(y)) % 5 == 4
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        d = x.shape[1]
        self.w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        tx, ty = x[~held], y[~held]
        for _ in range(EPOCHS):
            order = rng.permutation(len(ty))
            for a in range(0, len(ty), BATCH):
                i = order[a:a + BATCH]
                h = np.tanh(tx[i] @ self.w[0] + self.w[1])
                e = (_sigmoid(h @ self.w[2] + self.w[3]) - ty[i]) / len(i)
                back = np.outer(e, self.w[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((tx[i].T @ back, back.sum(axis=0), h.T @ e, e.sum(keepdims=True))):
                    g = g + DECAY * self.w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        # The temperature with the least cross-entropy on the rows held back.
        z, t = self._logit(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        loss = [-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean() for p in (np.clip(_sigmoid(z / g), 1e-7, 1 - 1e-7) for g in grid)]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(t) else 1.0

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return _sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = 5, held: int = 0) -> Network:
    """Train on labelled documents whose crc32(id) mod ``folds`` is not ``held`` (-1: on all)."""
    known = labels.where((id_bucket(id_col, folds) != held) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("double").alias("y"))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("_id")).distinct(), "_id", "left_semi")
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("t")) \
        .join(F.broadcast(sample), "_id")                         # at most TRAIN_ROWS ids and labels
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        buckets = _Buckets()
        for b in batches:
            yield {"id": b["_id"], "y": b["y"], "x": list(_features(b["t"], sent.value, buckets))}

    t = map_rows(rows, "id long, y double, x array<double>", run).dropDuplicates(["id"]).orderBy("id").toArrow()
    x = np.array(t["x"].to_pylist()).reshape(-1, 2 * DIM + 3)
    return Network(x, t["y"].to_numpy())


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          folds: int = 5, held: int = 0) -> tuple[np.ndarray, Network]:
    """(vectors, network): context and index vectors side by side, and the trained network."""
    vectors = np.concatenate([context_vectors(docs, text_col), index_vectors()], axis=1)
    return vectors, fit(docs, labels, vectors, id_col, text_col, label_col, folds, held)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          folds: int = 5, held: int = 0) -> DataFrame:
    """(id, held_out, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels, id_col, text_col, label_col, folds, held))

    def rows(batches):
        vectors, net = sent.value
        buckets = _Buckets()
        for b in batches:
            yield {"id": b["id"], "held_out": b["h"], "score": net.predict(_features(b["t"], vectors, buckets))}

    d = docs.select(F.col(id_col).cast("long").alias("id"), (id_bucket(id_col, folds) == held).alias("h"), text_bytes(text_col).alias("t"))
    return map_rows(d, "id long, held_out boolean, score double", rows)


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text",
                   train: DataFrame | None = None, **options) -> DataFrame:
    """Documents with a score of at least ``threshold``, with the columns they came with.  Vectors
    and network are fitted on ``train`` (by default on ``docs``)."""
    train = docs if train is None else train
    sent = docs.sparkSession.sparkContext.broadcast(model(train, labels, text_col=text_col, **options))
    at = docs.columns.index(text_col)

    def run(batches):
        vectors, net = sent.value
        buckets = _Buckets()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(net.predict(_features(texts, vectors, buckets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
