"""Links through buckets, split or not, against all pairs."""
import numpy as np
import pytest

from lexicluster.llm import simhash


def clustered(n, seed, weak):
    """Fingerprints around a few centres that differ in bits of ``weak``, and unrelated ones."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for _ in range(n):
        x = centres[rng.integers(4)]
        for b in rng.choice(weak, rng.integers(0, 6)):
            x ^= np.uint64(1) << np.uint64(b)
        out.append(x)
    return np.unique(np.concatenate([out, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64), np.array([0, 1, 2 ** 64 - 1], np.uint64)]))


@pytest.mark.parametrize("bucket,weak", [(1024, range(64)), (16, range(0, 64, 3)), (4, range(20)), (8, range(44, 64))])
def test_links_and_degrees(spark, monkeypatch, bucket, weak):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = clustered(700, bucket, list(weak))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(5)
    edges, degrees = simhash.links(df, 3)
    got = {}
    for r in degrees.collect():
        got[r.fp] = got.get(r.fp, 0) + r.n
    want = {int(x): int(n) - 1 for x, n in zip(fps.view(np.int64), near.sum(axis=1)) if n > 1}
    assert got == want
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = [(place[r.u], place[r.v]) for r in edges.collect()]

    def labels(links):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(fps))]
    assert labels(pairs) == labels(zip(*np.nonzero(near)))
    signed = fps.view(np.int64)
    assert len(pairs) <= 20 * len(fps) and all(signed[a] > signed[b] for a, b in pairs)


def test_masks_cover_every_close_pair():
    rng = np.random.default_rng(1)
    masks = [m for _, _, m in simhash._finer({0: (0, [])}, [0], 3)]
    assert len(masks) == 20
    for _ in range(500):
        x = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(x & (m & (2 ** 64 - 1)) == 0 for m in masks)
