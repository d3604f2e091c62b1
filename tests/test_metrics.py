import itertools
import math
import random

import numpy as np
import pandas as pd

from lexicluster.functions.vectors import ln_factorial
from lexicluster.operators import metrics as M


def _mi_parts(a, b):
    n = len(a)
    ct = pd.crosstab(pd.Series(a), pd.Series(b)).to_numpy().astype(float)
    ra, rb = ct.sum(1), ct.sum(0)
    mi = sum(ct[i, j] / n * math.log(n * ct[i, j] / (ra[i] * rb[j])) for i in range(ct.shape[0]) for j in range(ct.shape[1]) if ct[i, j])
    h = lambda r: -sum(x / n * math.log(x / n) for x in r if x)
    emi = 0.0
    for ai in ra:
        for bj in rb:
            for nij in range(max(1, int(ai + bj - n)), int(min(ai, bj)) + 1):
                lp = (math.lgamma(ai + 1) + math.lgamma(bj + 1) + math.lgamma(n - ai + 1) + math.lgamma(n - bj + 1)
                      - math.lgamma(n + 1) - math.lgamma(nij + 1) - math.lgamma(ai - nij + 1) - math.lgamma(bj - nij + 1)
                      - math.lgamma(n - ai - bj + nij + 1))
                emi += nij / n * math.log(n * nij / (ai * bj)) * math.exp(lp)
    return mi, h(ra), h(rb), emi


def test_hungarian_vs_brute_force():
    rng = random.Random(3)
    for k in range(1, 7):
        for _ in range(5):
            w = [[rng.randint(0, 20) for _ in range(k)] for _ in range(k)]
            best = max(sum(w[i][p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
            assert M.hungarian_max(w)[0] == best


def test_scores_against_formulas(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 4, 300)
    pred = np.where(rng.random(300) < 0.6, label, rng.integers(0, 5, 300))
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "pred": pred.astype(int), "label": label.astype(int)}))
    s = M.cluster_scores(df).first()
    mi, ha, hb, emi = _mi_parts(label, pred)
    assert abs(s["nmi"] - mi / math.sqrt(ha * hb)) < 1e-9
    assert abs(s["ami"] - (mi - emi) / (max(ha, hb) - emi)) < 1e-9
    # relabelling the clusters changes neither accuracy nor NMI
    df2 = df.withColumn("pred", (df.pred + 2) % 5)
    s2 = M.cluster_scores(df2).first()
    assert abs(s2["acc"] - s["acc"]) < 1e-12 and abs(s2["nmi"] - s["nmi"]) < 1e-12


def test_ami_identity_and_single_cluster(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3) for i in range(30)], "id int, pred int, label int")
    assert abs(M.adjusted_mutual_information(df).first()["ami"] - 1.0) < 1e-9
    one = spark.createDataFrame([(i, 0, 0) for i in range(10)], "id int, pred int, label int")
    assert M.normalized_mutual_information(one).first()["nmi"] == 1.0
    assert M.adjusted_mutual_information(one).first()["ami"] == 1.0


def test_ln_factorial(spark):
    df = spark.range(0, 400).select(ln_factorial("id").alias("v"), "id")
    for r in df.collect():
        assert abs(r["v"] - math.lgamma(r["id"] + 1)) <= 1e-9 * max(1.0, abs(r["v"]))
