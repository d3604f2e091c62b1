import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexicluster.functions import vectors as V
from lexicluster.operators import windows as W


def _events(spark, n=2000):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))   # one group holds ~40 %
    return pd.DataFrame({"id": np.arange(n), "g": g, "t": rng.permutation(n), "v": rng.random(n).round(3)})


def test_prefix_scan_partition_invariant(spark):
    pdf = _events(spark)
    exp = pdf.sort_values(["g", "t"]).assign(cum=lambda d: d.groupby("g")["v"].cumsum())
    exp = dict(zip(exp["id"], exp["cum"]))
    for parts in (1, 4, 17):
        df = spark.createDataFrame(pdf).repartition(parts)
        out = W.prefix_scan(df, ["g"], ["t"], ["v"], ["cum"]).select("id", "cum").collect()
        assert len(out) == len(pdf)
        assert max(abs(r["cum"] - exp[r["id"]]) for r in out) < 1e-9


def test_global_index_and_minibatches(spark):
    df = spark.range(0, 1000).repartition(7)
    r = W.assign_minibatches(df, "id", 64).collect()
    assert all(x["batch"] == x["id"] // 64 for x in r)


def test_stratified_sample_exact(spark):
    pdf = _events(spark).rename(columns={"g": "label"})
    df = spark.createDataFrame(pdf)
    sizes = F.when(F.col("label") == "hot", 300).otherwise(50)
    got = sorted(r["id"] for r in W.stratified_sample(df, "id", "label", sizes, seed=7, strict=True).collect())
    key = df.withColumn("h", W.hash_key("id", 7)).toPandas().sort_values(["h", "id"])
    exp = []
    for lab, grp in key.groupby("label"):
        exp += list(grp["id"].head(300 if lab == "hot" else 50))
    assert got == sorted(exp)


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 6.0],)], "x array<double>")
    r = df.select(V.layer_norm("x").alias("a"), V.layer_norm("x", 1e-6, 1).alias("b"), V.l2_normalize("x").alias("c")).first()
    x = np.array([1.0, 2.0, 3.0, 6.0])
    assert np.allclose(r["a"], (x - x.mean()) / x.std())
    assert np.allclose(r["b"], (x - x.mean()) / (x.std(ddof=1) + 1e-6))
    assert np.allclose(r["c"], x / np.linalg.norm(x))
    cs = spark.createDataFrame([([0.0, 0.0], [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]])], "x array<double>, c array<array<double>>")
    row = cs.select(V.nearest_center("x", F.col("c")).alias("n"), V.student_t_assignment("x", F.col("c")).alias("q")).first()
    assert row["n"]["center_id"] == 0                         # tie between 0 and 2 → lowest id
    assert abs(sum(row["q"]) - 1) < 1e-12
    p = cs.select(V.target_distribution(V.student_t_assignment("x", F.col("c")), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("p")).first()["p"]
    assert abs(sum(p) - 1) < 1e-12
