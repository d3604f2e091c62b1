"""Cases that went wrong once."""
import glob
import zipfile

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_oracles_and_tokens_need_no_spark_jar(spark, monkeypatch):
    import __spark_entry__ as E
    from lexicluster.plans import fixtures as fx
    from lexicluster.plans import registry
    monkeypatch.setattr(glob, "glob", lambda *a, **k: [])
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert set(registry.ORACLES) <= set(E.oracle_sql())
    assert fx.tokens(spark, SF).count() > 0


def test_one_broken_oracle_does_not_hide_the_others(monkeypatch):
    from lexicluster.plans import registry
    registry.load_all()
    monkeypatch.setitem(registry.ORACLES, "broken", lambda: 1 / 0)
    with pytest.warns(UserWarning):
        out = registry.oracle_sql()
    assert "broken" not in out and len(out) > 100


@pytest.mark.parametrize("op", ["sum", "max"])
def test_prefix_scan_null_groups(spark, op):
    from lexicluster.operators.windows import prefix_scan
    rows = [(g, i, float(i % 7)) for g in (None, "a", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = prefix_scan(df, ["g"], ["i"], ["v"], ["c"], op).groupBy("g").agg(F.max("c").alias("c"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sum(i % 7 for i in range(3000)) if op == "sum" else 6
    assert {r.g: (r.c, r.n) for r in got} == {g: (want, 3000) for g in (None, "a", "b")}


def test_seeded_rows_keep_their_label(spark):
    from lexicluster.plans import registry
    registry.load_all()
    got = {r[0]: r[1] for r in registry.QUERIES["seeded_dcn_fit"](spark, SF).collect()}
    assert float(got["seeds_off_label"]) == 0


def test_dec_targets_stay_between_refreshes(spark):
    import numpy as np
    from lexicluster.operators import deep as D
    from lexicluster.plans import fixtures as fx
    f = fx.feat(spark, SF).withColumnRenamed("vec_id", "id").limit(60).persist()
    X = np.array([r.x for r in f.orderBy("id").collect()])
    C0 = X[:4].copy()
    seen = []
    D.dec_refine(f, C0, max_steps=3, update_interval=10, tol=0.0, lr=0.05, metrics=seen)
    C, state = C0.copy(), (np.zeros_like(C0), np.zeros_like(C0), 0)
    q = D.soft_assign(X, C)[2]
    p = D.target_from_q(q, q.sum(0))
    import pandas as pd
    want = []
    for _ in range(3):
        g, loss = D._dec_batch((C, None, len(X)), X, None, pd.DataFrame({"p": list(p)}))
        step, state = D._adam(state, g.reshape(C.shape), 0.05)
        C = C - step
        want.append(loss)
    assert [v for k, _, v in seen if k == "bce_loss"] == pytest.approx(want)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from lexicluster import session

    class Conf:
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
