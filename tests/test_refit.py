"""Refits from stored slices against plain quantiles of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsnap.codecs.hotblock import robust_scale
from vecsnap.operators.refit import RefitStore, refit_robust_scale

PROBS = [0.0, 0.001, 0.25, 0.5, 0.93, 1.0]


@pytest.mark.parametrize("shape, buffer_values", [("smooth", 40), ("ties", 10**6), ("heavy", 40), ("shifted", 10**6)])
def test_quantiles_after_appends(spark, tmp_path, shape, buffer_values):
    rng = np.random.default_rng(2)
    store = RefitStore(spark, str(tmp_path), slices=12, buffer_values=buffer_values)
    seen = []
    for batch in range(3):
        x = rng.standard_normal(800)
        if shape == "ties":
            x = np.round(x)
        if shape == "heavy":
            x[:300] = 0.25
        if shape == "shifted":
            x = x + 10 * batch
        rows = [(int(i % 2), float(v)) for i, v in enumerate(x)] + [(0, None), (1, float("nan"))]
        store.append(spark.createDataFrame(rows, "g int, v double").repartition(3), "v", "g")
        seen += rows[:-2]
        if batch == 1:
            continue
        got, near = store.quantiles(PROBS), store.quantiles([0.5, 0.9], around={0: 0.25, 1: -0.5})
        for g, middle in ((0, 0.25), (1, -0.5)):
            held = np.array([v for k, v in seen if k == g])
            assert np.allclose(got[g], np.quantile(held, PROBS), rtol=1e-12, atol=1e-15)
            assert np.allclose(near[g], np.quantile(np.abs(held - middle), [0.5, 0.9]), rtol=1e-12, atol=1e-15)
    facts = {r["grp"]: r for r in store.moments().collect()}
    for g in (0, 1):
        held = np.array([v for k, v in seen if k == g])
        assert facts[g]["n"] == len(held) and facts[g]["mean"] == pytest.approx(held.mean())
        assert facts[g]["deviation"] == pytest.approx(held.std()) and facts[g]["high"] == held.max()


def test_a_refit_equals_a_full_fit(spark, vectors, tmp_path):
    """After an append, medians of all dimensions are exactly those of a fit on all rows."""
    store = RefitStore(spark, str(tmp_path), slices=32)
    for half in (0, 1):
        part = vectors.where(F.pmod("vec_id", F.lit(2)) == half)
        store.append(part.select(F.posexplode("embedding").alias("pos", "v")), "v", "pos")
    assert refit_robust_scale(store) == robust_scale(vectors, "embedding", 500)


def test_a_refit_reads_little(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").selectExpr("l_orderkey", "l_extendedprice AS v")
    store = RefitStore(spark, str(tmp_path), slices=48)
    for half in (0, 1):
        store.append(df.where(F.pmod("l_orderkey", F.lit(2)) == half))
    got = store.quantiles([0.25, 0.5, 0.999])[0]
    want = df.selectExpr("percentile(v, array(0.25, 0.5, 0.999))").first()[0]
    assert got == pytest.approx(want, rel=1e-14)
    held = store.held()
    assert held.rows == 600_000 or held.rows == df.count()
    assert store.reads.rows < 0.3 * held.rows and store.reads.bytes < 0.3 * held.bytes


def test_an_unfinished_append_does_not_count(spark, tmp_path):
    store = RefitStore(spark, str(tmp_path), slices=3)
    store.append(spark.createDataFrame([(float(i),) for i in range(11)], "v double"))
    lost = spark.createDataFrame([(0, 99.0, 0)], "grp int, v double, slice int")
    lost.write.partitionBy("slice").parquet(f"{tmp_path}/values/part=0-lost")
    assert store.quantiles([0.5, 1.0]) == {0: [5.0, 10.0]}
