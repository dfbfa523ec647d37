"""The sampled entropy against the exact one."""

import math
from collections import Counter

import numpy as np
import pytest

from vecsnap.operators.entropy import quick_entropy


@pytest.mark.parametrize("kind", ["zipf", "uniform", "hot", "single"])
def test_within_its_bound(spark, kind):
    rng = np.random.default_rng(3)
    x = {"zipf": rng.zipf(1.4, 60_000) % 50_000, "uniform": rng.integers(0, 40_000, 60_000),
         "hot": np.where(rng.random(60_000) < 0.4, 7, rng.integers(0, 30_000, 60_000)), "single": np.full(5000, 3)}[kind]
    df = spark.createDataFrame([(int(v), None if v % 5 == 0 else "w") for v in x], "a int, b string").repartition(4)
    counts = np.array(list(Counter(x.tolist()).values()), dtype=float)
    exact = math.log2(len(x)) - (counts * np.log2(counts)).sum() / len(x)
    r = quick_entropy(df, ["a", "b"], sample_codes=1000).first()
    assert r["n_codes"] == len(x) and abs(r["entropy_bits"] - exact) <= r["error_bits"] + 1e-9
    assert r["error_bits"] < 0.35 and abs(r["about_distinct"] - len(counts)) <= 0.1 * len(counts) + 1
    whole = quick_entropy(df, ["a", "b"]) if kind == "single" else quick_entropy(df, ["a", "b"], sample_codes=10**6)
    assert whole.first()["error_bits"] == 0.0 and whole.first()["entropy_bits"] == pytest.approx(exact)


def test_nothing(spark):
    assert tuple(quick_entropy(spark.createDataFrame([], "a int"), ["a"]).first()) == (0, 0, 0.0, 0.0)
