"""Nearest lattice points, codebooks and scalar column functions."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecsnap.functions import arrays as A
from vecsnap.functions import bits, lattice
from vecsnap.kernels.lattice import code_keys, e8_codebook, nearest_e8


def brute_e8(x):
    """Nearest E8 point by trying every near candidate of both cosets."""
    best = None
    for shift in (0.0, 0.5):
        low = np.floor(x - shift)
        for bump in itertools.product((0, 1), repeat=8):
            p = low + bump
            if p.sum() % 2 == 0:
                d = np.square(x - p - shift).sum()
                if best is None or d < best - 1e-12:
                    best = d
    return best


def test_nearest_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 8)) * 2
    got = nearest_e8(x)
    for row, q in zip(x, got):
        assert np.square(row - q).sum() == pytest.approx(brute_e8(row), abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=8, max_size=8))
def test_point_invariants(values):
    x = np.array([values])
    q = nearest_e8(x)
    doubled = 2 * q
    assert np.all(doubled == np.rint(doubled))
    assert len(set(np.mod(doubled, 2).ravel())) == 1  # all whole or all half
    assert np.mod(q.sum(), 2) == 0
    assert np.square(x - q).sum() <= 1 + 1e-9  # covering radius
    assert np.array_equal(nearest_e8(q), q)


def test_ties_and_zero():
    assert np.array_equal(nearest_e8(np.zeros((1, 8))), np.zeros((1, 8)))
    odd = np.array([[1.0, 0, 0, 0, 0, 0, 0, 0]])  # equal errors: first coordinate moves up
    assert nearest_e8(odd)[0].tolist() == [2.0, 0, 0, 0, 0, 0, 0, 0]
    halves = np.full((1, 8), 0.5)
    assert nearest_e8(halves)[0].tolist() == [0.5] * 8


def test_codebook_order():
    book = e8_codebook() * np.sqrt(2)
    assert book.shape == (240, 8)
    assert np.allclose(np.square(book).sum(axis=1), 2.0)
    assert book[0].tolist() == [1, 1, 0, 0, 0, 0, 0, 0]
    assert book[1].tolist() == [1, -1, 0, 0, 0, 0, 0, 0]
    assert book[112].tolist() == [0.5] * 8
    assert len({tuple(r) for r in book}) == 240


def test_code_keys_are_exact():
    codes = np.array([[1, -2, 3, 4, 5, 6, 7, 8], [1, -2, 3, 4, 5, 6, 7, 9], [1, 2, 3, 4, 5, 6, 7, 10**9]])
    k0, k1, wide = code_keys(codes)
    assert len(set(zip(k0, k1, wide))) == 3
    assert wide[0] is None and wide[2] is not None


def test_builtin_expression_equals_kernel(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.standard_normal((200, 8)) * 3, np.rint(rng.standard_normal((50, 8)) * 4) / 2])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    rows = lattice.e8_nearest(df, "x").orderBy("id").collect()
    assert np.array_equal(np.array([r["q"] for r in rows]), nearest_e8(x))
    lattice.register(spark)
    df.createOrReplaceTempView("points")
    rows = spark.sql("SELECT id, e8_nearest(x) AS q FROM points ORDER BY id").collect()
    assert np.array_equal(np.array([r["q"] for r in rows]), nearest_e8(x))


def test_codebook_table(spark):
    assert lattice.codebook_table(spark).count() == 240


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.0], [1.0, 2.0, 2.0])], "a array<double>, b array<double>")
    row = df.select(
        A.dot("a", "b").alias("dot"), A.norm("a").alias("norm"), A.squared_distance("a", "b").alias("d"),
        A.argmax("b").alias("arg"), A.mean("b").alias("mean"), A.std("b").alias("pop"),
        A.std("b", sample=True).alias("samp"), A.add("a", "b").alias("add"), A.subtract("a", "b").alias("sub"),
        A.scaled("a", 2.0).alias("two"), A.pad("a", 3, 8).alias("pad"), A.chunk("a", 3, 2).alias("chunk"),
        A.unchunk(A.chunk("a", 3, 2), 3).alias("back"), A.sign(F.lit(0.0)).alias("sign"),
        A.clip(F.lit(7.0), 0.0, 1.0).alias("clip"),
    ).first()
    assert (row["dot"], row["norm"], row["d"], row["arg"]) == (-5.0, 5.0, 44.0, 1)
    assert row["pop"] == pytest.approx(np.std([1, 2, 2])) and row["samp"] == pytest.approx(np.std([1, 2, 2], ddof=1))
    assert row["pad"] == [3.0, -4.0, 0, 0, 0, 0, 0, 0] and row["chunk"] == [[3.0, -4.0], [0.0, 0.0]]
    assert row["back"] == [3.0, -4.0, 0.0] and row["sign"] == 1.0 and row["clip"] == 1.0
    assert row["add"] == [4.0, -2.0, 2.0] and row["sub"] == [2.0, -6.0, -2.0] and row["two"] == [6.0, -8.0, 0.0]


def test_code_words(spark):
    words = bits.messages(spark.range(4096), "id")
    weights = {r["weight"]: r["count"] for r in words.groupBy("weight").count().collect()}
    assert weights == {0: 1, 8: 759, 12: 2576, 16: 759, 24: 1}


def test_sql_function_passes_null_through(spark):
    lattice.register(spark)
    rows = spark.sql("SELECT e8_nearest(x) AS q FROM VALUES (array(1.1D,0D,0D,0D,0D,0D,0D,0.9D)), (NULL) AS t(x)").collect()
    assert [r["q"] for r in rows] == [[1.0, 0, 0, 0, 0, 0, 0, 1.0], None]
