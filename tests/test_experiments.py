"""Experiment tables: shapes, nesting of staged fits, and the rate search."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from vecsnap.codecs.direction import DirectionCodec
from vecsnap.codecs.hotblock import HotBlockCodec
from vecsnap.codecs.layered import LayeredCodec
from vecsnap.operators import metrics
from vecsnap.plans import experiments as X


def test_prefixes_are_shorter_fits(vectors):
    long = X.prefix_models(LayeredCodec("block", 64, 3).fit(vectors))
    assert long[2].scales == LayeredCodec("block", 64, 2).fit(vectors).scales
    hot = X.prefix_models(HotBlockCodec(64, 3).fit(vectors))
    assert hot[2] == HotBlockCodec(64, 2).fit(vectors)
    snr = X.config_snr(long, vectors, "embedding", 64)
    one = metrics.summarize(long[1].errors(vectors)).first()["snr_db"]
    assert snr["1"] == pytest.approx(one)
    rates = X.prefix_rates(long[2], vectors, "embedding")
    assert rates[2] == pytest.approx(long[2].measure(vectors).first()["total_bpd"])


def test_targets_share_a_fit(vectors):
    two = LayeredCodec("dual", 64, 4).fit_targets(vectors, [3.0, 5.0])
    assert two[1] == LayeredCodec("dual", 64, 4, 5.0).fit(vectors)
    rates = X.mixed_rates({"a": two[0], "b": two[1]}, vectors, "embedding")
    assert rates["b"] == pytest.approx(two[1].measure(vectors).first()["total_bpd"])


def test_rate_grid(spark):
    needs = spark.createDataFrame([("key", 64, 3.0), ("value", 64, 3.0), ("plain", 22, 3.0)], "role string, dim int, target_bpd double")
    rows = X.rate_grid(needs).collect()
    assert rows and all(0 <= r["norm_bits"] <= 24 for r in rows)
    assert {r["stages"] for r in rows if r["role"] == "key"} <= {2, 3, 4}
    for r in rows:
        blocks = math.ceil(r["dim"] / 8)
        bits = blocks * r["stages"] * (math.log2(240) + r["norm_bits"]) + r["sketch_rank"]
        assert bits == pytest.approx(r["target_bpd"] * r["dim"])


def test_search_finds_the_best(vectors):
    model, ranked = X.search_rate(vectors, vectors, 64, 3.0, "value", fit_samples=500, search_samples=500)
    rows = ranked.orderBy("place").collect()
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert model.bits_per_dim() == pytest.approx(3.0)
    best = rows[0]
    alone = DirectionCodec(
        64, best["stages"], best["norm_bits"], use_sketch=best["sketch_rank"] > 0,
        sketch_rank=best["sketch_rank"], fit_samples=500,
    ).fit(vectors)
    assert dataclasses.asdict(alone) == dataclasses.asdict(model)
    snr = metrics.summarize(model.errors(vectors), floor=0, add=1e-12).first()["snr_db"]
    assert snr == pytest.approx(best["snr_db"], abs=1e-6)
    with pytest.raises(RuntimeError):
        X.search_rate(vectors, vectors, 64, 0.5, "key")


def test_search_with_queries_and_ladder(vectors):
    target, model, ranked = X.search_ladder(
        vectors, vectors, 64, role="key", queries=vectors, targets=(30.0, 3.0), fit_samples=200, search_samples=100
    )
    assert target == 3.0 and ranked.where("score > 0").count() == 0
    assert model.bits_per_dim() == pytest.approx(3.0)


def test_winners_and_pivot(spark):
    rows = [(4.0, "hotblock", 1.0), (4.0, "block", 0.5), (6.0, "hotblock", 2.0), (6.0, "block", 52.0)]
    df = spark.createDataFrame(rows, "target_bpd double, version string, snr_db double")
    assert {r["target_bpd"]: r["winner"] for r in X.winners(df).collect()} == {4.0: "hotblock", 6.0: "block"}
    tiers = spark.createDataFrame([("a", "extreme", 1.0), ("a", "loose", 3.0)], "version string, tier string, snr_db double")
    assert X.tier_pivot(tiers).first()[:] == ("a", 1.0, None, 3.0)


def test_reshape_dim(vectors):
    """Every value of every vector is used at any length, and ids stay unique."""
    source = {r["vec_id"]: list(r["embedding"]) for r in vectors.collect()}
    for dim in (8, 22, 64, 100):
        rows = X.reshape_dim(vectors, dim).collect()
        pieces = -(-64 // dim)
        assert len({r["vec_id"] for r in rows}) == len(rows) == pieces * len(source)
        for r in rows:
            whole, k = source[r["vec_id"] // pieces], r["vec_id"] % pieces
            assert list(r["embedding"]) == [whole[(k * dim + i) % 64] for i in range(dim)]
