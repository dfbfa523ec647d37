"""Bit accounting: plug-in entropy of codes and bit-rate formulas."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE_KEY = ["k0", "k1", "wide"]


def code_histogram(codes: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Occurrences of every distinct code (partial counts are merged map side)."""
    return codes.groupBy(*by, *CODE_KEY).agg(F.count(F.lit(1)).alias("c"))


def code_entropy(codes: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Plug-in entropy in bits per code, per group: ``log2 n - (sum c log2 c) / n``."""
    c = F.col("c").cast("double")
    return (
        code_histogram(codes, by)
        .groupBy(*by)
        .agg(
            F.sum("c").alias("n_codes"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.sum(c * F.log2(c)).alias("_cl"),
        )
        .withColumn(
            "entropy_bits",
            F.greatest(F.lit(0.0), F.log2("n_codes") - F.col("_cl") / F.col("n_codes")),
        )
        .drop("_cl")
    )


# Codes counted exactly by the quick entropy: a hash sample of distinct codes, and frequent ones.
SAMPLE_CODES, FREQUENT_CODES, SAMPLE_ROWS = 16_384, 4_096, 65_536


def quick_entropy(
    codes: DataFrame, key: Sequence[str] = CODE_KEY, sample_codes: int = SAMPLE_CODES, sigmas: float = 5.0
) -> DataFrame:
    """Entropy of a very large code set without counting every code, and a bound of its error.

    One row: n_codes, about_distinct, entropy_bits, error_bits. A row sample proposes frequent codes,
    which are counted exactly. Of the others, those whose hash falls below a cut-off are counted
    exactly; their ``sum c log2 c`` is scaled up by the share of hashes (the coverage). The bound is
    ``sigmas`` deviations of that estimate, and 0 where every code was counted. Only codes below the
    cut-off and rows of frequent codes are exchanged; all parts merge map side.
    """
    rows = codes.select(*key)
    hashed = F.shiftrightunsigned(F.xxhash64(*key), 1)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*key), 0.02).alias("d")).first()
    n, about = facts["n"], facts["d"]
    fields = "n_codes bigint, about_distinct bigint, entropy_bits double, error_bits double"
    if not n:
        return codes.sparkSession.createDataFrame([(0, 0, 0.0, 0.0)], fields)
    share = 1.0 if about <= sample_codes else sample_codes / about
    frequent = None
    if share < 1.0:
        some = rows.where(F.rand(11) < min(1.0, SAMPLE_ROWS / n))
        top = some.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 8").orderBy(F.desc("c"), *key).limit(FREQUENT_CODES)
        found = top.select(*key).collect()
        if found:
            frequent = codes.sparkSession.createDataFrame(found, rows.schema).withColumn("_f", F.lit(True))
            frequent = frequent.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(key)})
            same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(key)])
            rows = rows.join(F.broadcast(frequent), same, "left")
    if frequent is None:
        rows = rows.withColumn("_f", F.lit(None).cast("boolean"))
    kept = rows.where(F.col("_f") | (hashed < F.lit(min(int(share * 2.0**63), 2**63 - 1))))
    c = F.col("c").cast("double")
    f = c * F.log2(c)
    sums = (
        kept.groupBy(*key, "_f").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(F.coalesce("_f", F.lit(False)).alias("frequent"))
        .agg(F.sum(f).alias("s"), F.sum(f * f).alias("q"), F.max(f).alias("top"))
        .collect()
    )
    total = variance = top = 0.0
    for r in sums:
        whole = r["frequent"] or share == 1.0
        total += r["s"] if whole else r["s"] / share
        if not whole:
            variance, top = r["q"] * (1 - share) / share**2, r["top"] / share
    error = 0.0 if share == 1.0 else (sigmas * variance**0.5 + top) / n
    bits = max(0.0, math.log2(n) - total / n)
    return codes.sparkSession.createDataFrame([(n, about, bits, error)], fields)


def storage_footprint(
    vectors: DataFrame, column: str, by: Sequence[str], coded_bpd: float = 2.2
) -> DataFrame:
    """Bytes of a stored vector table at fp16 / int8 / int4 / coded rate, per group."""
    elements = F.sum(F.size(column).cast("bigint"))
    out = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n_vectors"), elements.alias("n_values"))
    n = F.col("n_values")
    return (
        out.withColumn("fp16_bytes", n * 2.0)
        .withColumn("int8_bytes", n * 1.0)
        .withColumn("int4_bytes", n * 0.5)
        .withColumn("coded_bytes", n * (coded_bpd / 8.0))
        .withColumn("saving_pct", (1 - F.col("coded_bytes") / F.col("fp16_bytes")) * 100)
    )


def cache_gigabytes(
    tokens: DataFrame, n_tokens: str, layers: int = 32, kv_heads: int = 8, head_dim: int = 128
) -> DataFrame:
    """Size of a key/value cache of ``n_tokens`` tokens at each stored precision."""
    per_token = layers * 2 * kv_heads * head_dim
    gib = F.col(n_tokens) * float(per_token) / float(1024**3)
    return (
        tokens.withColumn("fp16_gb", gib * 2.0)
        .withColumn("int8_gb", gib)
        .withColumn("int4_gb", gib * 0.5)
        .withColumn("coded_gb", gib * (2.2 / 8.0))
        .withColumn("saving_pct", (1 - F.col("coded_gb") / F.col("fp16_gb")) * 100)
    )


def graph_codec_bits(dim: int, residual_bits: int) -> int:
    """7-bit vertex id and ``residual_bits`` per coordinate for each 22-block."""
    return math.ceil(dim / 22) * (7 + 22 * residual_bits)


def rotated_bpd(dim: int, bits: int) -> float:
    """Level bits, one sign bit per dimension, and two 32-bit row statistics."""
    return bits + 1 + 64.0 / dim
