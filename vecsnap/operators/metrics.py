"""Fidelity metrics of a reconstruction: MSE, SNR, cosine, closure, segment drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsnap.functions.arrays import dot, norm, sum_squares, vec


def row_errors(df: DataFrame, original: str = "embedding", rebuilt: str = "rebuilt") -> DataFrame:
    """Per-row sums every metric is built from (narrow; no shuffle)."""
    a, b = vec(original), F.col(rebuilt)
    gap = F.zip_with(a, b, lambda x, y: x - y)
    return (
        df.withColumn("signal", sum_squares(a))
        .withColumn("noise", sum_squares(gap))
        .withColumn("n_values", F.size(F.col(original)).cast("bigint"))
        .withColumn("cosine", dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12)))
        .withColumn("max_abs", F.array_max(F.transform(gap, lambda v: F.abs(v))))
        .drop(original, rebuilt)
    )


def snr_db(signal: Column, noise: Column, n: Column, floor: float = 1e-30, add: float = 0.0) -> Column:
    """``10 log10(mean signal / mean noise)``.

    ``floor`` bounds the noise from below, ``add`` is added to it; with both zero a
    perfect reconstruction gives infinity.
    """
    mse = noise / n + add
    if floor:
        mse = F.greatest(mse, F.lit(floor))
    value = 10 * F.log10((signal / n) / F.when(mse == 0, F.lit(None)).otherwise(mse))
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(value)


def norm_ratio_db(signal: Column, noise: Column) -> Column:
    """``20 log10(|a| / |a - b|)`` over the whole table."""
    return 20 * F.log10(F.sqrt(signal) / F.sqrt(noise))


def summarize(
    errors: DataFrame, by: Sequence[str] = (), floor: float = 1e-30, add: float = 0.0
) -> DataFrame:
    """MSE, SNR, mean cosine and largest error per group of ``by``."""
    sums = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.sum("signal").alias("_s"),
        F.sum("noise").alias("_e"),
        F.sum("n_values").alias("_n"),
        F.avg("cosine").alias("cosine"),
        F.max("max_abs").alias("max_abs"),
    )
    return sums.select(
        *by,
        "n_vectors",
        (F.col("_e") / F.col("_n")).alias("mse"),
        snr_db(F.col("_s"), F.col("_e"), F.col("_n"), floor, add).alias("snr_db"),
        norm_ratio_db(F.col("_s"), F.when(F.col("_e") > 0, F.col("_e"))).alias("norm_ratio_db"),
        "cosine",
        "max_abs",
    )


def status(snr: Column, exact_above: float = 100.0, stable_above: float = 20.0) -> Column:
    return (
        F.when(snr > exact_above, "BIT EXACT").when(snr > stable_above, "STABLE").otherwise("N/A")
    )


def max_difference(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Largest absolute element difference between two results joined on ``key``."""
    both = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key)
    gap = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    return both.agg(F.max(gap).alias("max_abs"))


def perplexity_delta(losses: DataFrame, by: str, variant: str, loss: str, base: str) -> DataFrame:
    """Perplexity ``exp(mean loss)`` per variant and its difference to ``base``, per ``by``."""
    ppl = losses.groupBy(by, variant).agg(F.exp(F.avg(loss)).alias("ppl"))
    reference = ppl.where(F.col(variant) == base).select(by, F.col("ppl").alias("base_ppl"))
    return ppl.join(reference, by).withColumn("ppl_delta", F.col("ppl") - F.col("base_ppl"))
