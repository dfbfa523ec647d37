"""Deterministic sampling, shuffling and splitting by hashed identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsnap.operators.quantiles import order_statistic
from vecsnap.operators.running import running_totals


def hash_order(id_col: str, seed: int) -> Column:
    """A reproducible pseudo-random order key of a row (hex text, uniform)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hash: a seeded sample without replacement.

    One pass counts the rows by bit length of the hash. The shortest length that
    leaves at least ``n`` rows cuts the table to at most a few times ``n`` before the
    ordered limit, so its merge does not grow with the number of partitions.
    """
    key = hash_order(id_col, seed)
    bits = F.length(F.bin(F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint")))
    sizes = df.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).orderBy("bits").collect()
    if sum(r["n"] for r in sizes) <= n:
        return df
    kept = 0
    for r in sizes:
        kept += r["n"]
        if kept >= n:
            break
    return df.where(bits <= r["bits"]).orderBy(key, id_col).limit(n)


def hash_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """All rows in seeded pseudo-random order (range-partitioned sort)."""
    return df.orderBy(hash_order(id_col, seed), id_col)


def split_by_position(
    df: DataFrame, id_col: str, train_share: float = 0.2, min_train: int = 200, cal_rows: int = 256
) -> DataFrame:
    """Label rows ``train`` / ``cal`` / ``test`` by position in id order.

    The first ``max(min_train, share * n)`` rows train; calibration is the first
    ``cal_rows`` rows after them (a subset of the held-out rows, flagged on its own).
    Cut positions are found by order statistics instead of numbering the rows.
    """
    n = df.count()
    n_train = min(n, max(min_train, int(n * train_share)))
    n_cal = min(n, n_train + cal_rows)
    last_train = int(order_statistic(df, id_col, n_train, n))
    last_cal = int(order_statistic(df, id_col, n_cal, n))
    return df.withColumn(
        "part",
        F.when(F.col(id_col) <= last_train, "train")
        .when(F.col(id_col) <= last_cal, "cal")
        .otherwise("test"),
    )


def positions(df: DataFrame, id_col: str, seed: int | None = None, small_rows: int | None = None) -> DataFrame:
    """Add the 1-based ``position`` of each row in id order (distributed row number)."""
    return running_totals(df, id_col, {"position": F.lit(1).cast("bigint")}, small_rows=small_rows)
