"""E8 nearest-point as a column expression and as a registered SQL function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from vecsnap.functions.arrays import argmax, sign, squared_distance, total
from vecsnap.kernels.lattice import e8_codebook, nearest_e8


def _even_sum(x: Column) -> Column:
    whole = F.transform(x, lambda v: F.rint(v))
    gap = F.zip_with(x, whole, lambda v, w: v - w)
    at = argmax(F.transform(gap, lambda g: F.abs(g)))
    moved = F.transform(
        whole, lambda w, i: w + F.when(i == at, sign(F.get(gap, i))).otherwise(F.lit(0.0))
    )
    return F.when(F.pmod(total(whole), F.lit(2.0)) != 0, moved).otherwise(whole)


def e8_nearest(df: DataFrame, column: str, out: str = "q") -> DataFrame:
    """Add the nearest E8 point of an 8-element array column, with built-ins only.

    The two cosets are materialized as columns of their own; one stage is the use
    for this form, multi-stage codecs run the Arrow kernel.
    """
    x = F.col(column)
    return (
        df.withColumn("_whole", _even_sum(x))
        .withColumn("_half", F.transform(_even_sum(F.transform(x, lambda v: v - 0.5)), lambda v: v + 0.5))
        .withColumn(
            out,
            F.when(
                squared_distance(x, F.col("_half")) < squared_distance(x, F.col("_whole")), F.col("_half")
            ).otherwise(F.col("_whole")),
        )
        .drop("_whole", "_half")
    )


@pandas_udf(T.ArrayType(T.DoubleType()))
def _e8_udf(x: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(x), dtype=object)
    known = np.flatnonzero(x.notna().to_numpy())
    if len(known):
        for i, point in zip(known, nearest_e8(np.stack(x.to_numpy()[known]).astype(float))):
            out[i] = point
    return out


def register(spark: SparkSession) -> None:
    """Register ``e8_nearest(array<double>)`` for SQL text; NULL gives NULL."""
    spark.udf.register("e8_nearest", _e8_udf)


def codebook_table(spark: SparkSession) -> DataFrame:
    """The 240 unit codewords as ``(id, x)``; fixed size, safe to broadcast."""
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(e8_codebook())]
    return spark.createDataFrame(rows, "id smallint, x array<double>")
