"""Vector tables: parquet, word-vector text, key/value caches, derived fixtures."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsnap.operators.running import running_totals


def read_vectors(
    spark: SparkSession, path: str, column: str = "embedding", keep: list[str] | None = None
) -> DataFrame:
    """Vector table with only the wanted columns read from parquet."""
    df = spark.read.parquet(path)
    return df.select(*(keep or ["vec_id"]), column)


def require_dim(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Raise on the first vector of another length (checked where the rows are read)."""
    ok = F.size(column) == dim
    checked = F.when(ok, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected dim={dim}, got "), F.size(column).cast("string")))
    )
    return df.withColumn(column, checked)


def is_valid(dim: int, column: str = "embedding") -> Column:
    """No NULL, right length, no NULL / NaN / infinite element."""
    finite = F.forall(
        column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) == dim) & finite, F.lit(False))


def split_valid(df: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows): nothing is dropped silently."""
    return df.where(is_valid(dim, column)), df.where(~is_valid(dim, column))


NUMBER = r"(?i)^[-+]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?|nan|inf|infinity)$"


def read_word_vectors(
    spark: SparkSession, path: str, dim: int | None = None, n: int | None = None
) -> DataFrame:
    """Text lines ``word v1 v2 ...`` as ``(line, word, embedding)``.

    With ``dim``, lines need at least ``dim`` values and further ones are cut; lines with
    a value that is no number are skipped. ``n`` looks at the first ``n`` lines only.
    Line numbers follow the file name and the position in the file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")
    )
    if n is not None:
        lines = lines.orderBy("file", "at").limit(n)
    return parse_word_vectors(lines, "value", dim)


def parse_word_vectors(lines: DataFrame, text: str, dim: int | None = None) -> DataFrame:
    """Adds ``word`` and ``embedding`` to a table of text lines; malformed lines are left out."""
    # With a fixed length, everything after the last used value stays one unsplit token.
    tokens = F.split(F.trim(F.col(text)), r"\s+", -1 if dim is None else dim + 2)
    count = F.size(tokens) - 1
    values = F.transform(
        F.slice(tokens, F.lit(2), F.greatest(count, F.lit(0)) if dim is None else F.lit(dim)),
        # The pattern keeps words away from the cast, where each would raise and be caught.
        lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")),
    )
    out = lines.withColumn("word", tokens[0]).withColumn("embedding", values)
    if dim is not None:
        out = out.where(F.size("embedding") == dim)
    return out.where((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull()))


def write_word_vectors(df: DataFrame, path: str, word: str, column: str) -> None:
    text = F.concat_ws(" ", F.col(word), F.array_join(F.transform(column, lambda v: v.cast("string")), " "))
    df.select(text.alias("value")).write.mode("overwrite").text(path)


CACHE_COORDINATES = ["role", "layer", "batch", "head", "pos"]


def flatten_cache(df: DataFrame, tensor: str, keep: list[str] | None = None) -> DataFrame:
    """Nested ``(layer, batch, head, pos, value)`` arrays to one row per vector with its coordinates."""
    out = df.select(*(keep or []), F.col(tensor).alias("_t"))
    for name in ("layer", "batch", "head", "pos"):
        rest = [c for c in out.columns if c != "_t"]
        out = out.select(*rest, F.posexplode("_t").alias(name, "_t"))
    return out.withColumnRenamed("_t", "embedding")


def valid_tokens(cache: DataFrame, lengths: DataFrame, on: list[str], length: str = "seq_len") -> DataFrame:
    """Keep positions below the sequence length of their batch entry."""
    return cache.join(lengths.select(*on, length), on).where(F.col("pos") < F.col(length)).drop(length)


def write_cache(df: DataFrame, path: str, model_name: str, prompt: str, column: str = "embedding") -> None:
    """Cache as parquet partitioned by role and layer, and its one-row JSON description."""
    df.write.mode("overwrite").partitionBy("role", "layer").parquet(f"{path}/vectors")
    shapes = {
        r["role"]: [r["l"], r["b"], r["h"], r["p"], r["d"]]
        for r in df.groupBy("role")
        .agg(
            F.count_distinct("layer").alias("l"), (F.max("batch") + 1).alias("b"),
            (F.max("head") + 1).alias("h"), (F.max("pos") + 1).alias("p"),
            F.max(F.size(column)).alias("d"),
        ).collect()
    }
    element = df.schema[column].dataType.elementType
    meta = {
        "model_name": model_name,
        "prompt": prompt,
        "num_layers": max(s[0] for s in shapes.values()),
        "keys_shape": shapes.get("key", []),
        "values_shape": shapes.get("value", []),
        "dtype": "float32" if isinstance(element, T.FloatType) else "float64",
    }
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/metadata")


def read_cache(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    """Cache vectors; ``role`` prunes the partitions that are read."""
    df = spark.read.parquet(f"{path}/vectors")
    return df if role is None else df.where(F.col("role") == role)


def read_cache_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/metadata")


def cache_from_labels(embeddings: DataFrame, small_rows: int | None = None) -> DataFrame:
    """View a labelled vector table as a cache: layer = label, role by label, pos in id order."""
    counted = running_totals(
        embeddings, "vec_id", {"_p": F.lit(1).cast("bigint")}, ["label"], small_rows=small_rows
    )
    return counted.select(
        F.when(F.col("label") < 5, "key").otherwise("value").alias("role"),
        F.col("label").alias("layer"), F.lit(0).alias("batch"), F.lit(0).alias("head"),
        (F.col("_p") - 1).alias("pos"), "vec_id", "embedding",
    )


def gaussian_vectors(ids: DataFrame, id_col: str, dim: int, seed: int = 42, out: str = "embedding") -> DataFrame:
    """Standard-normal vectors from hashes of ``(id, coordinate, seed)``: the same on any partitioning."""

    def unit(i: Column, salt: int) -> Column:
        bits = F.xxhash64(F.col(id_col), i, F.lit(seed), F.lit(salt)).bitwiseAND((1 << 52) - 1)
        return (bits.cast("double") + 0.5) / float(1 << 52)

    def normal(i: Column) -> Column:
        return F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * math.pi * unit(i, 1))

    return ids.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal))
