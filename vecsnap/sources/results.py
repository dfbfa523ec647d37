"""Result records, compressed payloads and fitted models on storage."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsnap.codecs.base import ModelBase

RESULT_SCHEMA = (
    "Model string, Version string, Tier string, BPD double, SNR double, "
    "`Base PPL` double, `Quant PPL` double, `PPL Delta` double"
)


def read_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Experiment records: one JSON array per file, or JSON lines; not both in one folder.

    A multi-line read of JSON lines would give the first record of each file only.
    """
    value = F.trim("value")
    arrays, lines = (
        spark.read.text(path)
        .where(value != "")
        .agg(F.count_if(value.startswith("[")), F.count_if(value.startswith("{") & value.endswith("}")))
        .first()
    )
    if arrays and lines and not _all_files_hold_arrays(spark, path):
        raise ValueError(f"{path} mixes arrays and JSON lines")
    return spark.read.schema(schema).json(path, multiLine=arrays > 0)


def _all_files_hold_arrays(spark: SparkSession, path: str) -> bool:
    """Arrays may hold one whole record per line, but then each file has a line that opens one."""
    opens = F.max(F.trim("value").startswith("[")).alias("opens")
    files = spark.read.text(path).where(F.trim("value") != "").groupBy(F.col("_metadata.file_path")).agg(opens)
    return files.where(~F.col("opens")).isEmpty()


def write_results(df: DataFrame, path: str) -> None:
    """Records as JSON lines, written by the tasks that hold them."""
    df.write.mode("overwrite").json(path)


def code_table(encoded: DataFrame, key: str, blocks: int) -> DataFrame:
    """Long form of a layered payload: ``(key, chunk_id, stage, code)``."""
    stages = encoded.select(key, F.posexplode("codes").alias("stage", "_c"))
    chunk = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("chunk_id")
    return stages.select(key, "stage", "_c", chunk).select(
        key, "chunk_id", "stage", F.slice("_c", F.col("chunk_id") * 8 + 1, F.lit(8)).alias("code")
    )


def sum_codes(codes: DataFrame, key: str, scales: tuple[float, ...]) -> DataFrame:
    """Residual blocks from the long code table: sum over stages of ``code / (2 scale)``."""
    scale = F.element_at(F.array(*[F.lit(2.0 * s) for s in scales]), F.col("stage") + 1)
    part = codes.select(
        key, "chunk_id", "stage", F.transform("code", lambda c: c.cast("double") / scale).alias("x")
    )
    sums = [F.sum(F.get("x", F.lit(i))) for i in range(8)]
    return part.groupBy(key, "chunk_id").agg(F.array(*sums).alias("x"))


def write_payload(df: DataFrame, path: str, narrow: str | None = "int") -> None:
    """Compressed payload as parquet.

    ``narrow`` stores lattice codes in the smaller integer type; a code that does not
    fit fails the write (ANSI cast) instead of being changed.
    """
    if narrow and "codes" in df.columns and "bigint" in dict(df.dtypes)["codes"]:
        wide = dict(df.dtypes)["codes"]
        df = df.withColumn("codes", F.col("codes").cast(wide.replace("bigint", narrow)))
    df.write.mode("overwrite").parquet(path)


def write_code_table(codes: DataFrame, path: str) -> None:
    """Long code table partitioned by stage, so a partial decode reads fewer stages."""
    codes.write.mode("overwrite").partitionBy("stage").parquet(path)


def _model_kinds() -> dict[str, type]:
    from vecsnap.codecs import direction, graphcode, hotblock, layered, scalar

    return {
        c.__name__: c
        for c in (
            layered.LayeredModel, hotblock.HotBlockModel, direction.DirectionModel,
            scalar.ScalarModel, scalar.RotatedModel, scalar.BlockMeanModel, graphcode.GraphModel,
        )
    }


def _freeze(value):
    return tuple(_freeze(v) for v in value) if isinstance(value, list) else value


def model_from_json(text: str) -> ModelBase:
    from vecsnap.codecs.hotblock import HotStage
    from vecsnap.codecs.layered import Layer

    data = json.loads(text)
    cls = _model_kinds()[data.pop("model")]
    data = {k: _freeze(v) for k, v in data.items()}
    if cls.__name__ == "LayeredModel":
        data["layers"] = tuple(Layer(**layer) for layer in data["layers"])
    if cls.__name__ == "HotBlockModel":
        data["stages"] = tuple(HotStage(**stage) for stage in data["stages"])
    return cls(**data)


def model_to_json(model: ModelBase) -> str:
    return json.dumps({"model": type(model).__name__, **dataclasses.asdict(model)})


def save_model(spark: SparkSession, model: ModelBase, path: str) -> None:
    """A fitted model (scalars and vector-length tuples) as one text row."""
    spark.createDataFrame([(model_to_json(model),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def load_model(spark: SparkSession, path: str) -> ModelBase:
    return model_from_json(spark.read.text(path).first()["value"])

