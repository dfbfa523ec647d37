"""Online encoding as a streaming job, and drift of a finished table; state is kept in ``keyed.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecsnap.codecs.base import ModelBase
from vecsnap.operators.metrics import summarize


def encode_stream(
    vectors: DataFrame, model: ModelBase, path: str, checkpoint: str, column: str = "embedding"
) -> StreamingQuery:
    """Encode arriving vectors with a fixed model (its stored cut-offs) into parquet."""
    return (
        model.encode(vectors, column)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drift_by_segment(errors: DataFrame, segment: str) -> DataFrame:
    """SNR per segment and its distance to the first segment."""
    facts = summarize(errors, [segment])
    first = facts.agg(F.min_by("snr_db", segment).alias("first_snr")).withColumn("_one", F.lit(1))
    return (
        facts.withColumn("_one", F.lit(1))
        .join(F.broadcast(first), "_one")
        .select(segment, "n_vectors", "snr_db", (F.col("snr_db") - F.col("first_snr")).alias("drift_db"))
    )
