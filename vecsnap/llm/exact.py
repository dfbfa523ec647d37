"""Exact dedup by content sort.

Texts are range-partitioned on their digest at sampled splitters and sorted by digest, then by
the whole text, so equal texts become neighbours; neighbours are compared in full. A group of
copies larger than a range is subdivided by row, and the parts' counts are added afterwards.

Defined results: a null text counts as empty; rows without an id rank below all ids, and of equal
ids in one group any one row stays; repeated rows are copies; an empty table gives an empty
result. Columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsnap.llm.common import leading_bits, whole
from vecsnap.llm.splitters import default_pieces, sample_ranges


def exact_groups(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """``docs`` with keep_id, group_size, kept, text_sha256; the largest doc_id stays."""
    outputs = {"keep_id", "group_size", "kept", "text_sha256"}
    rows = docs.drop(*[c for c in docs.columns if c in outputs])
    rows = rows.withColumn("text_sha256", F.sha2(whole(), 256))
    rows = rows.withColumn("_point", leading_bits(F.col("text_sha256")))
    row_hash = F.xxhash64("doc_id", "text_sha256")
    weighed = rows.select("doc_id", "_point", "text_sha256", (F.octet_length(whole()) + 64).alias("_bytes"))
    ranges = sample_ranges(weighed, "_point", "_bytes", row_hash, pieces or default_pieces(docs))

    placed = ranges.assign(rows, "_point", row_hash)
    # One column for range and part, so the windows need no exchange of their own.
    placed = placed.withColumn("_slice", F.col("_range") * F.lit(1 << 31) + F.col("_part"))
    spread = placed.repartition("_slice").withColumn("_body", whole())
    # Window groups are runs of neighbours whose whole texts are equal, in the order of the sort.
    run = Window.partitionBy("_slice", "text_sha256", "_body").orderBy(F.col("doc_id").desc_nulls_last())
    all_rows = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        spread.withColumn("keep_id", F.max("doc_id").over(all_rows))
        .withColumn("group_size", F.count(F.lit(1)).over(all_rows))
        .withColumn("_first", F.row_number().over(run) == 1)
    )
    if not ranges.hot:
        return runs.withColumnRenamed("_first", "kept").drop("_point", "_range", "_part", "_slice", "_body")
    # The parts of the few subdivided contents (fewer than ranges) are put together.
    split = docs.sparkSession.createDataFrame([(v,) for v in sorted(ranges.hot)], "_point double")
    heads = (
        placed.select("doc_id", "text_sha256", "_point", "_part")
        .join(F.broadcast(split), "_point")
        .groupBy("text_sha256", "_part")
        .agg(F.max("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    )
    joint = heads.groupBy("text_sha256").agg(
        F.max("_id").alias("_keep"),
        F.sum("_n").alias("_size"),
        F.max_by("_part", F.struct(F.col("_id").isNotNull(), F.col("_id"), F.col("_part"))).alias("_home"),
    )
    # As many rows as subdivided digests.
    merged = runs.join(F.broadcast(joint.withColumnRenamed("text_sha256", "_sha")), F.col("text_sha256") == F.col("_sha"), "left")
    single = F.col("_sha").isNull()
    return (
        merged.withColumn("kept", F.col("_first") & (single | (F.col("_part") == F.col("_home"))))
        .withColumn("keep_id", F.when(single, F.col("keep_id")).otherwise(F.col("_keep")))
        .withColumn("group_size", F.when(single, F.col("group_size")).otherwise(F.col("_size")))
        .drop("_first", "_sha", "_keep", "_size", "_home", "_point", "_range", "_part", "_slice", "_body")
    )
