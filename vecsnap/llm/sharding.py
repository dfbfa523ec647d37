"""Shards of near equal bytes by sampled splitters.

Size-weighted samples of the content key give range boundaries, exact sums per range place
every record on one global line of bytes, and the line is cut into equal shares. A cut inside
a small group of equal texts moves to the group's nearer end; a group larger than
``GROUP_SHARE`` of a shard is cut where the cut falls.

Defined results: a null text has no bytes (size 8) and forms one group with no other text, an
empty one has size 8 too; null and repeated ids are ordinary rows; an empty table gives an empty
result. Columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsnap.llm.common import leading_bits, stored
from vecsnap.llm.splitters import default_pieces, sample_ranges

RECORD_BYTES = 8
GROUP_SHARE = 0.02


def shard(docs: DataFrame, n_shards: int = 24, keep: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    """``doc_id``, size, text_crc32, law, shard, slot, grown_shard, and the columns ``keep``."""
    spark = docs.sparkSession
    digest = F.coalesce(F.md5("text"), F.lit("f" * 32))
    rows = docs.select(
        "doc_id",
        *keep,
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        digest.alias("_digest"),
        leading_bits(digest).alias("_point"),
    )
    rows = stored(rows, "shard-rows")
    row_hash = F.xxhash64("doc_id", "_digest")
    ranges = sample_ranges(rows, "_point", "size", row_hash, pieces or default_pieces(docs))
    placed = ranges.assign(rows, "_point", row_hash)
    # One row per range, a number set by ``pieces``.
    sums = placed.groupBy("_range", "_part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    total, line, count, offsets = sum(r["b"] for r in sums), 0, 0, []
    for r in sorted(sums, key=lambda r: (r["_range"], r["_part"])):
        offsets.append((r["_range"], r["_part"], line, count))
        line, count = line + r["b"], count + r["n"]
    table = spark.createDataFrame(offsets, "_range int, _part int, _bytes_before bigint, _rows_before bigint")
    order = Window.partitionBy("_range", "_part").orderBy("_point", "_digest", "doc_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    lined = (
        placed.withColumn("_in_bytes", F.sum("size").over(run) - F.col("size"))
        .withColumn("_in_rows", F.row_number().over(order) - 1)
        .join(F.broadcast(table), ["_range", "_part"])
        .withColumn("_start", F.col("_bytes_before") + F.col("_in_bytes"))
        .withColumn("_rank", F.col("_rows_before") + F.col("_in_rows"))
        .drop("_range", "_part", "_in_bytes", "_in_rows", "_bytes_before", "_rows_before")
    )
    lined = stored(lined, "shard-line")

    cuts = _cuts(lined, total, n_shards)
    bounds = sorted(set(cuts))
    first = sorted({(b, max(i + 1 for i, c in enumerate(cuts) if c == b)) for b in bounds})
    numbered = F.lit(0)
    out = lined.withColumn("_start_d", F.col("_start").cast("double"))
    if bounds:
        splits = [-math.inf, *map(float, bounds), math.inf]
        out = Bucketizer(splits=splits, inputCol="_start_d", outputCol="_between").transform(out)
        numbered = F.array(F.lit(0), *[F.lit(n) for _, n in first])[F.col("_between").cast("int")]
    out = out.withColumn("shard", numbered)
    starts = out.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return (
        out.join(F.broadcast(starts), "shard")  # n_shards rows at most
        .withColumn("slot", F.col("_rank") - F.col("_first"))
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select("doc_id", *keep, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


def _cuts(lined: DataFrame, total: int, n_shards: int) -> list[int]:
    """Byte positions of the ``n_shards - 1`` cuts, moved off small groups of equal texts."""
    ideal = [total * i // n_shards for i in range(1, n_shards)] if total else []
    if not ideal:
        return []
    points = F.array(*[F.lit(c) for c in ideal])
    end = F.col("_start") + F.col("size")
    crossed = F.exists(points, lambda c: (c > F.col("_start")) & (c < end))
    hit = lined.where(crossed).select("_digest").distinct()  # one group per cut at most
    groups = (
        lined.join(F.broadcast(hit), "_digest")
        .groupBy("_digest")
        .agg(F.min("_start").alias("lo"), F.max(end).alias("hi"))
        .collect()
    )
    between = [(r["lo"], r["hi"]) for r in groups]
    # A cut between two rows of one group crosses no row; the row that starts there tells.
    edge = lined.where(F.array_contains(points, F.col("_start"))).select("_digest").distinct()
    for r in lined.join(F.broadcast(edge), "_digest").groupBy("_digest").agg(
        F.min("_start").alias("lo"), F.max(end).alias("hi")
    ).collect():
        between.append((r["lo"], r["hi"]))
    out = []
    for cut in ideal:
        lo, hi = next(((a, b) for a, b in between if a < cut < b), (cut, cut))
        whole = hi - lo <= GROUP_SHARE * total / n_shards
        if not whole:
            row = lined.where((F.col("_start") <= cut) & (end > cut)).select("_start", end.alias("e")).first()
            lo, hi = row["_start"], row["e"]
        out.append(lo if cut - lo <= hi - cut else hi)
    return out


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, rows in slot order."""
    rows = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
