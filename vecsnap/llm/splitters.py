"""Sampled splitters: weighted key samples give the boundaries of a range partitioning.

A key is a double (52 bits of a content digest). A value that fills several ranges alone, one
large group of copies, cannot be cut by key; its rows are subdivided by a second hash instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import uniform

# Expected sample rows per range; the sample on the driver is at most twice this number of
# rows per range, whatever the table's size.
SAMPLE_PER_RANGE = 32


@dataclass
class Ranges:
    """Boundaries, and the number of parts of each value that is larger than a range."""

    cuts: list[float]
    hot: dict[float, int]

    def assign(self, df: DataFrame, key: str, row_hash: Column) -> DataFrame:
        """Add ``_range`` and ``_part``: equal keys share both, but for the hot values.

        Sorted by ``(_range, _part, key)`` equal keys stay adjacent.
        """
        cuts = sorted(set(self.cuts) | set(self.hot))
        if cuts:
            splits = [-math.inf, *cuts, math.inf]
            df = Bucketizer(splits=splits, inputCol=key, outputCol="_range").transform(df)
        else:
            df = df.withColumn("_range", F.lit(0.0))
        df = df.withColumn("_range", F.col("_range").cast("int"))
        if not self.hot:
            return df.withColumn("_part", F.lit(0))
        rows = [(v, n) for v, n in sorted(self.hot.items())]
        hot = df.sparkSession.createDataFrame(rows, "_hot double, _parts int")
        # One row per hot value, and at most one hot value per range.
        out = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        part = F.when(F.col("_hot").isNull(), F.lit(1 << 30)).otherwise(F.pmod(row_hash, F.col("_parts")).cast("int"))
        return out.withColumn("_part", part).drop("_hot", "_parts")


def _boundaries(rows: list[tuple[float, float]], pieces: int) -> Ranges:
    """Quantile boundaries of (key, weight) pairs; a key over several quantiles becomes hot."""
    rows = sorted(rows)
    total, done, cuts = sum(w for _, w in rows), 0.0, []
    for key, weight in rows:
        before, done = done, done + weight
        first, last = math.floor(before / total * pieces), math.floor(done / total * pieces)
        cuts += [key] * (min(last, pieces - 1) - first)
    hot = {k: cuts.count(k) for k in {c for i, c in enumerate(cuts) if i and c == cuts[i - 1]}}
    return Ranges(sorted(set(cuts)), {k: n + 1 for k, n in hot.items()})


def sample_ranges(
    df: DataFrame, key: str, weight: str, row_hash: Column, pieces: int, rounds: int = 3
) -> Ranges:
    """Boundaries for about ``pieces`` ranges of equal weight, overfull ones cut again.

    A row is drawn with probability ``weight * draws / total`` from a hash of the row, so a
    second run draws the same rows; those above ``total / draws`` are all drawn.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return Ranges([], {})

    def draw(part: DataFrame, part_total: float, part_pieces: int) -> list[tuple[float, float]]:
        step = part_total / (SAMPLE_PER_RANGE * part_pieces)
        taken = part.where(uniform(row_hash) * step < F.col(weight)).select(key, weight)
        return [(r[0], max(float(r[1]), step)) for r in taken.collect()]

    ranges = _boundaries(draw(df, total, pieces), pieces) if pieces > 1 else Ranges([], {})
    for _ in range(rounds):
        sums = ranges.assign(df, key, row_hash).groupBy("_range", "_part").agg(F.sum(weight).alias("w"))
        full = {(r["_range"], r["_part"]): r["w"] for r in sums.where(F.col("w") > 3 * total / pieces).collect()}
        if not full:
            break
        cuts = sorted(set(ranges.cuts) | set(ranges.hot))
        before, ends = (list(cuts), dict(ranges.hot)), [-math.inf, *cuts, math.inf]
        for number in sorted({r for r, _ in full}):
            lo, hi = ends[number], ends[number + 1]
            inside = df.where((F.col(key) >= lo) & (F.col(key) < hi))
            held = sum(w for (r, _), w in full.items() if r == number)
            more = _boundaries(draw(inside, held, n := math.ceil(held / total * pieces) + 1), n)
            ranges.cuts += more.cuts
            for value, parts in more.hot.items():
                ranges.hot[value] = max(parts, ranges.hot.get(value, 0))
        ranges.cuts = sorted(set(ranges.cuts))
        if before == (sorted(set(ranges.cuts) | set(ranges.hot)), ranges.hot):
            break
    return ranges


def default_pieces(df: DataFrame) -> int:
    """Two ranges per shuffle partition, so a range shrinks as the cluster grows."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
