"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training progress (piecewise linear, from 0 to 1). Its
integral is the source's weight; words are shared by weight, no source above ``max_repeats``
times its own words. The documents of a source, in hash order, consume its demand curve:
the curve's inverse at a document's middle word is its place in training, and all sources are
then range-sorted by it. So at any progress each source has delivered what its schedule asks.

Defined results: a null source is one source of its own; a null, empty or wordless text has
size 0 and is never taken; repeated rows are taken like different ones; an empty table gives an
empty result. Columns of the input that carry an output name are replaced, others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecsnap.llm.common import let, stored, whole, words

WEIGHTS = (5.0, 2.0, 1.0)
# Schedules of the three weight classes, each with integral 1: falling, level, rising.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.1), (1.0, 1.45)))


def schedule(number: Column, weights: Sequence[float] = WEIGHTS, shapes=SHAPES) -> Column:
    """Knots ``(at, weight)`` of the ``number``-th source; weights and shapes repeat."""

    def knots(weight: float, shape) -> Column:
        area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(shape, shape[1:]))
        pair = lambda at, w: F.struct(F.lit(at).alias("at"), F.lit(weight * w / area).alias("weight"))
        return F.array(*[pair(at, w) for at, w in shape])

    n = math.lcm(len(weights), len(shapes))
    out = F.lit(None)
    for i in range(n):
        out = F.when(F.pmod(number, F.lit(n)) == i, knots(weights[i % len(weights)], shapes[i % len(shapes)])).otherwise(out)
    return out


def integrate(knots: Column) -> Column:
    """Segments of a schedule: start, length, both weights and the area before each."""
    n = F.size(knots)
    area = lambda a, b: (b["at"] - a["at"]) * (a["weight"] + b["weight"]) / 2
    before = lambda i: F.aggregate(
        F.when(i > 0, F.sequence(F.lit(0), i - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda s, j: s + area(knots[j], knots[j + 1]),
    )
    segment = lambda i: F.struct(
        knots[i]["at"].alias("at"),
        (knots[i + 1]["at"] - knots[i]["at"]).alias("length"),
        knots[i]["weight"].alias("w0"),
        knots[i + 1]["weight"].alias("w1"),
        before(i).alias("before"),
        before(i + 1).alias("upto"),
    )
    return F.transform(F.sequence(F.lit(0), n - 2), segment)


def invert(segments: Column, share: Column) -> Column:
    """Progress at which a schedule has handed out ``share`` (0 to 1) of its integral."""
    asked = share * segments[F.size(segments) - 1]["upto"]
    hit = F.coalesce(F.get(F.filter(segments, lambda s: s["upto"] >= asked), F.lit(0)), segments[F.size(segments) - 1])

    def place(s: Column) -> Column:
        rest = asked - s["before"]
        slope = (s["w1"] - s["w0"]) / s["length"]
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * rest, F.lit(0.0)))
        return F.least(s["at"] + F.coalesce(F.try_divide(2 * rest, s["w0"] + root), F.lit(0.0)), F.lit(1.0))

    return let(hit, place)


def source_targets(sources: DataFrame, total: Column, max_repeats: float) -> DataFrame:
    """Add ``target``: ``total`` shared by ``weight``, capped, the excess shared again.

    ``sources`` has one row per source of the mix (``source``, ``source_size``, ``weight``).
    Sources in the order of cap per weight are full up to the first whose level stays below.
    """
    cap = F.col("source_size") * F.lit(float(max_repeats))
    ratio = cap / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = sources.withColumn("_level", (total - full) / weight).withColumn("_ratio", ratio)
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy())
    rows = rows.withColumn("_fill", level)
    target = F.when(F.col("_fill").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("_fill")))
    return rows.withColumn("target", target).drop("_level", "_ratio", "_fill")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    shapes=SHAPES,
    words_ratio: float = 1.5,
    max_repeats: int = 2,
    seed: int = 7,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and positions (one per copy).

    The prefix sums of a source run over hash buckets, so a source with a third of all rows is
    spread over as many tasks as there are buckets. Documents are taken whole, while their
    middle word lies below the target.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(2, math.ceil(math.log(4 * partitions, 16)))
    outputs = {"size", "source_size", "target", "copies", "taken", "positions"}
    text = whole()
    keyed = (
        docs.drop(*[c for c in docs.columns if c in outputs])
        .withColumn("size", F.size(words(text)).cast("long"))
        .withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"), text)))
        .withColumn("_bucket", F.substring("_key", 1, digits))
    )
    sums = stored(keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    per_source = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    plan = per_source.withColumn("_segments", integrate(schedule(number, weights, shapes)))
    last = F.col("_segments")[F.size("_segments") - 1]
    plan = plan.withColumn("weight", F.round(last["upto"], 9))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(words_ratio))
    plan = source_targets(plan.withColumn("_total", total), F.col("_total"), max_repeats).drop("_total", "weight")

    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("_t"),
        F.col("_bucket"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    )
    offsets = offsets.join(plan.withColumnRenamed("source", "_u"), F.col("_t").eqNullSafe(F.col("_u"))).drop("_u")
    # A null source as one key without nulls: the window and the join then share one exchange of the texts.
    named = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c).cast("string")))
    offsets = offsets.withColumn("_s", named("_t")).drop("_t")
    inside = Window.partitionBy("_s", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("_s", named("source")).withColumn("_run", F.sum("size").over(inside))
    placed = placed.join(offsets, ["_s", "_bucket"])
    middle = F.col("_offset") + F.col("_run") - F.col("size") / 2
    copy_at = lambda e: middle + e * F.col("source_size")
    fits = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: copy_at(e) < F.col("target"))
    epochs = F.when(F.col("size") > 0, fits).otherwise(F.array().cast("array<int>"))
    at = lambda e: F.round(invert(F.col("_segments"), copy_at(e) / F.col("target")), 9)
    return (
        placed.withColumn("_epochs", epochs)
        .withColumn("copies", F.size("_epochs"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .withColumn("positions", F.transform("_epochs", at))
        .drop("_key", "_bucket", "_run", "_s", "_offset", "_segments", "_epochs")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy with its ``position``, range-sorted by it (ties by doc_id)."""
    rows = mixed.withColumn("position", F.explode("positions"))
    return rows.orderBy("position", "doc_id")
