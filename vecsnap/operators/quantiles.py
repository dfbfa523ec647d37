"""Exact interpolated quantiles that never gather a group's values in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. It is
used only where the number of values has a proven bound. Beyond it the quantile is
found by sketch-and-verify: a mergeable sketch proposes a bracket, a counting pass
proves which ranks the bracket holds, and only a bounded bracket is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values of one group that may be sorted in one aggregation buffer (8 MB of doubles).
BUFFER_VALUES = 1_000_000
# Values of one group for Spark's ``percentile``, whose value map is slower and larger.
PERCENTILE_VALUES = 50_000
SKETCH_ACCURACY = 10_000
_GRID = [i / 100 for i in range(101)]


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    max_rows: int | None = None,
    buffer_values: int = BUFFER_VALUES,
    with_mean: bool = False,
) -> dict[tuple, list[float]]:
    """Linear-interpolated quantiles of ``value`` per group of ``by``.

    ``by`` must have few groups (positions, stages, configurations): the result is
    a driver dict. ``max_rows`` is a proven upper bound on the values per group;
    when it fits the buffer one plain aggregation answers. ``with_mean`` appends the mean.
    """
    by, probs = list(by), [float(p) for p in probs]
    df = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    if max_rows is not None and max_rows <= min(buffer_values, PERCENTILE_VALUES):
        rows = df.groupBy(*by).agg(
            F.percentile("_v", probs).alias("__q"), F.count("_v").alias("__n"), F.avg("_v").alias("__m")
        )
        return {
            tuple(r[c] for c in by): [*r["__q"], r["__m"]] if with_mean else list(r["__q"])
            for r in rows.collect()
            if r["__n"]
        }
    found = _select(df, probs, by, buffer_values)
    if with_mean:
        for r in df.groupBy(*by).agg(F.avg("_v").alias("__m")).collect():
            if r["__m"] is not None:
                found[tuple(r[c] for c in by)].append(r["__m"])
    return found


def _select(df, probs, by, buffer_values):
    spark = df.sparkSession
    slack = 2.0 / SKETCH_ACCURACY
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    sketch = (
        df.groupBy(*by)
        .agg(
            F.count("_v").alias("__n"),
            F.min("_v").alias("__lo"),
            F.max("_v").alias("__hi"),
            F.percentile_approx("_v", ends, SKETCH_ACCURACY).alias("__ends"),
        )
        .collect()
    )
    result: dict[tuple, list[float]] = {}
    open_items = []
    for r in sketch:
        if not r["__n"]:
            continue
        group = tuple(r[c] for c in by)
        result[group] = [math.nan] * len(probs)
        for i, p in enumerate(probs):
            rank = (r["__n"] - 1) * p
            open_items.append(
                {
                    "group": group, "i": i, "k": math.floor(rank), "frac": rank - math.floor(rank),
                    "last": r["__n"] - 1, "lo": r["__ends"][2 * i], "hi": r["__ends"][2 * i + 1],
                    "outer": (r["__lo"], r["__hi"]),
                }
            )

    def bracketed(items, extra=None):
        """Rows of ``df`` joined to the (few) brackets of their group."""
        extra = extra or {}
        keys = [f.dataType.simpleString() for f in df.select(*by).schema.fields] if by else []
        ddl = ", ".join(
            [f"{c} {t}" for c, t in zip(by, keys)] + ["_i int", "_lo double", "_hi double"]
            + [f"{c} bigint" for c in extra] + ["_one int"]
        )
        rows = [
            (*it["group"], it["i"], it["lo"], it["hi"], *(it[c] for c in extra.values()), 1) for it in items
        ]
        table = spark.createDataFrame(rows, ddl)
        on = by or ["_one"]
        left = df if by else df.withColumn("_one", F.lit(1))
        return left.join(F.broadcast(table.drop("_one") if by else table), on)

    ready = []
    # A bracket holds about 2 * slack of the rows; the finer sketch is for those beyond the buffer.
    finer = any((it["last"] + 1) * 2 * slack > buffer_values for it in open_items)
    while open_items:
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        counts = (
            bracketed(open_items)
            .groupBy(*by, "_i")
            .agg(
                F.count_if(F.col("_v") < F.col("_lo")).alias("__below"),
                F.count_if(inside).alias("__inside"),
                F.max(F.when(inside, F.col("_v"))).alias("__top"),
                F.min(F.when(F.col("_v") > F.col("_hi"), F.col("_v"))).alias("__above"),
                (
                    F.percentile_approx(F.when(inside, F.col("_v")), _GRID, SKETCH_ACCURACY)
                    if finer
                    else F.lit(None)
                ).alias("__g"),
            )
            .collect()
        )
        seen = {(tuple(r[c] for c in by), r["_i"]): r for r in counts}
        still_open = []
        for it in open_items:
            r = seen[(it["group"], it["i"])]
            below, inside_n = r["__below"], r["__inside"]
            upper = min(it["k"] + 1, it["last"]) if it["frac"] > 0 else it["k"]
            if it["k"] < below:
                it["outer"] = (it["outer"][0], math.nextafter(it["lo"], -math.inf))
                it["lo"], it["hi"] = it["outer"]
                still_open.append(it)
            elif it["k"] >= below + inside_n:
                it["outer"] = (math.nextafter(it["hi"], math.inf), it["outer"][1])
                it["lo"], it["hi"] = it["outer"]
                still_open.append(it)
            elif upper >= below + inside_n:
                x, y = r["__top"], r["__above"]
                result[it["group"]][it["i"]] = x + (y - x) * it["frac"]
            elif it["lo"] == it["hi"]:
                result[it["group"]][it["i"]] = it["lo"]
            elif inside_n <= buffer_values:
                it["first"], it["second"] = it["k"] - below + 1, upper - below + 1
                ready.append(it)
            elif not finer:
                still_open.append(it)
            else:
                it["outer"] = (it["lo"], it["hi"])
                where = (it["k"] - below) / inside_n * 100
                grid = r["__g"]
                lo = grid[max(0, math.floor(where) - 1)]
                hi = grid[min(100, math.ceil(where) + 1)]
                if (lo, hi) == it["outer"]:
                    # Heavily repeated values: narrow by value until a single one is left.
                    hi = lo + (hi - lo) / 2
                it["lo"], it["hi"] = lo, hi
                still_open.append(it)
        open_items, finer = still_open, True

    if ready:
        picked = (
            bracketed(ready, {"__first": "first", "__second": "second"})
            .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .groupBy(*by, "_i", "__first", "__second")
            .agg(F.sort_array(F.collect_list("_v")).alias("__a"))
            .select(*by, "_i", F.expr("__a[__first - 1]").alias("__x"), F.expr("__a[__second - 1]").alias("__y"))
            .collect()
        )
        fracs = {(it["group"], it["i"]): it["frac"] for it in ready}
        for r in picked:
            group = tuple(r[c] for c in by)
            f = fracs[(group, r["_i"])]
            result[group][r["_i"]] = r["__x"] + (r["__y"] - r["__x"]) * f
    return result


def order_statistic(df: DataFrame, value: str, rank: int, max_rows: int | None = None) -> float:
    """Exact ``rank``-th smallest value (1-based), found without sorting the table.

    Whole numbers are found by their upper and then their lower 32 bits, which doubles hold exactly.
    """
    if df.schema[value].dataType.typeName() == "long":
        halves = df.select(F.shiftright(value, 32).alias("_high"), F.col(value).bitwiseAND((1 << 32) - 1).alias("_low"))
        halves = halves.where("_high IS NOT NULL").select(F.col("_high").cast("double"), F.col("_low").cast("double"))
        high = order_statistic(halves, "_high", rank)
        below = halves.where(F.col("_high") < high).count()
        low = order_statistic(halves.where(F.col("_high") == high), "_low", rank - below)
        return (int(high) << 32) | int(low)
    n = df.count() if max_rows is None else max_rows
    if n <= 1:
        return exact_quantiles(df, value, [0.0], max_rows=n)[()][0]
    return exact_quantiles(df, value, [(rank - 1) / (n - 1)], max_rows=n)[()][0]
