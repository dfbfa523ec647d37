"""Exact quantiles and moments of a growing table, refitted without reading it again.

Every append writes its values once, cut into sorted slices, and a catalog of them: count, extremes,
sums and a mergeable quantile sketch per slice and group. A refit merges the sketches, which propose a
bracket for every quantile. Slices wholly below a bracket are counted from the catalog; only slices that
meet it are read, which proves the ranks and gives the values. The result is the one a full pass gives.

The catalog and the brackets are metadata: their size goes with the number of slices and of groups, not
of rows. Null and NaN values are left out. An append without a catalog (a lost driver) does not count.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_K = 1024
# Values of a group whose rank a merged sketch may miss, as a share; more only costs another pass.
SLACK = 0.01
BUFFER_VALUES = 1_000_000
STEPS = 400
CATALOG = "slice int, grp int, n bigint, low double, high double, total double, squares double, sketch binary, part string"


@dataclass
class Reads:
    """Rows and bytes that refits have read, and what the store holds."""

    rows: int = 0
    bytes: int = 0


class RefitStore:
    """Values ``(grp, v)`` below a shared folder; ``grp`` has few values, such as a dimension."""

    def __init__(self, spark: SparkSession, path: str, slices: int | None = None, buffer_values: int = BUFFER_VALUES):
        self.spark, self.path, self.buffer_values = spark, path.rstrip("/"), buffer_values
        self.slices = slices or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.reads = Reads()

    def append(self, df: DataFrame, value: str = "v", group: str | Column | None = None) -> None:
        """Add rows: two writes, and an exchange of these rows alone."""
        grp = F.lit(0) if group is None else F.col(group) if isinstance(group, str) else group
        rows = df.select(grp.cast("int").alias("grp"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
        part = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        # Equal values may be many: a random number parts them where the range alone could not.
        dealt = rows.withColumn("_r", F.rand(7)).repartitionByRange(self.slices, "grp", "v", "_r").drop("_r")
        cut = dealt.sortWithinPartitions("grp", "v").withColumn("slice", F.spark_partition_id())
        cut.write.partitionBy("slice").parquet(f"{self.path}/values/part={part}")
        written = self.spark.read.schema("grp int, v double, slice int").parquet(f"{self.path}/values/part={part}")
        facts = written.groupBy("slice", "grp").agg(
            F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"),
            F.sum(F.col("v") * F.col("v")).alias("squares"), F.kll_sketch_agg_double("v", SKETCH_K).alias("sketch"),
        )
        facts.withColumn("part", F.lit(part)).write.parquet(f"{self.path}/catalog/{part}")

    def catalog(self) -> DataFrame:
        return self.spark.read.schema(CATALOG).parquet(f"{self.path}/catalog/*")

    def values(self) -> DataFrame:
        return self.spark.read.schema("grp int, v double, part string, slice int").parquet(f"{self.path}/values")

    def moments(self) -> DataFrame:
        """Count, mean, population deviation and extremes per group, from the catalog alone."""
        sums = self.catalog().groupBy("grp").agg(
            F.sum("n").alias("n"), F.sum("total").alias("s"), F.sum("squares").alias("q"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        mean = F.col("s") / F.col("n")
        deviation = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
        return sums.select("grp", "n", mean.alias("mean"), deviation.alias("deviation"), "low", "high")

    def quantiles(self, probs: Sequence[float], around: dict[int, float] | None = None) -> dict[int, list[float]]:
        """Interpolated quantiles per group; with ``around``, of the distance to a value per group."""
        grid = [i / STEPS for i in range(STEPS + 1)]
        merged = self.catalog().groupBy("grp").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
        steps = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(p) for p in grid]))
        brackets, sizes = {}, {}
        for r in merged.select("grp", "n", steps.alias("steps")).collect():
            g, n = r["grp"], r["n"]
            sizes[g] = n
            points = sorted(abs(v - around[g]) for v in r["steps"]) if around else list(r["steps"])
            for i, p in enumerate(probs):
                k = (n - 1) * p
                for j, rank in enumerate({math.floor(k), min(math.ceil(k), n - 1)}):
                    at = [min(STEPS, max(0, f((p + d) * STEPS))) for f, d in ((math.floor, -SLACK), (math.ceil, SLACK))]
                    brackets[g, 2 * i + j] = {"rank": rank, "lo": points[at[0]], "hi": points[at[1]], "below": -math.inf, "above": math.inf}
        found = self._ranks(brackets, around)
        out = {}
        for g, n in sizes.items():
            out[g] = []
            for i, p in enumerate(probs):
                k = (n - 1) * p
                x = {brackets[g, 2 * i + j]["rank"]: found[g, 2 * i + j] for j in (0, 1) if (g, 2 * i + j) in found}
                low, high = x[math.floor(k)], x[min(math.ceil(k), n - 1)]
                out[g].append(low + (high - low) * (k - math.floor(k)))
        return out

    def _ranks(self, brackets: dict, around: dict[int, float] | None) -> dict:
        """The value of every bracket's rank; brackets that miss it are widened, large ones cut."""
        middle = F.create_map(*[F.lit(x) for pair in (around or {}).items() for x in pair]) if around else None
        of = lambda c: F.abs(c - F.element_at(middle, F.col("grp"))) if around else c
        slices = self.catalog().drop("sketch")
        if around:
            inside = F.element_at(middle, F.col("grp")).between(F.col("low"), F.col("high"))
            ends = F.array(of(F.col("low")), of(F.col("high")))
            low = F.when(inside, 0.0).otherwise(F.array_min(ends))
            slices = slices.select("part", "slice", "grp", "n", low.alias("low"), F.array_max(ends).alias("high"))
        found, left = {}, dict(brackets)
        while left:
            rows = [(g, i, b["lo"], b["hi"]) for (g, i), b in left.items()]
            table = F.broadcast(self.spark.createDataFrame(rows, "grp int, i int, lo double, hi double"))
            met = slices.join(table, "grp")
            under = met.where("high < lo").groupBy("grp", "i").agg(F.sum("n").alias("n"))
            below = {(r["grp"], r["i"]): r["n"] for r in under.collect()}
            touched = met.where("high >= lo AND low <= hi").select("part", "slice", "grp", "i", "lo", "hi")
            held = touched.select("part", "slice").distinct().collect()
            rows = self._read(held).withColumn("x", of(F.col("v"))).join(F.broadcast(touched), ["part", "slice", "grp"])
            within = F.col("x").between(F.col("lo"), F.col("hi"))
            facts = rows.groupBy("grp", "i").agg(
                F.count_if(F.col("x") < F.col("lo")).alias("under"), F.count_if(within).alias("inside"),
                F.percentile_approx(F.when(within, F.col("x")), [j / 100 for j in range(101)], 10_000).alias("cuts"),
            )
            facts = {(r["grp"], r["i"]): r for r in facts.collect()}
            ready, again = {}, {}
            for key, b in left.items():
                r = facts.get(key)
                before = below.get(key, 0) + (r["under"] if r else 0)
                inside = r["inside"] if r else 0
                if b["rank"] < before:
                    again[key] = b | {"above": b["lo"], "hi": math.nextafter(b["lo"], -math.inf), "lo": b["below"]}
                elif b["rank"] >= before + inside:
                    again[key] = b | {"below": b["hi"], "lo": math.nextafter(b["hi"], math.inf), "hi": b["above"]}
                elif b["lo"] == b["hi"]:
                    found[key] = b["lo"]
                elif inside <= self.buffer_values:
                    ready[key] = b | {"at": b["rank"] - before}
                else:
                    at = (b["rank"] - before) / inside * 100
                    lo, hi = r["cuts"][max(0, math.floor(at) - 1)], r["cuts"][min(100, math.ceil(at) + 1)]
                    if (lo, hi) == (b["lo"], b["hi"]):
                        hi = lo + (hi - lo) / 2
                    again[key] = b | {"lo": lo, "hi": hi, "below": b["lo"], "above": b["hi"]}
            if ready:
                wanted = [(g, i, b["at"]) for (g, i), b in ready.items()]
                wanted = F.broadcast(self.spark.createDataFrame(wanted, "grp int, i int, at bigint"))
                sorted_values = rows.where(within).join(wanted, ["grp", "i"]).groupBy("grp", "i", "at").agg(F.sort_array(F.collect_list("x")).alias("a"))
                for r in sorted_values.select("grp", "i", F.get("a", F.col("at").cast("int")).alias("x")).collect():
                    found[r["grp"], r["i"]] = r["x"]
            left = again
        return found

    def _read(self, held: list) -> DataFrame:
        """The rows of some slices; their folders are chosen before any file is opened."""
        by_part: dict[str, list[int]] = {}
        for r in held:
            by_part.setdefault(r["part"], []).append(r["slice"])
        chosen = F.lit(False)
        for part, numbers in by_part.items():
            chosen = chosen | ((F.col("part") == part) & F.col("slice").isin(numbers))
        rows = self.values().where(chosen)
        files = rows.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
        size = files.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
        self.reads.rows += size["n"] or 0
        self.reads.bytes += size["size"] or 0
        return rows

    def held(self) -> Reads:
        """Rows and bytes of all values in the store."""
        files = self.values().select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
        r = files.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
        return Reads(r["n"] or 0, r["size"] or 0)


def refit_robust_scale(store: RefitStore) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Median and median absolute deviation (+1e-12) per dimension of a store grouped by dimension."""
    center = {g: q[0] for g, q in store.quantiles([0.5]).items()}
    spread = {g: q[0] for g, q in store.quantiles([0.5], around=center).items()}
    return tuple(center[g] for g in sorted(center)), tuple(spread[g] + 1e-12 for g in sorted(spread))
