"""Keyed associative memory folded from a command log.

Commands are rows ``(seq, op, slot, key, value)``; ``op`` is ``store``, ``forget`` or
``update``. A store without a slot takes the next position of a ring of ``capacity``
slots. The state after any prefix of the log is an aggregation per slot, so a slot that
receives a third of all commands is merged map side like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.operators.quantiles import order_statistic
from vecsnap.operators.running import running_totals
from vecsnap.operators.search import lattice_key


def assign_slots(stores: DataFrame, capacity: int, stored_before: int = 0) -> tuple[DataFrame, int]:
    """Ring positions ``(n-th store - 1) mod capacity`` of stores without a slot, and their count.

    Only the last ``capacity`` of them can survive in the ring, so older ones are left
    out: a cut-off sequence number replaces numbering the whole log. The rest are numbered
    by bucketed running counts at every ring size. Sequence numbers are unique.
    """
    open_slot = stores.where("slot IS NULL")
    n = open_slot.count()
    older = max(0, n - capacity)
    if older:
        open_slot = open_slot.where(F.col("seq") >= order_statistic(open_slot, "seq", older + 1, n))
    counted = running_totals(open_slot, "seq", {"_n": F.lit(1).cast("bigint")})
    ring = F.pmod(F.col("_n") - 1 + older + stored_before, F.lit(capacity)).cast("bigint")
    return counted.withColumn("slot", ring).drop("_n"), n


def place(log: DataFrame, capacity: int, stored_before: int = 0) -> tuple[DataFrame, int]:
    """The log with every relevant store placed, and the number of ring stores in it."""
    ring, n = assign_slots(log.where("op = 'store'"), capacity, stored_before)
    return ring.unionByName(log.where("slot IS NOT NULL")), n


def fold(log: DataFrame) -> DataFrame:
    """State per slot: ``(slot, key, value, forgotten, seq)``.

    The last store wins; it clears the flag. A forget after it sets the flag; updates
    count only between the last store and the first forget after it. Slots never
    stored are not part of the memory.
    """
    when = F.when
    stores = (
        log.where("op = 'store'")
        .groupBy(F.col("slot").alias("s_slot"))
        .agg(F.max_by(F.struct("key", "value"), "seq").alias("kv"), F.max("seq").alias("stored"))
    )
    later = log.where("op IN ('forget', 'update')").join(
        stores.select(F.col("s_slot").alias("slot"), "stored"), "slot"
    ).where("seq > stored OR (seq = stored AND op = 'forget')")
    first_forget = later.groupBy("slot").agg(F.min(when(F.col("op") == "forget", F.col("seq"))).alias("gone"))
    updates = (
        later.where("op = 'update'")
        .join(first_forget, "slot")
        .where("gone IS NULL OR seq < gone")
        .groupBy("slot")
        .agg(F.max_by("value", "seq").alias("new_value"), F.max("seq").alias("updated"))
    )
    return (
        stores.withColumnRenamed("s_slot", "slot")
        .join(first_forget, "slot", "left")
        .join(updates, "slot", "left")
        .select(
            "slot",
            F.col("kv.key").alias("key"),
            when(F.col("updated").isNotNull(), F.col("new_value")).otherwise(F.col("kv.value")).alias("value"),
            F.col("gone").isNotNull().alias("forgotten"),
            F.greatest("stored", F.coalesce("updated", "stored"), F.coalesce("gone", "stored")).alias("seq"),
        )
    )


def as_commands(state: DataFrame) -> DataFrame:
    """A saved state as the log that recreates it (used to continue a memory).

    The forget of a forgotten slot carries the sequence number of its store, which no
    other pair of commands shares.
    """
    cols = ["slot", "key", "value"]
    store = state.select("seq", F.lit("store").alias("op"), *cols)
    forget = state.where("forgotten").select("seq", F.lit("forget").alias("op"), *cols)
    return store.unionByName(forget)


def anchor_keys(state: DataFrame, dim: int) -> DataFrame:
    """Snap the keys of a state to the lattice: ``E8(10 k) / 10``."""
    others = [c for c in state.columns if c != "key"]
    return lattice_key(state, "key", dim, others, "anchor").withColumnRenamed("anchor", "key")


def build_memory(log: DataFrame, dim: int, capacity: int = 1024) -> DataFrame:
    """State after the whole log. Keys are snapped once a store has survived."""
    placed, _ = place(log, capacity)
    return anchor_keys(fold(placed), dim)
