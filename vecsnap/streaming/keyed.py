"""The associative memory and drift reports as keyed streaming state.

The memory is one value per slot in Spark's state store. A micro-batch changes only the slots its
commands name; a restart goes on from the checkpoint, and a replayed command changes nothing. Stores
without a slot first get their place on the ring: their number needs a count over the whole log, which a
marker file keeps between batches, so the numbering holds no state but that count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vecsnap.codecs.base import ModelBase
from vecsnap.operators.memory import anchor_keys, place
from vecsnap.operators.metrics import snr_db

PLACED = "seq bigint, op string, slot bigint, key array<double>, value array<double>"
SLOT = "key array<double>, value array<double>, forgotten boolean, stored bigint, seq bigint, rank int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANKS = {"store": 0, "update": 1, "forget": 2}


class SlotProcessor(StatefulProcessor):
    """Commands of one slot, in the order of their numbers, over its stored value.

    A store replaces the slot and clears its flag; an update counts while the slot is not forgotten;
    a forget sets the flag. Commands up to the last one applied are replays and are skipped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("memory", SLOT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        commands = pd.concat(rows)
        commands["rank"] = commands["op"].map(RANKS)
        commands = commands.sort_values(["seq", "rank"])
        held = list(self.slot.get()) if self.slot.exists() else None
        n = 0
        for seq, rank, k, v in commands[["seq", "rank", "key", "value"]].itertuples(index=False):
            if held is not None and (seq, rank) <= (held[4], held[5]):
                continue
            if rank == RANKS["store"]:
                held = [_doubles(k), _doubles(v), False, int(seq), int(seq), int(rank)]
            elif held is None or held[2]:
                continue
            elif rank == RANKS["update"]:
                held[1], held[4], held[5] = _doubles(v), int(seq), int(rank)
            else:
                held[2], held[4], held[5] = True, int(seq), int(rank)
            n += 1
        if n:
            self.slot.update(tuple(held))
            yield pd.DataFrame({"slot": [key[0]], "applied": [n]})

    def close(self) -> None:
        pass


def _doubles(values) -> list[float] | None:
    return None if values is None else [float(v) for v in values]


def start_with_rocks(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query on the RocksDB state store, leaving the session's setting as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def read_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows written below ``path`` by ``write_version``, none if there are none yet."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


class KeyedMemory:
    """The memory of a stream of commands ``(seq, op, slot, key, value)`` in order of ``seq``."""

    def __init__(self, spark: SparkSession, path: str, dim: int, capacity: int = 1024):
        self.spark, self.path, self.dim, self.capacity = spark, path, dim, capacity

    def _stored(self, before: int) -> int:
        marks = read_versions(self.spark, f"{self.path}/marks", "version bigint, stored bigint")
        row = marks.where(F.col("version") < before).orderBy(F.desc("version")).first()
        return row["stored"] if row else 0

    def place(self, batch: DataFrame, version: int) -> None:
        """Write a batch's commands with their slots; a replayed batch rewrites its own folder."""
        stored = self._stored(version)
        batch = batch.select("seq", "op", F.col("slot").cast("bigint").alias("slot"), "key", "value").persist()
        try:
            log, new = place(batch, self.capacity, stored)
            # What a later store of the same slot replaces within this batch need not be sent on.
            last = log.where("op = 'store'").groupBy("slot").agg(F.max("seq").alias("last"))
            kept = log.join(last, "slot", "left").where("last IS NULL OR seq >= last").drop("last")
            kept.select("seq", "op", "slot", "key", "value").write.mode("overwrite").parquet(f"{self.path}/placed/{version:09d}")
            mark = self.spark.createDataFrame([(version, stored + new)], "version bigint, stored bigint")
            mark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/{version:09d}")
        finally:
            batch.unpersist()

    def follow(self, commands: DataFrame, checkpoint: str) -> None:
        """Apply what has arrived: place it, then fold it into the slots' state. Ends when all is applied."""
        placing = commands.writeStream.foreachBatch(self.place).option("checkpointLocation", f"{checkpoint}/place")
        placing.trigger(availableNow=True).start().awaitTermination()
        source = self.spark.readStream.schema(PLACED).option("maxFilesPerTrigger", 64)
        slots = source.parquet(f"{self.path}/placed/*").groupBy("slot")
        touched = slots.transformWithStateInPandas(SlotProcessor(), "slot bigint, applied bigint", "Update", "none")

        def write(batch: DataFrame, version: int) -> None:
            batch.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(
                f"{self.path}/touched/{version:09d}"
            )

        self.checkpoint = f"{checkpoint}/slots"
        stream = touched.writeStream.foreachBatch(write).outputMode("update")
        stream = stream.option("checkpointLocation", self.checkpoint).trigger(availableNow=True)
        start_with_rocks(self.spark, stream.start).awaitTermination()

    def touched(self) -> DataFrame:
        """Which slots each batch wrote, and how many commands it applied to them."""
        return read_versions(self.spark, f"{self.path}/touched", "slot bigint, applied bigint, version bigint")

    def state(self) -> DataFrame:
        """``(slot, key, value, forgotten, seq)`` from the state store, keys snapped to the lattice."""
        held = self.spark.read.format("statestore").option("stateVarName", "memory").load(self.checkpoint)
        state = held.select("key.slot", "value.key", "value.value", "value.forgotten", "value.seq")
        return anchor_keys(state, self.dim).select("slot", "key", "value", "forgotten", "seq")


FACTS = (
    "segment bigint, n_vectors bigint, signal double, noise double, n_values bigint, cosine double, max_abs double, "
    "row_snr binary, version bigint"
)


def drift_stream(
    vectors: DataFrame, model: ModelBase, segment, path: str, checkpoint: str, column: str = "embedding"
) -> StreamingQuery:
    """Fidelity of every segment, brought up to date by each micro-batch that has vectors of it.

    The state of a segment is its sums and a mergeable quantile sketch of its vectors' SNR, so a
    segment may go over any number of batches. Partial sums are made before the exchange. ``segment``
    is a column of ``vectors``.
    """
    errors = model.errors(vectors.select(segment.cast("bigint").alias("segment"), column), column)
    row_snr = snr_db(F.col("signal"), F.col("noise"), F.col("n_values"))
    facts = errors.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.sum("signal").alias("signal"),
        F.sum("noise").alias("noise"),
        F.sum("n_values").alias("n_values"),
        F.sum("cosine").alias("cosine"),
        F.max("max_abs").alias("max_abs"),
        F.kll_sketch_agg_double(row_snr).alias("row_snr"),
    )

    def write(batch: DataFrame, version: int) -> None:
        batch.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{path}/{version:09d}")

    stream = facts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    """The latest facts of every segment, and its distance to the first segment."""
    columns = [c.split(" ")[0] for c in FACTS.split(", ")]
    latest = read_versions(spark, path, FACTS).groupBy("segment").agg(
        F.max_by(F.struct(*columns[1:-1]), "version").alias("f"), F.count(F.lit(1)).alias("n_batches")
    )
    snr = snr_db(F.col("f.signal"), F.col("f.noise"), F.col("f.n_values"))
    facts = latest.select(
        "segment", "n_batches", F.col("f.n_vectors").alias("n_vectors"), snr.alias("snr_db"),
        (F.col("f.cosine") / F.col("f.n_vectors")).alias("cosine"), F.col("f.max_abs").alias("max_abs"),
        F.kll_sketch_get_quantile_double("f.row_snr", F.lit(0.5)).alias("median_row_snr"),
    )
    first = facts.agg(F.min_by("snr_db", "segment").alias("first"), F.lit(1).alias("one"))
    both = facts.withColumn("one", F.lit(1)).join(F.broadcast(first), "one").drop("one")
    return both.withColumn("drift_db", F.col("snr_db") - F.col("first")).drop("first")
