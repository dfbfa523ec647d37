"""Memory and drift kept as streaming state, against the fold of the whole log."""

import pytest
from pyspark.sql import functions as F

from test_operators import LOG, random_log, replay, same_memory
from vecsnap.codecs.layered import LayeredCodec
from vecsnap.operators import metrics
from vecsnap.streaming import jobs, keyed


def write(spark, rows, path, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


def test_memory_over_batches_and_a_restart(spark, tmp_path):
    """Stores, updates and forgets in seven batches equal the fold of the log after each stop."""
    log = random_log(300, 10, 5)
    memory = keyed.KeyedMemory(spark, f"{tmp_path}/memory", 8, 10)
    cuts, stops = [0, 40, 90, 91, 150, 200, 260, 300], (3, 5, 7)
    done = 0
    for stop in stops:
        for k in range(done, stop):
            write(spark, log[cuts[k] : cuts[k + 1]], f"{tmp_path}/log/{k}")
        done = stop
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
        # Nothing but the folders and the checkpoint goes over from one start to the next.
        memory = keyed.KeyedMemory(spark, f"{tmp_path}/memory", 8, 10)
        memory.follow(stream, f"{tmp_path}/ck")
        same_memory(memory.state(), replay(log[: cuts[stop]], 10))


def test_a_batch_touches_only_its_slots(spark, tmp_path):
    memory = keyed.KeyedMemory(spark, f"{tmp_path}/memory", 8, 50)
    store = lambda seq, slot: (seq, "store", slot, [float(seq)] * 8, [1.0])
    batches = [[store(i, i) for i in range(20)], [store(30, 3), (31, "forget", 7, None, None)], [(40, "update", 44, None, [2.0])]]
    for k, rows in enumerate(batches):
        write(spark, rows, f"{tmp_path}/log/{k}")
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log/*")
        memory.follow(stream, f"{tmp_path}/ck")
    touched = {}
    for r in memory.touched().collect():
        touched.setdefault(r["version"], set()).add(r["slot"])
    # The last batch updates a slot that was never stored, which writes nothing.
    assert touched == {0: set(range(20)), 1: {3, 7}}
    state = {r["slot"]: r for r in memory.state().collect()}
    assert sorted(state) == list(range(20)) and state[7]["forgotten"] and state[3]["seq"] == 30


def test_replayed_commands_change_nothing(spark, tmp_path):
    """The same commands, placed once more, are known by their numbers."""
    log = [r for r in random_log(80, 6, 3)]
    memory = keyed.KeyedMemory(spark, f"{tmp_path}/memory", 8, 6)
    for k, part in enumerate((log[:50], log[50:])):
        write(spark, part, f"{tmp_path}/log/{k}")
        stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log/*")
        memory.follow(stream, f"{tmp_path}/ck")
        # The driver fails after the batch was placed and places it again.
        memory.place(spark.createDataFrame(part, LOG), k)
    memory.follow(spark.readStream.schema(LOG).parquet(f"{tmp_path}/log/*"), f"{tmp_path}/ck")
    same_memory(memory.state(), replay(log, 6))


def test_drift_over_batches(spark, vectors, tmp_path):
    """Segments that go over several files equal the report of the whole table."""
    for k in range(5):
        vectors.where(f"vec_id >= {k * 100} AND vec_id < {k * 100 + 100}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    model = LayeredCodec("gain16", 64).fixed([100.0])
    segment = F.floor(F.col("vec_id") / 140)
    stream = spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    keyed.drift_stream(stream, model, segment, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {r["segment"]: r for r in keyed.read_drift(spark, f"{tmp_path}/out").collect()}
    want = jobs.drift_by_segment(model.errors(vectors.withColumn("segment", segment)), "segment").collect()
    assert sorted(got) == [r["segment"] for r in sorted(want, key=lambda r: r["segment"])]
    for r in want:
        for name in ("n_vectors", "snr_db", "drift_db"):
            assert got[r["segment"]][name] == pytest.approx(r[name])
    assert max(r["n_batches"] for r in got.values()) >= 2
    rows = model.errors(vectors).select(metrics.snr_db(F.col("signal"), F.col("noise"), F.col("n_values")).alias("s"))
    assert rows.count() == sum(r["n_vectors"] for r in got.values())


def test_nothing_yet(spark, tmp_path):
    assert keyed.read_drift(spark, f"{tmp_path}/none").count() == 0
    assert keyed.KeyedMemory(spark, f"{tmp_path}/memory", 8).touched().count() == 0
