"""Readers, writers, generators and streaming jobs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsnap.codecs.layered import LayeredCodec
from vecsnap.operators import metrics
from vecsnap.sources import results, vectors as V
from vecsnap.streaming import jobs


def test_read_prunes_columns(spark):
    df = V.read_vectors(spark, "/root/testdata/sf0.001/embeddings.parquet")
    assert df.columns == ["vec_id", "embedding"]


def test_require_and_split(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [1.0, float("nan")]), (4, [None, 1.0]), (5, [1.0, float("inf")])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good, bad = V.split_valid(df, 2)
    assert [r["vec_id"] for r in good.collect()] == [0]
    assert sorted(r["vec_id"] for r in bad.collect()) == [1, 2, 3, 4, 5]
    assert V.require_dim(df.where("vec_id = 0"), 2).count() == 1
    with pytest.raises(Exception, match="expected dim=2"):
        V.require_dim(df.where("vec_id = 1"), 2).collect()


def test_word_vectors(spark, tmp_path):
    lines = ["w1 1 2.5 -3e2", "w2 1 2", "w3 1 x 3", " w4  4\t5 6 7", "", "w5"]
    (tmp_path / "words.txt").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "words.txt")
    got = {r["word"]: r["embedding"] for r in V.read_word_vectors(spark, path, 3).collect()}
    assert got == {"w1": [1.0, 2.5, -300.0], "w4": [4.0, 5.0, 6.0]}
    free = {r["word"]: r["embedding"] for r in V.read_word_vectors(spark, path).collect()}
    assert free == {"w1": [1.0, 2.5, -300.0], "w2": [1.0, 2.0], "w4": [4.0, 5.0, 6.0, 7.0]}
    assert [r["word"] for r in V.read_word_vectors(spark, path, n=2).orderBy("at").collect()] == ["w1", "w2"]
    back = spark.createDataFrame([("a", [0.5, 1.0])], "word string, v array<double>")
    V.write_word_vectors(back, f"{tmp_path}/out", "word", "v")
    assert V.read_word_vectors(spark, f"{tmp_path}/out", 2).first()["embedding"] == [0.5, 1.0]


def test_cache(spark, vectors, tmp_path):
    tensor = np.arange(2 * 1 * 3 * 4 * 5, dtype=float).reshape(2, 1, 3, 4, 5)
    df = spark.createDataFrame([("key", tensor.tolist())], "role string, t array<array<array<array<array<double>>>>>")
    flat = V.flatten_cache(df, "t", ["role"])
    assert flat.count() == 24
    for r in flat.collect():
        assert r["embedding"] == tensor[r["layer"], r["batch"], r["head"], r["pos"]].tolist()
    lengths = spark.createDataFrame([(0, 2)], "batch int, seq_len int")
    assert V.valid_tokens(flat, lengths, ["batch"]).agg(F.max("pos"), F.count("*")).first()[:] == (1, 12)
    V.write_cache(flat, f"{tmp_path}/cache", "m", "hello")
    assert V.read_cache(spark, f"{tmp_path}/cache", "key").count() == 24
    meta = V.read_cache_metadata(spark, f"{tmp_path}/cache").first()
    assert meta["keys_shape"] == [2, 1, 3, 4, 5] and meta["num_layers"] == 2 and meta["dtype"] == "float64"
    view = V.cache_from_labels(vectors)
    assert view.groupBy("layer", "pos").count().where("count > 1").count() == 0


def test_gaussian(spark):
    ids = spark.range(2000)
    a = V.gaussian_vectors(ids, "id", 32, 1).orderBy("id").collect()
    b = V.gaussian_vectors(ids.repartition(13), "id", 32, 1).orderBy("id").collect()
    x = np.array([r["embedding"] for r in a])
    assert np.array_equal(x, np.array([r["embedding"] for r in b]))
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02
    assert abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.08 and abs((x**4).mean() - 3) < 0.15


def test_result_records(spark, tmp_path):
    rows = [
        {"Model": "m", "Version": "A", "Tier": "Extreme", "BPD": 2.5, "SNR": 51.0, "Base PPL": 4.0, "Quant PPL": 4.1, "PPL Delta": 0.1},
        {"Model": "m", "Version": "B", "Tier": "Medium", "BPD": 6.5, "SNR": 151.0, "Base PPL": 4.0, "Quant PPL": 4.0, "PPL Delta": 0.0},
    ]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    df = results.read_results(spark, str(tmp_path / "r.json"))
    assert df.count() == 2 and df.agg(F.max("SNR")).first()[0] == 151.0
    results.write_results(df, f"{tmp_path}/out")
    assert results.read_results(spark, f"{tmp_path}/out").count() == 2
    # Lines of one file, an array with a record per line, and both in one folder.
    results.write_results(df.coalesce(1), f"{tmp_path}/lines")
    assert results.read_results(spark, f"{tmp_path}/lines").count() == 2
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.json").write_text("[" + ",\n".join(map(json.dumps, rows)) + "]")
    (tmp_path / "mixed" / "b.json").write_text("[\n" + ",\n".join(map(json.dumps, rows)) + "\n]")
    assert results.read_results(spark, f"{tmp_path}/mixed").count() == 4
    (tmp_path / "mixed" / "c.json").write_text("\n".join(map(json.dumps, rows)))
    with pytest.raises(ValueError):
        results.read_results(spark, f"{tmp_path}/mixed")


def test_encode_stream(spark, vectors, tmp_path):
    for i in range(2):
        vectors.where(F.pmod("vec_id", F.lit(2)) == i).write.mode("append").parquet(f"{tmp_path}/in")
    model = LayeredCodec("sparse", 64, 3, 3.0).fit(vectors)
    stream = spark.readStream.schema(vectors.schema).parquet(f"{tmp_path}/in")
    jobs.encode_stream(stream, model, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    coded = spark.read.parquet(f"{tmp_path}/out")
    assert coded.count() == 500
    diff = metrics.max_difference(model.decode(coded), model.reconstruct(vectors), "vec_id", "rebuilt")
    assert diff.first()[0] == 0.0
