import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, a hot source and groups of copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = prose(120)
    near = base.split(" ")
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "b", 3),
        (5, "One TWO three", "en", "b", 13), (6, "one two three", "en", "b", 13), (7, prose(30_000), "en", "hot", 9),
        (8, "naïve ﬁ 日本語 ▁x  two   spaces\n\n\ttab 12345 é \x00", "xx", "b", 1), (9, "same\nsame\nsame\nx\n", "en", "a", 1),
        (10, "word " * 400, "en", "b", 1), (None, "no id " + prose(60), "en", "a", 1), (None, prose(10), None, "hot", 1),
        (11, base, "en", "hot", 1), (12, base, "en", "hot", 1), (12, base, "en", "hot", 1),
    ]
    for i in range(40):
        edited = list(near)
        edited[(3 * i) % 120] = f"edit{i}"
        rows.append((20 + i, " ".join(edited), "en", "hot", 1))
    rows += [(100 + i, prose(rng.randint(1, 200)), "en", rng.choice(["a", "b", "hot", "hot", None]), 1) for i in range(60)]
    rows += [(200 + i, "many copies of one text " * 12, "en", "hot", 1) for i in range(150)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
