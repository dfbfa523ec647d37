"""Codebooks and codes against plain loops over whole numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from vecsnap.llm import vectorcodes
from vecsnap.llm.queries import op13_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=256, parts=4, rounds=4, scale=1024):
    """All rows of the query, by comparing every part with every entry."""
    kept = [
        (i, [math.floor(scale * x) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return Counter()
    x = np.array([r[1] for r in kept], dtype=np.int64)
    pieces = np.split(x, parts, axis=1)
    books = [p[:entries].copy() for p in pieces]

    def nearest(p, book):
        return np.array([int(np.argmin(((book - row) ** 2).sum(axis=1))) for row in p])

    for _ in range(rounds):
        for p, book in zip(pieces, books):
            codes = nearest(p, book)
            for e in set(codes.tolist()):
                members = p[codes == e]
                book[e] = members.sum(axis=0) // len(members)
    codes = [nearest(p, book) for p, book in zip(pieces, books)]
    error = sum(((p - book[c]) ** 2).sum(axis=1) for p, book, c in zip(pieces, books, codes))
    by_label = Counter()
    for r, e in zip(kept, error.tolist()):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    return Counter(
        (r[0], "".join(f"{c[k]:02x}" for c in codes), e, by_label[r[2]], digest)
        for k, (r, e) in enumerate(zip(kept, error.tolist()))
    )


def odd_vectors(n, dim, seed):
    """Clusters, one very common vector, ties between entries, nulls, repeated ids and labels."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            v = [0.25] * dim
        elif kind < 0.6:
            v = [rng.randrange(-2, 3) / 512 for _ in range(dim)]
        else:
            v = [c + rng.gauss(0, 0.02) for c in rng.choice(centres)]
        rows.append((rng.randrange(n), [float(np.float32(x)) for x in v], rng.choice([None, 1, 1, 1, 2, 3])))
    rows += [(None, [0.5] * dim, None), (1, None, 1), (2, [], 1), (3, [None] * dim, 2), (4, [float("nan")] * dim, 2)]
    rows += [(5, [float("inf"), *[0.0] * (dim - 1)], 1), (6, [float("-inf"), *[0.0] * (dim - 1)], 1)]
    return rows


@pytest.mark.parametrize("n, dim", [(1500, 16), (40, 8), (300, 64), (1, 4)])
def test_query(spark, tmp_path, n, dim):
    rows = odd_vectors(n, dim, n)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = Counter(map(tuple, op13_vector_codes(spark, str(tmp_path)).collect()))
    assert out == plain(rows)


def test_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, op13_vector_codes(spark, folder).collect())) == plain(rows)


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_assign(kind):
    """Trees of every shape give the entry, the sums and the counts of a plain comparison."""
    rng = np.random.default_rng(3)
    for case in range(150):
        n, m, w = int(rng.integers(1, 400)), int(rng.integers(1, 40)), int(rng.integers(1, 5))
        reach = int(rng.choice([2, 30, 1000]))
        x, book = rng.integers(-reach, reach, (n, w)).astype(kind), rng.integers(-reach, reach, (m, w)).astype(kind)
        if case % 3 == 0:
            x[: n // 2] = book[0]
        order = vectorcodes.tree_order(x, 8)
        assert sorted(order.tolist()) == list(range(n))
        got, sums, counts = vectorcodes.assign(vectorcodes.Tree(x[order], 8), book, vectorcodes.tree_order(book, 1))
        want = ((x[order][:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert got.tolist() == want.tolist()
        assert counts.tolist() == np.bincount(want, minlength=m).tolist()
        plain_sums = np.zeros((m, w))
        np.add.at(plain_sums, want, x[order])
        assert sums.tolist() == plain_sums.tolist()


def test_trees_assign_whole_nodes():
    """On clusters, most rows are assigned without being compared one by one."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-1000, 1000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(float)
    order = vectorcodes.tree_order(x, 64)
    tree = vectorcodes.Tree(x[order], 64)
    compared = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            compared.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    tree.x = tree.x.view(Watched)
    vectorcodes.assign(tree, centres.astype(float), vectorcodes.tree_order(centres, 1))
    assert sum(compared) < len(x) / 2


def test_large_numbers_other_lengths_and_names(spark):
    rows = [(1, [1e30, -1e30, 0.0, 1.0], "a"), (2, [0.5] * 4, None), (3, [0.5] * 8, "a")]
    fields = "vec_id long, embedding array<float>, label string, codes int, error string, of int"
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], fields)
    out = {r["vec_id"]: r for r in vectorcodes.compress(docs).collect()}
    assert sorted(out) == [1, 2] and all(r["error"] == 0 and r["label_error"] == 0 for r in out.values())
    assert vectorcodes.compress(spark.createDataFrame([(1, [0.5] * 6, "a")], "vec_id long, embedding array<float>, label string")).count() == 0


def test_empty_and_decode(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vectorcodes.compress(empty).count() == 0
    rows = [(i, [i / 8] * 8, i % 2) for i in range(20)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    fitted = vectorcodes.fit(vectors, entries=20)
    back = vectorcodes.decode(vectorcodes.encode(fitted, T.IntegerType()), fitted.codebooks)
    assert {r["vec_id"]: list(r["rebuilt"]) for r in back.collect()} == {i: v for i, v, _ in rows}
