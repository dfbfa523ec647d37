"""Quantiles, running totals, search, sets, graphs, memory, subspace: against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsnap.codecs.graphcode import adjacency, design_blocks, vertices
from vecsnap.codecs.scalar import weight_table_lattice
from vecsnap.functions import bits
from vecsnap.kernels.lattice import nearest_e8
from vecsnap.operators import entropy, graph, memory, metrics, sampling, search, sets, subspace
from vecsnap.operators.quantiles import exact_quantiles, order_statistic
from vecsnap.operators.running import running_totals

PROBS = [0.0, 0.001, 0.25, 0.5, 0.93, 0.999, 1.0]


@pytest.mark.parametrize("buffer_values", [3, 40, 10**6])
@pytest.mark.parametrize("shape", ["smooth", "ties", "heavy", "huge"])
def test_exact_quantiles(spark, buffer_values, shape):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(3000)
    if shape == "ties":
        x = np.round(x)
    if shape == "heavy":
        x[:1100] = 0.25  # one value holds a third of the rows
    if shape == "huge":
        x = np.exp(40 * x)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    got = exact_quantiles(df, "v", PROBS, ["g"], buffer_values=buffer_values)
    for g in range(3):
        assert np.allclose(got[(g,)], np.quantile(x[g::3], PROBS), rtol=1e-12, atol=1e-15)
    whole = exact_quantiles(df, "v", PROBS, buffer_values=buffer_values, with_mean=True)[()]
    assert np.allclose(whole[:-1], np.quantile(x, PROBS), rtol=1e-12, atol=1e-15)
    assert whole[-1] == pytest.approx(x.mean())


def test_quantiles_of_little(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert exact_quantiles(df, "v", [0.5])[()] == [1.0]
    assert exact_quantiles(df.where("v > 5"), "v", [0.5]) == {}
    assert exact_quantiles(df.where("v > 5"), "v", [0.5], max_rows=10) == {}
    ids = spark.range(1000).withColumn("id", F.col("id") * 7)
    assert order_statistic(ids, "id", 10) == 63


@pytest.mark.parametrize("small", [None, 10**6])
def test_running_totals_with_a_hot_key(spark, small):
    rng = np.random.default_rng(2)
    rows = [(i, 0 if rng.random() < 0.4 else int(rng.integers(1, 9)), float(rng.random())) for i in range(4000)]
    df = spark.createDataFrame(rows, "t bigint, k int, v double").repartition(5)
    out = running_totals(df, "t", {"s": F.col("v"), "n": F.lit(1)}, ["k"], buckets=16, small_rows=small)
    sums, counts = {}, {}
    want = {}
    for t, k, v in rows:
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
        want[t] = (sums[k], counts[k])
    for r in out.collect():
        assert (r["s"], r["n"]) == pytest.approx(want[r["t"]])
    assert out.columns == ["t", "k", "v", "s", "n"]


def test_running_totals_keep_null_rows(spark):
    rows = [(None, 1, 5.0), (1, None, 1.0), (2, None, 2.0), (3, 1, 1.0)]
    df = spark.createDataFrame(rows, "t bigint, k int, v double")
    for small in (None, 10):
        out = running_totals(df, "t", {"s": F.col("v")}, ["k"], buckets=4, small_rows=small).collect()
        assert {(r["t"], r["k"], r["s"]) for r in out} == {(None, 1, 5.0), (3, 1, 6.0), (1, None, 1.0), (2, None, 3.0)}


def test_sampling(spark, vectors):
    a = sampling.hash_sample(vectors, "vec_id", 30, 5)
    b = sampling.hash_sample(vectors.repartition(7), "vec_id", 30, 5)
    ids = {r["vec_id"] for r in a.collect()}
    assert len(ids) == 30 and ids == {r["vec_id"] for r in b.collect()}
    assert sampling.hash_sample(vectors, "vec_id", 10**6).count() == vectors.count()
    order = sampling.hash_shuffle(vectors, "vec_id").select("vec_id").collect()
    assert [r[0] for r in order] != sorted(r[0] for r in order)
    parts = {r["part"]: r["n"] for r in sampling.split_by_position(vectors, "vec_id", cal_rows=50)
             .groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 200, "cal": 50, "test": 250}
    pos = sampling.positions(vectors, "vec_id").orderBy("vec_id").select("position").collect()
    assert [r[0] for r in pos] == list(range(1, 501))


def brute_nearest(q, x, k, metric, skip):
    d = q @ x.T if metric == "dot" else -np.linalg.norm(q[:, None] - x[None], axis=2)
    out = set()
    for i in range(len(q)):
        order = sorted((j for j in range(len(x)) if not (skip and i == j)), key=lambda j: (-d[i, j], j))
        out |= {(i, j, r + 1) for r, j in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("metric,skip", [("l2", True), ("dot", False)])
@pytest.mark.parametrize("rows", [10**6, 60, 7])
def test_nearest_in_every_shape(spark, vectors, matrix, metric, skip, rows):
    queries = vectors.where("vec_id < 20").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    got = search.nearest(
        queries, vectors.repartition(4), 4, 64, metric=metric, skip_same_id=skip, ship_bytes=rows * 8 * 64
    )
    want = brute_nearest(matrix[:20], matrix, 4, metric, skip)
    assert {(r["q_id"], r["vec_id"], r["rank"]) for r in got.collect()} == want
    if metric == "l2":
        r = got.first()
        assert r["score"] == pytest.approx(np.linalg.norm(matrix[r["q_id"]] - matrix[r["vec_id"]]))


def test_nearest_keeps_ties_by_id(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q_id bigint, q_vec array<double>")
    for limit in (10**6, 16 * 5):
        got = search.nearest(q, items.repartition(3), 3, 2, ship_bytes=limit).collect()
        assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 0), (2, 1), (3, 2)]


def test_recall_and_needles(vectors):
    same = vectors.withColumn("rebuilt", F.col("embedding").cast("array<double>"))
    assert search.recall_at_k(same, "embedding", "rebuilt", 64).first()["recall"] == 1.0
    q = vectors.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    assert search.find_needles(q, same, 64).where("NOT hit").count() == 0


def test_score_fidelity(vectors, matrix):
    q = vectors.where("vec_id < 5").select(F.col("embedding").alias("q_vec"))
    both = vectors.withColumn("rebuilt", F.transform("embedding", lambda v: F.round(v.cast("double"), 1)))
    r = search.score_fidelity(q, both, "embedding", "rebuilt", 64, weight=0.25).first()
    hat = np.array([x["rebuilt"] for x in both.orderBy("vec_id").collect()])
    a, b = matrix[:5] @ matrix.T, matrix[:5] @ hat.T
    mse, qk = np.mean((matrix - hat) ** 2), np.mean((a - b) ** 2)
    want = 0.75 * mse / (np.var(matrix) + 1e-12) + 0.25 * qk / (np.var(a) + 1e-12)
    assert r["combined"] == pytest.approx(want) and r["qk_mse"] == pytest.approx(qk)


def random_sets(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(120):
        size = 25 if s < 4 else int(rng.integers(1, 11))
        items = set(rng.integers(0, 60, size).tolist()) | ({7} if s % 3 == 0 else set())  # item 7 is hot
        rows += [(s, int(x)) for x in items]
    return rows


@pytest.mark.parametrize("small_set", [3, 8, 12])
def test_set_overlaps(spark, small_set):
    rows = random_sets()
    df = spark.createDataFrame(rows + rows[:50], "s bigint, x int").repartition(4)
    family = {}
    for s, x in rows:
        family.setdefault(s, set()).add(x)
    hist = {}
    for a, b in itertools.combinations(family, 2):
        shared = len(family[a] & family[b])
        hist[shared] = hist.get(shared, 0) + 1
    got = {r["shared"]: r["n_pairs"] for r in sets.overlap_histogram(df, "s", "x", small_set).collect()}
    assert got == hist
    for r in sets.disjoint_partners(df, "s", "x", small_set).collect():
        met = sum(1 for t in family if t != r["s"] and family[t] & family[r["s"]])
        assert (r["n_items"], r["n_overlapping"], r["n_disjoint"]) == (len(family[r["s"]]), met, 119 - met)


def test_design(spark):
    words = bits.messages(spark.range(4096), "id").where("weight = 8")
    octads = words.select("id", bits.support(F.col("word")).alias("points"))
    blocks = sets.derived_blocks(octads, "points", [0, 1])
    assert {frozenset(r["block"]) for r in blocks.collect()} == set(design_blocks())
    members = blocks.select("id", F.explode("block").alias("x"))
    check = sets.cover_check(members, "id", "x", 3).first()
    assert check["exactly_once"] and check["n_covered"] == 1540 and check["n_sets"] == 77
    partners = sets.disjoint_partners(members, "id", "x").select("n_disjoint").distinct().collect()
    assert [r[0] for r in partners] == [16]
    assert [r["n"] for r in sets.incidence(members, "id", "x").select("n").distinct().collect()] == [21]
    fewer = members.where("NOT (x = 3 AND id % 8 = 3)")
    assert not sets.cover_check(fewer, "id", "x", 3).first()["exactly_once"]


def test_graph_regularity(spark):
    a = adjacency()
    edges = graph.undirected(
        spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))], "src int, dst int")
    )
    r = graph.regularity(edges).first()
    assert (r["n_vertices"], r["n_edges"], r["degree_min"], r["degree_max"]) == (100, 1100, 22, 22)
    assert (r["lambda_min"], r["lambda_max"], r["mu_mean"], r["mu_variance"]) == (0, 0, 6.0, 0.0)
    assert r["strongly_regular"]
    assert not graph.regularity(edges.where("NOT (a = 0 AND b = 1)")).first()["strongly_regular"]
    hist = graph.degree_histogram(edges).first()
    assert (hist["degree"], hist["n_vertices"]) == (22, 100)


def test_common_neighbours(spark):
    rng = np.random.default_rng(6)
    a = np.triu(rng.random((40, 40)) < 0.15, 1)
    a[0, 1:] = True  # a hub
    a = a | a.T
    edges = graph.undirected(spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))], "src int, dst int"))
    pairs = [(i, j) for i, j in itertools.combinations(range(40), 2)] + [(3, 99)]
    got = graph.common_neighbours(edges, spark.createDataFrame(pairs, "a int, b int")).collect()
    square = a.astype(int) @ a.astype(int)
    assert len(got) == len(pairs)
    assert all(r["n_common"] == (0 if r["b"] == 99 else square[r["a"], r["b"]]) for r in got)
    r = graph.regularity(edges).first()
    far = [square[i, j] for i, j in itertools.combinations(range(40), 2) if not a[i, j]]
    assert r["mu_mean"] == pytest.approx(np.mean(far)) and r["mu_variance"] == pytest.approx(np.var(far))


@pytest.mark.parametrize("room, bucket", [(1 << 15, 1 << 20), (7, 9)])
def test_graph_regularity_in_blocks(spark, monkeypatch, room, bucket):
    """Triangles and 4-cycles of a graph with a hub, met in small blocks and in parts of a vertex; no wedge or pair is exchanged."""
    monkeypatch.setattr(graph.sets, "MEET_PAIRS", room)
    monkeypatch.setattr(graph.sets, "BUCKET_SETS", bucket)
    rng = np.random.default_rng(8)
    a = np.triu(rng.random((40, 40)) < 0.2, 1)
    a[0, 1:] = True
    a = a | a.T
    edges = graph.undirected(spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))], "src int, dst int"))
    square, upper = a.astype(int) @ a.astype(int), np.triu(np.ones(a.shape, dtype=bool), 1)
    r = graph.regularity(edges).first()
    assert (r["n_edges"], r["lambda_min"], r["lambda_max"]) == (a.sum() // 2, square[a].min(), square[a].max())
    far = square[upper & ~a]
    assert r["mu_mean"] == pytest.approx(far.mean()) and r["mu_variance"] == pytest.approx(far.var())
    closed = {(x["a"], x["b"]): x["n"] for x in graph._closed_wedges(edges, graph.degrees(edges)).collect()}
    common = square[upper]
    assert closed.pop((None, None)) == (common * (common - 1) // 2).sum() // 2
    assert sorted(closed.values()) == sorted(c for c in square[upper & a].tolist() if c)
    none = graph.regularity(edges.limit(0)).first()
    assert (none["n_vertices"], none["n_edges"], none["lambda_min"], none["mu_mean"]) == (0, 0, None, None)


def test_product_statistics(spark):
    v = vertices()
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id bigint, v array<double>")
    edges = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(adjacency())))]
    rows = graph.product_statistics(df, spark.createDataFrame(edges, "a bigint, b bigint"), "id", "v", 22).collect()
    by = {r["adjacent"]: r for r in rows}
    assert by[True]["n_pairs"] == 1100 and by[True]["mean"] == pytest.approx(-0.08)
    assert by[False]["n_pairs"] == 3850 and by[False]["mean"] == pytest.approx(0.02)
    assert by[True]["deviation"] < 1e-7 and by[False]["deviation"] < 1e-7


def replay(log, capacity):
    """The commands applied one after another."""
    slots, n = {}, 0
    for _, op, slot, key, value in sorted(log):
        if op == "store":
            if slot is None:
                slot, n = n % capacity, n + 1
            slots[slot] = [key, value, False]
        elif slot in slots and op == "forget":
            slots[slot][2] = True
        elif slot in slots and not slots[slot][2]:
            slots[slot][1] = value
    return slots


LOG = "seq bigint, op string, slot bigint, key array<double>, value array<double>"


def random_log(n=400, capacity=10, seed=8):
    rng = np.random.default_rng(seed)
    log = []
    for i in range(n):
        op = ["store", "forget", "update"][int(rng.choice(3, p=[0.4, 0.2, 0.4]))]
        slot = int(rng.integers(0, capacity)) if rng.random() < 0.6 else 3  # slot 3 is hot
        if op == "store" and rng.random() < 0.7:
            slot = None
        key = [float(v) for v in rng.standard_normal(8)] if op == "store" else None
        log.append((i, op, slot, key, None if op == "forget" else [float(i)]))
    return log


def same_memory(state, want):
    got = {r["slot"]: r for r in state.collect()}
    assert set(got) == set(want)
    for slot, (key, value, gone) in want.items():
        assert got[slot]["value"] == value and got[slot]["forgotten"] == gone
        assert np.allclose(got[slot]["key"], nearest_e8(np.array([key]) * 10)[0] / 10)


@pytest.mark.parametrize("capacity", [10, 64, 1000])
def test_memory_replay(spark, capacity):
    log = random_log(capacity=min(capacity, 40))
    df = spark.createDataFrame(log, LOG).repartition(5)
    same_memory(memory.build_memory(df, 8, capacity), replay(log, capacity))


def test_memory_facts(spark):
    """Store two facts, retrieve both, forget the first: it is gone, the second stays."""
    rng = np.random.default_rng(0)
    k = rng.standard_normal((2, 128))
    facts = [[1.0, 2.0, 3.0] + [0.0] * 125, [9.0, 8.0, 7.0] + [0.0] * 125]
    log = [(i, "store", None, k[i].tolist(), facts[i]) for i in range(2)]
    q = spark.createDataFrame([(i, k[i].tolist()) for i in range(2)], "q_id bigint, q_vec array<double>")
    state = memory.build_memory(spark.createDataFrame(log, LOG), 128, 10)
    found = {r["q_id"]: r["value"] for r in search.retrieve(q, state, 128).collect()}
    assert found == {0: facts[0], 1: facts[1]}
    log.append((2, "forget", 0, None, None))
    state = memory.build_memory(spark.createDataFrame(log, LOG), 128, 10)
    for limit in (1 << 20, 1):
        found = {r["q_id"]: r["value"] for r in search.retrieve(q, state, 128, ship_bytes=limit).collect()}
        assert found == {0: facts[1], 1: facts[1]}


def test_energy_subspace(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((100, 8)) @ rng.standard_normal((8, 256)) + 0.05 * rng.standard_normal((100, 256))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>").repartition(6)
    vectors_, values = subspace.energy_subspace(df, "v", 256, rank=16, energy=0.9)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(values, s[: len(values)], rtol=1e-3)
    assert len(values) == np.flatnonzero(np.cumsum(s**2) / np.sum(s**2) >= 0.9)[0] + 1
    assert np.allclose(vectors_ @ vectors_.T, np.eye(len(values)), atol=1e-8)


def test_sum_matrices_tree(spark, vectors, matrix):
    many = vectors.repartition(150)
    n, total, gram, squares, _ = subspace.gram_sums(many, "embedding", 64)
    assert n == 500 and np.allclose(total, matrix.sum(0)) and np.allclose(gram, matrix.T @ matrix)
    assert squares == pytest.approx(np.square(matrix).sum())


@pytest.mark.parametrize("limit", [1 << 20, 8 * 64 * 3])
def test_multiply(spark, vectors, matrix, limit):
    w = np.random.default_rng(1).standard_normal((7, 64))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "out_id int, w array<double>")
    coded = weight_table_lattice(table, "w", 64)
    got = subspace.multiply(vectors, coded, 64, ship_bytes=limit).orderBy("vec_id").collect()
    scale = w.std(ddof=1) + 1e-12
    wq = nearest_e8(w / scale * 100) / 100 * scale
    assert np.allclose(np.array([r["y"] for r in got]), matrix @ wq.T)


def test_metrics(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 2.0], [1.0, 1.0]), (1, [0.0, 3.0], [0.0, 3.0])], "id int, embedding array<double>, rebuilt array<double>"
    )
    r = metrics.summarize(metrics.row_errors(df)).first()
    assert r["mse"] == 0.25 and r["max_abs"] == 1.0 and r["snr_db"] == pytest.approx(10 * np.log10(3.5 / 0.25))
    assert r["norm_ratio_db"] == pytest.approx(r["snr_db"])
    exact = df.withColumn("rebuilt", F.col("embedding"))
    assert metrics.summarize(metrics.row_errors(exact)).first()["snr_db"] == pytest.approx(10 * np.log10(3.5 / 1e-30))
    assert metrics.summarize(metrics.row_errors(exact), floor=0).first()["snr_db"] == float("inf")
    assert metrics.max_difference(df, exact, "id", "rebuilt").first()[0] == 1.0
    labels = spark.createDataFrame([(150.0,), (50.0,), (3.0,)], "snr double").select(metrics.status(F.col("snr")))
    assert [x[0] for x in labels.collect()] == ["BIT EXACT", "STABLE", "N/A"]


def test_entropy_of_repeated_codes(spark):
    rows = [(0, 1, 1, None)] * 6 + [(0, 1, 2, None)] * 2 + [(1, 0, 0, b"x")] * 4
    codes = spark.createDataFrame(rows, "stage int, k0 bigint, k1 bigint, wide binary")
    got = {r["stage"]: r for r in entropy.code_entropy(codes).collect()}
    assert got[0]["entropy_bits"] == pytest.approx(0.811278, abs=1e-6) and got[0]["n_distinct"] == 2
    assert got[1]["entropy_bits"] == 0.0
    sizes = entropy.cache_gigabytes(spark.createDataFrame([(10_000_000,)], "n bigint"), "n").first()
    assert sizes["fp16_gb"] == pytest.approx(1220.70, abs=0.01) and sizes["saving_pct"] == pytest.approx(86.25)


def test_running_totals_keep_null_values(spark):
    rows = [(i, None if i in (0, 50, 51, 52, 99) else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "seq int, v double")
    many = running_totals(df, "seq", {"t": F.col("v")}, buckets=50)
    one = running_totals(df, "seq", {"t": F.col("v")}, small_rows=100)
    assert sorted(many.collect()) == sorted(one.collect())


def test_order_statistic_of_large_ids(spark):
    base = 1 << 60
    df = spark.range(300).select((F.col("id") + base).alias("id"))
    assert [order_statistic(df, "id", k) for k in (1, 60, 300)] == [base, base + 59, base + 299]
    signed = spark.range(300).select((F.col("id") * (1 << 33) - (1 << 40)).alias("id"))
    assert order_statistic(signed, "id", 7) == 6 * (1 << 33) - (1 << 40)
