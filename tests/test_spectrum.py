"""Common neighbours, products and eigenvalues of all pairs against plain matrices."""

from collections import Counter

import numpy as np
import pytest

from vecsnap.codecs.graphcode import adjacency, vertices
from vecsnap.operators import spectrum


def edge_table(spark, matrix):
    rows = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(matrix)))]
    return spark.createDataFrame(rows, "a bigint, b bigint").repartition(3)


def random_graph(n, hubs, seed):
    rng = np.random.default_rng(seed)
    m = np.triu(rng.random((n, n)) < 0.06, 1)
    m[:hubs] |= np.triu(rng.random((hubs, n)) < 0.7, 1)[:hubs]
    m = m | m.T
    np.fill_diagonal(m, False)
    m[0, 1] = m[1, 0] = True
    return m


@pytest.mark.parametrize("hub_degree, block", [(1000, 2048), (15, 2048), (15, 11), (0, 9)])
def test_neighbour_histogram(spark, hub_degree, block):
    m = random_graph(60, 4, 3)
    m = m[m.any(axis=1)][:, m.any(axis=1)]
    common = m.astype(int) @ m.astype(int)
    upper = np.triu(np.ones(m.shape, dtype=bool), 1)
    want = Counter((bool(f), int(c)) for f, c in zip(m[upper], common[upper]))
    out = spectrum.neighbour_histogram(edge_table(spark, m), hub_degree, block_vertices=block).collect()
    assert {(r["adjacent"], r["shared"]): r["n_pairs"] for r in out} == dict(want)


def test_light_neighbours_make_no_rows(spark, monkeypatch):
    """Twenty vertices just below the limit beside one hub: the pairs they make are met in blocks, never joined as rows."""
    m = np.zeros((80, 80), dtype=bool)
    m[:20, 20:] = np.random.default_rng(4).random((20, 60)) < 0.8
    m[20, 20:] = True
    m[20, 20] = False
    m |= m.T
    common, upper = m.astype(int) @ m.astype(int), np.triu(np.ones(m.shape, dtype=bool), 1)
    most = int(m.sum(axis=0).max())
    monkeypatch.setattr(spectrum, "_block_pairs", None)
    out = spectrum.neighbour_histogram(edge_table(spark, m), most - 1).collect()
    want = Counter((bool(f), int(c)) for f, c in zip(m[upper], common[upper]))
    assert {(r["adjacent"], r["shared"]): r["n_pairs"] for r in out} == dict(want)


def test_block_graph(spark):
    """The 100-vertex graph: 0 common neighbours or 6, three products, three eigenvalues."""
    edges = edge_table(spark, adjacency())
    out = {tuple(r) for r in spectrum.neighbour_histogram(edges).collect()}
    assert out == {(True, 0, 1100), (False, 6, 3850)}
    out = {(r["eigenvalue"], r["multiplicity"]) for r in spectrum.eigenvalues(edges).collect()}
    assert out == {(22.0, 1), (2.0, 77), (-8.0, 22)}
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(vertices())]
    df = spark.createDataFrame(rows, "id bigint, x array<double>")
    gram = np.round(vertices() @ vertices().T, 6) + 0.0
    upper = np.triu(np.ones(gram.shape, dtype=bool), 1)
    want = Counter((bool(f), float(p)) for f, p in zip(adjacency()[upper], gram[upper]))
    for block in (2048, 17):
        out = spectrum.rounded_products(df, edges, "id", "x", 22, block_vertices=block).collect()
        assert {(r["adjacent"], r["product"]): r["n_pairs"] for r in out} == dict(want) and len(want) == 2


def test_eigenvalues(spark):
    cycle = np.roll(np.eye(5), 1, axis=1)
    cycle = cycle + cycle.T > 0
    out = {(r["eigenvalue"], r["multiplicity"]) for r in spectrum.eigenvalues(edge_table(spark, cycle)).collect()}
    assert out == {(2.0, 1), (0.618034, 2), (-1.618034, 2)}
    cube = np.array([[bin(i ^ j).count("1") == 1 for j in range(16)] for i in range(16)])
    out = {(r["eigenvalue"], r["multiplicity"]) for r in spectrum.eigenvalues(edge_table(spark, cube)).collect()}
    assert out == {(4.0, 1), (2.0, 4), (0.0, 6), (-2.0, 4), (-4.0, 1)}
    with pytest.raises(ValueError):
        spectrum.eigenvalues(edge_table(spark, random_graph(40, 2, 1)), most=4).collect()


@pytest.mark.parametrize("products, bins", [(1 << 16, 1 << 18), (64, 1)])
def test_products_in_few_blocks(spark, monkeypatch, products, bins):
    """Large tables are cut into a bounded number of blocks; counts by number and by sorting agree with all pairs."""
    seen, block_pairs = [], spectrum._block_pairs
    monkeypatch.setattr(spectrum, "_block_pairs", lambda rows, key, blocks: seen.append(blocks) or block_pairs(rows, key, blocks))
    for name, value in dict(BLOCK_VERTICES=8, PRODUCT_BLOCKS=3, PRODUCTS=products, MOST_BINS=bins).items():
        monkeypatch.setattr(spectrum, name, value)
    x = np.random.default_rng(2).normal(size=(60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    pairs = spark.createDataFrame([(3, 4), (4, 3), (5, 50), (7, 7), (9, None), (1, 900)], "a long, b long")
    got = {(r["adjacent"], r["product"]): r["n_pairs"] for r in spectrum.rounded_products(df, pairs, "id", "v", 4, digits=1).collect()}
    want: dict = {}
    for i in range(60):
        for j in range(i + 1, 60):
            key = ((i, j) in ((3, 4), (5, 50)), float(np.round(x[i].astype(float) @ x[j].astype(float), 1) + 0.0))
            want[key] = want.get(key, 0) + 1
    assert got == want and seen == [3]
