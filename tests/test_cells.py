"""Nearest neighbours by cells against brute force."""

import numpy as np
import pytest

from vecsnap.operators import cells, search


def frame(spark, x, id_col, vec, shift=0):
    rows = [(int(i) + shift, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"{id_col} bigint, {vec} array<double>").repartition(3)


def plain(q, y, k, metric, skip=False):
    out = {}
    for i, a in enumerate(q):
        score = -((a - y) ** 2).sum(axis=1) if metric == "l2" else y @ a
        ids = [j for j in np.lexsort((np.arange(len(y)), -score)) if not (skip and i == j)][:k]
        out[i] = [(j, score[j]) for j in ids]
    return out


def tables(kind):
    rng = np.random.default_rng(5)
    if kind == "grid":  # many ties
        return rng.integers(-2, 3, (150, 3)).astype(float), rng.integers(-2, 3, (400, 3)).astype(float)
    if kind == "hot":  # one vector holds a third of either side
        q, y = rng.standard_normal((200, 5)), rng.standard_normal((500, 5))
        q[:70], y[:180] = 0.5, 0.5
        return q, y
    centres = 5 * rng.standard_normal((12, 8))
    return (centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, 8)) for n in (250, 600))


@pytest.mark.parametrize("metric", ["l2", "dot"])
@pytest.mark.parametrize("kind", ["grid", "hot", "clusters"])
@pytest.mark.parametrize("k, sizes", [(1, {}), (7, dict(n_pivots=20, group_rows=40, query_rows=30)), (60, dict(n_pivots=9, group_rows=25))])
def test_equals_brute_force(spark, metric, kind, k, sizes):
    q, y = tables(kind)
    out = cells.nearest_by_cells(frame(spark, q, "q_id", "q_vec"), frame(spark, y, "vec_id", "embedding"), k, q.shape[1], metric=metric, **sizes)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["q_id"], r["rank"])):
        got.setdefault(r["q_id"], []).append((r["vec_id"], r["score"]))
    want = plain(q, y, k, metric)
    assert sorted(got) == sorted(want)
    for i, rows in want.items():
        scores = [np.sqrt(-s) if metric == "l2" else s for _, s in rows]
        assert np.allclose([s for _, s in got[i]], scores, atol=1e-12)
        if metric == "l2":
            assert [j for j, _ in got[i]] == [j for j, _ in rows]


def test_skips_the_same_id(spark):
    _, y = tables("hot")
    df = frame(spark, y, "vec_id", "embedding")
    q = df.selectExpr("vec_id AS q_id", "embedding AS q_vec")
    out = cells.nearest_by_cells(q, df, 2, 5, skip_same_id=True, n_pivots=12, group_rows=50, query_rows=40)
    got = {(r["q_id"], r["rank"]): r["vec_id"] for r in out.collect()}
    want = plain(y, y, 2, "l2", skip=True)
    assert got == {(i, rank + 1): rows[rank][0] for i, rows in want.items() for rank in range(2)}


def test_work_is_below_all_pairs(spark):
    q, y = tables("clusters")
    args = (frame(spark, q, "q_id", "q_vec"), frame(spark, y, "vec_id", "embedding"), 3, 8)
    r = cells.search_work(*args).first()
    assert (r["n_queries"], r["n_items"], r["all_pairs"]) == (250, 600, 150_000)
    assert r["computed"] < 0.5 * r["all_pairs"]


def test_groups_are_bounded(spark):
    """No group holds more items than allowed, however many are equal."""
    _, y = tables("hot")
    items = frame(spark, y, "id", "v")
    _, dealt = cells.build_cells(items, 5, n_pivots=15, group_rows=40)
    sizes = [r["count"] for r in dealt.groupBy("grp").count().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 70


def test_empty_and_large_tables(spark):
    q, y = tables("clusters")
    queries, items = frame(spark, q, "q_id", "q_vec"), frame(spark, y, "vec_id", "embedding")
    assert cells.nearest_by_cells(queries, items.limit(0), 3, 8).count() == 0
    assert cells.nearest_by_cells(queries.limit(0), items, 3, 8).count() == 0
    big = search.nearest(queries, items, 3, 8, ship_bytes=1000).collect()
    want = plain(q, y, 3, "l2")
    assert {(r["q_id"], r["rank"]): r["vec_id"] for r in big} == {(i, n + 1): v[n][0] for i, v in want.items() for n in range(3)}


def test_large_tables_have_few_groups(spark, monkeypatch):
    """Groups grow with a table, floats travel as floats, and vectors of the last visits are not stored."""
    for name, value in dict(GROUP_ROWS=20, GROUPS=4).items():
        monkeypatch.setattr(cells, name, value)
    q, y = (x.astype(np.float32) for x in tables("clusters"))
    queries, items = frame(spark, q, "q_id", "q_vec"), frame(spark, y, "vec_id", "embedding")
    floats = queries.selectExpr("q_id", "CAST(q_vec AS array<float>) AS q_vec")
    left, right = cells._side(floats, "q_id", "q_vec"), cells._side(items, "vec_id", "embedding")
    assert left.schema["v"].dataType.simpleString() == "array<float>"
    built, _ = cells.build_cells(right, 8)
    assert len(built.rows) <= 2 * 4 + 1
    visits, _ = cells.search_cells(left, right, 3, 8)
    assert "v" not in visits.columns
    want = plain(q.astype(float), y.astype(float), 3, "l2")
    got = {(r["q"], r["rank"]): r["i"] for r in cells.best_of_visits(visits, 3).collect()}
    assert got == {(i, n + 1): v[n][0] for i, v in want.items() for n in range(3)}
