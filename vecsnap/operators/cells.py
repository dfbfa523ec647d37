"""Exact nearest neighbours of a whole table in a whole table, by cells around pivots.

A bounded sample of the items gives pivots; every item belongs to the cell of its nearest pivot, and
neighbouring cells form groups of bounded size. A query first visits one group, that of its own
cell, whose k-th distance is an upper bound. A cell can then be left out where the triangle
inequality (distances to its pivot, least and greatest radius) or the bisector between two pivots
puts all its items beyond that bound. A second exchange takes the query to the groups of the cells
that are left, with one row per group whatever the number of cells.

A large cell is dealt to several groups, and a group that many queries visit is copied for slices of
these queries, so neither a frequent vector nor a popular cell is one task. The driver holds the
pivots and three numbers per cell and group, all of bounded count; no table passes through it.

Inner products are searched as distances: items get one more component that brings all of them to
the same length, queries a zero. Scores themselves come from the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsnap.kernels.arrow import slices, to_matrix
from vecsnap.operators.sampling import hash_sample
from vecsnap.operators.search import _best, _TopK
from vecsnap.session import written

PIVOT_BYTES = 16 << 20
MAX_PIVOTS = 4096
# Items of a group, and queries that one copy of a group answers. Large tables have larger groups, so that
# a query goes to no more than some GROUPS of them, and no more slices than a cluster has use for.
GROUP_ROWS, MOST_GROUP_ROWS, GROUPS = 16_384, 131_072, 16
QUERY_ROWS, LEAST_SLICE, SLICES = 65_536, 1024, 256
# Working set of a block of queries against one cell.
BLOCK_BYTES = 8 << 20
VISIT = "id bigint, ids array<bigint>, scores array<double>, bound double, compared bigint"
# Computed distances may be off by this share of the lengths involved; bounds are widened by it.
SLACK = 1e-9


@dataclass(frozen=True)
class Cells:
    """Pivots in an order that keeps neighbours together, the radii of their cells, and their groups."""

    pivots: np.ndarray  # (cells, dim), or dim + 1 for inner products
    inner: np.ndarray  # least and greatest distance of a cell's items to its pivot
    outer: np.ndarray
    group: np.ndarray  # first group of a cell, and over how many groups it is dealt
    spread: np.ndarray
    rows: np.ndarray  # items of every group
    metric: str
    length: float  # greatest length of an item, for inner products

    def lift(self, x: np.ndarray, item: bool) -> np.ndarray:
        """Vectors in the space of the pivots."""
        if self.metric == "l2":
            return x
        rest = np.sqrt(np.maximum(self.length**2 - np.einsum("ij,ij->i", x, x), 0.0)) if item else np.zeros(len(x))
        return np.c_[x, rest]

    def distances(self, lifted: np.ndarray, cells: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Distances to pivots, at full precision for short vectors too."""
        p = self.pivots[cells]
        square = np.einsum("ij,ij->i", lifted, lifted)[:, None] + np.einsum("ij,ij->i", p, p)[None, :]
        return np.sqrt(np.maximum(square - 2.0 * lifted @ p.T, 0.0))

    def reach(self, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The k-th score of a query as a distance in the space of the pivots."""
        if self.metric == "l2":
            return np.sqrt(np.maximum(-kth, 0.0))
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x) + self.length**2 - 2.0 * kth, 0.0))

    def least(self, to_pivots: np.ndarray) -> np.ndarray:
        """A distance that no item of a cell falls below, per query and cell."""
        own = np.argmin(to_pivots, axis=1)
        bound = np.maximum(to_pivots - self.outer, self.inner - to_pivots)
        between = self.distances(self.pivots, own).T
        nearest = to_pivots[np.arange(len(own)), own][:, None]
        ahead = to_pivots**2 - nearest**2
        bisector = np.divide(ahead, 2.0 * between, out=np.zeros_like(ahead), where=between > 1e-6)
        # Products of lengths lose half the digits where vectors nearly agree.
        return np.maximum(np.maximum(bound, bisector), 0.0) - 1e-7 * (1.0 + to_pivots)


def _halved(x: np.ndarray) -> np.ndarray:
    """An order of rows in which each half, quarter and so on is near itself."""
    order, size = np.arange(len(x)), 1
    while size < len(x):
        node = np.arange(len(x)) * size // len(x)
        starts = np.flatnonzero(np.r_[True, np.diff(node) > 0])
        here = x[order]
        wide = np.argmax(np.maximum.reduceat(here, starts) - np.minimum.reduceat(here, starts), axis=1)
        order = order[np.lexsort((here[np.arange(len(x)), np.repeat(wide, np.diff(np.r_[starts, len(x)]))], node))]
        size *= 2
    return order


def _side(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    # Floats travel as they are; the kernels compute with doubles either way.
    v = F.col(vec) if df.schema[vec].dataType.simpleString() == "array<float>" else F.col(vec).cast("array<double>")
    return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def _kind(df: DataFrame) -> str:
    return df.schema["v"].dataType.simpleString()


def build_cells(
    items: DataFrame, dim: int, metric: str = "l2", n_pivots: int | None = None, group_rows: int | None = None
) -> tuple[Cells, DataFrame] | None:
    """Cells of ``items (id, v)``, and the items with ``cell`` and ``grp``, stored once."""
    n = items.count()
    if not n:
        return None
    group_rows = group_rows or min(MOST_GROUP_ROWS, max(GROUP_ROWS, -(-n // GROUPS)))
    most = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * (dim + 1))))
    n_pivots = min(most, n_pivots or max(1, int(np.sqrt(n))))
    length = 0.0
    if metric != "l2":
        square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
        length = float(np.sqrt(items.agg(F.max(square)).first()[0])) * (1 + 1e-12)
    sample = to_matrix(hash_sample(items, "id", n_pivots).limit(most).toArrow().combine_chunks().column("v").combine_chunks(), dim)
    blank = Cells(*[np.zeros((0, 0))] * 6, metric, length)
    lifted = np.unique(blank.lift(sample, item=True), axis=0)
    pivots = lifted[_halved(lifted)]
    start = Cells(pivots, *[np.zeros(len(pivots))] * 5, metric, length)
    shared = items.sparkSession.sparkContext.broadcast(start)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for part in slices(batches, max(dim, len(cells.pivots))):
            x = cells.lift(to_matrix(part.column("v"), dim), item=True)
            cell = np.argmin(cells.distances(x), axis=1)
            gap = x - cells.pivots[cell]
            far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], PLACED)

    PLACED = ["id", "v", "cell", "far"]
    placed = items.select("id", "v").mapInArrow(place, f"id bigint, v {_kind(items)}, cell int, far double")
    placed = written(placed, "cells")
    count, inner, outer = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    # An empty cell is beyond everything.
    inner[:] = np.inf
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).collect():
        count[r["cell"]], inner[r["cell"]], outer[r["cell"]] = r["n"], r["a"], r["b"]
    group, spread, rows = np.zeros(len(pivots), dtype=np.int64), np.ones(len(pivots), dtype=np.int64), []
    fill = group_rows
    for c, m in enumerate(count.tolist()):
        spread[c] = max(1, -(-m // group_rows))
        if spread[c] > 1 or fill + m > group_rows:
            rows.append(0)
            fill = 0
        group[c] = len(rows) - 1
        if spread[c] > 1:
            rows[-1:] = [-(-m // int(spread[c]))] * int(spread[c])
            fill = group_rows
        else:
            rows[-1] += m
            fill += m
    cells = Cells(pivots, inner, outer, group, spread, np.array(rows), metric, length)
    table = items.sparkSession.createDataFrame(
        [(c, int(g), int(s)) for c, (g, s) in enumerate(zip(group, spread))], "cell int, first int, spread int"
    )
    # A cell's items are dealt by position in the stored table, so equal ids and vectors part too.
    dealt = placed.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(table), "cell")
    grp = (F.col("first") + F.pmod(F.xxhash64("at"), F.col("spread"))).cast("int")
    return cells, dealt.select("id", "v", "cell", grp.alias("grp"))


def _search(cells: Cells, k: int, skip: bool, dim: int, q: pa.Table, items: pa.Table):
    """Best k of one group per query: (query row, item row, score), and how many items each met."""
    x, bound = to_matrix(q.column("v").combine_chunks(), dim), q.column("bound").to_numpy()
    ids, item_ids = q.column("id").to_numpy(), items.column("id").to_numpy()
    y, cell = to_matrix(items.column("v").combine_chunks(), dim), items.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    y, item_ids, cell = y[order], item_ids[order], cell[order]
    present, starts = np.unique(cell, return_index=True)
    ends = np.r_[starts[1:], len(cell)]
    top, compared = _TopK(len(x), k), np.zeros(len(x), dtype=np.int64)
    step = max(1, BLOCK_BYTES // (8 * max(dim, len(cells.pivots))))
    for a in range(0, len(x), step):
        rows = np.arange(a, min(a + step, len(x)))
        lifted = cells.lift(x[rows], item=False)
        to_pivots = cells.distances(lifted)
        least = cells.least(to_pivots)[:, present]
        visited = np.zeros(least.shape, dtype=bool)
        own = to_pivots[:, present] == to_pivots[:, present].min(axis=1, keepdims=True)
        # The nearest cell of the group first: its k-th score spares most of the others.
        for first in (True, False):
            for c in np.argsort(least.min(axis=0)) if not first else range(len(present)):
                reach = np.minimum(bound[rows], cells.reach(x[rows], top.scores[rows, -1]))
                go = (own[:, c] if first else ~visited[:, c]) & (least[:, c] <= reach * (1 + SLACK))
                visited[:, c] |= go
                some = rows[go]
                for b in range(starts[c], ends[c], 4096):
                    part = slice(b, min(b + 4096, ends[c]))
                    if not len(some):
                        break
                    same = ids[some][:, None] == item_ids[part][None, :] if skip else None
                    r, at, s = _best(x[some], y[part], item_ids[part], k, cells.metric, same, top.scores[some, -1])
                    keep = s > -np.inf
                    top.add(some[r[keep]], item_ids[part][at[keep]], s[keep])
                    compared[some] += part.stop - part.start
    return top, compared


def _visits(cells: Cells, items: DataFrame, queries: DataFrame, counts: dict[int, int], k: int, dim: int, skip: bool, query_rows: int):
    """One row per (query, group): the best k of the group that beat the query's bound.

    ``counts`` holds the queries of every group; items of a group with many are copied per slice.
    """
    spark = items.sparkSession
    # Small searches are cut finer, so that every core has a few slices.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = sum(counts.values()) // min(4 * partitions, max(SLICES, partitions))
    query_rows = min(query_rows, max(LEAST_SLICE, even))
    slots = [(int(g), max(1, -(-n // query_rows))) for g, n in counts.items()]
    table = F.broadcast(spark.createDataFrame(slots, "grp int, copies int"))
    shared = spark.sparkContext.broadcast(cells)

    def run(q: pa.Table, items: pa.Table) -> pa.Table:
        cells = shared.value
        if not q.num_rows or not items.num_rows:
            return pa.table({"id": q.column("id"), "ids": pa.array([[]] * q.num_rows, pa.list_(pa.int64())),
                             "scores": pa.array([[]] * q.num_rows, pa.list_(pa.float64())), "bound": q.column("bound"),
                             "compared": pa.array(np.zeros(q.num_rows, dtype=np.int64)), "v": q.column("v"), "grp": q.column("grp")})
        top, compared = _search(cells, k, skip, dim, q, items)
        held = top.scores > -np.inf
        ends = pa.array(np.r_[0, np.cumsum(held.sum(axis=1))].astype(np.int32))
        reach = cells.reach(to_matrix(q.column("v").combine_chunks(), dim), top.scores[:, -1])
        bound = np.minimum(q.column("bound").to_numpy(), reach)
        return pa.table({"id": q.column("id"), "ids": pa.ListArray.from_arrays(ends, pa.array(top.ids[held])),
                         "scores": pa.ListArray.from_arrays(ends, pa.array(top.scores[held])), "bound": pa.array(bound),
                         "compared": pa.array(compared), "v": q.column("v"), "grp": q.column("grp")})

    left = queries.join(table, "grp").withColumn("slice", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "copies"))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies").cast("bigint") - 1))
    right = items.join(table, "grp").select("id", "v", "cell", F.col("grp").alias("of"), copies.alias("copy"))
    left = left.select("id", "v", "bound", "grp", F.col("slice").cast("bigint").alias("slice"))
    both = left.groupBy("grp", "slice").cogroup(right.groupBy("of", "copy"))
    return both.applyInArrow(run, f"{VISIT}, v {_kind(queries)}, grp int")


def _count_by_group(groups: DataFrame) -> dict[int, int]:
    return {r["grp"]: r["n"] for r in groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}


def search_cells(
    queries: DataFrame, items: DataFrame, k: int, dim: int, metric: str = "l2", skip_same_id: bool = False,
    n_pivots: int | None = None, group_rows: int | None = None, query_rows: int = QUERY_ROWS,
) -> tuple[DataFrame, int] | None:
    """Visits of all queries (see ``VISIT``), stored, and the number of pivots; none without items.

    Both tables have columns ``id`` and ``v``; ids of queries are unique.
    """
    built = build_cells(items, dim, metric, n_pivots, group_rows)
    if built is None:
        return None
    cells, dealt = built
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    width = max(dim, len(cells.pivots))
    stage = f"id bigint, v {_kind(queries)}, bound double, grp int"

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group of the nearest cell; of a dealt cell, one by the query's id."""
        cells = shared.value
        for part in slices(batches, width):
            cell = np.argmin(cells.distances(cells.lift(to_matrix(part.column("v"), dim), item=False)), axis=1)
            # The sample's pivots can be without items only where vectors tie; any group will do.
            grp = cells.group[cell] + np.abs(part.column("id").to_numpy()) % cells.spread[cell]
            bound = np.full(part.num_rows, np.inf)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(bound), pa.array(grp.astype(np.int32))], ["id", "v", "bound", "grp"]
            )

    first = queries.select("id", "v").mapInArrow(home, stage)
    found = written(_visits(cells, dealt, first, _count_by_group(first), k, dim, skip_same_id, query_rows), "visits")

    def onward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per further group that holds a cell within the query's bound."""
        cells = shared.value
        whole = np.flatnonzero(cells.spread == 1)
        for part in slices(batches, width):
            x, bound = to_matrix(part.column("v"), dim), part.column("bound").to_numpy()
            least = cells.least(cells.distances(cells.lift(x, item=False)))
            near = (least <= bound[:, None] * (1 + SLACK)) & np.isfinite(cells.inner)
            go = np.zeros((len(x), len(cells.rows)), dtype=bool)
            np.logical_or.at(go, (slice(None), cells.group[whole]), near[:, whole])
            for c in np.flatnonzero(cells.spread > 1):
                go[:, cells.group[c] : cells.group[c] + cells.spread[c]] |= near[:, c : c + 1]
            go[np.arange(len(x)), part.column("grp").to_numpy()] = False
            r, g = np.nonzero(go)
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(at), part.column("v").take(at), part.column("bound").take(at), pa.array(g.astype(np.int32))],
                ["id", "v", "bound", "grp"],
            )

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many queries each group gets, without moving them."""
        total = np.zeros(len(shared.value.rows), dtype=np.int64)
        for part in onward(batches):
            total += np.bincount(part.column("grp").to_numpy(), minlength=len(total))
        g = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(total[g])], ["grp", "n"])

    plan = found.select("id", "v", "bound", "grp")
    per_group = plan.mapInArrow(counted, "grp int, n bigint").groupBy("grp").agg(F.sum("n").alias("n")).collect()
    if not per_group:
        return found.drop("v", "grp"), len(cells.pivots)
    more = plan.mapInArrow(onward, stage)
    counts = {r["grp"]: r["n"] for r in per_group}
    # These queries go no further, so their vectors are not stored again.
    more = _visits(cells, dealt, more, counts, k, dim, skip_same_id, query_rows).drop("v", "grp")
    return found.drop("v", "grp").unionByName(written(more, "visits")), len(cells.pivots)


def best_of_visits(visits: DataFrame, k: int) -> DataFrame:
    """``(q, i, s, rank)``: the best k over all visits of a query; ties go to the smaller id."""
    pairs = visits.select(F.col("id").alias("q"), F.explode(F.arrays_zip("ids", "scores")).alias("p"))
    pairs = pairs.select("q", F.col("p.ids").alias("i"), F.col("p.scores").alias("s"))
    w = Window.partitionBy("q").orderBy(F.desc("s"), "i")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_by_cells(
    queries: DataFrame, items: DataFrame, k: int, dim: int, query_id: str = "q_id", query_vec: str = "q_vec",
    item_id: str = "vec_id", item_vec: str = "embedding", metric: str = "l2", skip_same_id: bool = False, **sizes,
) -> DataFrame:
    """Exact top-``k`` items per query, ``(query_id, item_id, score, rank)``, both tables of any size.

    ``score`` is the inner product or the L2 distance. Without items nothing is found.
    """
    found = search_cells(_side(queries, query_id, query_vec), _side(items, item_id, item_vec), k, dim, metric, skip_same_id, **sizes)
    if found is None:
        empty = "q bigint, i bigint, s double, rank int"
        best = queries.sparkSession.createDataFrame([], empty)
    else:
        best = best_of_visits(found[0], k)
    score = F.sqrt(-F.col("s")) if metric == "l2" else F.col("s")
    return best.select(F.col("q").alias(query_id), F.col("i").alias(item_id), score.alias("score"), "rank")


def search_work(queries: DataFrame, items: DataFrame, k: int, dim: int, query_id: str = "q_id", query_vec: str = "q_vec",
                item_id: str = "vec_id", item_vec: str = "embedding", metric: str = "l2", **sizes) -> DataFrame:
    """How many distances the search computes, those to pivots included, against all pairs.

    One row: n_queries, n_items, all_pairs, computed.
    """
    left, right = _side(queries, query_id, query_vec), _side(items, item_id, item_vec)
    found = search_cells(left, right, k, dim, metric, **sizes)
    n_items = right.count()
    if found is None:
        return queries.sparkSession.createDataFrame([(left.count(), 0, 0, 0)], "n_queries bigint, n_items bigint, all_pairs bigint, computed bigint")
    visits, pivots = found
    # Each query meets the pivots when it is sent out, when it is sent on, and once per visit.
    facts = visits.agg(F.countDistinct("id").alias("n_queries"), F.count(F.lit(1)).alias("n_visits"), F.sum("compared").alias("compared"))
    n = F.lit(n_items).cast("bigint")
    to_pivots = (n + 2 * F.col("n_queries") + F.col("n_visits")) * pivots
    return facts.select("n_queries", n.alias("n_items"), (F.col("n_queries") * n).alias("all_pairs"), (F.col("compared") + to_pivots).alias("computed"))
