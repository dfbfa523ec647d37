"""Exact nearest-neighbour search, memory retrieval and codeword assignment.

One side is turned into a matrix of checked size and sent to the tasks; each task
keeps only its best ``k`` per query, so no pair table is ever shuffled. If both sides
exceed the limit, both are dealt to cells around pivots, see ``cells.py``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsnap.kernels.arrow import map_batches, slices, to_matrix
from vecsnap.kernels.lattice import best_codeword, e8_codebook, nearest_e8, pad_to
from vecsnap.operators.sampling import hash_sample

# Size limit of a matrix sent to every task.
SHIP_BYTES = 64 << 20


def _best(
    left: np.ndarray, right: np.ndarray, ids: np.ndarray, k: int, metric: str,
    banned: np.ndarray | None = None, floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` rows of ``right`` per row of ``left``: (left row, right row, score).

    ``floor`` is a score per left row below which nothing is of interest.

    Larger scores are nearer: inner product, or negative squared distance. Ties go to the
    smaller id. A matrix product finds candidates; distances of all candidates that could
    be among the best are then recomputed from differences at full precision.
    """
    cross = left @ right.T
    slack = 0.0
    if metric == "l2":
        a, b = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
        cross = 2.0 * cross - a[:, None] - b[None, :]
        slack = 1e-12 * (a[:, None] + (b.max() if len(b) else 0.0))
    if banned is not None:
        cross[banned] = -np.inf
    wanted = cross > -np.inf
    if floor is not None:
        wanted &= cross >= floor[:, None] - slack
    elif cross.shape[1] > k:
        wanted &= cross >= -np.partition(-cross, k - 1, axis=1)[:, k - 1 : k] - slack
    rows, cols = np.nonzero(wanted)
    if metric == "l2":
        gap = left[rows] - right[cols]
        score = -np.einsum("ij,ij->i", gap, gap)
    else:
        score = cross[rows, cols]
    return _first_k(rows, cols, score, ids[cols], len(left), k)


def _first_k(rows, cols, score, ids, n_rows: int, k: int):
    order = np.lexsort((ids, -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    starts = np.searchsorted(rows, np.arange(n_rows))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep], score[keep]


class _TopK:
    """Running best ``k`` per query of one task, sorted by score, then id."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidates; only the queries that have any are touched."""
        hit = np.unique(rows)
        if not len(hit):
            return
        all_rows = np.concatenate([np.repeat(np.arange(len(hit)), self.k), np.searchsorted(hit, rows)])
        all_ids = np.concatenate([self.ids[hit].reshape(-1), ids])
        all_scores = np.concatenate([self.scores[hit].reshape(-1), scores])
        r, at, s = _first_k(all_rows, np.arange(len(all_rows)), all_scores, all_ids, len(hit), self.k)
        shape = (len(hit), self.k)  # every touched query still holds exactly k entries
        self.ids[hit], self.scores[hit] = all_ids[at].reshape(shape), s.reshape(shape)


def _ship(df: DataFrame, id_col: str, column: str, dim: int, limit: int | None, extra=()):
    """The table as (ids, matrix, arrow table) sorted by id, or None above ``limit`` rows."""
    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), column, *extra)
    table = (rows if limit is None else rows.limit(limit + 1)).toArrow().combine_chunks()
    if limit is not None and table.num_rows > limit:
        return None
    if table.num_rows == 0:
        return np.zeros(0, np.int64), np.zeros((0, dim)), table
    table = table.sort_by(id_col).combine_chunks()
    matrix = to_matrix(table.column(column).combine_chunks(), dim)
    return table.column(id_col).to_numpy(), matrix, table


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    dim: int,
    query_id: str = "q_id",
    query_vec: str = "q_vec",
    item_id: str = "vec_id",
    item_vec: str = "embedding",
    metric: str = "l2",
    skip_same_id: bool = False,
    ship_bytes: int = SHIP_BYTES,
    few_queries: bool = False,
) -> DataFrame:
    """Exact top-``k`` items per query: ``(query_id, item_id, score, rank)``.

    Ties go to the smaller item id. ``score`` is the inner product or the L2 distance.
    Few items: they are shipped and every query is answered where it lies, without a
    shuffle. Few queries: they are shipped, each task keeps k per query over all its
    items, and those are merged. Otherwise both are dealt to cells (``operators/cells.py``).
    ``few_queries`` tries to ship the queries only.
    """
    limit = max(1, ship_bytes // (8 * dim))
    q_side = (queries, query_id, query_vec)
    i_side = (items, item_id, item_vec)
    common = (k, dim, metric, skip_same_id)
    shipped = None if few_queries else _ship(*i_side, dim, limit)
    if shipped is not None:
        found = _scan(*q_side, shipped, *common, small_is_query=False)
        return _named(found, query_id, item_id, metric)
    shipped = _ship(*q_side, dim, limit)
    if shipped is None:
        from vecsnap.operators.cells import nearest_by_cells

        return nearest_by_cells(queries, items, k, dim, query_id, query_vec, item_id, item_vec, metric, skip_same_id)
    found = _scan(*i_side, shipped, *common, small_is_query=True)
    w = Window.partitionBy("q").orderBy(F.desc("s"), "i")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return _named(found, query_id, item_id, metric)


def _named(found: DataFrame, query_id: str, item_id: str, metric: str) -> DataFrame:
    score = F.sqrt(-F.col("s")) if metric == "l2" else F.col("s")
    return found.select(
        F.col("q").alias(query_id), F.col("i").alias(item_id), score.alias("score"), "rank"
    )


def _scan(big, big_id, big_vec, shipped, k, dim, metric, same, small_is_query):
    """Score all rows of ``big`` against the shipped matrix, keeping k per query and task."""
    shared = big.sparkSession.sparkContext.broadcast(shipped[:2])
    schema = T.StructType.fromDDL("q bigint, i bigint, s double, rank int")
    width = max(dim, min(len(shipped[0]), 1 << 12))

    def out(q, i, s, rank):
        return pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(i), pa.array(s), pa.array(rank.astype(np.int32))], schema.names
        )

    def ranks(rows):
        starts = np.searchsorted(rows, np.unique(rows))
        return np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) + 1

    def run(batches):
        s_ids, s_mat = shared.value
        top = _TopK(len(s_ids), k) if small_is_query else None
        for part in slices(batches, width):
            if not len(s_ids) or not part.num_rows:
                continue
            b_ids = part.column("_id").to_numpy()
            x = to_matrix(part.column("_v"), dim)
            same_id = b_ids[:, None] == s_ids[None, :] if same else None
            if small_is_query:
                banned = None if same_id is None else same_id.T
                rows, cols, s = _best(s_mat, x, b_ids, k, metric, banned, top.scores[:, -1])
                top.add(rows, b_ids[cols], s)
            else:
                rows, cols, s = _best(x, s_mat, s_ids, k, metric, same_id)
                yield out(b_ids[rows], s_ids[cols], s, ranks(rows))
        if top is not None and len(s_ids):
            rows, cols = np.nonzero(top.scores > -np.inf)
            yield out(s_ids[rows], top.ids[rows, cols], top.scores[rows, cols], cols + 1)

    rows = big.select(
        F.col(big_id).cast("bigint").alias("_id"), F.col(big_vec).cast("array<double>").alias("_v")
    )
    return rows.mapInArrow(run, schema)


def recall_at_k(
    df: DataFrame, original: str, rebuilt: str, dim: int, k: int = 10, n_queries: int = 50,
    id_col: str = "vec_id", seed: int = 1,
) -> DataFrame:
    """Share of sampled queries whose true nearest vector is in the rebuilt top-k."""
    spark = df.sparkSession
    n = df.count()
    if n <= 1:
        return spark.createDataFrame([(0, 0.0)], "n_queries bigint, recall double")
    picked = hash_sample(df, id_col, min(n_queries, n), seed).select(
        F.col(id_col).cast("bigint").alias("q_id"),
        F.col(original).cast("array<double>").alias("q_true"),
        F.col(rebuilt).cast("array<double>").alias("q_hat"),
    )
    if n_queries * dim * 16 <= SHIP_BYTES:
        # A bounded query set is fetched once and used by both searches.
        picked = spark.createDataFrame(picked.toArrow(), picked.schema)
    same = dict(dim=dim, item_id=id_col, skip_same_id=True, few_queries=True)
    truth = nearest(picked, df, 1, query_vec="q_true", item_vec=original, **same)
    found = nearest(picked, df, min(k, n - 1), query_vec="q_hat", item_vec=rebuilt, **same)
    hit = truth.select("q_id", id_col).join(
        found.select("q_id", id_col, F.lit(1.0).alias("hit")), ["q_id", id_col], "left"
    )
    return hit.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")
    )


def find_needles(
    queries: DataFrame, rebuilt: DataFrame, dim: int, column: str = "rebuilt", id_col: str = "vec_id",
    by_cells: bool = False,
) -> DataFrame:
    """Whether the nearest rebuilt vector of each query is its own: ``(q_id, found_id, hit)``.

    ``by_cells`` deals both tables to cells whatever their size.
    """
    from vecsnap.operators.cells import nearest_by_cells

    search = nearest_by_cells if by_cells else nearest
    top = search(queries, rebuilt, 1, dim, item_id=id_col, item_vec=column)
    return top.select("q_id", F.col(id_col).alias("found_id"), (F.col("q_id") == F.col(id_col)).alias("hit"))


def lattice_key(df: DataFrame, column: str, dim: int, id_cols: list[str], out: str = "key") -> DataFrame:
    """Anchor of a memory key or query: ``E8(10 v) / 10`` (padded blocks are cropped)."""
    from vecsnap.kernels.arrow import add_columns, lists

    def kernel(batch: pa.RecordBatch):
        x = to_matrix(batch.column(column), dim)
        return {out: lists(nearest_e8(pad_to(x * 10.0, 8))[:, :dim] / 10.0)}

    return add_columns(df.select(*id_cols, column), kernel, f"{out} array<double>", dim, drop=[column])


def retrieve(
    queries: DataFrame, memory: DataFrame, dim: int, query_id: str = "q_id", query_vec: str = "q_vec",
    ship_bytes: int = SHIP_BYTES,
) -> DataFrame:
    """Value of the live slot with the largest inner product with the query's anchor.

    Forgotten slots are left out; ties go to the lowest slot. A memory of checked size is
    shipped with its values; a larger one is searched block-wise and joined.
    """
    live = memory.where(~F.col("forgotten")).select("slot", "key", "value")
    anchors = lattice_key(queries, query_vec, dim, [query_id], "anchor")
    shipped = _ship(live, "slot", "key", dim, max(1, ship_bytes // (16 * dim)), ["value"])
    if shipped is None:
        best = nearest(anchors, live, 1, dim, query_id, "anchor", "slot", "key", metric="dot")
        best = best.withColumnRenamed("score", "similarity").drop("rank")
        values = live.select(F.col("slot").cast("bigint").alias("slot"), "value")
        return best.join(values, "slot").select(query_id, "slot", "similarity", "value")
    slots, keys, held = shipped
    values = held.column("value").combine_chunks()
    shared = queries.sparkSession.sparkContext.broadcast((slots, keys, values))
    schema = T.StructType(
        [f for f in anchors.schema.fields if f.name == query_id]
        + T.StructType.fromDDL("slot bigint, similarity double").fields
        + [f for f in memory.schema.fields if f.name == "value"]
    )

    def run(batches):
        slots, keys, values = shared.value
        for part in slices(batches, max(dim, len(slots))):
            if len(slots):
                rows, cols, s = _best(to_matrix(part.column("anchor"), dim), keys, slots, 1, "dot")
                at = pa.array(cols)
                cols_out = [part.column(query_id).take(pa.array(rows)), pa.array(slots[cols]), pa.array(s)]
                yield pa.RecordBatch.from_arrays([*cols_out, values.take(at)], schema.names)

    return anchors.mapInArrow(run, schema)


def nearest_codeword(df: DataFrame, column: str, dim: int, id_cols: list[str]) -> DataFrame:
    """``(ids.., chunk_id, codeword, score)``: best of the 240 codewords per 8-block."""
    blocks = -(-dim // 8)
    source = df.select(*id_cols, column)
    ids = [f for f in source.schema.fields if f.name in id_cols]
    schema = T.StructType(ids + T.StructType.fromDDL("chunk_id int, codeword int, score double").fields)

    def run(batches):
        book = e8_codebook()
        for part in slices(batches, dim * 30):
            x = pad_to(to_matrix(part.column(column), dim), 8).reshape(-1, 8)
            best, score = best_codeword(x, book)
            at = pa.array(np.repeat(np.arange(part.num_rows), blocks))
            cols = [part.column(c).take(at) for c in id_cols]
            cols.append(pa.array(np.tile(np.arange(blocks, dtype=np.int32), part.num_rows)))
            cols += [pa.array(best.astype(np.int32)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def decode_codewords(codes: DataFrame, codebook: DataFrame, key: str, dim: int) -> DataFrame:
    """Equi-join codes with the (240-row) codebook and rebuild the cropped vectors."""
    part = codes.join(F.broadcast(codebook), codes["codeword"] == codebook["id"]).select(
        key, "chunk_id", F.transform("x", lambda v: v * F.col("score")).alias("x")
    )
    return part.groupBy(key).agg(
        F.slice(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("chunk_id", "x"))), lambda s: s["x"]
                )
            ), 1, dim,
        ).alias("rebuilt")
    )


def score_fidelity(
    queries: DataFrame, df: DataFrame, original: str, rebuilt: str, dim: int,
    query_vec: str = "q_vec", weight: float = 0.5,
) -> DataFrame:
    """Attention-score error: MSE of ``Q K'`` before and after, and the combined loss.

    ``combined = (1 - weight) * mse / var(K) + weight * qk_mse / var(Q K')`` with
    population variances. The sums over all pairs follow from the ``d x d`` matrices of sums of
    products of either side: ``sum (q.k)^2 = <Q'Q, K'K>``, so neither side is shipped or bounded.
    """
    from vecsnap.operators.subspace import sum_matrices

    def moments(x: np.ndarray) -> np.ndarray:
        x = np.c_[x, np.ones(len(x))]
        return x.T @ x

    shape = (dim + 1, dim + 1)
    off = df.select(F.zip_with(F.col(original).cast("array<double>"), F.col(rebuilt).cast("array<double>"),
                               lambda k, r: k - r).alias("_off"))
    q, k, e = (
        sum_matrices(table, column, dim, shape, moments)
        for table, column in ((queries, query_vec), (df, original), (off, "_off"))
    )
    qq, n_q, kk, n_k, ee = q[:dim, :dim], q[dim, dim], k[:dim, :dim], k[dim, dim], e[:dim, :dim]
    pairs, cells = n_q * n_k, n_k * dim
    if not pairs:
        raise ValueError("score fidelity needs queries and keys")
    mse, qk_mse = float(np.trace(ee)) / cells, float((qq * ee).sum()) / pairs
    k_var = float(np.trace(kk)) / cells - (float(k[dim, :dim].sum()) / cells) ** 2
    qk_var = float((qq * kk).sum()) / pairs - (float(q[dim, :dim] @ k[dim, :dim]) / pairs) ** 2
    row = [tuple(map(float, (mse, qk_mse, mse / (k_var + 1e-12), qk_mse / (qk_var + 1e-12))))]
    out = df.sparkSession.createDataFrame(row, "mse double, qk_mse double, mse_norm double, qk_mse_norm double")
    return out.withColumn("combined", (1 - weight) * F.col("mse_norm") + weight * F.col("qk_mse_norm"))
