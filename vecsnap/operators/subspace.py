"""Energy subspace of a vector table, Gram sums, and products with a weight table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsnap.kernels.arrow import add_columns, lists, slices, to_matrix
from vecsnap.operators.search import SHIP_BYTES


def sum_matrices(df: DataFrame, column: str, dim: int, shape: tuple[int, int], fn) -> np.ndarray:
    """Sum over all rows of a matrix-valued function ``fn(x)`` of a batch.

    Each task adds its batches into one matrix; task results are added in groups of at
    most 64, so neither one task nor the driver receives one matrix per partition.
    """
    schema = T.StructType.fromDDL("part int, m binary")

    def partial(batches):
        total = np.zeros(shape)
        for part in slices(batches, dim * 4):
            total += fn(to_matrix(part.column(column), dim))
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"]
        )

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for m in table.column("m"):
            total += np.frombuffer(m.as_buffer(), dtype=float).reshape(shape)
        number = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([number], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    parts = df.select(column).rdd.getNumPartitions()
    level = df.select(column).mapInArrow(partial, schema)
    while parts > 64:
        parts = -(-parts // 64)
        level = level.withColumn("part", F.floor(F.col("part") / 64).cast("int"))
        level = level.groupBy("part").applyInArrow(merge, schema)
    rows = level.collect()
    total = np.zeros(shape)
    for r in sorted(rows, key=lambda r: r["part"]):
        total += np.frombuffer(r["m"], dtype=float).reshape(shape)
    return total


def gram_sums(df: DataFrame, column: str, dim: int):
    """Row count, vector sum, Gram matrix, and sums of the 2nd and 4th power of the norms."""

    def fn(x: np.ndarray) -> np.ndarray:
        squares = np.einsum("ij,ij->i", x, x)
        tail = np.zeros((2, dim))
        tail[0] = x.sum(axis=0)
        tail[1, :3] = len(x), squares.sum(), np.square(squares).sum()
        return np.vstack([x.T @ x, tail])

    total = sum_matrices(df, column, max(dim, 3), (dim + 2, dim), fn)
    n, squares, fourth = total[dim + 1, :3]
    return int(round(n)), total[dim], total[:dim], float(squares), float(fourth)


def energy_subspace(
    df: DataFrame, column: str, dim: int, rank: int = 64, energy: float = 0.9, seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors holding ``energy`` of the captured energy.

    A seeded Gaussian sketch with ``rank + 10`` columns; one pass sums ``Y'X`` with
    ``Y = X W``. ``Y'Y = (Y'X) W`` then gives the orthonormal basis, and the small matrix
    ``Q'X`` is decomposed on the driver. Returns the vectors (rows) and singular values;
    vectors up to and including the first that reaches the threshold are kept.
    """
    width = rank + 10
    sketch = np.random.default_rng(seed).standard_normal((dim, width))
    shared = df.sparkSession.sparkContext.broadcast(sketch)
    cross = sum_matrices(df, column, dim, (width, dim), lambda x: (x @ shared.value).T @ x)
    values, vectors = np.linalg.eigh((lambda g: (g + g.T) / 2)(cross @ sketch))
    solid = values > values.max() * 1e-12
    small = (vectors[:, solid] / np.sqrt(values[solid])).T @ cross
    _, s, vt = np.linalg.svd(small, full_matrices=False)
    reached = np.flatnonzero(np.cumsum(s**2) / np.sum(s**2) >= energy)
    keep = (reached[0] if reached.size else rank) + 1
    return vt[:keep], s[:keep]


def energy_rank(values: DataFrame, value: str, order: str, threshold: float = 0.9) -> DataFrame:
    """Cumulative energy share in descending order of ``value`` and the first rank reaching it.

    ``values`` is a spectrum: one row per dimension, bounded by the vector length.
    """
    w = Window.orderBy(F.desc(value), order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.sum(value).over(run) / F.sum(value).over(everything)
    ranked = values.withColumn("rank", F.row_number().over(w)).withColumn("share", share)
    first = F.min(F.when(F.col("share") >= threshold, F.col("rank")))
    return ranked.withColumn("cutoff", first.over(Window.partitionBy()))


def multiply(
    df: DataFrame, weights: DataFrame, dim: int, column: str = "embedding",
    out_id: str = "out_id", out_vec: str = "weights", ship_bytes: int = SHIP_BYTES,
) -> DataFrame:
    """``x W'``: adds ``y``, one element per weight row in ``out_id`` order.

    The weight table is shipped in blocks of checked size, one narrow pass over the
    vectors per block; the partial results stay in the row.
    """
    limit = max(1, ship_bytes // (8 * dim))
    n = weights.count()
    blocks = -(-n // limit) or 1
    bounds = [None]
    if blocks > 1:
        from vecsnap.operators.quantiles import order_statistic

        bounds = [int(order_statistic(weights, out_id, 1 + b * limit, n)) for b in range(blocks)]
    names = []
    for b, low in enumerate(bounds):
        part = weights
        if low is not None:
            part = part.where(F.col(out_id) >= low)
        if b + 1 < len(bounds):
            part = part.where(F.col(out_id) < bounds[b + 1])
        matrix = np.array([r[out_vec] for r in part.select(out_id, out_vec).orderBy(out_id).collect()], float)
        shared = df.sparkSession.sparkContext.broadcast(matrix)
        name = f"_y{b}"
        names.append(name)

        def kernel(batch: pa.RecordBatch, shared=shared, name=name):
            return {name: lists(to_matrix(batch.column(column), dim) @ shared.value.T)}

        df = add_columns(df, kernel, f"{name} array<double>", max(dim, len(matrix)))
    return df.withColumn("y", F.concat(*names)).drop(*names)
