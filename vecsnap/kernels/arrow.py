"""Arrow-batch plumbing shared by every vector kernel.

A kernel is a small NumPy function over an ``(n, dim)`` matrix. Spark keeps the
partitioning: kernels run under ``mapInArrow`` on whatever partitions the scan
produced, so encode and decode never shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Working set of one kernel call; batches are sliced so wide vectors stay within it.
SLICE_BYTES = 1 << 19


def to_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column -> float64 matrix; NULL, wrong-length and non-finite vectors raise."""
    if len(column) == 0:
        return np.zeros((0, dim))
    lengths = pc.list_value_length(column)
    if column.null_count or pc.any(pc.not_equal(lengths, dim)).as_py():
        raise ValueError(f"expected vectors of length {dim}; found NULL or another length")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("vector holds a NULL element")
    out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if not np.isfinite(out).all():
        raise ValueError("vector holds a NaN or infinite element")
    return out


def to_cube(column: pa.Array, outer: int, inner: int, dtype=np.float64) -> np.ndarray:
    """List-of-list column -> (n, outer, inner) array."""
    flat = column.flatten().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), outer, inner)


def lists(matrix: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """(n, w) array -> list column; ``mask`` marks elements to store as NULL."""
    n, width = matrix.shape
    values = pa.array(matrix.reshape(-1), mask=None if mask is None else mask.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), values)


def nested_lists(cube: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """(n, s, w) array -> list-of-list column."""
    n, outer, inner = cube.shape
    values = lists(
        cube.reshape(n * outer, inner), None if mask is None else mask.reshape(n * outer, inner)
    )
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * outer), values)


def slices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice of ``width`` doubles per row fits the working set."""
    step = max(1, SLICE_BYTES // (8 * max(1, width)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array] | None],
    schema: str,
    width: int,
) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns a slice into named output columns (or None)."""
    out = T.StructType.fromDDL(schema)
    names = out.names

    def run(batches):
        for part in slices(batches, width):
            cols = fn(part)
            if cols is not None:
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return df.mapInArrow(run, out)


def add_columns(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    added: str,
    width: int,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Append kernel-made columns (DDL ``added``) and pass the other columns through."""
    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in new.names]
    out = T.StructType(kept + new.fields)
    kept_names = [f.name for f in kept]
    names = out.names

    def run(batches):
        for part in slices(batches, width):
            cols = fn(part)
            arrays = [part.column(c) for c in kept_names] + [cols[c] for c in new.names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, out)
