"""Column functions on ``ARRAY<DOUBLE>`` vectors (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vec(x: ColumnLike) -> Column:
    """Promote to double precision before any statistic."""
    return _c(x).cast("array<double>")


def total(x: ColumnLike) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sum_squares(x: ColumnLike) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v * v)


def norm(x: ColumnLike) -> Column:
    return F.sqrt(sum_squares(x))


def squared_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def add(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a: ColumnLike, b: ColumnLike) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scaled(x: ColumnLike, factor: Column | float) -> Column:
    return F.transform(_c(x), lambda v: v * factor)


def mean(x: ColumnLike) -> Column:
    return total(x) / F.size(_c(x))


def std(x: ColumnLike, sample: bool = False) -> Column:
    """Two-pass standard deviation: population, or sample with ``sample=True``."""
    col = _c(x)
    m = mean(col)
    square = total(F.transform(col, lambda v: (v - m) * (v - m)))
    return F.sqrt(square / (F.size(col) - (1 if sample else 0)))


def argmax(x: ColumnLike) -> Column:
    """0-based index of the first largest element."""
    return F.array_position(_c(x), F.array_max(_c(x))) - 1


def sign(v: Column) -> Column:
    """Sign with 0 counted as positive."""
    return F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def pad(x: ColumnLike, dim: int, width: int) -> Column:
    """Right zero-pad a ``dim``-vector to a multiple of ``width``."""
    extra = -dim % width
    return F.concat(vec(x), F.array_repeat(F.lit(0.0), extra)) if extra else vec(x)


def chunk(x: ColumnLike, dim: int, width: int) -> Column:
    """Padded vector as an array of consecutive ``width``-blocks."""
    padded = pad(x, dim, width)
    n = -(-dim // width)
    return F.array(*[F.slice(padded, i * width + 1, width) for i in range(n)])


def unchunk(chunks: ColumnLike, dim: int) -> Column:
    """Blocks back to one vector, cropped to ``dim``."""
    return F.slice(F.flatten(_c(chunks)), 1, dim)


def literal_vector(values) -> Column:
    """A fitted vector (bounded by the vector length) as a literal."""
    return F.lit([float(v) for v in values]).cast("array<double>")
