"""What several operators share: the word pattern, stored tables, numeric content keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsnap.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """All words of a text as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    A plain column would be copied into every mention when the optimizer moves a filter.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so lost executors cost no earlier stage.

    Every call takes a new sub-folder; the folder of ``spark.checkpoint.dir`` is scratch space.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def leading_bits(digest: Column) -> Column:
    """The first 52 bits of a hex digest as an exact double."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def uniform(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the values of a row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(20), *cols), 11) / F.lit(float(1 << 53))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to ``most`` at most, or of one row."""
    start = 0
    while start < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, side="right")))
        yield start, start + n
        start += n
