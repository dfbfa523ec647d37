"""22-dimensional graph codec: one of 100 vertices and a scalar residual per block.

The vertices are the rows of a 100 x 22 factor of the projector onto the smallest
eigenspace of the strongly regular graph with 100 vertices and degree 22. The factor
is the Cholesky factor in vertex order, so every process builds the same one.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.codecs.base import ModelBase, stable
from vecsnap.functions.bits import generator_words
from vecsnap.kernels.arrow import add_columns, lists, map_batches, nested_lists, to_matrix
from vecsnap.kernels.lattice import pad_to
from vecsnap.operators.entropy import graph_codec_bits

WIDTH = 22


@functools.lru_cache(maxsize=1)
def design_blocks() -> tuple[frozenset[int], ...]:
    """The 77 six-point blocks on 22 points: weight-8 words through points 0 and 1."""
    words = generator_words()
    blocks = []
    for message in range(1 << len(words)):
        word = 0
        for i, row in enumerate(words):
            word ^= row if message >> i & 1 else 0
        if word.bit_count() == 8 and word & 3 == 3:
            blocks.append(frozenset(p - 2 for p in range(2, 24) if word >> p & 1))
    return tuple(blocks)


@functools.lru_cache(maxsize=1)
def adjacency() -> np.ndarray:
    """Vertex 0, points 1..22, blocks 23..99: hub-point, point-in-block, disjoint blocks."""
    blocks = design_blocks()
    a = np.zeros((100, 100), dtype=np.int8)
    a[0, 1:23] = 1
    for i, block in enumerate(blocks):
        a[[p + 1 for p in block], 23 + i] = 1
        for j in range(i):
            a[23 + j, 23 + i] = not block & blocks[j]
    return a | a.T


@functools.lru_cache(maxsize=1)
def vertices() -> np.ndarray:
    """100 x 22 embedding with inner products 0.22 / -0.08 (adjacent) / 0.02 (not)."""
    a = adjacency()
    gram = np.where(a == 1, -0.08, 0.02)
    np.fill_diagonal(gram, 0.22)
    columns = []
    for i in range(100):
        if gram[i, i] > 1e-9:
            column = gram[:, i] / np.sqrt(gram[i, i])
            columns.append(column)
            gram = gram - np.outer(column, column)
    return np.stack(columns, axis=1)


@dataclasses.dataclass(frozen=True)
class GraphModel(ModelBase):
    dim: int
    bits: int
    lo: tuple[float, ...]  # residual range per coordinate of the 22-block
    step: tuple[float, ...]

    @property
    def blocks(self) -> int:
        return -(-self.dim // WIDTH)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vertex id per block (first largest inner product) and the residual."""
        blocks = pad_to(x, WIDTH).reshape(-1, WIDTH)
        ids = (blocks @ vertices().T).argmax(axis=1)
        return ids, blocks - vertices()[ids]

    def _encode_matrix(self, x: np.ndarray) -> dict:
        ids, left = self.split(x)
        levels = 1 << self.bits
        codes = np.floor((left - np.array(self.lo)) / np.array(self.step) * levels)
        shape = (len(x), self.blocks)
        return {
            "ids": ids.reshape(shape),
            "codes": np.clip(codes, 0, levels - 1).reshape(*shape, WIDTH),
        }

    def _decode_matrix(self, code: dict) -> np.ndarray:
        left = np.array(self.lo) + (code["codes"] + 0.5) / (1 << self.bits) * np.array(self.step)
        full = vertices()[code["ids"].astype(int)] + left
        return full.reshape(len(full), -1)[:, : self.dim]

    def encode(self, df: DataFrame, column: str = "embedding") -> DataFrame:
        model = self

        def kernel(batch: pa.RecordBatch):
            code = model._encode_matrix(to_matrix(batch.column(column), model.dim))
            return {
                "ids": lists(code["ids"].astype(np.int16)),
                "codes": nested_lists(code["codes"].astype(np.int16)),
            }

        ddl = "ids array<smallint>, codes array<array<smallint>>"
        return add_columns(df, kernel, ddl, self.dim * 5, drop=[column])

    def decode(self, encoded: DataFrame, out: str = "rebuilt") -> DataFrame:
        model = self

        def kernel(batch: pa.RecordBatch):
            flat = batch.column("codes").flatten().flatten().to_numpy(zero_copy_only=False)
            code = {
                "ids": to_matrix(batch.column("ids"), model.blocks),
                "codes": flat.reshape(batch.num_rows, model.blocks, WIDTH),
            }
            return {out: lists(model._decode_matrix(code))}

        return add_columns(encoded, kernel, f"{out} array<double>", self.dim * 5, drop=["ids", "codes"])

    def bits_per_vector(self) -> int:
        return graph_codec_bits(self.dim, self.bits)

    def compression_ratio(self) -> float:
        return 32 * self.dim / self.bits_per_vector()

    @staticmethod
    def overhead_bits() -> int:
        """The codebook is rebuilt from its rule and never stored."""
        return 0


@dataclasses.dataclass(frozen=True)
class GraphCodec:
    """Residual ranges are fitted: smallest and largest residual per coordinate."""

    dim: int
    bits_residual: int = 2

    def fit(self, df: DataFrame, column: str = "embedding") -> GraphModel:
        blank = GraphModel(self.dim, self.bits_residual, (0.0,) * WIDTH, (1.0,) * WIDTH)

        def kernel(batch: pa.RecordBatch):
            _, left = blank.split(to_matrix(batch.column(column), blank.dim))
            return {
                "pos": pa.array(np.arange(WIDTH, dtype=np.int32)),
                "lo": pa.array(left.min(axis=0)),
                "hi": pa.array(left.max(axis=0)),
            }

        ends = map_batches(df.select(column), kernel, "pos int, lo double, hi double", self.dim * 5)
        rows = ends.groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("pos")
        rows = rows.collect()
        lo = tuple(stable(r["lo"]) for r in rows)
        step = tuple(stable(r["hi"] - r["lo"] + 1e-9) for r in rows)
        return dataclasses.replace(blank, lo=lo, step=step)
