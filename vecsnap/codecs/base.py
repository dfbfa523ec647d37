"""What every codec model offers.

A fitted model is a frozen dataclass of scalars and vector-length tuples. It
encodes and decodes a DataFrame lazily in one narrow Arrow pass per call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecsnap.kernels.arrow import add_columns, lists, to_matrix


def stable(value: float) -> float:
    """A fitted scalar at 12 significant digits: independent of summation order."""
    return float(f"{value:.12g}")


class ModelBase:
    """The fused reconstruct and error passes."""

    def _encode_matrix(self, x: np.ndarray) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def _decode_matrix(self, code: dict[str, np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def _prepare(self, df: DataFrame, column: str, threshold: str) -> "ModelBase":
        """Hook for codecs whose cut-offs may be taken from the encoded batch."""
        return self

    def reconstruct(
        self, df: DataFrame, column: str = "embedding", out: str = "rebuilt", threshold: str = "model"
    ) -> DataFrame:
        """Encode and decode in one pass, keeping the original column."""
        model = self._prepare(df, column, threshold)
        dim = model.dim

        def kernel(batch: pa.RecordBatch):
            x = to_matrix(batch.column(column), dim)
            return {out: lists(model._decode_matrix(model._encode_matrix(x)))}

        return add_columns(df, kernel, f"{out} array<double>", dim)

    def errors(
        self, df: DataFrame, column: str = "embedding", threshold: str = "model"
    ) -> DataFrame:
        """Per-row signal, noise, cosine and largest error, without storing codes."""
        model = self._prepare(df, column, threshold)
        dim = model.dim

        def kernel(batch: pa.RecordBatch):
            x = to_matrix(batch.column(column), dim)
            return error_columns(x, model._decode_matrix(model._encode_matrix(x)))

        return add_columns(df, kernel, ERROR_DDL, dim, drop=[column])


ERROR_DDL = "signal double, noise double, n_values bigint, cosine double, max_abs double"


def error_columns(x: np.ndarray, r: np.ndarray) -> dict[str, pa.Array]:
    gap = x - r
    signal, power = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", r, r)
    cross = np.einsum("ij,ij->i", x, r)
    return {
        "signal": pa.array(signal),
        "noise": pa.array(np.einsum("ij,ij->i", gap, gap)),
        "n_values": pa.array(np.full(len(x), x.shape[1], dtype=np.int64)),
        "cosine": pa.array(cross / ((np.sqrt(signal) + 1e-12) * (np.sqrt(power) + 1e-12))),
        "max_abs": pa.array(np.abs(gap).max(axis=1)),
    }
