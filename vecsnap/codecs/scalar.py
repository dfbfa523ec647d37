"""Baseline codecs: per-dimension min-max levels, block means, rotated min-max rows."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.codecs.base import ModelBase
from vecsnap.functions.arrays import literal_vector, vec
from vecsnap.kernels.arrow import add_columns, lists, to_matrix
from vecsnap.kernels.lattice import pad_to


@dataclasses.dataclass(frozen=True)
class ScalarModel(ModelBase):
    """Uniform levels between each dimension's minimum and maximum."""

    dim: int
    bits: int
    lo: tuple[float, ...]
    step: tuple[float, ...]  # max - min + 1e-9

    def encode(self, df: DataFrame, column: str = "embedding", out: str = "codes") -> DataFrame:
        model = self

        def kernel(batch: pa.RecordBatch):
            code = model._encode_matrix(to_matrix(batch.column(column), model.dim))["codes"]
            return {out: lists(code.astype(np.int16))}

        return add_columns(df, kernel, f"{out} array<smallint>", self.dim, drop=[column])

    def decode(self, encoded: DataFrame, codes: str = "codes", out: str = "rebuilt") -> DataFrame:
        model = self

        def kernel(batch: pa.RecordBatch):
            return {out: lists(model._decode_matrix({"codes": to_matrix(batch.column(codes), model.dim)}))}

        return add_columns(encoded, kernel, f"{out} array<double>", self.dim, drop=[codes])

    def encode_builtin(self, df: DataFrame, column: str = "embedding", out: str = "codes") -> DataFrame:
        """The same codes with built-in expressions (no Python worker)."""
        levels = float(1 << self.bits)
        scaled = F.zip_with(
            F.zip_with(vec(column), literal_vector(self.lo), lambda x, lo: x - lo),
            literal_vector(self.step),
            lambda x, w: F.least(F.greatest(F.floor(x / w * levels), F.lit(0)), F.lit(int(levels) - 1)),
        )
        return df.withColumn(out, scaled.cast("array<smallint>")).drop(column)

    def decode_builtin(self, encoded: DataFrame, codes: str = "codes", out: str = "rebuilt") -> DataFrame:
        levels = float(1 << self.bits)
        middle = F.zip_with(
            F.transform(codes, lambda c: (c.cast("double") + 0.5) / levels),
            literal_vector(self.step),
            lambda c, w: c * w,
        )
        rebuilt = F.zip_with(middle, literal_vector(self.lo), lambda c, lo: lo + c)
        return encoded.withColumn(out, rebuilt).drop(codes)

    def _encode_matrix(self, x: np.ndarray) -> dict:
        levels = 1 << self.bits
        unit = (x - np.array(self.lo)) / np.array(self.step)
        return {"codes": np.clip(np.floor(unit * levels), 0, levels - 1)}

    def _decode_matrix(self, code: dict) -> np.ndarray:
        return np.array(self.lo) + (code["codes"] + 0.5) / (1 << self.bits) * np.array(self.step)


@dataclasses.dataclass(frozen=True)
class ScalarCodec:
    dim: int
    bits: int = 3

    def fit(self, df: DataFrame, column: str = "embedding") -> ScalarModel:
        ends = (
            df.select(F.posexplode(column).alias("pos", "v"))
            .groupBy("pos")
            .agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
            .orderBy("pos")
            .collect()
        )
        lo = tuple(r["lo"] for r in ends)
        return ScalarModel(self.dim, self.bits, lo, tuple(r["hi"] - r["lo"] + 1e-9 for r in ends))


@dataclasses.dataclass(frozen=True)
class BlockMeanModel(ModelBase):
    """Every 8-block is replaced by its mean: 24 bits of statistics per block."""

    dim: int

    def _encode_matrix(self, x: np.ndarray) -> dict:
        return {"mean": pad_to(x, 8).reshape(len(x), -1, 8).mean(axis=2)}

    def _decode_matrix(self, code: dict) -> np.ndarray:
        return np.repeat(code["mean"], 8, axis=1)[:, : self.dim]


def orthogonal_matrix(dim: int, seed: int = 42) -> np.ndarray:
    """Haar-distributed orthogonal matrix from a seeded Gaussian."""
    gauss = np.random.default_rng(seed).standard_normal((dim, dim))
    q, r = np.linalg.qr(gauss)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


@dataclasses.dataclass(frozen=True)
class RotatedModel(ModelBase):
    """Rotate, min-max quantize the row, keep the sign of the remaining error."""

    dim: int
    bits: int = 4
    seed: int = 42

    def _encode_matrix(self, x: np.ndarray) -> dict:
        turned = x @ orthogonal_matrix(self.dim, self.seed)
        low, high = turned.min(axis=1, keepdims=True), turned.max(axis=1, keepdims=True)
        step = (high - low) / ((1 << self.bits) - 1)
        step[step == 0] = 1e-10
        levels = np.rint((turned - low) / step)
        return {"levels": levels, "low": low, "step": step, "sign": np.sign(turned - low - levels * step)}

    def _decode_matrix(self, code: dict) -> np.ndarray:
        turned = code["low"] + (code["levels"] + code["sign"] / 4.0) * code["step"]
        return turned @ orthogonal_matrix(self.dim, self.seed).T

    def encode(self, df: DataFrame, column: str = "embedding") -> DataFrame:
        model = self

        def kernel(batch: pa.RecordBatch):
            code = model._encode_matrix(to_matrix(batch.column(column), model.dim))
            return {
                "levels": lists(code["levels"].astype(np.int32)),
                "sign": lists(code["sign"].astype(np.int8)),
                "low": pa.array(code["low"][:, 0]),
                "step": pa.array(code["step"][:, 0]),
            }

        ddl = "levels array<int>, sign array<tinyint>, low double, step double"
        return add_columns(df, kernel, ddl, self.dim, drop=[column])

    def decode(self, encoded: DataFrame, out: str = "rebuilt") -> DataFrame:
        model = self

        def kernel(batch: pa.RecordBatch):
            code = {
                "levels": to_matrix(batch.column("levels"), model.dim),
                "sign": to_matrix(batch.column("sign"), model.dim),
                "low": batch.column("low").to_numpy()[:, None],
                "step": batch.column("step").to_numpy()[:, None],
            }
            return {out: lists(model._decode_matrix(code))}

        used = ["levels", "sign", "low", "step"]
        return add_columns(encoded, kernel, f"{out} array<double>", self.dim, drop=used)


def row_standard_lattice(df: DataFrame, column: str, dim: int, out: str = "rebuilt") -> DataFrame:
    """Centre by row mean, scale by the row's sample deviation, snap to E8 at 100."""
    from vecsnap.kernels.lattice import nearest_e8

    def kernel(batch: pa.RecordBatch):
        x = to_matrix(batch.column(column), dim)
        mean = x.mean(axis=1, keepdims=True)
        std = x.std(axis=1, ddof=1, keepdims=True) + 1e-12
        q = nearest_e8(pad_to((x - mean) / std * 100.0, 8))[:, :dim]
        return {out: lists(q / 100.0 * std + mean)}

    return add_columns(df, kernel, f"{out} array<double>", dim)


def table_moments(df: DataFrame, column: str) -> tuple[float, float, float]:
    """Mean, population and sample deviation over all elements of all vectors."""
    r = (
        df.select(F.explode(column).alias("v"))
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("p"), F.stddev_samp("v").alias("s"))
        .first()
    )
    return r["m"], r["p"], r["s"]


def table_standard_lattice(
    train: DataFrame, df: DataFrame, column: str, dim: int, out: str = "rebuilt"
) -> DataFrame:
    """Scalar mean and deviation of ``train`` applied to ``df``, snapped to E8 at scale 1."""
    from vecsnap.kernels.lattice import nearest_e8

    mean, std, _ = table_moments(train, column)

    def kernel(batch: pa.RecordBatch):
        x = to_matrix(batch.column(column), dim)
        q = nearest_e8(pad_to((x - mean) / std, 8))[:, :dim]
        return {out: lists(q * std + mean)}

    return add_columns(df, kernel, f"{out} array<double>", dim)


def weight_table_lattice(df: DataFrame, column: str, dim: int, out: str = "weights") -> DataFrame:
    """A weight table on the lattice: sample deviation of all weights, E8 at 100 per unit."""
    from vecsnap.kernels.lattice import nearest_e8

    scale = table_moments(df, column)[2] + 1e-12

    def kernel(batch: pa.RecordBatch):
        x = to_matrix(batch.column(column), dim)
        q = nearest_e8(pad_to(x / scale * 100.0, 8))[:, :dim]
        return {out: lists(q / 100.0 * scale)}

    return add_columns(df, kernel, f"{out} array<double>", dim, drop=[column])
