"""Masked staged codeword codec over robustly centred dimensions.

Each dimension is centred by its median and scaled by its median absolute
deviation. A stage looks only at "hot" 8-blocks (energy above a quantile), stores
the nearest of 240 unit codewords and a 15-level quantization of the inner product.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.codecs.base import ModelBase, stable
from vecsnap.functions.arrays import literal_vector
from vecsnap.kernels.arrow import add_columns, lists, map_batches, nested_lists, to_matrix
from vecsnap.kernels.lattice import best_codeword, e8_codebook, pad_to
from vecsnap.operators.quantiles import exact_quantiles

LEVELS = 15


@dataclasses.dataclass(frozen=True)
class HotStage:
    lo: float
    hi: float
    cutoff: float  # a block is hot when its energy is strictly above


def robust_scale(
    df: DataFrame, column: str, rows: int
) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Median and median absolute deviation (+1e-12) of every dimension."""
    long = df.select(F.posexplode(column).alias("pos", "v"))
    center = {g[0]: q[0] for g, q in exact_quantiles(long, "v", [0.5], ["pos"], rows).items()}
    dims = len(center)
    middle = literal_vector(center[i] for i in range(dims))
    away = long.select("pos", F.abs(F.col("v") - F.get(middle, F.col("pos"))).alias("v"))
    spread = {g[0]: q[0] for g, q in exact_quantiles(away, "v", [0.5], ["pos"], rows).items()}
    return (
        tuple(center[i] for i in range(dims)),
        tuple(spread[i] + 1e-12 for i in range(dims)),
    )


@dataclasses.dataclass(frozen=True)
class HotBlockModel(ModelBase):
    dim: int
    threshold: float
    center: tuple[float, ...]
    spread: tuple[float, ...]
    stages: tuple[HotStage, ...]

    @property
    def blocks(self) -> int:
        return -(-self.dim // 8)

    def normalize(self, x: np.ndarray) -> np.ndarray:
        scaled = (x - np.array(self.center)) / np.array(self.spread)
        return pad_to(scaled, 8).reshape(-1, 8)

    def _stage(self, res: np.ndarray, stage: HotStage, codebook: np.ndarray):
        """Codeword ids (-1 where cold), levels (0 where cold) and the next residual."""
        hot = np.einsum("bi,bi->b", res, res) / 8.0 > stage.cutoff
        ids = np.full(len(res), -1, dtype=np.int16)
        levels = np.zeros(len(res), dtype=np.int16)
        out = res.copy()
        if hot.any():
            best, scores = best_codeword(res[hot], codebook)
            span = max(stage.hi - stage.lo, 1e-6)
            level = np.floor(np.clip((scores - stage.lo) / span, 0, 0.9999) * LEVELS) + 1
            ids[hot], levels[hot] = best, level
            out[hot] -= codebook[best] * self._height(level, stage)[:, None]
        return ids, levels, out

    @staticmethod
    def _height(level: np.ndarray, stage: HotStage) -> np.ndarray:
        return stage.lo + (level - 0.5) / LEVELS * max(stage.hi - stage.lo, 1e-6)

    def residual(self, x: np.ndarray, upto: int) -> np.ndarray:
        res, codebook = self.normalize(x), e8_codebook()
        for stage in self.stages[:upto]:
            _, _, res = self._stage(res, stage, codebook)
        return res

    def _encode_matrix(self, x: np.ndarray) -> dict:
        res, codebook, ids, levels = self.normalize(x), e8_codebook(), [], []
        for stage in self.stages:
            i, q, res = self._stage(res, stage, codebook)
            ids.append(i.reshape(len(x), -1))
            levels.append(q.reshape(len(x), -1))
        shape = (len(x), len(self.stages), self.blocks)
        return {
            "ids": np.stack(ids, axis=1) if ids else np.zeros(shape, np.int16),
            "levels": np.stack(levels, axis=1) if levels else np.zeros(shape, np.int16),
        }

    def _decode_matrix(self, code: dict) -> np.ndarray:
        ids, levels = code["ids"], code["levels"]
        book = np.vstack([e8_codebook(), np.zeros(8)])  # id -1 picks the zero row
        out = np.zeros((len(ids), self.blocks, 8))
        for s, stage in enumerate(self.stages):
            out += book[ids[:, s]] * self._height(levels[:, s].astype(float), stage)[:, :, None]
        flat = out.reshape(len(ids), -1)[:, : self.dim]
        return flat * np.array(self.spread) + np.array(self.center)

    def _prepare(self, df: DataFrame, column: str, threshold: str) -> "HotBlockModel":
        if threshold != "batch" or self.threshold >= 1.0:
            return self
        model, rows = self, df.count() * self.blocks
        for s in range(len(self.stages)):
            cut = exact_quantiles(model.energies(df, column, s), "energy", [self.threshold], (), rows)
            stages = list(model.stages)
            stages[s] = dataclasses.replace(stages[s], cutoff=cut[()][0])
            model = dataclasses.replace(model, stages=tuple(stages))
        return model

    def energies(self, df: DataFrame, column: str, upto: int) -> DataFrame:
        """Energy of every block before stage ``upto``."""
        model = self

        def kernel(batch: pa.RecordBatch):
            res = model.residual(to_matrix(batch.column(column), model.dim), upto)
            return {"energy": pa.array(np.einsum("bi,bi->b", res, res) / 8.0)}

        return map_batches(df.select(column), kernel, "energy double", self.dim)

    def encode(self, df: DataFrame, column: str = "embedding", threshold: str = "model") -> DataFrame:
        """Replace the vector by ``ids`` and ``levels`` per stage (NULL where cold)."""
        model = self._prepare(df, column, threshold)

        def kernel(batch: pa.RecordBatch):
            code = model._encode_matrix(to_matrix(batch.column(column), model.dim))
            cold = code["ids"] < 0
            return {"ids": nested_lists(code["ids"], cold), "levels": nested_lists(code["levels"], cold)}

        ddl = "ids array<array<smallint>>, levels array<array<smallint>>"
        return add_columns(df, kernel, ddl, self.dim * max(1, len(self.stages)), drop=[column])

    def decode(self, encoded: DataFrame, out: str = "rebuilt") -> DataFrame:
        model = self

        def cube(col: pa.Array, missing: int) -> np.ndarray:
            flat = col.flatten().flatten().fill_null(missing).to_numpy(zero_copy_only=False)
            return flat.reshape(len(col), len(model.stages), model.blocks)

        def kernel(batch: pa.RecordBatch):
            code = {"ids": cube(batch.column("ids"), -1), "levels": cube(batch.column("levels"), 0)}
            return {out: lists(model._decode_matrix(code))}

        width = self.dim * max(1, len(self.stages))
        return add_columns(encoded, kernel, f"{out} array<double>", width, drop=["ids", "levels"])

    def bit_rate(self, encoded: DataFrame) -> DataFrame:
        """64 metadata bits, one mask bit per block and stage, 12 bits per hot block."""
        hot = F.aggregate(
            F.transform("ids", lambda s: F.size(F.filter(s, lambda i: i.isNotNull()))),
            F.lit(0), lambda acc, n: acc + n,
        )
        sums = encoded.agg(F.count(F.lit(1)).alias("n_vectors"), F.sum(hot).alias("n_hot"))
        bits = 64.0 + len(self.stages) * self.blocks + 12.0 * F.col("n_hot") / F.col("n_vectors")
        return sums.withColumn("total_bpd", bits / float(self.dim))

    def nominal_bpd(self) -> float:
        return 64.0 / self.dim + 1.5 * len(self.stages)

    def measure(self, df: DataFrame, column: str = "embedding", threshold: str = "model") -> DataFrame:
        return self.bit_rate(self.encode(df, column, threshold))


@dataclasses.dataclass(frozen=True)
class HotBlockCodec:
    """``threshold=1`` keeps every block hot in every stage."""

    dim: int
    stages: int = 8
    threshold: float = 0.95

    def fit(self, df: DataFrame, column: str = "embedding") -> HotBlockModel:
        rows = df.count()
        center, spread = robust_scale(df, column, rows)
        model = HotBlockModel(self.dim, self.threshold, center, spread, ())
        blocks = rows * model.blocks
        for s in range(self.stages):
            cut = -1.0
            if self.threshold < 1.0:
                energy = model.energies(df, column, s)
                cut = exact_quantiles(energy, "energy", [self.threshold], (), blocks)[()][0]
            scores = self._scores(model, df, column, s, cut)
            ends = exact_quantiles(scores, "score", [0.001, 0.999], (), blocks)
            if not ends:
                break
            lo, hi = ends[()]
            stage = HotStage(stable(lo), stable(hi), cut)
            model = dataclasses.replace(model, stages=(*model.stages, stage))
        return model

    @staticmethod
    def _scores(model: HotBlockModel, df: DataFrame, column: str, upto: int, cut: float) -> DataFrame:
        """Best inner product of every hot block before stage ``upto``."""

        def kernel(batch: pa.RecordBatch):
            res = model.residual(to_matrix(batch.column(column), model.dim), upto)
            hot = res[np.einsum("bi,bi->b", res, res) / 8.0 > cut]
            return {"score": pa.array(best_codeword(hot, e8_codebook())[1])}

        return map_batches(df.select(column), kernel, "score double", model.dim)
