"""Multi-stage E8 codecs over normalized blocks.

Four codecs share one shape: normalize a row, then snap the residual to E8 at a
fitted scale, stage after stage. They differ in the normalization and in which
blocks the later stages touch:

* ``block``   mean and deviation per 8-block, every stage dense;
* ``gain16``  row mean/deviation and a gain per 16-block, every stage dense;
* ``sparse``  as ``gain16``; stage 0 and the refinement run on the most energetic
  share of blocks that a bit budget allows;
* ``dual``    gains per 32-block; two base stages, then refinement on a share.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.codecs.base import ModelBase, stable
from vecsnap.kernels.arrow import add_columns, lists, map_batches, nested_lists, to_cube, to_matrix
from vecsnap.kernels.lattice import code_keys, nearest_e8, pad_to
from vecsnap.operators.entropy import code_entropy
from vecsnap.operators.quantiles import exact_quantiles

GAIN_WIDTH = {"block": 8, "gain16": 16, "sparse": 16, "dual": 32}
TINY = 1e-12


@dataclasses.dataclass(frozen=True)
class Layer:
    """Stages ``first .. last`` share one block mask: energy >= ``cutoff``."""

    first: int
    last: int
    density: float = 1.0
    cutoff: float = -math.inf


@dataclasses.dataclass(frozen=True)
class LayeredModel(ModelBase):
    kind: str
    dim: int
    scales: tuple[float, ...]
    layers: tuple[Layer, ...]
    metadata_bpd: float
    stage_bpd: tuple[float, ...] = ()
    target_bpd: float | None = None

    # -- geometry ---------------------------------------------------------------

    @property
    def gain_width(self) -> int:
        return GAIN_WIDTH[self.kind]

    @property
    def padded(self) -> int:
        return -(-self.dim // self.gain_width) * self.gain_width

    @property
    def blocks(self) -> int:
        return self.padded // 8

    @property
    def sparse(self) -> bool:
        return any(layer.density < 1.0 for layer in self.layers)

    # -- kernels ----------------------------------------------------------------

    def normalize(self, x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Residual blocks (n, blocks, 8) and the row metadata that undoes it."""
        n = len(x)
        wide = pad_to(x, self.gain_width)
        if self.kind == "block":
            parts = wide.reshape(n, -1, 8)
            shift = parts.mean(axis=2)
            spread = parts.std(axis=2) + TINY
            return (parts - shift[:, :, None]) / spread[:, :, None], {"shift": shift, "spread": spread}
        shift = wide.mean(axis=1, keepdims=True)
        spread = wide.std(axis=1, keepdims=True) + TINY
        parts = ((wide - shift) / spread).reshape(n, -1, self.gain_width)
        gains = parts.std(axis=2) + TINY
        res = (parts / gains[:, :, None]).reshape(n, -1, 8)
        return res, {"shift": shift, "spread": spread, "gains": gains}

    def _denormalize(self, res: np.ndarray, meta: dict[str, np.ndarray]) -> np.ndarray:
        n = len(res)
        if self.kind == "block":
            out = res * meta["spread"][:, :, None] + meta["shift"][:, :, None]
        else:
            out = res.reshape(n, -1, self.gain_width) * meta["gains"][:, :, None]
            out = out.reshape(n, -1) * meta["spread"] + meta["shift"]
        return out.reshape(n, -1)[:, : self.dim]

    def _run(self, res: np.ndarray, stop: int | None = None) -> tuple[list, list, np.ndarray]:
        """Doubled codes per stage, mask per layer, and the final residual."""
        codes, masks = [], []
        stop = len(self.scales) if stop is None else stop
        for layer in self.layers:
            if layer.first >= stop:
                break
            energy = np.einsum("nbi,nbi->nb", res, res) / 8.0
            mask = energy >= layer.cutoff if layer.density > 0 else np.zeros(energy.shape, bool)
            dense = mask.all()
            live = res if dense else res[mask]
            for s in range(layer.first, min(layer.last + 1, stop)):
                q = nearest_e8(live * self.scales[s])
                live = live - q / self.scales[s]
                if dense:
                    codes.append(2 * q)
                else:
                    full = np.zeros(res.shape)
                    full[mask] = 2 * q
                    codes.append(full)
            if dense:
                res = live
            else:
                res = res.copy()
                res[mask] = live
            masks.append(mask)
        return codes, masks, res

    def _encode_matrix(self, x: np.ndarray) -> dict:
        res, code = self.normalize(x)
        codes, masks, _ = self._run(res)
        return {**code, "codes": codes, "masks": masks}

    def _decode_matrix(self, code: dict) -> np.ndarray:
        """Sum of ``q / scale`` over the stages, then the inverse normalization."""
        res = sum(q / (2.0 * s) for q, s in zip(code["codes"], self.scales))
        return self._denormalize(res.reshape(len(res), self.blocks, 8), code)

    # -- DataFrame API ----------------------------------------------------------

    def _prepare(self, df: DataFrame, column: str, threshold: str) -> "LayeredModel":
        return self.with_batch_cutoffs(df, column) if threshold == "batch" and self.sparse else self

    def with_batch_cutoffs(self, df: DataFrame, column: str, n: int | None = None) -> "LayeredModel":
        """Cut-offs taken from ``df`` itself: an exact energy quantile per sparse layer."""
        model = self
        rows = (df.count() if n is None else n) * self.blocks
        for i, layer in enumerate(self.layers):
            if 0.0 < layer.density < 1.0:
                energy = model._energies(df, column, layer.first)
                cut = exact_quantiles(energy, "energy", [1.0 - layer.density], max_rows=rows)[()][0]
                layers = list(model.layers)
                layers[i] = dataclasses.replace(layer, cutoff=cut)
                model = dataclasses.replace(model, layers=tuple(layers))
        return model

    def _energies(self, df: DataFrame, column: str, stop: int) -> DataFrame:
        """Block energies of the residual before stage ``stop``."""
        model = self

        def kernel(batch: pa.RecordBatch):
            res, _ = model.normalize(to_matrix(batch.column(column), model.dim))
            _, _, res = model._run(res, stop)
            return {"energy": pa.array((np.einsum("nbi,nbi->nb", res, res) / 8.0).reshape(-1))}

        return map_batches(df.select(column), kernel, "energy double", self.padded)

    def encode(self, df: DataFrame, column: str = "embedding", threshold: str = "model") -> DataFrame:
        """Replace the vector by ``shift, spread[, gains], codes[, active]``.

        ``codes`` holds doubled lattice coordinates per stage (exact integers);
        ``active`` the block mask of each layer for the sparse kinds.
        """
        model = self._prepare(df, column, threshold)
        gains = model.kind != "block"
        ddl = "shift array<double>, spread array<double>"
        ddl += ", gains array<double>" if gains else ""
        ddl += ", codes array<array<bigint>>"
        ddl += ", active array<array<boolean>>" if model.sparse else ""

        def kernel(batch: pa.RecordBatch):
            x = to_matrix(batch.column(column), model.dim)
            code = model._encode_matrix(x)
            stacked = np.stack(code["codes"], axis=1).reshape(len(x), len(model.scales), -1)
            cols = {
                "shift": lists(code["shift"]),
                "spread": lists(code["spread"]),
                "codes": nested_lists(stacked.astype(np.int64)),
            }
            if gains:
                cols["gains"] = lists(code["gains"])
            if model.sparse:
                cols["active"] = nested_lists(np.stack(code["masks"], axis=1))
            return cols

        return add_columns(df, kernel, ddl, self.padded * len(self.scales), drop=[column])

    def decode(self, encoded: DataFrame, out: str = "rebuilt") -> DataFrame:
        model = self
        gains = self.kind != "block"
        stats = self.blocks if self.kind == "block" else 1
        used = ["shift", "spread", "codes"] + (["gains"] if gains else [])
        used += ["active"] if self.sparse else []

        def kernel(batch: pa.RecordBatch):
            cube = to_cube(batch.column("codes"), len(model.scales), model.padded)
            code = {
                "codes": list(np.moveaxis(cube, 1, 0)),
                "shift": to_matrix(batch.column("shift"), stats),
                "spread": to_matrix(batch.column("spread"), stats),
            }
            if gains:
                code["gains"] = to_matrix(batch.column("gains"), model.padded // model.gain_width)
            return {out: lists(model._decode_matrix(code))}

        width = self.padded * len(self.scales)
        return add_columns(encoded, kernel, f"{out} array<double>", width, drop=used)

    def code_rows(self, df: DataFrame, column: str = "embedding", threshold: str = "model") -> DataFrame:
        """One row per counted code: ``stage`` and its exact grouping key."""
        model = self._prepare(df, column, threshold)

        def kernel(batch: pa.RecordBatch):
            code = model._encode_matrix(to_matrix(batch.column(column), model.dim))
            return _key_columns(model, code["codes"], code["masks"])

        return map_batches(
            df.select(column), kernel, "stage int, k0 bigint, k1 bigint, wide binary",
            self.padded * len(self.scales),
        )

    def code_rows_of(self, encoded: DataFrame) -> DataFrame:
        """The same rows from a stored payload."""
        model = self
        cols = ["codes"] + (["active"] if self.sparse else [])

        def kernel(batch: pa.RecordBatch):
            cube = to_cube(batch.column("codes"), len(model.scales), model.padded, np.int64)
            n = len(cube)
            if model.sparse:
                act = to_cube(batch.column("active"), len(model.layers), model.blocks, bool)
                masks = [act[:, i] for i in range(len(model.layers))]
            else:
                masks = [np.ones((n, model.blocks), bool)] * len(model.layers)
            codes = [cube[:, s].reshape(n, model.blocks, 8) for s in range(len(model.scales))]
            return _key_columns(model, codes, masks)

        return map_batches(
            encoded.select(*cols), kernel, "stage int, k0 bigint, k1 bigint, wide binary",
            self.padded * len(self.scales),
        )

    def bit_rate(self, code_rows: DataFrame, n_vectors: int | DataFrame) -> DataFrame:
        """One row: metadata, code and total bits per dimension, and code counts.

        ``n_vectors`` may be a DataFrame, whose row count then joins as an aggregate.
        ``sample_limited`` flags rates that more data would raise.
        """
        n = n_vectors.count() if isinstance(n_vectors, DataFrame) else n_vectors
        per_stage = code_entropy(code_rows)
        return (
            per_stage.agg(
                F.sum("n_codes").alias("n_codes"),
                F.sum("n_distinct").alias("n_distinct"),
                (F.coalesce(F.sum(F.col("entropy_bits") * F.col("n_codes")), F.lit(0.0))
                 / float(n * self.dim)).alias("code_bpd"),
            )
            .withColumn("metadata_bpd", F.lit(float(self.metadata_bpd)))
            .withColumn("total_bpd", F.col("metadata_bpd") + F.col("code_bpd"))
            .withColumn("sample_limited", F.col("n_distinct") > 0.5 * F.col("n_codes"))
            .select("metadata_bpd", "code_bpd", "total_bpd", "n_codes", "n_distinct", "sample_limited")
        )

    def measure(self, df: DataFrame, column: str = "embedding", threshold: str = "model") -> DataFrame:
        return self.bit_rate(self.code_rows(df, column, threshold), df)


def _key_columns(model: LayeredModel, codes, masks) -> dict[str, pa.Array]:
    stages, firsts, seconds, wides = [], [], [], []
    for layer, mask in zip(model.layers, masks):
        for s in range(layer.first, layer.last + 1):
            k0, k1, wide = code_keys(codes[s][mask])
            stages.append(np.full(len(k0), s, dtype=np.int32))
            firsts.append(k0)
            seconds.append(k1)
            wides.extend(wide)
    return {
        "stage": pa.array(np.concatenate(stages)),
        "k0": pa.array(np.concatenate(firsts)),
        "k1": pa.array(np.concatenate(seconds)),
        "wide": pa.array(wides, type=pa.binary()),
    }


@dataclasses.dataclass(frozen=True)
class LayeredCodec:
    """``kind`` is one of block / gain16 / sparse / dual."""

    kind: str
    dim: int
    max_stages: int = 4
    target_bpd: float = 3.0

    def metadata_bpd(self) -> float:
        blocks = -(-self.dim // 8)
        if self.kind == "block":
            return 32 * blocks / self.dim
        gains = -(-self.dim // GAIN_WIDTH[self.kind])
        mask = 0 if self.kind == "gain16" else blocks
        return (32 + 8 * gains + mask) / self.dim

    def fixed(self, scales: list[float]) -> LayeredModel:
        """A dense model with given stage scales (no fitting)."""
        layers = (Layer(0, len(scales) - 1),)
        return LayeredModel(self.kind, self.dim, tuple(scales), layers, self.metadata_bpd())

    def fit(self, df: DataFrame, column: str = "embedding") -> LayeredModel:
        """One aggregation job per stage; residuals are recomputed from known scales."""
        return self.fit_targets(df, [self.target_bpd], column)[0]

    def fit_targets(
        self, df: DataFrame, targets: Sequence[float], column: str = "embedding"
    ) -> list[LayeredModel]:
        """Models for several target rates; scales and stage rates are fitted once."""
        if self.kind in ("sparse", "dual") and self.max_stages < 2:
            raise ValueError(f"the {self.kind} kind needs at least 2 stages")
        scales: list[float] = []
        n_vectors = None
        budgeted = self.kind in ("sparse", "dual")
        for _ in range(self.max_stages):
            mean_square, n_vectors = self._mean_square(df, column, scales)
            if scales and not budgeted and mean_square < 1e-15:
                break
            scales.append(stable(100.0 / (math.sqrt(mean_square) + 1e-15)))
        dense = self.fixed(scales)
        if not budgeted:
            return [dense for _ in targets]
        entropy = code_entropy(dense.code_rows(df, column)).collect()
        rates = {r["stage"]: stable(r["entropy_bits"] / 8.0) for r in entropy}
        stage_bpd = tuple(rates[s] for s in range(len(scales)))
        models = []
        for target in targets:
            layers = dataclasses.replace(self, target_bpd=target)._layers(stage_bpd)
            model = dataclasses.replace(
                dense, layers=layers, stage_bpd=stage_bpd, target_bpd=float(target)
            )
            models.append(model.with_batch_cutoffs(df, column, n_vectors))
        return models

    def _layers(self, bpd: tuple[float, ...]) -> tuple[Layer, ...]:
        """Densities that spend the target rate: base stages first, refinement after."""
        last = len(bpd) - 1
        budget = self.target_bpd - self.metadata_bpd()
        base = 1 if self.kind == "sparse" else 2
        left = budget - sum(bpd[:base])
        if left > 0:
            rest = sum(bpd[base:])
            density = min(1.0, left / (max(1e-6, rest) if self.kind == "dual" else rest or math.inf))
            squeezed = 1.0
        else:
            density = 0.0
            spent_before = sum(bpd[: base - 1])
            squeezed = max(0.1, (budget - spent_before) / bpd[base - 1])
        layers = [] if self.kind == "sparse" else [Layer(0, 0)]
        layers.append(Layer(base - 1, base - 1, min(1.0, squeezed)))
        if last >= base:
            layers.append(Layer(base, last, density))
        return tuple(layers)

    def _mean_square(self, df: DataFrame, column: str, scales: list[float]) -> tuple[float, int]:
        model = self.fixed(scales) if scales else LayeredModel(self.kind, self.dim, (), (), 0.0)

        def kernel(batch: pa.RecordBatch):
            res, _ = model.normalize(to_matrix(batch.column(column), model.dim))
            _, _, res = model._run(res)
            return {"s": pa.array([float(np.square(res).sum())]), "n": pa.array([len(res)])}

        sums = map_batches(df.select(column), kernel, "s double, n bigint", model.padded)
        row = sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
        if not row["n"]:
            raise ValueError("cannot fit on an empty table")
        return row["s"] / (row["n"] * model.padded), row["n"]


def fit_stage_energies(model: LayeredModel, df: DataFrame, column: str = "embedding") -> DataFrame:
    """Mean squared residual after each stage count (0 = after normalization)."""

    def kernel(batch: pa.RecordBatch):
        res, _ = model.normalize(to_matrix(batch.column(column), model.dim))
        sums = [float(np.square(res).sum())]
        for s in range(len(model.scales)):
            res = res - nearest_e8(res * model.scales[s]) / model.scales[s]
            sums.append(float(np.square(res).sum()))
        stages = list(range(len(sums)))
        return {
            "stage": pa.array(stages, pa.int32()),
            "s": pa.array(sums),
            "n": pa.array([res.size] * len(sums)),
        }

    rows = map_batches(df.select(column), kernel, "stage int, s double, n bigint", model.padded)
    return rows.groupBy("stage").agg((F.sum("s") / F.sum("n")).alias("mean_square"))


def rate_switch(dim: int, target_bpd: float = 8.0):
    """Codec for a target rate: masked codewords below 5.5 bits per dimension, else blocks."""
    from vecsnap.codecs.hotblock import HotBlockCodec

    if target_bpd < 5.5:
        return HotBlockCodec(dim, stages=int(target_bpd))
    return LayeredCodec("block", dim, max_stages=max(0, int((target_bpd - 4.0) / 1.5)))
