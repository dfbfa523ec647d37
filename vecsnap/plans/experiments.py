"""Experiments: codec configurations crossed with data groups, reported as tables.

Greedy staged codecs nest: the first ``s`` stages of a long fit are the ``s``-stage fit.
Reports over stage counts therefore fit once and evaluate all prefixes in one pass.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsnap.codecs.base import ModelBase
from vecsnap.codecs.direction import (
    ID_BITS, DirectionCodec, DirectionModel, _per_config, fit_grid, outlier_scales,
)
from vecsnap.codecs.hotblock import HotBlockCodec, HotBlockModel
from vecsnap.codecs.layered import LayeredCodec, LayeredModel
from vecsnap.codecs.scalar import RotatedModel, ScalarCodec, table_standard_lattice
from vecsnap.kernels.arrow import map_batches, to_matrix
from vecsnap.operators.entropy import code_entropy, rotated_bpd
from vecsnap.operators.metrics import row_errors, snr_db, status, summarize
from vecsnap.operators.sampling import hash_sample
from vecsnap.operators.search import recall_at_k
from vecsnap.operators.subspace import sum_matrices


def prefix_models(model: ModelBase) -> dict[int, ModelBase]:
    """The nested models with 1, 2, ... stages of a dense or masked staged codec."""
    if isinstance(model, HotBlockModel):
        return {s: dataclasses.replace(model, stages=model.stages[:s]) for s in range(1, len(model.stages) + 1)}
    codec = LayeredCodec(model.kind, model.dim)
    return {s: codec.fixed(list(model.scales[:s])) for s in range(1, len(model.scales) + 1)}


def config_errors(models: dict, df: DataFrame, column: str, dim: int) -> DataFrame:
    """``(config, signal, noise, n_values)`` totals of many models in one scan."""
    keys = list(models)

    def kernel(batch: pa.RecordBatch):
        x = to_matrix(batch.column(column), dim)
        rows = []
        for model in models.values():
            gap = x - model._decode_matrix(model._encode_matrix(x))
            rows.append((float(np.square(x).sum()), float(np.square(gap).sum()), x.size))
        return {
            "config": pa.array([str(k) for k in keys]),
            "signal": pa.array([r[0] for r in rows]),
            "noise": pa.array([r[1] for r in rows]),
            "n_values": pa.array([r[2] for r in rows]),
        }

    ddl = "config string, signal double, noise double, n_values bigint"
    parts = map_batches(df.select(column), kernel, ddl, dim * 4)
    return parts.groupBy("config").agg(
        F.sum("signal").alias("signal"), F.sum("noise").alias("noise"), F.sum("n_values").alias("n_values")
    )


def config_snr(models: dict, df: DataFrame, column: str, dim: int, floor: float = 1e-30) -> dict[str, float]:
    rows = config_errors(models, df, column, dim)
    snr = snr_db(F.col("signal"), F.col("noise"), F.col("n_values"), floor)
    return {r["config"]: r["snr"] for r in rows.select("config", snr.alias("snr")).collect()}


def prefix_rates(model: LayeredModel, df: DataFrame, column: str) -> dict[int, float]:
    """Total bits per dimension of each stage prefix of a dense model."""
    bits = {r["stage"]: r["entropy_bits"] for r in code_entropy(model.code_rows(df, column)).collect()}
    out, total = {}, model.metadata_bpd
    for s in range(len(model.scales)):
        total += bits[s] * model.blocks / model.dim
        out[s + 1] = total
    return out


def ablation(
    train: DataFrame, test: DataFrame, dim: int, column: str = "embedding", deep: int = 4
) -> DataFrame:
    """Deep and single-stage block codec against a single global scale at stage 1."""
    spark = train.sparkSession
    model = LayeredCodec("block", dim, deep).fit(train, column)
    picked = {f"block {deep}-stage": model, "block 1-stage": prefix_models(model)[1]}
    snr = config_snr(picked, test, column, dim)
    rate = prefix_rates(model, test, column)
    rows = [
        (name, snr[name], rate[len(m.scales)]) for name, m in picked.items()
    ]
    table = spark.createDataFrame(rows, "method string, snr_db double, bpd double")
    bare = summarize(row_errors(table_standard_lattice(train, test, column, dim), column)).select(
        F.lit("global scale").alias("method"), "snr_db", F.lit(4.0).alias("bpd")
    )
    return table.unionByName(bare)


VERSIONS = {"block": "block", "gain16": "gain16", "sparse": "sparse", "dual": "dual"}


def trial_results(
    df: DataFrame, trial: str, train: str, dim: int, kinds: Sequence[str] = tuple(VERSIONS),
    stages: dict[str, int] | None = None, target_bpd: float = 3.0, column: str = "embedding",
) -> DataFrame:
    """``(trial, version, snr_db, bpd)``: each version fitted on the trial's training rows.

    ``trial`` has few values; ``train`` is a boolean column splitting each trial.
    """
    spark = df.sparkSession
    stages = stages or {"block": 4, "gain16": 4, "sparse": 4, "dual": 6}
    rows = []
    for r in df.select(trial).distinct().orderBy(trial).collect():
        mine = df.where(F.col(trial) == r[0])
        learn, test = mine.where(F.col(train)), mine.where(~F.col(train))
        models = {k: LayeredCodec(k, dim, stages[k], target_bpd).fit(learn, column) for k in kinds}
        models = {k: m._prepare(test, column, "batch") for k, m in models.items()}
        snr = config_snr(models, test, column, dim)
        rates = mixed_rates(models, test, column)
        rows += [(int(r[0]), k, snr[k], rates[k]) for k in kinds]
    return spark.createDataFrame(rows, "trial int, version string, snr_db double, bpd double")


def mixed_rates(models: dict[str, LayeredModel], df: DataFrame, column: str) -> dict[str, float]:
    """Total bits per dimension of several layered models: one shuffle of all their codes."""
    rows = None
    for name, model in models.items():
        part = model.code_rows(df, column).withColumn("config", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    per = code_entropy(rows, ["config", "stage"]).groupBy("config").agg(
        F.sum(F.col("entropy_bits") * F.col("n_codes")).alias("bits")
    )
    bits = {r["config"]: r["bits"] for r in per.collect()}
    n = df.count()
    return {k: m.metadata_bpd + bits.get(k, 0.0) / (n * m.dim) for k, m in models.items()}


def trial_summary(results: DataFrame) -> DataFrame:
    """Mean and sample deviation over trials, per version."""
    return results.groupBy("version").agg(
        F.avg("snr_db").alias("snr_mean"), F.stddev_samp("snr_db").alias("snr_std"),
        F.avg("bpd").alias("bpd_mean"), F.stddev_samp("bpd").alias("bpd_std"),
    )


TIER_STAGES = {"block": (1, 2, 4), "gain16": (1, 3, 8)}
TIER_TARGETS = {"sparse": (2.2, 4.5, 8.0), "dual": (2.99, 4.5, 8.0)}
TIERS = ("extreme", "medium", "loose")


def tier_results(
    df: DataFrame, dim: int, column: str = "embedding",
    stages: dict[str, Sequence[int]] | None = None, targets: dict[str, Sequence[float]] | None = None,
    max_stages: int = 8,
) -> DataFrame:
    """``(version, tier, bpd, snr_db, status)`` for stage-count and target-rate tiers."""
    stages = TIER_STAGES if stages is None else stages
    targets = TIER_TARGETS if targets is None else targets
    models: dict[str, LayeredModel] = {}
    for kind, counts in stages.items():
        full = LayeredCodec(kind, dim, max(counts)).fit(df, column)
        nested = prefix_models(full)
        for tier, s in zip(TIERS, counts):
            models[f"{kind}:{tier}"] = nested[min(s, len(nested))]
    for kind, rates in targets.items():
        for tier, m in zip(TIERS, LayeredCodec(kind, dim, max_stages).fit_targets(df, rates, column)):
            models[f"{kind}:{tier}"] = m
    snr = config_snr(models, df, column, dim)
    rate = mixed_rates(models, df, column)
    rows = [(*k.split(":"), rate[k], snr[k]) for k in models]
    table = df.sparkSession.createDataFrame(rows, "version string, tier string, bpd double, snr_db double")
    return table.withColumn("status", status(F.col("snr_db")))


def tier_pivot(results: DataFrame, value: str = "snr_db") -> DataFrame:
    return results.groupBy("version").pivot("tier", list(TIERS)).agg(F.first(value))


def crossover(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Masked codewords against block lattice at target rates 4.0, 4.5, ... 10.0."""
    hot = prefix_models(HotBlockCodec(dim, stages=10).fit(df, column))
    block = prefix_models(LayeredCodec("block", dim, 4).fit(df, column))
    models = {**{f"hot{s}": m for s, m in hot.items()}, **{f"block{s}": m for s, m in block.items()}}
    snr = config_snr(models, df, column, dim, floor=1e-25)
    rows = []
    for half in range(8, 21):
        rate = half / 2
        s = int((rate - 4.0) / 1.5)
        # Without a lattice stage the block codec has no output; 0.5 dB stands for it.
        other = snr[f"block{min(s, len(block))}"] if s > 0 else 0.5
        rows += [(rate, "hotblock", snr[f"hot{min(int(rate), len(hot))}"]), (rate, "block", other)]
    return df.sparkSession.createDataFrame(rows, "target_bpd double, version string, snr_db double")


def winners(results: DataFrame, by: str = "target_bpd") -> DataFrame:
    # Of equal versions the block codec wins: the other one must be strictly better.
    best = F.min_by("version", F.struct(-F.col("snr_db"), "version")).alias("winner")
    return results.groupBy(by).agg(F.max("snr_db").alias("snr_db"), best)


KEY_SKETCH = (0.0625, 0.125, 0.1875, 0.25, 0.3125, 0.375)
VALUE_SKETCH = (0.0, 0.03125, 0.0625, 0.09375)
PLAIN_SKETCH = (0.0, 0.015625, 0.03125, 0.0625, 0.125, 0.1875, 0.25, 0.375, 0.5, 0.625)


def rate_grid(needs: DataFrame, max_stages: int = 4) -> DataFrame:
    """Feasible configurations for rows ``(role, dim, target_bpd)``.

    ``role`` is key, value, or plain (no role). The norm bits are what the target leaves
    after codeword ids and sketch signs; configurations outside 0..24 bits are dropped
    before anything is fitted.
    """
    stages = (
        F.when(F.col("role") == "key", F.sequence(F.lit(2), F.lit(max_stages)))
        .when(F.col("role") == "value", F.sequence(F.lit(2), F.lit(min(max_stages, 3))))
        .otherwise(F.sequence(F.lit(1), F.lit(max_stages)))
    )
    turns = F.when(F.col("role") == "value", F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    shares = (
        F.when(F.col("role") == "key", F.lit(list(KEY_SKETCH)))
        .when(F.col("role") == "value", F.lit(list(VALUE_SKETCH)))
        .otherwise(F.lit(list(PLAIN_SKETCH)))
    )
    grid = (
        needs.withColumn("stages", F.explode(stages))
        .withColumn("rotation", F.explode(turns))
        .withColumn("_f", F.explode(shares))
    )
    blocks = F.ceil(F.col("dim") / 8)
    rank = F.rint(F.col("_f") * F.col("dim")).cast("int")
    left = F.col("target_bpd") * F.col("dim") - F.col("sketch_rank") - blocks * F.col("stages") * ID_BITS
    return (
        grid.withColumn("sketch_rank", rank)
        .withColumn("norm_bits", left / (blocks * F.col("stages")))
        .where("norm_bits BETWEEN 0 AND 24")
        .drop("_f")
    )


class NoFeasibleRate(RuntimeError):
    """No codec of the grid reaches the asked rate."""


def search_rate(
    train: DataFrame, calibration: DataFrame, dim: int, target_bpd: float, role: str = "key",
    queries: DataFrame | None = None, qk_weight: float = 0.5, handle_outliers: bool = True,
    max_stages: int = 4, fit_samples: int | None = None, search_samples: int | None = None, seed: int = 42,
    column: str = "embedding", id_col: str = "vec_id",
) -> tuple[DirectionModel, DataFrame]:
    """Best direction codec at a rate, and the ranked table of all feasible ones.

    All configurations are fitted together (one job per stage) and scored together in one job,
    on all rows or on samples of the given sizes; ranking is score, then closure error.
    """
    spark = train.sparkSession
    if role not in ("key", "value", "plain"):
        raise ValueError("role must be key, value or plain")
    need = spark.createDataFrame([(role, dim, float(target_bpd))], "role string, dim int, target_bpd double")
    grid = rate_grid(need, max_stages).orderBy("stages", "rotation", "sketch_rank").collect()
    if not grid:
        raise NoFeasibleRate(f"no valid codec for target_bpd={target_bpd}, role={role}")
    models = [
        DirectionCodec(
            dim, g["stages"], g["norm_bits"], use_rotation=g["rotation"],
            use_sketch=g["sketch_rank"] > 0, sketch_rank=g["sketch_rank"], seed=seed,
        ).blank()
        for g in grid
    ]
    if handle_outliers and role == "key":
        found = {}
        for m in models:
            if m.reflections not in found:
                found[m.reflections] = outlier_scales(m, train, column)
        models = [dataclasses.replace(m, block_scales=found[m.reflections]) for m in models]

    def rows_of(df: DataFrame, n: int | None) -> DataFrame:
        rows = df.select(id_col, column)
        return rows if n is None else hash_sample(rows, id_col, n, seed)

    models = fit_grid(models, rows_of(train, fit_samples), column, fit_samples)
    judged = rows_of(calibration, search_samples)
    q = None
    if queries is not None and role == "key":
        # Scores of all pairs are summed from the queries' count, sum and products.
        def moments(x: np.ndarray) -> np.ndarray:
            x = np.c_[x, np.ones(len(x))]
            return x.T @ x

        q = sum_matrices(rows_of(queries, search_samples), column, dim, (dim + 1, dim + 1), moments)

    def fn(model, x):
        code = model._encode_matrix(x)
        gap = x - model._decode_matrix(code)
        closure = np.abs(code["debug"] - model._decode_rotated(code)).max()
        sums = [x.size, x.sum(), np.square(x).sum(), np.square(gap).sum()]
        if q is not None:
            products, total, n_q = q[:dim, :dim], q[dim, :dim], q[dim, dim]
            squares = [np.einsum("ij,ij->", v @ products, v) for v in (x, gap)]
            sums += [len(x) * n_q, x.sum(axis=0) @ total, *squares]
        else:
            sums += [0.0] * 4
        return {**{f"c{i}": np.array([float(v)]) for i, v in enumerate(sums)}, "closure": np.array([closure])}

    ddl = ", ".join(f"c{i} double" for i in range(8)) + ", closure double"
    parts = _per_config(models, range(len(models)), judged.select(column), column, fn, ddl)
    sums = parts.groupBy("config").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(8)], F.max("closure").alias("closure")
    )
    mse = F.col("c3") / F.col("c0")
    snr = 10 * F.log10(F.col("c2") / F.col("c0") / (mse + 1e-12))
    score = snr
    if q is not None:
        var = F.col("c2") / F.col("c0") - (F.col("c1") / F.col("c0")) ** 2
        qk_var = F.col("c6") / F.col("c4") - (F.col("c5") / F.col("c4")) ** 2
        qk = F.col("c7") / F.col("c4")
        score = -((1 - qk_weight) * mse / (var + 1e-12) + qk_weight * qk / (qk_var + 1e-12))
    names = spark.createDataFrame(
        [(i, g["stages"], g["rotation"], g["sketch_rank"], g["norm_bits"]) for i, g in enumerate(grid)],
        "config int, stages int, rotation boolean, sketch_rank int, norm_bits double",
    )
    w = Window.orderBy(F.desc("score"), "closure", "config")
    ranked = (
        sums.join(F.broadcast(names), "config")
        .select("config", "stages", "rotation", "sketch_rank", "norm_bits", snr.alias("snr_db"),
                score.alias("score"), "closure")
        .withColumn("place", F.row_number().over(w))
    ).persist()
    best = ranked.where("place = 1").first()["config"]
    return models[best], ranked


def search_ladder(*args, targets: Sequence[float] = (6.0, 5.0, 4.0, 3.5, 3.0), **kwargs):
    """First feasible target of a descending list: ``(target, model, ranked table)``."""
    for target in targets:
        try:
            model, ranked = search_rate(*args, target_bpd=target, **kwargs)
            return target, model, ranked
        except NoFeasibleRate:
            continue
    raise NoFeasibleRate("no target of the ladder is feasible")


def method_table(
    train: DataFrame, test: DataFrame, dim: int, column: str = "embedding", id_col: str = "vec_id",
    recall_queries: int = 50,
) -> DataFrame:
    """Rate, SNR, cosine, recall@10 and closure of the codecs and the scalar baselines."""
    direction = {}
    for rate in (2.75, 3.0):
        direction[f"direction {rate}"] = search_rate(train, test, dim, rate, "key", column=column)[0]
    direction["direction deep"] = DirectionCodec(
        dim, 4, 2.5, use_sketch=True, sketch_rank=max(1, dim // 16), handle_outliers=True
    ).fit(train, column, id_col)
    hot1 = HotBlockCodec(dim, 1, 0.95).fit(train, column)
    hot2 = HotBlockCodec(dim, 2, 1.0).fit(train, column)
    block = LayeredCodec("block", dim, 4).fit(train, column)
    methods = [("scalar 3-bit", ScalarCodec(dim, 3).fit(test, column), 3.0, 3.0)]
    methods += [(k, m, m.bits_per_dim(), m.bits_per_dim(raw=True)) for k, m in direction.items()]
    methods.append(("rotated 4-bit", RotatedModel(dim, 4), rotated_bpd(dim, 4), rotated_bpd(dim, 4)))
    for name, m in (("hot 1-stage", hot1), ("hot 2-stage dense", hot2)):
        rate = m.measure(test, column).first()["total_bpd"]
        methods.append((name, m, rate, rate))
    rate = prefix_rates(block, test, column)[len(block.scales)]
    methods.append(("block 4-stage", block, rate, rate))
    out = None
    for name, model, bpd, raw in methods:
        both = model.reconstruct(test.select(id_col, column), column)
        facts = summarize(row_errors(both, column), floor=0, add=1e-12)
        recall = recall_at_k(both, column, "rebuilt", dim, 10, recall_queries, id_col).select("recall")
        one = F.lit(1).alias("_one")
        row = facts.withColumn("_one", one).join(recall.withColumn("_one", one), "_one")
        row = row.select(
            F.lit(name).alias("method"), F.lit(float(bpd)).alias("bpd"), F.lit(float(raw)).alias("raw_bpd"),
            "snr_db", "cosine", "recall",
        )
        out = row if out is None else out.unionByName(row)
    return out


def reshape_dim(df: DataFrame, dim: int, column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The table at another vector length, with every value of every vector in it.

    A longer vector is cut into pieces, numbered on from ``id * pieces``; the last piece, or a
    shorter vector, goes on with the vector's own first values.
    """
    size = F.size(column)
    pieces = F.ceil(size / dim).cast("int")
    wide = F.flatten(F.array_repeat(F.col(column), F.ceil(pieces * dim / size).cast("int")))
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: F.slice(wide, k * dim + 1, F.lit(dim)))
    others = [c for c in df.columns if c not in (column, id_col)]
    rows = df.where(size > 0).select(*others, F.col(id_col).alias("_id"), pieces.alias("_n"), F.posexplode(cut).alias("_k", column))
    return rows.select(*others, (F.col("_id") * F.col("_n") + F.col("_k")).alias(id_col), column)


def dimension_sweep(
    df: DataFrame, dims: Sequence[int] = (8, 22, 64, 128), target_bpd: float = 3.0,
    column: str = "embedding", id_col: str = "vec_id",
) -> DataFrame:
    """SNR of the searched codec and of the 3-bit scalar baseline per dimension."""
    rows = []
    for dim in dims:
        table = reshape_dim(df.select(id_col, column), dim, column, id_col)
        base = ScalarCodec(dim, 3).fit(table, column)
        model, _ = search_rate(table, table, dim, target_bpd, "key", column=column, id_col=id_col, seed=99 + dim)
        snr = config_snr({"base": base, "found": model}, table, column, dim)
        rows.append((dim, snr["base"], snr["found"], snr["found"] - snr["base"]))
    return df.sparkSession.createDataFrame(
        rows, "dim int, scalar_snr_db double, codec_snr_db double, gain_db double"
    )


