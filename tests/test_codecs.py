"""Codecs against direct NumPy computations of the same definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsnap.codecs.direction import DirectionCodec, bit_schedule, outlier_scales, scales_from_maxima
from vecsnap.codecs.graphcode import GraphCodec, adjacency, design_blocks, vertices
from vecsnap.codecs.hotblock import HotBlockCodec
from vecsnap.codecs.layered import LayeredCodec, fit_stage_energies, rate_switch
from vecsnap.codecs.scalar import BlockMeanModel, RotatedModel, ScalarCodec, orthogonal_matrix
from vecsnap.kernels.lattice import e8_codebook, nearest_e8
from vecsnap.operators import metrics
from vecsnap.sources import results


def snr(x, r):
    return 10 * math.log10(np.mean(x**2) / np.mean((x - r) ** 2))


def rebuilt(df):
    return np.array([r["rebuilt"] for r in df.orderBy("vec_id").select("rebuilt").collect()])


def gains(x, width):
    z = x - x.mean(1, keepdims=True)
    gs = z.std(1, keepdims=True) + 1e-12
    parts = (z / gs).reshape(len(x), -1, width)
    ls = parts.std(2, keepdims=True) + 1e-12
    return (parts / ls).reshape(len(x), -1, 8), gs, ls


@pytest.mark.parametrize("stages,expected", [(1, 51.45), (2, 102.9), (3, 154.35)])
def test_dense_gain_stages(vectors, matrix, stages, expected):
    model = LayeredCodec("gain16", 64, stages).fit(vectors)
    r = rebuilt(model.decode(model.encode(vectors)))
    assert snr(matrix, r) == pytest.approx(expected, abs=0.5)
    row = metrics.summarize(model.errors(vectors)).first()
    assert row["snr_db"] == pytest.approx(snr(matrix, r), abs=1e-6)


def test_gain_codec_matches_numpy(vectors, matrix):
    model = LayeredCodec("gain16", 64, 2).fit(vectors)
    res, gs, ls = gains(matrix, 16)
    total = np.zeros_like(res)
    for scale in model.scales:
        want = 100 / (np.sqrt(np.mean(res**2)) + 1e-15)
        assert scale == pytest.approx(want, rel=1e-9)
        q = nearest_e8(res * scale)
        res, total = res - q / scale, total + q / scale
    back = (total.reshape(len(matrix), -1, 16) * ls).reshape(len(matrix), -1) * gs
    back = back + matrix.mean(1, keepdims=True)
    assert np.abs(back - rebuilt(model.reconstruct(vectors))).max() < 1e-12


@pytest.mark.parametrize("kind,target", [("sparse", 3.0), ("sparse", 2.2), ("dual", 3.0), ("dual", 5.0)])
def test_budgeted_codecs_match_numpy(vectors, matrix, kind, target):
    codec = LayeredCodec(kind, 64, 4, target)
    model = codec.fit(vectors)
    res, gs, ls = gains(matrix, 16 if kind == "sparse" else 32)
    bpd, dense = [], res
    for scale in model.scales:
        q = nearest_e8(dense * scale)
        counts = np.unique(q.reshape(-1, 8), axis=0, return_counts=True)[1]
        p = counts / counts.sum()
        bpd.append(-(p * np.log2(p)).sum() / 8)
        dense = dense - q / scale
    assert np.allclose(bpd, model.stage_bpd, atol=1e-9)
    meta = codec.metadata_bpd()
    start, densities = res, {}
    if kind == "sparse":
        left = target - meta - bpd[0]
        first = 1.0 if left > 0 else max(0.1, (target - meta) / bpd[0])
        densities = {(0,): first, (1, 2, 3): min(1.0, left / sum(bpd[1:])) if left > 0 else 0.0}
    else:
        left = target - meta - bpd[0] - bpd[1]
        first = 1.0 if left > 0 else max(0.1, (target - meta - bpd[0]) / bpd[1])
        densities = {(0,): 1.0, (1,): first, (2, 3): min(1.0, left / sum(bpd[2:])) if left > 0 else 0.0}
    for stages, density in densities.items():
        if density == 0:
            continue
        energy = np.mean(start**2, axis=2)
        mask = energy >= np.quantile(energy, 1 - density) if density < 1 else np.ones(energy.shape, bool)
        for s in stages:
            q = np.zeros_like(start)
            q[mask] = nearest_e8(start[mask] * model.scales[s])
            start = start - q / model.scales[s]
    width = 16 if kind == "sparse" else 32
    gap = (start.reshape(len(matrix), -1, width) * ls).reshape(len(matrix), -1) * gs
    want = 10 * math.log10(np.mean(matrix**2) / np.mean(gap**2))
    for threshold in ("batch", "model"):  # the fitted batch itself: both cut-offs agree
        got = metrics.summarize(model.errors(vectors, threshold=threshold)).first()["snr_db"]
        assert got == pytest.approx(want, abs=1e-4)
    encoded = model.encode(vectors)
    assert np.allclose(rebuilt(model.decode(encoded)), rebuilt(model.reconstruct(vectors)), atol=0)
    rate = model.bit_rate(model.code_rows_of(encoded), vectors).first()
    assert rate["total_bpd"] == pytest.approx(model.measure(vectors).first()["total_bpd"])
    assert rate["total_bpd"] <= max(target, meta + 0.15) + 0.01 and rate["sample_limited"]


def test_batch_cutoffs_depend_on_the_batch(vectors):
    model = LayeredCodec("dual", 64, 3, 3.0).fit(vectors)
    half = vectors.where("label < 5")
    a = model.errors(half, threshold="model").agg(F.sum("noise")).first()[0]
    b = model.errors(half, threshold="batch").agg(F.sum("noise")).first()[0]
    assert a != b


def test_block_codec_and_padding(spark, vectors, matrix):
    odd = vectors.select("vec_id", F.slice("embedding", 1, 60).alias("embedding"))
    x = matrix[:, :60]
    for kind in ("block", "gain16", "dual"):
        model = LayeredCodec(kind, 60, 2, 9.0).fit(odd)
        r = rebuilt(model.decode(model.encode(odd)))
        assert r.shape == x.shape and snr(x, r) > 95
    wide = np.pad(x, ((0, 0), (0, 4))).reshape(len(x), 8, 8)
    res = (wide - wide.mean(2, keepdims=True)) / (wide.std(2, keepdims=True) + 1e-12)
    scale = LayeredCodec("block", 60, 1).fit(odd).scales[0]
    assert scale == pytest.approx(100 / np.sqrt(np.mean(res**2)), rel=1e-9)


def test_constant_and_zero_rows(spark):
    rows = [(0, [0.0] * 16), (1, [2.5] * 16), (2, [float(i) for i in range(16)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    model = LayeredCodec("gain16", 16, 2).fit(df)
    r = rebuilt(model.reconstruct(df))
    assert np.allclose(r, np.array([v for _, v in rows]), atol=1e-3)


@pytest.mark.parametrize("bad", [[1.0] * 15, [float("nan")] * 16, None])
def test_bad_vectors_raise(spark, bad):
    df = spark.createDataFrame([(0, bad)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="vector"):
        LayeredCodec("gain16", 16).fixed([100.0]).encode(df).collect()


def test_too_few_stages():
    for kind in ("sparse", "dual"):
        with pytest.raises(ValueError):
            LayeredCodec(kind, 64, 1).fit(None)


def test_stage_energies_fall(vectors):
    model = LayeredCodec("gain16", 64, 2).fit(vectors)
    e = [r["mean_square"] for r in fit_stage_energies(model, vectors).orderBy("stage").collect()]
    assert e[0] > 1e4 * e[1] > 1e8 * e[2]


@pytest.mark.parametrize("stages,threshold", [(1, 0.95), (3, 0.9), (2, 1.0)])
def test_hot_blocks_match_numpy(vectors, matrix, stages, threshold):
    model = HotBlockCodec(64, stages, threshold).fit(vectors)
    book = e8_codebook()
    m = np.median(matrix, 0)
    md = np.median(np.abs(matrix - m), 0) + 1e-12
    res, out, active = ((matrix - m) / md).reshape(-1, 8), 0, 0
    for _ in range(stages):
        energy = np.mean(res**2, axis=1)
        mask = energy > np.quantile(energy, threshold) if threshold < 1 else np.ones(len(res), bool)
        ids = (res[mask] @ book.T).argmax(1)
        dots = np.einsum("ij,ij->i", res[mask], book[ids])
        lo, hi = np.quantile(dots, [0.001, 0.999])
        span = max(hi - lo, 1e-6)
        level = np.floor(np.clip((dots - lo) / span, 0, 0.9999) * 15) + 1
        res[mask] -= book[ids] * (lo + (level - 0.5) / 15 * span)[:, None]
        active += mask.sum()
    want = matrix - res.reshape(matrix.shape) * md
    coded = model.encode(vectors, threshold="batch")
    assert np.abs(rebuilt(model.decode(coded)) - want).max() < 1e-8
    rate = model.bit_rate(coded).first()
    assert rate["n_hot"] == active
    assert rate["total_bpd"] == pytest.approx((64 + stages * 8 + 12 * active / len(matrix)) / 64)
    assert model.nominal_bpd() == 1 + 1.5 * stages


def test_rate_switch():
    assert rate_switch(64, 5.0) == HotBlockCodec(64, stages=5)
    assert rate_switch(64, 8.0) == LayeredCodec("block", 64, max_stages=2)


def direct_direction(x, stages, bits, reflect, sketch, tail, seed):
    """The direction codec fitted and applied to the same rows, straight in NumPy."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    mirrors = []
    for _ in range(reflect):
        v = rng.standard_normal(dim)
        mirrors.append(v / (np.linalg.norm(v) + 1e-12))
    proj = rng.choice([-1.0, 1.0], size=(sketch, dim)) / math.sqrt(dim) if sketch else None
    y = x.copy()
    for v in mirrors:
        y = y - 2 * np.outer(y @ v, v)
    res, book = y.reshape(len(x), -1, 8), e8_codebook()
    for s in range(stages):
        norms = np.linalg.norm(res, axis=2)
        ids = ((res / norms[:, :, None]) @ book.T).argmax(2)
        logs = np.log(norms)
        lo, hi = np.quantile(logs, 0.002), np.quantile(logs, 0.998)
        hi = max(hi, lo + 1e-3)
        margin = (hi - lo) / (2 * max(1, 2**bits - 1)) if bits else 0.1 * (hi - lo) + 0.05
        lo, hi = lo - margin, hi + margin
        hat = np.zeros_like(norms)
        for b in range(norms.shape[1]):
            n = bit_schedule(norms.shape[1], bits, s)[b]
            if n == 0:
                hat[:, b] = math.exp(logs.mean())
                continue
            levels = 2**n - 1
            code = np.floor(np.clip((logs[:, b] - lo) / (hi - lo), 0, 1 - 1e-12) * levels)
            hat[:, b] = np.exp(lo + (code + 0.5) / levels * (hi - lo))
        res = res - book[ids] * hat[:, :, None]
    flat = res.reshape(x.shape)
    if sketch:
        basis = np.where(flat @ proj.T >= 0, 1.0, -1.0) @ proj / math.sqrt(sketch)
        flat = flat - np.sum(flat * basis) / (np.sum(basis**2) + 1e-12) * basis
    if tail:
        scale, levels = 2 * np.quantile(np.abs(flat), 0.995), 2**tail
        code = np.floor((np.clip(flat / scale, -0.5, 0.5 - 1 / levels) + 0.5) * levels)
        flat = flat - ((code + 0.5) / levels - 0.5) * scale
    for v in reversed(mirrors):
        flat = flat - 2 * np.outer(flat @ v, v)
    return x - flat


@pytest.mark.parametrize(
    "stages,bits,reflect,sketch,tail", [(4, 3.0, 8, 0, 0), (2, 2.5, 8, 4, 2), (2, 0.0, 0, 0, 0), (1, 3.25, 0, 2, 0)]
)
def test_direction_matches_numpy(vectors, matrix, stages, bits, reflect, sketch, tail):
    model = DirectionCodec(
        64, stages, bits, tail, use_rotation=reflect > 0, use_sketch=sketch > 0, sketch_rank=sketch
    ).fit(vectors)
    want = direct_direction(matrix, stages, bits, reflect, sketch, tail, 42)
    got = rebuilt(model.decode(model.encode(vectors)))
    assert snr(matrix, got) == pytest.approx(snr(matrix, want), abs=1e-3)
    assert np.mean(np.abs(got - want) > 1e-6) < 1e-3
    assert model.closure_error(vectors).first()["max_abs"] < 1e-12
    rate = (8 * (stages * math.log2(240) + stages * bits) + tail * 64 + sketch) / 64
    assert model.bits_per_dim() == pytest.approx(rate)


def test_rotation_keeps_norms(matrix):
    model = DirectionCodec(64).blank()
    turned = model.rotate(matrix)
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(matrix, axis=1))
    assert np.allclose(model.rotate(turned, inverse=True), matrix)


def test_bit_schedule():
    assert bit_schedule(8, 2.5, 0).tolist() == [2, 3, 2, 3, 2, 3, 2, 3]
    assert bit_schedule(8, 2.5, 1).tolist() == [3, 2, 3, 2, 3, 2, 3, 2]
    assert bit_schedule(4, 3.0, 2).tolist() == [3] * 4


def test_outlier_scales(vectors, matrix):
    loud = vectors.withColumn(
        "embedding", F.transform("embedding", lambda v, i: v.cast("double") * F.when(i < 8, 30.0).otherwise(1.0))
    )
    blank = DirectionCodec(64, use_rotation=False).blank()
    got = outlier_scales(blank, loud, "embedding")
    x = matrix.copy()
    x[:, :8] *= 30
    top = np.linalg.norm(x.reshape(len(x), 8, 8), axis=2).max(0)
    assert np.allclose(got, scales_from_maxima(top, 4.0)) and got[0] > 1 and got[3] == 1
    codec = DirectionCodec(64, 3, 3.0, use_rotation=False, handle_outliers=True)
    model = codec.fit(loud)
    assert model.block_scales == got
    r = rebuilt(model.decode(model.encode(loud)))
    assert snr(x, r) > 12


def test_scalar_codec(vectors, matrix):
    model = ScalarCodec(64, 3).fit(vectors)
    lo, step = matrix.min(0), matrix.max(0) - matrix.min(0) + 1e-9
    codes = np.clip(np.floor((matrix - lo) / step * 8), 0, 7)
    coded = model.encode(vectors)
    got = np.array([r["codes"] for r in coded.orderBy("vec_id").collect()])
    assert np.array_equal(got, codes)
    assert np.allclose(rebuilt(model.decode(coded)), lo + (codes + 0.5) / 8 * step)
    builtin = model.encode_builtin(vectors)
    assert np.array_equal(np.array([r["codes"] for r in builtin.orderBy("vec_id").collect()]), codes)
    assert np.allclose(rebuilt(model.decode_builtin(builtin)), lo + (codes + 0.5) / 8 * step)


def test_rotated_and_mean_codecs(vectors, matrix):
    r = orthogonal_matrix(64)
    assert np.allclose(r @ r.T, np.eye(64))
    model = RotatedModel(64, 4)
    got = rebuilt(model.decode(model.encode(vectors)))
    assert np.allclose(got, rebuilt(model.reconstruct(vectors)))
    y = matrix @ r
    step = (y.max(1, keepdims=True) - y.min(1, keepdims=True)) / 15
    q = np.rint((y - y.min(1, keepdims=True)) / step)
    err = y - y.min(1, keepdims=True) - q * step
    want = (y.min(1, keepdims=True) + q * step + np.sign(err) * step / 4) @ r.T
    assert np.allclose(got, want)
    means = np.repeat(matrix.reshape(len(matrix), 8, 8).mean(2), 8, axis=1)
    assert np.allclose(rebuilt(BlockMeanModel(64).reconstruct(vectors)), means)


def test_graph_constants():
    assert len(design_blocks()) == 77 and {len(b) for b in design_blocks()} == {6}
    a = adjacency().astype(int)
    assert set(a.sum(0)) == {22} and (a == a.T).all()
    square = a @ a
    off = ~np.eye(100, dtype=bool)
    assert set(square[(a == 1)]) == {0} and set(square[(a == 0) & off]) == {6}
    v = vertices()
    assert v.shape == (100, 22)
    gram = v @ v.T
    assert np.allclose(np.diag(gram), 0.22)
    assert np.allclose(gram[a == 1], -0.08) and np.allclose(gram[(a == 0) & off], 0.02)
    values = np.rint(np.linalg.eigvalsh(a)).astype(int)
    assert dict(zip(*np.unique(values, return_counts=True))) == {-8: 22, 2: 77, 22: 1}


def test_graph_codec(vectors, matrix):
    model = GraphCodec(64, 2).fit(vectors)
    got = rebuilt(model.decode(model.encode(vectors)))
    assert np.allclose(got, rebuilt(model.reconstruct(vectors)))
    x = np.pad(matrix, ((0, 0), (0, 2))).reshape(-1, 22)
    ids = (x @ vertices().T).argmax(1)
    left = x - vertices()[ids]
    lo, step = left.min(0), left.max(0) - left.min(0) + 1e-9
    code = np.clip(np.floor((left - lo) / step * 4), 0, 3)
    want = (vertices()[ids] + lo + (code + 0.5) / 4 * step).reshape(len(matrix), -1)[:, :64]
    assert np.allclose(got, want, atol=1e-9)
    sizes = {22: 51, 64: 153, 768: 1785, 4096: 9537}
    for dim, bits in sizes.items():
        assert GraphCodec(dim, 2) and model.__class__(dim, 2, (), ()).bits_per_vector() == bits
    assert model.overhead_bits() == 0 and round(model.compression_ratio(), 2) == 13.39


def test_models_survive_storage(spark, vectors, tmp_path):
    models = [
        LayeredCodec("dual", 64, 3, 3.0).fit(vectors), HotBlockCodec(64, 1).fit(vectors),
        DirectionCodec(64, 2, 2.0).fit(vectors), ScalarCodec(64).fit(vectors), GraphCodec(64).fit(vectors),
        RotatedModel(64),
    ]
    for i, model in enumerate(models):
        results.save_model(spark, model, f"{tmp_path}/m{i}")
        assert results.load_model(spark, f"{tmp_path}/m{i}") == model


def test_payload_storage(spark, vectors, tmp_path):
    model = LayeredCodec("gain16", 64).fixed([100.0, 30000.0])
    coded = model.encode(vectors)
    results.write_payload(coded, f"{tmp_path}/payload", "smallint")
    stored = spark.read.parquet(f"{tmp_path}/payload")
    assert "smallint" in dict(stored.dtypes)["codes"]
    assert np.allclose(rebuilt(model.decode(stored)), rebuilt(model.reconstruct(vectors)))
    codes = results.code_table(coded, "vec_id", 8)
    results.write_code_table(codes, f"{tmp_path}/codes")
    long = spark.read.parquet(f"{tmp_path}/codes")
    assert long.where("stage = 0").count() == vectors.count() * 8
    sums = results.sum_codes(long, "vec_id", model.scales).where("vec_id = 3 AND chunk_id = 2").first()["x"]
    code = coded.where("vec_id = 3").first()["codes"]
    want = [code[0][16 + i] / 200.0 + code[1][16 + i] / 60000.0 for i in range(8)]
    assert np.allclose(sums, want)
