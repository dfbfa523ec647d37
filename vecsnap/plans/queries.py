"""The named queries: each reads whole driver tables and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsnap.codecs.direction import DirectionCodec, outlier_scales
from vecsnap.codecs.graphcode import GraphCodec
from vecsnap.codecs.hotblock import HotBlockCodec, robust_scale
from vecsnap.codecs.layered import LayeredCodec, fit_stage_energies
from vecsnap.codecs.layered import rate_switch as layered_switch
from vecsnap.codecs.scalar import (
    BlockMeanModel, RotatedModel, ScalarCodec, row_standard_lattice, weight_table_lattice,
)
from vecsnap.functions import arrays as A
from vecsnap.functions import bits, lattice
from vecsnap.operators import cells, entropy, graph, memory, metrics, sampling, search, sets, spectrum, subspace
from vecsnap.operators.quantiles import exact_quantiles
from vecsnap.operators.refit import RefitStore, refit_robust_scale
from vecsnap.operators.running import running_totals
from vecsnap.plans import experiments as X
from vecsnap.session import checkpoint_dir
from vecsnap.sources import results, vectors
from vecsnap.streaming import jobs, keyed

DIM = 64


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*cols) if cols else df


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings", "vec_id", "embedding", "label")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Only what a per-label report reads: Python passes keep every column they are given."""
    return table(spark, sf, "embeddings", "embedding", "label")


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round the double columns, so results do not depend on summation order."""
    names = names or tuple(c for c, t in df.dtypes if t == "double")
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def fidelity(errors: DataFrame, by: list[str], **kw) -> DataFrame:
    return rounded(metrics.summarize(errors, by, **kw).select(*by, "n_vectors", "snr_db", "cosine"))


# -- sources and reshaping ------------------------------------------------------


def word_vectors(spark, sf):
    """Parse word-vector lines mixed with ordinary prose; only well-formed lines survive."""
    number = lambda v: F.rint(v.cast("double") * 1000000).cast("bigint").cast("string")
    lines = emb(spark, sf).select(
        F.lit("vector").alias("kind"),
        F.concat(
            F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "),
            F.array_join(F.transform("embedding", number), " "),
        ).alias("text"),
    )
    prose = table(spark, sf, "documents", "text").select(F.lit("prose").alias("kind"), "text")
    both = lines.unionByName(prose)
    parsed = vectors.parse_word_vectors(both, "text", DIM)
    good = parsed.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_parsed"),
        F.sum(A.total("embedding")).cast("bigint").alias("value_sum"),
        F.count_distinct("word").alias("n_words"),
    )
    seen = both.groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return seen.join(good, "kind", "left").select(
        "kind", "n_lines", zero("n_parsed"), zero("value_sum"), zero("n_words")
    )


def valid_vectors(spark, sf):
    """Usable and rejected vectors per label; some labels are cut or given a NULL element."""
    spoiled = (
        F.when(F.col("label") == 0, F.slice("embedding", 1, DIM - 1))
        .when(F.col("label") == 1, F.transform("embedding", lambda v: F.when(v > 0, v)))
        .when(F.col("label") == 2, F.lit(None))
        .otherwise(F.col("embedding"))
    )
    df = emb(spark, sf).withColumn("embedding", spoiled)
    return df.groupBy("label").agg(
        F.count_if(vectors.is_valid(DIM)).alias("n_valid"), F.count_if(~vectors.is_valid(DIM)).alias("n_rejected")
    )


def kv_cache_layout(spark, sf):
    """Vectors as a cache (layer = label), cut to a sequence length per layer, per role."""
    cache = vectors.cache_from_labels(emb(spark, sf))
    lengths = cache.groupBy("layer").agg((F.floor(F.count(F.lit(1)) / 2) + F.col("layer")).alias("seq_len"))
    kept = vectors.valid_tokens(cache, lengths, ["layer"])
    first = F.col("embedding")[0].cast("double")
    return rounded(
        kept.groupBy("role", "layer").agg(
            F.count(F.lit(1)).alias("n_tokens"), F.max("pos").alias("last_pos"),
            F.sum("vec_id").alias("id_sum"), F.sum(first * (F.col("pos") + 1)).alias("weighted"),
        )
    )


def cache_flatten(spark, sf):
    """Nested (layer, batch, head, position, value) tensors to one row per vector."""
    nested = F.array(F.array(F.array(A.chunk("embedding", DIM, 16))))  # 1 x 1 x 1 x 4 x 16
    flat = vectors.flatten_cache(emb(spark, sf).withColumn("tensor", nested), "tensor", ["vec_id"])
    return rounded(
        flat.groupBy("layer", "batch", "head", "pos").agg(
            F.count(F.lit(1)).alias("n_vectors"), F.sum(A.total("embedding")).alias("value_sum")
        )
    )


def chunk_blocks(spark, sf):
    """Pad to 22-blocks, split, regroup and crop back: block sums and the round trip."""
    df = emb(spark, sf).select("vec_id", A.vec("embedding").alias("v"), A.chunk("embedding", DIM, 22).alias("c"))
    df = df.withColumn("same", (A.unchunk("c", DIM) == F.col("v")).cast("int"))
    long = df.select("vec_id", "same", F.posexplode("c").alias("chunk_id", "x"))
    return rounded(
        long.groupBy("chunk_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_same"), F.sum(F.size("x")).alias("n_values"),
            F.sum(A.total("x") * (F.col("chunk_id") + 1)).alias("block_sum"),
        )
    )


# -- statistics -------------------------------------------------------------------


def dim_median_mad(spark, sf):
    df = emb(spark, sf)
    center, spread = robust_scale(df, "embedding", df.count())
    rows = [(i, c, s) for i, (c, s) in enumerate(zip(center, spread))]
    return rounded(spark.createDataFrame(rows, "pos int, center double, spread double"), 9)


def _appended(spark, name: str, df: DataFrame, order: str, value: str, group) -> RefitStore:
    """A store of the table's values, filled by two appends in order of a number."""
    store = RefitStore(spark, _scratch(spark, name), slices=48)
    middle = df.agg((F.min(order) + F.max(order)) / 2).first()[0]
    for half in (F.col(order) <= middle, F.col(order) > middle):
        store.append(df.where(half), value, group)
    return store


def refit_median_mad(spark, sf):
    """Median and deviation of every dimension, refitted from slices after an append."""
    long = emb(spark, sf).select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    center, spread = refit_robust_scale(_appended(spark, "refit", long, "vec_id", "v", "pos"))
    rows = [(i, c, s) for i, (c, s) in enumerate(zip(center, spread))]
    return rounded(spark.createDataFrame(rows, "pos int, center double, spread double"), 9)


def refit_price_quantiles(spark, sf):
    """Price quantiles per return flag, refitted after an append that a third of the rows at most are read for."""
    df = table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", "l_returnflag")
    store = _appended(spark, "refit", df, "l_orderkey", "l_extendedprice", F.ascii("l_returnflag"))
    found = store.quantiles([0.001, 0.5, 0.999])
    few = store.reads.rows * 3 < store.held().rows
    rows = [(chr(g), *q, few) for g, q in found.items()]
    facts = store.moments().select(F.char("grp").alias("l_returnflag"), "n", "mean")
    out = spark.createDataFrame(rows, "l_returnflag string, q001 double, q500 double, q999 double, read_few boolean")
    return rounded(out.join(facts, "l_returnflag"), 4)


def order_price_quantiles(spark, sf):
    df = table(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    q = exact_quantiles(
        df, "o_totalprice", [0.001, 0.25, 0.5, 0.999], ["o_orderpriority"], max_rows=df.count()
    )
    rows = [(k[0], *v) for k, v in q.items()]
    ddl = "o_orderpriority string, q001 double, q250 double, q500 double, q999 double"
    return rounded(spark.createDataFrame(rows, ddl), 4)


def dim_extremes(spark, sf):
    long = emb(spark, sf).select(F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return rounded(
        long.groupBy("pos").agg(
            F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("dev")
        ), 9,
    )


def block_moments(spark, sf):
    """Mean and deviation of 8-blocks, summed per block position."""
    df = emb(spark, sf).select("vec_id", F.posexplode(A.chunk("embedding", DIM, 8)).alias("chunk_id", "x"))
    df = df.select("vec_id", "chunk_id", A.mean("x").alias("m"), A.std("x").alias("s"))
    return rounded(
        df.groupBy("chunk_id").agg(
            F.sum("m").alias("mean_sum"), F.sum("s").alias("dev_sum"), F.max("s").alias("dev_max")
        )
    )


def gain_moments(spark, sf):
    """Row mean/deviation, then gains of 16- and 32-blocks of the standardized row."""
    df = emb(spark, sf).select("vec_id", "label", A.vec("embedding").alias("v"))
    df = df.select("vec_id", "label", "v", A.mean("v").alias("gm"), (A.std("v") + 1e-12).alias("gs"))
    z = F.transform("v", lambda t: (t - F.col("gm")) / F.col("gs"))
    df = df.select("vec_id", "label", "gm", "gs", z.alias("z"))
    sums = [F.sum("gm").alias("mean_sum"), F.sum("gs").alias("dev_sum")]
    for width in (16, 32):
        gains = F.transform(A.chunk("z", DIM, width), lambda b: A.std(b) + 1e-12)
        df = df.withColumn(f"g{width}", A.total(gains))
        sums.append(F.sum(f"g{width}").alias(f"gain{width}_sum"))
    return rounded(df.groupBy("label").agg(*sums))


def outlier_block_scales(spark, sf):
    """Largest block norm per position of event-weighted vectors and the robust scale."""
    weight = F.when(F.col("label") == 3, F.lit(5.0)).otherwise(F.lit(1.0))
    loud = F.transform("embedding", lambda v, i: v.cast("double") * F.when(i < 8, weight).otherwise(F.lit(1.0)))
    df = emb(spark, sf).select(loud.alias("embedding"))
    blank = DirectionCodec(DIM, use_rotation=False).blank()
    scales = outlier_scales(blank, df, "embedding", 4.0)
    return rounded(spark.createDataFrame(list(enumerate(scales)), "chunk_id int, scale double"))


# -- lattice and codebooks ------------------------------------------------------------


def e8_snr_by_label(spark, sf):
    model = LayeredCodec("gain16", DIM).fixed([100.0])
    return fidelity(model.errors(labelled(spark, sf)), ["label"])



def e8_codes(spark, sf):
    """Doubled E8 coordinates of every 8-block at scale 10 (Arrow kernel)."""
    df = emb(spark, sf).select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 10.0).alias("v"))
    model = df.select("vec_id", F.posexplode(A.chunk("v", DIM, 8)).alias("chunk_id", "x"))
    lattice.register(spark)
    out = model.withColumn("q", F.call_function("e8_nearest", F.col("x")))
    return out.select("vec_id", "chunk_id", _code_text_doubled("q").alias("code"))


def _code_text_doubled(col: str) -> F.Column:
    return F.array_join(F.transform(col, lambda v: (v * 2).cast("bigint").cast("string")), ",")


def e8_codes_builtin(spark, sf):
    """The same codes with built-in expressions only."""
    df = emb(spark, sf).select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 10.0).alias("v"))
    long = df.select("vec_id", F.posexplode(A.chunk("v", DIM, 8)).alias("chunk_id", "x"))
    return lattice.e8_nearest(long, "x").select("vec_id", "chunk_id", _code_text_doubled("q").alias("code"))


def nearest_codeword(spark, sf):
    return rounded(search.nearest_codeword(emb(spark, sf), "embedding", DIM, ["vec_id"]), 9)


def codeword_decode(spark, sf):
    """Codes joined with the codebook and rebuilt; fidelity per label."""
    df = emb(spark, sf)
    codes = search.nearest_codeword(df, "embedding", DIM, ["vec_id"])
    rebuilt = search.decode_codewords(codes, lattice.codebook_table(spark), "vec_id", DIM)
    return fidelity(metrics.row_errors(df.join(rebuilt, "vec_id")), ["label"])


def row_standard_snr(spark, sf):
    return fidelity(metrics.row_errors(row_standard_lattice(labelled(spark, sf), "embedding", DIM)), ["label"])


def block_mean_snr(spark, sf):
    return fidelity(BlockMeanModel(DIM).errors(labelled(spark, sf)), ["label"])


def scalar_codec(spark, sf):
    """3-bit min-max codec, encoded and decoded with built-in expressions."""
    df = emb(spark, sf)
    model = ScalarCodec(DIM, 3).fit(df)
    both = df.withColumn("kept", F.col("embedding"))
    rebuilt = model.decode(model.encode(both)).withColumnRenamed("kept", "embedding")
    return fidelity(metrics.row_errors(rebuilt), ["label"], floor=0, add=1e-12)


def rotated_codec(spark, sf):
    return fidelity(RotatedModel(DIM, 4).errors(labelled(spark, sf)), ["label"])


def graph_codec(spark, sf):
    """22-dimensional graph codec with a 2-bit residual, per label."""
    df = emb(spark, sf)
    return fidelity(GraphCodec(DIM, 2).fit(df).errors(df), ["label"])


def direction_codes(spark, sf):
    """Single direction stage: codeword, log-norm code, per block position and code."""
    df = emb(spark, sf)
    model = DirectionCodec(DIM, 1, 2.5, use_rotation=False).fit(df)
    code = model.encode(df).select(
        F.posexplode(F.arrays_zip(F.col("ids")[0].alias("id"), F.col("codes")[0].alias("code"))).alias("chunk_id", "z")
    )
    return code.groupBy("chunk_id", F.col("z.code").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("z.id").cast("bigint")).alias("id_sum")
    )


def direction_tail_snr(spark, sf):
    """One direction stage and a 2-bit tail."""
    df = emb(spark, sf)
    model = DirectionCodec(DIM, 1, 2.5, bits_tail=2, use_rotation=False).fit(df)
    return fidelity(model.errors(df), ["label"])


def direction_codec(spark, sf):
    """Four rotated stages with a sign sketch, outlier scales on; fidelity and closure."""
    df = emb(spark, sf)
    model = DirectionCodec(DIM, 4, 2.5, use_sketch=True, sketch_rank=4, handle_outliers=True).fit(df)
    closed = (model.closure_error(df).first()["max_abs"] < 1e-12)
    return fidelity(model.errors(df), ["label"]).withColumn("closed", F.lit(closed))


# -- codecs and rates ---------------------------------------------------------------------


def _rate(model, df, snr: bool = True):
    rate = rounded(model.measure(df))
    one = F.lit(1).alias("_one")
    facts = rounded(metrics.summarize(model.errors(df)).select("snr_db"), 4)
    return rate.withColumn("_one", one).join(facts.withColumn("_one", one), "_one").drop("_one")


def block_codec(spark, sf):
    df = emb(spark, sf)
    return _rate(LayeredCodec("block", DIM, 2).fit(df), df)


def gain16_codec(spark, sf):
    df = emb(spark, sf)
    return _rate(LayeredCodec("gain16", DIM, 2).fit(df), df)


def sparse_codec(spark, sf):
    df = emb(spark, sf)
    return _rate(LayeredCodec("sparse", DIM, 2, 3.0).fit(df), df)


def dual_codec(spark, sf):
    df = emb(spark, sf)
    return _rate(LayeredCodec("dual", DIM, 2, 3.0).fit(df), df)


def dual_codec_deep(spark, sf):
    """Two dense base stages and pulsed refinement with four more, at 5 bits per dimension."""
    df = emb(spark, sf)
    return _rate(LayeredCodec("dual", DIM, 6, 5.0).fit(df), df)


def code_entropy(spark, sf):
    """Plug-in entropy of coarse codes (scale 1), where codes repeat."""
    df = emb(spark, sf)
    return rounded(entropy.code_entropy(LayeredCodec("gain16", DIM).fixed([1.0]).code_rows(df)))


def quick_entropy(spark, sf):
    """Entropy of the words of all events' properties and values, sampled by hash, against the exact one."""
    ev = table(spark, sf, "events", "user_id", "event_type", "value").select(
        F.concat_ws("/", "user_id", "event_type", F.floor("value")).alias("code")
    )
    quick = entropy.quick_entropy(ev, ["code"], sample_codes=512)
    counts = ev.groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("c"))
    exact = counts.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    exact = exact.select((F.log2("n") - F.col("s") / F.col("n")).alias("exact_bits"), F.lit(1).alias("one"))
    out = quick.withColumn("one", F.lit(1)).join(exact, "one")
    within = F.abs(F.col("entropy_bits") - F.col("exact_bits")) <= F.col("error_bits") + 1e-9
    return rounded(out.select("n_codes", "exact_bits", within.alias("inside"), (F.col("error_bits") < 0.5).alias("useful")))


def stage_residuals(spark, sf):
    model = LayeredCodec("gain16", DIM, 2).fit(emb(spark, sf))
    out = fit_stage_energies(model, emb(spark, sf))
    return out.select("stage", F.round(10 * F.log10("mean_square"), 6).alias("residual_db"))


def payload_sums(spark, sf):
    """Long code table of two stages, dequantized by ``sum(code / scale)`` per block."""
    model = LayeredCodec("gain16", DIM).fixed([100.0, 30000.0])
    codes = results.code_table(model.encode(emb(spark, sf)), "vec_id", model.blocks)
    blocks = results.sum_codes(codes, "vec_id", model.scales)
    return rounded(
        blocks.groupBy("chunk_id").agg(
            F.sum(A.sum_squares("x")).alias("energy"), F.sum(A.total("x")).alias("value_sum")
        )
    )


def hot_chunks(spark, sf):
    """Blocks above the 95 % energy quantile and in the densest quarter, per position."""
    df = emb(spark, sf)
    long = df.select(F.posexplode(A.chunk("embedding", DIM, 8)).alias("chunk_id", "x"))
    energy = long.select("chunk_id", (A.sum_squares("x") / 8).alias("energy"))
    hot, dense = exact_quantiles(energy, "energy", [0.95, 0.75], max_rows=df.count() * 8)[()]
    return energy.groupBy("chunk_id").agg(
        F.count_if(F.col("energy") > hot).alias("n_hot"), F.count_if(F.col("energy") >= dense).alias("n_dense")
    )


def hotblock_codes(spark, sf):
    """First stage of the masked codec: hot blocks by level with their codeword ids."""
    df = emb(spark, sf)
    coded = HotBlockCodec(DIM, 1, 0.95).fit(df).encode(df)
    long = coded.select(F.posexplode(F.col("ids")[0]).alias("chunk_id", "id"), F.col("levels")[0].alias("l"))
    long = long.select("chunk_id", "id", F.col("l")[F.col("chunk_id")].alias("level")).where("id IS NOT NULL")
    return long.groupBy("chunk_id", F.col("level").cast("int").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("bigint")).alias("id_sum")
    )


def hotblock_codec(spark, sf):
    """Dense two-stage masked codec: rate and fidelity."""
    df = emb(spark, sf)
    model = HotBlockCodec(DIM, 2, 1.0).fit(df)
    one = F.lit(1).alias("_one")
    facts = metrics.summarize(model.errors(df)).select("snr_db", "cosine").withColumn("_one", one)
    return rounded(model.measure(df).withColumn("_one", one).join(facts, "_one").drop("_one"))


# -- retrieval -------------------------------------------------------------------------------


def _rebuilt(spark, sf):
    df = emb(spark, sf)
    return ScalarCodec(DIM, 3).fit(df).reconstruct(df)


def _probes(df: DataFrame) -> DataFrame:
    """Mean vector of every label, as queries."""
    long = df.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = long.groupBy("label", "pos").agg(F.avg("v").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(F.col("label").cast("bigint").alias("q_id")).agg(
        F.transform(ordered, lambda s: s["m"]).alias("q_vec")
    )


def knn_of_label_means(spark, sf):
    df = emb(spark, sf)
    return rounded(search.nearest(_probes(df), df, 10, DIM))


def recall_at_10(spark, sf):
    return search.recall_at_k(_rebuilt(spark, sf), "embedding", "rebuilt", DIM)


def needle_lookup(spark, sf):
    """Every vector looks itself up among the 3-bit reconstructions; hits per label."""
    df = _rebuilt(spark, sf)
    queries = df.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    found = search.find_needles(queries, df.select("vec_id", "rebuilt"), DIM, by_cells=True)
    labels = df.select(F.col("vec_id").alias("q_id"), "label")
    return found.join(labels, "q_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hits")
    )


def knn_of_rebuilt(spark, sf):
    """The three nearest 3-bit reconstructions of every vector, both tables dealt to cells."""
    df = _rebuilt(spark, sf)
    queries = df.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    return rounded(cells.nearest_by_cells(queries, df, 3, DIM, item_vec="rebuilt"))


def cell_search_work(spark, sf):
    """Pairs of vectors and reconstructions, and whether the cells spare some of their distances."""
    df = _rebuilt(spark, sf)
    queries = df.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    work = cells.search_work(queries, df, 1, DIM, item_vec="rebuilt")
    return work.select("n_queries", "n_items", "all_pairs", (F.col("computed") < F.col("all_pairs")).alias("fewer"))


def qk_fidelity(spark, sf):
    df = _rebuilt(spark, sf)
    return rounded(search.score_fidelity(_probes(df), df, "embedding", "rebuilt", DIM), 9)


CAPACITY = 64


def _event_log(spark, sf):
    ev = table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    op = F.when(F.col("event_type") == "error", "forget").when(F.col("event_type") == "signup", "update").otherwise("store")
    key = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.col("event_id") * i) % 17 - 8) / 10.0)
    return ev.select(
        F.col("event_id").alias("seq"), op.alias("op"),
        F.when(op != "store", F.pmod("user_id", F.lit(CAPACITY))).alias("slot"),
        F.when(op == "store", key).alias("key"),
        F.when(op != "forget", F.array(F.col("value"), F.col("user_id").cast("double"))).alias("value"),
    )


def memory_latest_state(spark, sf):
    """Memory after all event commands: 64-slot ring, updates, forgets."""
    state = memory.build_memory(_event_log(spark, sf), 8, CAPACITY)
    return rounded(
        state.select(
            "slot", "forgotten", "seq", F.col("value")[0].alias("v0"), F.col("value")[1].alias("v1"),
            A.dot("key", F.lit([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])).alias("key_mark"),
        )
    )


def _vector_log(df: DataFrame) -> DataFrame:
    store = df.select(
        (F.col("vec_id") * 2).alias("seq"), F.lit("store").alias("op"), F.lit(None).cast("bigint").alias("slot"),
        A.vec("embedding").alias("key"), F.array(F.col("label").cast("double")).alias("value"),
    )
    forget = df.where("label = 0").select(
        (F.col("vec_id") * 2 + 1).alias("seq"), F.lit("forget").alias("op"),
        F.pmod("vec_id", F.lit(CAPACITY)).alias("slot"),
        F.lit(None).cast("array<double>").alias("key"), F.lit(None).cast("array<double>").alias("value"),
    )
    return store.unionByName(forget)


def memory_retrieve(spark, sf):
    """All vectors query the memory the vectors themselves filled."""
    df = emb(spark, sf)
    state = memory.build_memory(_vector_log(df), DIM, CAPACITY)
    q = df.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    found = search.retrieve(q, state, DIM)
    return rounded(found.select("q_id", "slot", "similarity", F.col("value")[0].alias("v0")))


def _in_parts(df: DataFrame, order: str, parts: int, path: str, which: range) -> None:
    """Some of ``parts`` runs of rows in order of a number, each in a folder of its own."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - low) * parts / (high - low + 1)), F.lit(parts - 1))
    for k in which:
        df.where(part == k).coalesce(1).write.parquet(f"{path}/{k:03d}")


def memory_stream(spark, sf):
    """The event commands in six micro-batches with a restart between them, kept as state by slot."""
    root = _scratch(spark, "memory")
    log = _event_log(spark, sf)
    mem = keyed.KeyedMemory(spark, f"{root}/memory", 8, CAPACITY)
    for which in (range(4), range(4, 6)):
        _in_parts(log, "seq", 6, f"{root}/log", which)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log/*")
        mem.follow(stream, f"{root}/checkpoint")
    return rounded(
        mem.state().select(
            "slot", "forgotten", "seq", F.col("value")[0].alias("v0"), F.col("value")[1].alias("v1"),
            A.dot("key", F.lit([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])).alias("key_mark"),
        )
    )


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; Spark's writers create it, at any kind of path."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def encode_stream(spark, sf):
    """Vectors encoded online with a fixed model, then decoded; fidelity per label."""
    root = _scratch(spark, "encode")
    source = emb(spark, sf).select("vec_id", "label", "embedding", F.col("embedding").alias("kept"))
    source.write.parquet(f"{root}/vectors")
    model = LayeredCodec("gain16", DIM).fixed([100.0])
    stream = spark.readStream.schema(source.schema).parquet(f"{root}/vectors")
    jobs.encode_stream(stream, model, f"{root}/codes", f"{root}/checkpoint").awaitTermination()
    rebuilt = model.decode(spark.read.parquet(f"{root}/codes")).withColumnRenamed("kept", "embedding")
    return fidelity(metrics.row_errors(rebuilt), ["label"])


# -- sets, graphs, windows ----------------------------------------------------------------------


def basket_disjoint_partners(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    return sets.disjoint_partners(li, "l_orderkey", "l_partkey")


def basket_overlap_histogram(spark, sf):
    return sets.overlap_histogram(table(spark, sf, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


def basket_cover_check(spark, sf):
    return sets.cover_check(table(spark, sf, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


def customer_overlaps(spark, sf):
    """Customers by suppliers they buy from, dozens each: how many others share none or some of them."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    return sets.disjoint_partners(rows, "o_custkey", "l_suppkey")


def customer_overlap_histogram(spark, sf):
    """Pairs of customers by how many suppliers they share."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    return sets.overlap_histogram(rows, "o_custkey", "l_suppkey")


def basket_cover_ranges(spark, sf):
    """Triples of parts by how many orders hold them: ranges of ranks, their sum, the longest."""
    ranges = sets.cover_ranges(table(spark, sf, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")
    length = F.col("last") - F.col("first") + 1
    return ranges.groupBy("times").agg(
        F.count(F.lit(1)).alias("n_ranges"), F.sum(length).alias("n_triples"), F.max(length).alias("longest"),
        F.min("first").alias("lowest"), F.max("last").alias("highest"),
    )


def incidence_counts(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    per_item = sets.incidence(li, "l_orderkey", "l_partkey", "item").select(F.lit("item").alias("per"), "n")
    per_set = sets.incidence(li, "l_orderkey", "l_partkey", "set").select(F.lit("set").alias("per"), "n")
    return per_item.unionByName(per_set).groupBy("per", "n").agg(F.count(F.lit(1)).alias("times"))


def order_codewords(spark, sf):
    """GF(2) code words of order keys: weights, and blocks through two fixed points."""
    df = bits.messages(table(spark, sf, "orders", "o_orderkey"), "o_orderkey")
    pts = bits.support(F.col("word"))
    block = F.size(F.array_except(pts, F.lit([0, 1])))
    holds = F.arrays_overlap(pts, F.lit([0])) & F.arrays_overlap(pts, F.lit([1]))
    return df.groupBy("weight").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("word").cast("bigint")).alias("word_sum"),
        F.count_if(holds).alias("n_holding"), F.sum(F.when(holds, block).otherwise(0)).cast("bigint").alias("rest_points"),
    )


def _trade_graph(spark, sf):
    # Suppliers become negative numbers, so that no part and supplier share a vertex.
    lines = table(spark, sf, "lineitem", "l_partkey", "l_suppkey").withColumn("l_suppkey", -F.col("l_suppkey") - 1)
    return graph.undirected(lines, "l_partkey", "l_suppkey")


def common_neighbours(spark, sf):
    """Shared neighbours of every part and the next part in the part-supplier graph."""
    edges = _trade_graph(spark, sf)
    nodes = graph.both_ways(edges).select(F.col("v").alias("a")).distinct()
    pairs = nodes.select("a", (F.col("a") + 1).alias("b"))
    return graph.common_neighbours(edges, pairs)


def graph_degrees(spark, sf):
    return graph.degree_histogram(_trade_graph(spark, sf))


def graph_regularity(spark, sf):
    return rounded(graph.regularity(_trade_graph(spark, sf)))


def neighbour_counts(spark, sf):
    """All pairs of parts and suppliers by adjacency and number of common neighbours."""
    return spectrum.neighbour_histogram(_trade_graph(spark, sf))


def product_values(spark, sf):
    """Inner products of all pairs of vectors at two digits, consecutive vectors apart from the others."""
    df = emb(spark, sf)
    pairs = df.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return spectrum.rounded_products(df, pairs, "vec_id", "embedding", DIM, digits=2)


def graph_spectrum(spark, sf):
    """Eigenvalues of the graph that links every vector to its group of ten consecutive ids."""
    edges = emb(spark, sf).select((-1 - F.floor(F.col("vec_id") / 10)).cast("bigint").alias("a"), F.col("vec_id").alias("b"))
    return spectrum.eigenvalues(edges)


def product_statistics(spark, sf):
    """Inner products of consecutive vectors against all other pairs."""
    df = emb(spark, sf)
    pairs = df.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return rounded(graph.product_statistics(df, pairs, "vec_id", "embedding", DIM))


def energy_rank(spark, sf):
    long = emb(spark, sf).select(F.posexplode("embedding").alias("pos", "v"))
    energy = long.groupBy("pos").agg(F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("energy"))
    out = subspace.energy_rank(energy, "energy", "pos")
    return rounded(out.select("pos", "rank", "share", "cutoff"), 9)


def running_drift(spark, sf):
    """Running sum of event values per user in event order."""
    ev = table(spark, sf, "events", "event_id", "user_id", "value")
    out = running_totals(ev, "event_id", {"drift": F.col("value")}, ["user_id"])
    return rounded(out.select("event_id", "user_id", "drift"), 4)


def drift_by_segment(spark, sf):
    df = emb(spark, sf).withColumn("segment", F.floor(F.col("vec_id") / 100).cast("bigint"))
    model = LayeredCodec("gain16", DIM).fixed([100.0])
    return rounded(jobs.drift_by_segment(model.errors(df), "segment"))


# -- sampling -------------------------------------------------------------------------------------


def sampled_rows(spark, sf):
    """Seeded sample of 100 vectors without replacement."""
    return sampling.hash_sample(emb(spark, sf), "vec_id", 100, 7).select("vec_id", "label")


def shuffled_rows(spark, sf):
    """Position of every vector in a seeded shuffle."""
    df = emb(spark, sf).select("vec_id", F.conv(F.substring(sampling.hash_order("vec_id", 42), 1, 12), 16, 10).cast("bigint").alias("h"))
    return running_totals(df, "h", {"position": F.lit(1).cast("bigint")}).select("vec_id", "position")


def position_split(spark, sf):
    df = sampling.split_by_position(emb(spark, sf), "vec_id")
    return df.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")
    )


def noise_vectors(spark, sf):
    """Seeded normal noise for every vector id: moments per label."""
    df = vectors.gaussian_vectors(emb(spark, sf).select("vec_id", "label"), "vec_id", DIM)
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(A.mean("embedding")).alias("mean"), F.avg(A.std("embedding")).alias("dev")
    )


# -- products, subspace, accounting ---------------------------------------------------------------


def lattice_products(spark, sf):
    """Products of all vectors with a lattice-coded weight table (label means)."""
    df = emb(spark, sf)
    weights = _probes(df).select(F.col("q_id").alias("out_id"), F.col("q_vec").alias("w"))
    coded = weight_table_lattice(weights, "w", DIM)
    out = subspace.multiply(df, coded, DIM)
    long = out.select("label", F.posexplode("y").alias("out_id", "y"))
    return rounded(long.groupBy("label", "out_id").agg(F.sum("y").alias("y_sum")))


def energy_subspace(spark, sf):
    """Singular values of the sketched subspace that holds 90 % of the captured energy."""
    _, s = subspace.energy_subspace(emb(spark, sf), "embedding", DIM, rank=32)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "idx int, singular_value double")


def storage_footprint(spark, sf):
    df = emb(spark, sf).withColumn("role", F.when(F.col("label") < 5, "key").otherwise("value"))
    return rounded(entropy.storage_footprint(df, "embedding", ["role", "label"]))


def cache_sizes(spark, sf):
    """Cache size if the tokens of each language's documents were one context."""
    docs = table(spark, sf, "documents", "lang", "n_chars")
    return rounded(entropy.cache_gigabytes(docs.groupBy("lang").agg(F.sum("n_chars").alias("n_tokens")), "n_tokens"))


def graph_codec_rates(spark, sf):
    """Bits per vector and compression of the graph codec for the stored vector lengths."""
    df = emb(spark, sf).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    df = df.withColumn("residual_bits", F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 4)])))
    n_bits = F.ceil(F.col("dim") / 22) * (7 + 22 * F.col("residual_bits"))
    return rounded(
        df.select(
            "dim", "residual_bits", n_bits.cast("bigint").alias("bits"),
            (32 * F.col("dim") / n_bits).alias("ratio"), (F.col("n") * n_bits).cast("bigint").alias("table_bits"),
        )
    )


# -- experiments ------------------------------------------------------------------------------------


def rate_grid(spark, sf):
    """Feasible configurations for the stored vector length, by role and target rate."""
    df = emb(spark, sf).groupBy(
        F.when(F.col("label") < 5, "key").otherwise("value").alias("role"), F.size("embedding").alias("dim")
    ).agg(F.count(F.lit(1)).alias("n"))
    targets = F.explode(F.array(*[F.lit(t) for t in (2.75, 3.0, 4.0, 6.0)])).alias("target_bpd")
    grid = X.rate_grid(df.select("role", "dim", targets))
    return rounded(grid.select("role", "dim", "target_bpd", "stages", "rotation", "sketch_rank", "norm_bits"))


def rate_search(spark, sf):
    df = emb(spark, sf)
    split = sampling.split_by_position(df, "vec_id")
    train, cal = split.where("part = 'train'"), split.where("part <> 'train'")
    _, ranked = X.search_rate(train, cal, DIM, 3.0, "key", queries=train)
    return ranked.drop("config")


def ablation(spark, sf):
    df = emb(spark, sf)
    out = X.ablation(df, df, DIM, deep=2)
    return rounded(out, 4)


def _trials(df):
    return df.withColumn("trial", F.pmod("vec_id", F.lit(3)).cast("int")).withColumn(
        "train", F.pmod("vec_id", F.lit(5)) < 3
    )


def trial_summary(spark, sf):
    """Single-stage block and 16-gain codecs over three trials."""
    results_ = X.trial_results(
        _trials(emb(spark, sf)), "trial", "train", DIM, ("block", "gain16"), {"block": 1, "gain16": 1}
    )
    return rounded(X.trial_summary(results_), 4)


def trial_comparison(spark, sf):
    """All four layered versions over three trials."""
    return rounded(X.trial_summary(X.trial_results(_trials(emb(spark, sf)), "trial", "train", DIM)), 4)


def tier_pivot(spark, sf):
    """SNR by version and tier for one and two dense stages."""
    got = X.tier_results(emb(spark, sf), DIM, stages={"block": (1, 2, 2), "gain16": (1, 2, 2)}, targets={})
    return rounded(X.tier_pivot(got), 4)


def tier_matrix(spark, sf):
    return rounded(X.tier_results(emb(spark, sf), DIM), 4)


def rate_crossover(spark, sf):
    return rounded(X.winners(X.crossover(emb(spark, sf), DIM)), 4)


def method_table(spark, sf):
    df = emb(spark, sf)
    return rounded(X.method_table(df, df, DIM), 4)


def dimension_sweep(spark, sf):
    return rounded(X.dimension_sweep(emb(spark, sf), (8, 22, 64)), 4)


def perplexity_delta(spark, sf):
    """Perplexity per event type and user half, taking scaled values as token losses."""
    ev = table(spark, sf, "events", "event_type", "user_id", "value")
    losses = ev.select(
        F.col("event_type").alias("model"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "base").otherwise("coded").alias("variant"),
        (F.col("value") / 100).alias("token_loss"),
    )
    return rounded(metrics.perplexity_delta(losses, "model", "variant", "token_loss", "base"))


# -- storage round trips and reports -----------------------------------------------------------------


def stored_payload(spark, sf):
    """Payload and model written to storage, read back and decoded; fidelity per label."""
    root = _scratch(spark, "payload")
    model = LayeredCodec("gain16", DIM).fixed([100.0])
    kept = labelled(spark, sf).withColumn("kept", F.col("embedding"))
    results.write_payload(model.encode(kept), f"{root}/codes")
    results.save_model(spark, model, f"{root}/model")
    again = results.load_model(spark, f"{root}/model")
    rebuilt = again.decode(spark.read.parquet(f"{root}/codes")).withColumnRenamed("kept", "embedding")
    return fidelity(metrics.row_errors(rebuilt), ["label"])


def stored_codes(spark, sf):
    """The long code table written by stage; a partial decode reads the first stage alone."""
    root = _scratch(spark, "codes")
    model = LayeredCodec("gain16", DIM).fixed([100.0, 30000.0])
    results.write_code_table(results.code_table(model.encode(emb(spark, sf)), "vec_id", DIM // 8), root)
    sums = results.sum_codes(spark.read.parquet(root).where("stage = 0"), "vec_id", (100.0, 30000.0))
    return rounded(
        sums.groupBy("chunk_id").agg(
            F.sum(A.sum_squares("x")).alias("energy"), F.sum(A.total("x")).alias("value_sum")
        )
    )


def stored_cache(spark, sf):
    """Cache and description written and read again: the keys of every layer."""
    root = _scratch(spark, "cache")
    vectors.write_cache(vectors.cache_from_labels(emb(spark, sf)), root, "any", "none")
    meta = vectors.read_cache_metadata(spark, root).select("num_layers", "dtype", F.col("keys_shape")[4].alias("dim"))
    first = F.col("embedding")[0].cast("double")
    keys = vectors.read_cache(spark, root, "key").groupBy(F.col("layer").cast("int").alias("layer")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(first * (F.col("pos") + 1)).alias("weighted")
    )
    return rounded(keys.join(F.broadcast(meta), how="cross"))  # one row of description


def result_records(spark, sf):
    """Fidelity per label at two scales as result records: written, read, and named by status."""
    root = _scratch(spark, "records")
    rows = None
    for tier, scale in (("coarse", 1.0), ("fine", 100.0)):
        facts = metrics.summarize(LayeredCodec("gain16", DIM).fixed([scale]).errors(labelled(spark, sf)), ["label"])
        part = facts.select(
            F.concat(F.lit("label "), F.col("label")).alias("Model"), F.lit("gain16").alias("Version"),
            F.lit(tier).alias("Tier"), F.lit(3.0).alias("BPD"), F.col("snr_db").alias("SNR"),
        )
        rows = part if rows is None else rows.unionByName(part)
    results.write_results(rows, root)
    read = results.read_results(spark, root).withColumn("status", metrics.status(F.col("SNR")))
    return rounded(read.select("Model", "Version", "Tier", "BPD", "SNR", "status", F.col("Base PPL").alias("base_ppl")))


def fidelity_report(spark, sf):
    """Every metric of a one-stage codec per label."""
    errors = LayeredCodec("gain16", DIM).fixed([100.0]).errors(labelled(spark, sf))
    return rounded(metrics.summarize(errors, ["label"]), 9)


def largest_difference(spark, sf):
    """Largest element difference between vectors and their reconstruction, joined by id."""
    df = emb(spark, sf)
    rebuilt = LayeredCodec("gain16", DIM).fixed([100.0]).reconstruct(df.select("vec_id", "embedding"))
    return rounded(metrics.max_difference(rebuilt, df.select("vec_id", F.col("embedding").alias("rebuilt")), "vec_id", "rebuilt"), 9)


def rate_switch(spark, sf):
    """The codec chosen on either side of 5.5 bits per dimension, and its fidelity."""
    df, rows = emb(spark, sf), None
    for target in (5.0, 5.5, 7.0):
        codec = layered_switch(DIM, target)
        kind = "block" if isinstance(codec, LayeredCodec) else "hotblock"
        facts = metrics.summarize(codec.fit(df).errors(df)).select(
            F.lit(target).alias("target_bpd"), F.lit(kind).alias("version"), "n_vectors", "snr_db"
        )
        rows = facts if rows is None else rows.unionByName(facts)
    return rounded(rows, 4)


def direction_rates(spark, sf):
    """Stored bits of every label's vectors under the direction codec and the rotated codec."""
    model = DirectionCodec(DIM, 4, 2.5, use_sketch=True, sketch_rank=4).blank()
    values = F.sum(F.size("embedding"))
    out = labelled(spark, sf).groupBy("label").agg(
        (values * model.bits_per_dim()).alias("effective_bits"),
        (values * model.bits_per_dim(raw=True)).alias("raw_bits"),
        (values * entropy.rotated_bpd(DIM, 4)).alias("rotated_bits"),
    )
    return rounded(out, 3)


def first_words(spark, sf):
    """The first 300 lines of a stored word-vector file."""
    root = _scratch(spark, "words")
    df = emb(spark, sf).orderBy("vec_id").select(F.concat(F.lit("w"), F.col("vec_id")).alias("word"), "embedding")
    vectors.write_word_vectors(df, root, "word", "embedding")
    read = vectors.read_word_vectors(spark, root, DIM, 300)
    return rounded(
        read.agg(
            F.count(F.lit(1)).alias("n_words"), F.max(F.substring("word", 2, 20).cast("bigint")).alias("last_id"),
            F.sum(A.total("embedding")).alias("value_sum"),
        ), 5,
    )


def sparse_codec_batch(spark, sf):
    """Fitted on the even ids; both halves are coded, each with the cut-off of its own energies."""
    df, out = emb(spark, sf), None
    model = LayeredCodec("sparse", DIM, 2, 3.0).fit(df.where("vec_id % 2 = 0"))
    for half in (0, 1):
        batch = df.where(F.col("vec_id") % 2 == half)
        rate = _rate(model.with_batch_cutoffs(batch, "embedding"), batch).withColumn("half", F.lit(half))
        out = rate if out is None else out.unionByName(rate)
    return out


def deep_codecs(spark, sf):
    """Up to four block and eight gain stages on all rows; fitting stops where nothing is left."""
    df, rows = emb(spark, sf), None
    for kind, stages in (("block", 4), ("gain16", 8)):
        model = LayeredCodec(kind, DIM, stages).fit(df)
        facts = metrics.summarize(model.errors(df)).select(
            F.lit(kind).alias("version"), F.lit(len(model.scales)).alias("stages"), "n_vectors", "snr_db"
        )
        rows = facts if rows is None else rows.unionByName(facts)
    return rounded(rows, 2)


def drift_stream(spark, sf):
    """SNR per segment of a hundred vectors that arrive in seven micro-batches, against the first one.

    ``median_near``: the sketch's median stands within 3 % of the middle rank of the segment.
    """
    root = _scratch(spark, "drift")
    df = emb(spark, sf)
    model = LayeredCodec("gain16", DIM).fixed([100.0])
    segment = F.floor(F.col("vec_id") / 100).cast("bigint")
    _in_parts(df, "vec_id", 7, f"{root}/vectors", range(7))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/vectors/*")
    keyed.drift_stream(stream, model, segment, f"{root}/facts", f"{root}/checkpoint").awaitTermination()
    facts = keyed.read_drift(spark, f"{root}/facts")
    rows = model.errors(df.select(segment.alias("segment"), "embedding"))
    row_snr = metrics.snr_db(F.col("signal"), F.col("noise"), F.col("n_values"))
    rank = F.avg((row_snr <= F.col("median_row_snr")).cast("double"))
    near = rows.join(facts.select("segment", "median_row_snr"), "segment").groupBy("segment").agg(rank.alias("rank"))
    out = facts.join(near, "segment").withColumn("median_near", F.abs(F.col("rank") - 0.5) <= 0.03)
    return rounded(out.select("segment", "n_vectors", "snr_db", "drift_db", "median_near"))


QUERIES = {
    f.__name__: f
    for f in (
        e8_snr_by_label, word_vectors, valid_vectors, kv_cache_layout, cache_flatten, chunk_blocks,
        dim_median_mad, refit_median_mad, refit_price_quantiles, order_price_quantiles, dim_extremes, block_moments, gain_moments,
        outlier_block_scales, e8_codes, e8_codes_builtin, nearest_codeword, codeword_decode,
        row_standard_snr, block_mean_snr, scalar_codec, rotated_codec, graph_codec,
        direction_codes, direction_tail_snr, direction_codec,
        block_codec, gain16_codec, sparse_codec, dual_codec, dual_codec_deep, code_entropy, quick_entropy,
        stage_residuals, payload_sums, hot_chunks, hotblock_codes, hotblock_codec,
        knn_of_label_means, recall_at_10, needle_lookup, knn_of_rebuilt, cell_search_work, qk_fidelity,
        memory_latest_state, memory_retrieve, memory_stream, encode_stream,
        basket_disjoint_partners, basket_overlap_histogram, basket_cover_check, customer_overlaps,
        customer_overlap_histogram, basket_cover_ranges, incidence_counts,
        order_codewords, common_neighbours, graph_degrees, graph_regularity, neighbour_counts, product_values,
        graph_spectrum, product_statistics,
        energy_rank, running_drift, drift_by_segment,
        sampled_rows, shuffled_rows, position_split, noise_vectors,
        lattice_products, energy_subspace, storage_footprint, cache_sizes, graph_codec_rates,
        rate_grid, rate_search, ablation, trial_summary, trial_comparison, tier_pivot, tier_matrix,
        rate_crossover, method_table, dimension_sweep, perplexity_delta,
        stored_payload, stored_codes, stored_cache, result_records, fidelity_report, largest_difference,
        rate_switch, direction_rates, first_words, sparse_codec_batch, deep_codecs, drift_stream,
    )
}
