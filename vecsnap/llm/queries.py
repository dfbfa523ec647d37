"""The named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsnap.llm import (
    bpe,
    exact,
    jaccard,
    licenses,
    mixing,
    periodic,
    pieces,
    quality,
    secrets,
    sharding,
    substrings,
    tokencount,
    vectorcodes,
)
from vecsnap.llm.common import let, whole, words
from vecsnap.llm.oracle import oracle_sql  # noqa: F401


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark, sf):
    """Words each document gives to a mix of 150 % of all words, in training order."""
    mixed = mixing.mix(documents(spark, sf).select("doc_id", "text", "source"))
    first = F.get("positions", F.lit(0)).alias("first_position")
    second = F.get("positions", F.lit(1)).alias("next_position")
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", first, second)
    return rows.orderBy("first_position", "doc_id")


def op2_jaccard(spark, sf):
    """Component of every document under links of 0.8 between sets of five-word shingles."""
    rows = jaccard.similar(documents(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op3_licenses(spark, sf):
    """License statements of every document with their wording differences."""
    return licenses.scan(documents(spark, sf))


def op4_shards(spark, sf):
    """24 shards of near equal bytes."""
    return sharding.shard(documents(spark, sf), 24)


def op5_token_counts(spark, sf):
    """Tokens of every document, and whether they exceed 4,096."""
    return tokencount.count_tokens(documents(spark, sf), model_path())


def op6_substrings(spark, sf):
    """Passages of 50 words and more that repeat across documents."""
    return substrings.repeated_passages(documents(spark, sf).select("doc_id", "text"))


def op7_exact_dedup(spark, sf):
    """Groups of equal texts; the largest id stays."""
    rows = exact.exact_groups(documents(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_secrets(spark, sf):
    """Secrets per document, the wider kinds where their owners show them to be live."""
    return secrets.scan(documents(spark, sf).select("doc_id", "text", "source"))


def op9_piece_codec(spark, sf):
    """Digests of the ids of every text and of the text decoded from them."""
    return pieces.encode(documents(spark, sf), model_path(), with_ids=False)


def op10_quality(spark, sf):
    """Features, base rules and the verdict of the rules under weak supervision."""
    rows = quality.judge(documents(spark, sf).select("doc_id", "text"), keep_text=False)
    names = ["doc_id", *quality.FEATURES, "base_failed", "p_good", "kept"]
    return rows.select(*names)


def op11_bpe_codec(spark, sf):
    """Digests of the ids of every text and of the text decoded from them."""
    rows = bpe.encode(documents(spark, sf), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``words``, the words of one document in ten made periodic from some word on.

    With h the checksum of the id and g = floor(h / 10), word i >= a = g % n of such a document
    becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id alters nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def alter(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        periodic_words = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p)))
        return F.when((h % 10 == 0) & (n > 0), periodic_words).otherwise(w)

    return docs.select("doc_id", let(words(whole()), alter).alias("words"))


def op12_periodic_runs(spark, sf):
    """Runs of repeated words per document, the strongest of them, and the text without repetitions."""
    rows = periodic.find_runs(planted_periods(documents(spark, sf)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = periodic.strongest()
    return rows.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark, sf):
    """Four bytes per vector from four codebooks, its error and that of its label."""
    rows = vectorcodes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return rows.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_jaccard": op2_jaccard,
    "op3_licenses": op3_licenses,
    "op4_shards": op4_shards,
    "op5_token_counts": op5_token_counts,
    "op6_substrings": op6_substrings,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secrets": op8_secrets,
    "op9_piece_codec": op9_piece_codec,
    "op10_quality": op10_quality,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

