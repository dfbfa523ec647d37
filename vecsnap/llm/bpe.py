"""Byte-level BPE by a table of distinct words, and decoding by an id-to-piece join.

Spark cuts every text into the tokenizer's words with one regular expression. Each chunk of
documents keeps its words as numbers into the list of its own distinct words; of the words, only
these lists are exchanged. Equal words of all chunks meet in one partition, whose table encodes
each distinct word once; the ids go back to the chunks, which put them at the positions of the
word. Ids become text by a join with the broadcast table of pieces, as large as the vocabulary.

Numbers travel as compressed bytes, seven bits each, the frequent ones in one byte. The row of a
chunk is exchanged once and serves both sides, so a chunk is numbered from one computation.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text;
repeated rows, null ids and ties get a row each; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored. One word of any length is one entry of the table,
so memory is bounded by the larger of a chunk and the longest text, and by the table of a partition.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsnap.llm.common import cut, whole

# Words of a chunk, unless one text has more.
CHUNK_WORDS = 1 << 20
CHUNKED = "chunk long, doc_ids array<long>, counts array<int>, numbers binary, text binary, sizes binary"
DEALT = "bucket int, chunk long, text binary, sizes binary, numbers binary"
PLACED = "home long, numbers binary, sizes binary, ids binary"
# White space as byte-level BPE splits it (fixed values).
SPACES = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LAST_POINT = 0x110000


def _library(content: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=2)
def _word_encoder(content: str):
    """The tokenizer without its word splitting: every input is one word."""
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = _library(content)
    tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


def _runs(points: Iterable[int]) -> list[tuple[int, int]]:
    """Sorted numbers as closed ranges."""
    a = np.fromiter(points, dtype=np.int64)
    cuts = np.flatnonzero(np.diff(a) != 1)
    return list(zip(a[np.r_[0, cuts + 1]].tolist(), a[np.r_[cuts, len(a) - 1]].tolist())) if len(a) else []


def _ranges(points: set[int]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _runs(sorted(points)))


def _library_classes(content: str) -> tuple[set[int], set[int]]:
    """Letters and numbers as the tokenizer sees them, from its cuts of a text of all characters."""
    cut = _library(content).pre_tokenizer.pre_tokenize_str
    text = "".join(map(chr, _all_points()))
    letters, numbers = set(), set()
    for _, (a, b) in cut(text):
        last = text[b - 1]
        for mark, kind in (("a", letters), ("1", numbers)):
            if len(cut(mark + last)) == 1:
                kind.update(ord(c) for c in text[a:b] if c != " ")
    return letters, numbers


def _all_points() -> Iterator[int]:
    return (c for c in range(LAST_POINT) if not 0xD800 <= c < 0xE000)


@functools.lru_cache(maxsize=2)
def _pattern(spark: SparkSession, content: str) -> str:
    """The expression whose matches in a text are the tokenizer's words, one after another.

    Spark's letters and numbers come from another edition of Unicode than the tokenizer's, so both
    are asked for theirs, and the classes state the difference.
    """
    text = F.lit("".join(map(chr, _all_points())))
    classes = []
    for name, wanted in zip(r"\p{L} \p{N}".split(), _library_classes(content)):
        found = spark.range(1).select(F.regexp_extract_all(text, F.lit(f"{name}+"), F.lit(0))).first()[0]
        have = {ord(c) for run in found for c in run}
        more, less = wanted - have, have - wanted
        # Nested, so that the long list is looked at only for characters from its first one on.
        added = f"[\\x{{{min(more):X}}}-\\x{{{LAST_POINT - 1:X}}}&&[{_ranges(more)}]]" if more else ""
        classes.append(f"[{name}{added}]" if not less else f"[[{name}{added}]&&[^{_ranges(less)}]]")
    letter, number = classes
    specials = [t["content"] for t in json.loads(content).get("added_tokens", [])]
    special = "|".join(f"\\Q{s}\\E" for s in sorted(specials, key=len, reverse=True))
    free = f"(?!{special})" if special else ""
    other = f"[^{SPACES}{letter}{number}]"
    solid = f"[^{SPACES}]"
    # Frequent alternatives first; only a special token can share its first character with them.
    shared = any(s[0].isspace() or s[0].isalnum() for s in specials)
    front, back = (f"{special}|", "") if shared else ("", f"{special}|" if special else "")
    return (
        rf"{front}\x20?{letter}+|\x20?{number}+|{back}'(?:[stmd]|re|ve|ll)"
        rf"|\x20?(?:{free}{other})++|[{SPACES}]+(?!{free}{solid})|[{SPACES}]+"
    )


def split_words(spark: SparkSession, text: Column, content: str) -> Column:
    """The tokenizer's words of a text, special tokens as words of their own."""
    return F.regexp_extract_all(text, F.lit(_pattern(spark, content)), F.lit(0))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^28, seven bits a byte, low ones first, the last byte below 128; then compressed."""
    n = np.asarray(numbers, dtype=np.uint32)
    size = 1 + (n >= 1 << 7) + (n >= 1 << 14) + (n >= 1 << 21)
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    at = np.cumsum(size) - size
    for k in range(4):
        has = size > k
        out[at[has] + k] = (n[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return zstandard.compress(out.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of ``pack``."""
    raw = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    out = (raw[starts] & 127).astype(np.int64)
    for k in range(1, 4):
        has = ends - starts >= k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    """Words one after another, compressed, and their packed lengths."""
    return zstandard.compress("".join(words).encode()), pack(np.array([len(w) for w in words]))


def unpack_words(text: bytes, sizes: bytes) -> list[str]:
    """The words of ``pack_words``."""
    whole_text, ends = zstandard.decompress(text).decode(), np.cumsum(unpack(sizes)).tolist()
    return [whole_text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def chunks(docs: DataFrame, content: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """A row per chunk: ids and word counts of its documents, packed word numbers, distinct words.

    Numbers follow the frequency of the words, so frequent ones are short.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            words, ids = batch.column("words"), batch.column("doc_id")
            counts = np.diff(words.offsets.to_numpy())
            for a, b in cut(counts, chunk_words):
                coded = words.slice(a, b - a).flatten().dictionary_encode()
                index = coded.indices.to_numpy()
                order = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                text, sizes = pack_words(coded.dictionary.take(pa.array(order)).to_pylist())
                row = [chunk, ids.slice(a, b - a).to_pylist(), counts[a:b], pack(rank[index]), text, sizes]
                yield _batch(CHUNKED, [[value] for value in row])
                chunk += 1

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), split_words(docs.sparkSession, whole(), content).alias("words")
    )
    # Every reader takes all columns of this exchange, so the plan holds it once.
    return rows.mapInArrow(run, CHUNKED).repartition("chunk")


def _batch(fields: str, columns: list[list]) -> pa.RecordBatch:
    """Columns of Python values as a batch with the names and types of ``fields``."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in fields.split(", ")))
    types = [pa.list_(kinds[t[6:-1]]) if t.startswith("array<") else kinds[t] for t in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))


def words_by_bucket(chunked: DataFrame, buckets: int) -> DataFrame:
    """The distinct words of every chunk, dealt by a checksum of the word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("chunk", "text", "sizes")]
            for chunk, text, sizes in zip(*columns):
                words = unpack_words(text, sizes)
                bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], dtype=np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                parts = [part.tolist() for part in np.split(order, cuts)[1:]]
                packed = [pack_words([words[i] for i in part]) for part in parts]
                steps = [pack(np.diff(part, prepend=0)) for part in parts]
                yield _batch(
                    DEALT, [bucket[order[cuts]], [chunk] * len(parts), [t for t, _ in packed], [n for _, n in packed], steps]
                )

    return chunked.mapInArrow(run, DEALT).repartition(buckets, "bucket")


class WordTable(dict):
    """Ids of words, each encoded once."""

    def __init__(self, content: str):
        super().__init__()
        self.encoder = _word_encoder(content)

    def look_up(self, words: list[str]) -> list[list[int]]:
        new = [w for w in words if w not in self]
        self.update(zip(new, (e.ids for e in self.encoder.encode_batch(new, add_special_tokens=False))))
        return [self[w] for w in words]


def encode_words(dealt: DataFrame, content: str) -> DataFrame:
    """Packed ids of the words of every chunk; each distinct word of a partition is encoded once."""
    shared = dealt.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value)
        for batch in batches:
            ids, sizes = [], []
            for text, lengths in zip(batch.column("text").to_pylist(), batch.column("sizes").to_pylist()):
                found = table.look_up(unpack_words(text, lengths))
                ids.append(pack(np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64)))
                sizes.append(pack(np.fromiter(map(len, found), dtype=np.int64)))
            yield _batch(PLACED, [batch.column("chunk"), batch.column("numbers"), sizes, ids])

    return dealt.mapInArrow(run, PLACED)


def pieces(content: str) -> pa.Array:
    """The bytes of every id, in the order of ids; an id without a piece is null."""
    # The published alphabet of byte-level BPE: printable bytes stand for themselves, others follow 255.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    to_byte = {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(shifted)}}
    vocabulary = _library(content).get_vocab(with_added_tokens=True)
    rows: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        known = all(c in to_byte for c in token)
        rows[i] = bytes(map(to_byte.__getitem__, token)) if known else token.encode()
    return pa.array(rows, pa.large_binary())


def join_pieces(ids: np.ndarray, ends: np.ndarray, table: pa.Array) -> pa.Array:
    """Text of each run of ids: the pieces found by id lie one after another, runs are cut from them."""
    known = pa.array(ids, mask=(ids < 0) | (ids >= len(table)))
    found = table.take(known).fill_null(b"")
    cuts = np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(found) + 1][ends] if len(found) else ends * 0
    raw = memoryview(found.buffers()[2] or b"")
    return pa.array([bytes(raw[a:b]).decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:])], pa.string())


@functools.lru_cache(maxsize=2)
def _pieces(content: str) -> pa.Array:
    return pieces(content)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of every row with ``ids``; null ids and unknown ids give no text.

    The table of pieces is broadcast; its size is that of the vocabulary. Bytes that are no UTF-8
    become replacement characters, as in the library.
    """
    with open(path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())]
            ids = lists.flatten().fill_null(-1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("key"), join_pieces(ids, ends, table)], ["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def encode(docs: DataFrame, path: str, chunk_words: int = CHUNK_WORDS, buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, ``ids``, and ``decoded``, the text that these ids decode to.

    ``path``: the tokenizer's file on the driver; its content goes to the workers once. ``buckets``:
    parts of the table of distinct words; by default the session's number of shuffle partitions.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(content)
    numbered = chunks(docs, content, chunk_words)
    dealt = words_by_bucket(numbered, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def place(docs: pa.Table, words: pa.Table) -> pa.Table:
        row = docs.to_pylist()[0]
        # Numbers are steps from 0 in each row.
        at = [np.cumsum(unpack(x)) for x in words.column("numbers").to_pylist()]
        n = [unpack(x) for x in words.column("sizes").to_pylist()]
        flat = [unpack(x) for x in words.column("ids").to_pylist()]
        at, n, flat = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (at, n, flat))
        sizes, begins = np.zeros((2, len(at)), dtype=np.int64)
        sizes[at], begins[at] = n, np.cumsum(n) - n
        numbers = unpack(row["numbers"])
        n = sizes[numbers]
        before = np.r_[0, np.cumsum(n)]
        # The ids of a word lie in a row: where the word begins, then one further each.
        ids = flat[np.arange(before[-1]) + np.repeat(begins[numbers] - before[:-1], n)].astype(np.int32)
        ends = before[np.r_[0, np.cumsum(row["counts"])]]
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                "decoded": join_pieces(ids, ends, _pieces(shared.value)),
            }
        )

    placed = numbered.groupBy("chunk").cogroup(encode_words(dealt, content).groupBy("home"))
    return placed.applyInArrow(place, "doc_id long, ids array<int>, decoded string")
