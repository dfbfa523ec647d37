"""Vectors as short codes: one codebook per part of the vector, fitted by Lloyd rounds over two trees.

Vectors become whole numbers and are stored once in blocks. For each part, a block holds a balanced
tree over its vectors (halved at the median of the widest dimension), and every round builds one
over the codebook's entries. Both are descended together: boxes of a node pair bound its distances,
so a pair whose least distance exceeds the surest entry's greatest one is dropped. A node with one
entry left is assigned whole, by its cached sum and count; the vectors of leaves with several
entries left are compared with these in whole numbers. A round shuffles one row per task, part and
used entry; the driver holds the codebooks, whose size does not depend on the data.

Defined results: vectors that are null, empty or hold a null or non-finite component are dropped;
so are those whose length does not divide into the parts, and of the rest those of another length
than the one of the smallest id. Null ids come after all others, equal ids by their vectors; repeated
rows count as often as they appear. Numbers beyond 2^26 are taken as 2^26, so that no sum of
squares overflows. A sum of errors beyond a long is null. An empty table gives an empty result;
columns other than the three named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsnap.llm.common import stored

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
BLOCK, LEAF = 8192, 64
LARGEST = 1 << 26
# Up to this size, products and sums of whole numbers are exact as doubles.
EXACT = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """``books[part][entry]`` in whole numbers, and the factor that made them whole."""

    books: np.ndarray
    scale: int

    def digest(self) -> str:
        """SHA-256 of all numbers in decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the order of a balanced tree over n rows, and its end."""
    return n * np.arange((1 << level) + 1) // (1 << level)


def depth(n: int, leaf: int) -> int:
    """Levels below the root, so that leaves hold about ``leaf`` rows and never none."""
    return max(0, int(np.log2(max(1, n // leaf))))


def tree_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in the order of the tree's leaves: every node is halved along its widest dimension."""
    order = np.arange(len(x))
    for level in range(depth(len(x), leaf)):
        cuts = bounds(len(x), level)
        here = x[order]
        widest = np.argmax(np.maximum.reduceat(here, cuts[:-1]) - np.minimum.reduceat(here, cuts[:-1]), axis=1)
        node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        order = order[np.lexsort((here[np.arange(len(x)), widest[node]], node))]
    return order


class Tree:
    """Boxes, sums and counts of all nodes, level by level, over rows in the tree's order."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.cuts = x, [bounds(len(x), level) for level in range(depth(len(x), leaf) + 1)]
        starts = self.cuts[-1][:-1]
        parts = {
            "low": (np.minimum, np.minimum.reduceat(x, starts)),
            "high": (np.maximum, np.maximum.reduceat(x, starts)),
            "sums": (np.add, np.add.reduceat(x, starts)),
        }
        for name, (join, rows) in parts.items():
            levels = [rows]
            for _ in self.cuts[1:]:
                levels.insert(0, join(levels[0][0::2], levels[0][1::2]))
            setattr(self, name, levels)


def assign(tree: Tree, book: np.ndarray, entry_order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of every row (ties to the lower one), and sums and counts by entry."""
    entries = Tree(book[entry_order], 1)
    # Below its leaves, which may hold two entries, the entry tree has a level of single entries.
    single = len(entries.cuts)
    home = np.repeat(np.arange(len(entries.cuts[-1]) - 1), np.diff(entries.cuts[-1]))
    first = np.r_[0, np.cumsum(np.bincount(home))]
    norms = (book * book).sum(axis=1)
    nearest = np.full(len(tree.x), -1, dtype=np.int64)
    sums, counts = np.zeros(book.shape, dtype=tree.x.dtype), np.zeros(len(book), dtype=np.int64)
    q, e = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    at, level = 0, 0
    while True:
        low, high = tree.low[at][q], tree.high[at][q]
        entry_low, entry_high = (entries.x[e],) * 2 if level == single else (entries.low[level][e], entries.high[level][e])
        gap = np.maximum(np.maximum(low - entry_high, entry_low - high), 0)
        reach = np.maximum(high - entry_low, entry_high - low)
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        surest = np.minimum.reduceat((reach * reach).sum(axis=1), starts)
        keep = (gap * gap).sum(axis=1) <= np.repeat(surest, np.diff(np.r_[starts, len(q)]))
        q, e = q[keep], e[keep]
        if level == single:
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            alone = np.diff(np.r_[starts, len(q)]) == 1
            nodes, chosen = q[starts[alone]], entry_order[e[starts[alone]]]
            cuts = tree.cuts[at]
            np.add.at(sums, chosen, tree.sums[at][nodes])
            np.add.at(counts, chosen, cuts[nodes + 1] - cuts[nodes])
            for a, b, c in zip(cuts[nodes].tolist(), cuts[nodes + 1].tolist(), chosen.tolist()):
                nearest[a:b] = c
            left = np.repeat(~alone, np.diff(np.r_[starts, len(q)]))
            q, e = q[left], e[left]
        if not len(q) or (at == len(tree.cuts) - 1 and level == single):
            break
        if level < single:
            if level + 1 < single:
                q, e = np.repeat(q, 2), np.stack([2 * e, 2 * e + 1], axis=1).reshape(-1)
            else:
                n = np.diff(first)[e]
                q, e = np.repeat(q, n), np.arange(n.sum()) + np.repeat(first[e] - np.cumsum(n) + n, n)
            level += 1
        if at < len(tree.cuts) - 1:
            n = np.diff(np.r_[np.flatnonzero(np.r_[True, q[1:] != q[:-1]]), len(q)])
            # Both children of a node take all its entries; pairs stay sorted by node.
            begins = np.repeat(np.cumsum(n) - n, 2)
            lengths = np.repeat(n, 2)
            child = np.repeat(2 * q[np.cumsum(n) - n], 2) + np.tile([0, 1], len(n))
            e = e[np.arange(lengths.sum()) + np.repeat(begins - np.cumsum(lengths) + lengths, lengths)]
            q = np.repeat(child, lengths)
            at += 1
    cuts = tree.cuts[-1]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
    for a, b in zip(starts.tolist(), np.r_[starts[1:], len(q)].tolist()):
        some = np.sort(entry_order[e[a:b]])
        rows = slice(cuts[q[a]], cuts[q[a] + 1])
        nearest[rows] = some[np.argmin(norms[some] - 2 * (tree.x[rows] @ book[some].T), axis=1)]
    if len(q):
        rows = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in q[starts]])
        np.add.at(sums, nearest[rows], tree.x[rows])
        counts += np.bincount(nearest[rows], minlength=len(book))
    return nearest, sums, counts


def blocks(vectors: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """Valid vectors of ``dim`` components as whole numbers, in blocks with the tree order of each part."""
    label = vectors.schema["label"].dataType
    fields = T.StructType(
        [
            T.StructField("vec_ids", T.ArrayType(T.LongType())),
            T.StructField("labels", T.ArrayType(label)),
            T.StructField("numbers", T.ArrayType(T.IntegerType())),
            T.StructField("orders", T.ArrayType(T.IntegerType())),
        ]
    )

    def one(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = part.column("embedding").flatten().to_numpy().astype(np.float64).reshape(part.num_rows, dim)
                x = np.clip(np.floor(x * scale), -LARGEST, LARGEST)
                orders = np.concatenate([tree_order(piece, LEAF) for piece in np.split(x, parts, axis=1)])
                columns = [part.column("vec_id"), part.column("label")]
                columns += [pa.array(v.reshape(-1).astype(np.int32)) for v in (x, orders)]
                yield pa.RecordBatch.from_arrays([one(c) for c in columns], fields.names)

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, fields)


def _parts_of(row: dict, parts: int, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part number, tree order and ordered numbers of a stored block, in a type that stays exact."""
    n = len(row["vec_ids"])
    x = np.asarray(row["numbers"].values).reshape(n, -1)
    small = max(np.abs(x).max(), np.abs(books).max()) <= EXACT
    x = x.astype(np.float64 if small else np.int64)
    for k, (order, piece) in enumerate(zip(np.asarray(row["orders"].values).reshape(parts, n), np.split(x, parts, axis=1))):
        yield k, order, piece[order]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def _lloyd_round(stored_blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries moved to the mean of their parts, rounded down; unused entries stay."""
    parts, entries, width = books.shape
    shared = stored_blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        orders = [tree_order(book, 1) for book in books]
        for row in _rows(batches):
            for k, _, x in _parts_of(row, parts, books):
                _, s, n = assign(Tree(x, LEAF), books[k].astype(x.dtype), orders[k])
                sums[k] += s.astype(np.int64)
                counts[k] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part.astype(np.int32)),
                "entry": pa.array(entry.astype(np.int32)),
                "n": pa.array(counts[part, entry]),
                "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
            }
        )

    partial = stored_blocks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    moved = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        moved[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return moved


@dataclass(frozen=True)
class Fitted:
    """Codebooks and the stored blocks they were fitted on; none where no vector is valid."""

    codebooks: Codebooks | None
    blocks: DataFrame | None


def fit(
    vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE
) -> Fitted:
    """Codebooks of ``vectors`` (vec_id, embedding, label) after some Lloyd rounds.

    They begin with the parts of the ``entries`` smallest ids, the only vectors that reach the driver.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = finite & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    kept = vectors.select("vec_id", "label", "embedding").where(F.coalesce(fits, F.lit(False)))
    order = [F.asc_nulls_last("vec_id"), F.asc("embedding")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return Fitted(None, None)
    dim = len(first[0]["embedding"])
    kept = kept.where(F.size("embedding") == dim)
    start = kept.orderBy(*order).limit(entries).select("embedding").collect()
    x = np.floor(np.array([r[0] for r in start], dtype=np.float64) * scale)
    x = np.clip(x, -LARGEST, LARGEST).astype(np.int64)
    books = np.stack(np.split(x, parts, axis=1))
    cut = stored(blocks(kept, dim, parts, scale), "vector-blocks")
    for _ in range(rounds):
        books = _lloyd_round(cut, books)
    return Fitted(Codebooks(books, scale), cut)


def encode(fitted: Fitted, label: T.DataType) -> DataFrame:
    """Per fitted vector: vec_id, label, ``codes`` (an entry per part) and ``error`` (squared distance)."""
    books = fitted.codebooks.books
    parts = len(books)
    shared = fitted.blocks.sparkSession.sparkContext.broadcast(books)
    fields = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("label", label),
            T.StructField("codes", T.ArrayType(T.IntegerType())),
            T.StructField("error", T.LongType()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        orders = [tree_order(book, 1) for book in books]
        for row in _rows(batches):
            n = len(row["vec_ids"])
            codes, error = np.zeros((n, parts), dtype=np.int32), np.zeros(n, dtype=np.int64)
            for k, order, x in _parts_of(row, parts, books):
                nearest, _, _ = assign(Tree(x, LEAF), books[k].astype(x.dtype), orders[k])
                codes[order, k] = nearest
                error[order] += ((x - books[k][nearest]) ** 2).sum(axis=1).astype(np.int64)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            lists = pa.ListArray.from_arrays(ends, pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [row["vec_ids"].values, row["labels"].values, lists, pa.array(error)], fields.names
            )

    return fitted.blocks.mapInArrow(run, fields)


def decode(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``coded`` with ``rebuilt``, the entries that its ``codes`` name, as fractions again."""
    shared = coded.sparkSession.sparkContext.broadcast(codebooks.books / codebooks.scale)
    fields = T.StructType([*coded.schema.fields, T.StructField("rebuilt", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, _, width = books.shape
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, parts)
            x = books[np.arange(parts), codes].reshape(-1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (parts * width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(x))], fields.names)

    return coded.mapInArrow(run, fields)


def compress(
    vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Per valid vector: vec_id, codes, error, label_error and codebooks_sha256.

    ``label_error`` is the error of all vectors of equal label, null labels together. It is summed
    before it meets the rows, so a frequent label is no task of its own.
    """
    label = vectors.schema["label"].dataType
    fitted = fit(vectors, entries, parts, rounds, scale)
    if fitted.codebooks is None:
        fields = "vec_id long, codes array<int>, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], fields)
    coded = stored(encode(fitted, label), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    rows = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return rows.select("vec_id", "codes", "error", "label_error", F.lit(fitted.codebooks.digest()).alias("codebooks_sha256"))
