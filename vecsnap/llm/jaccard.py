"""N-gram Jaccard join in the metric space of shingle sets: exact links of 0.8 and more.

Distance is one minus the Jaccard similarity. Nearly all pairs of texts share nothing and lie at
distance 1, where no document can serve as a pivot; so the first level uses single shingles as
pivots. Among the rarest shingles of two linked texts (its first ``n - ceil(0.8 n) + 1`` in one
global order) one is common, so replicating a text to those pivots' cells loses no link, and cells
that share a text form a region. Within a region documents are the pivots: each text goes to its
nearest pivot's cell and, by the triangle inequality, to every cell whose pivot is at most twice
the radius farther (a boundary text), and cells are joined recursively. Cells whose texts are
already connected need no further look; cells that pivots cannot divide are compared directly, but
only the texts outside the largest connected part against all others. These two shortcuts serve
components only; where links are asked for, every link is computed, inside connected parts too.

Regions of up to ``REGION_DOCS`` distinct sets are joined in one task; larger ones are divided by
the same rule as Spark jobs, over chunks of their texts.

Defined results: a null text counts as empty; texts without words have no shingle and no link;
equal sets are linked; a component's id is its smallest non-null doc_id (null if all are null);
repeated rows get the same result each; an empty table gives an empty result. Other columns are
ignored by ``similar`` and kept by ``one_of_each_group``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import stored, uniform, whole
from vecsnap.llm.components import components
from vecsnap.llm.shingles import mix, shingle_sets

PERCENT = 80
REGION_DOCS = 4096
PIVOTS = 16
# Bits of the tables that order the shingles (16 and 4 MB); the order never changes a result.
MAP_BITS = 27
LEVEL_BITS = 22
# Shingles a task gathers before it deals them out.
FLUSH = 2_000_000


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= PERCENT * (a + b - inter)


class Region:
    """Some shingle sets and their connected parts, joined by pivots; with ``every``, all their links."""

    def __init__(self, sets: list[np.ndarray], every: bool = False):
        self.every = every
        self.met: list[np.ndarray] = []
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.mark = np.zeros(len(values), dtype=bool)
        self.part = np.arange(len(sets))

    def shared(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Size of the intersection of set ``x`` with each of ``rows``."""
        own = self.flat[self.starts[x] : self.starts[x + 1]]
        self.mark[own] = True
        lengths = self.sizes[rows]
        cuts = np.r_[0, np.cumsum(lengths)]
        at = np.repeat(self.starts[rows] - cuts[:-1], lengths) + np.arange(cuts[-1])
        out = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), cuts[:-1])
        self.mark[own] = False
        return out

    def against(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Distances of ``x`` to ``rows``; links join the connected parts."""
        inter = self.shared(x, rows)
        near = rows[linked(inter, self.sizes[x], self.sizes[rows])]
        if self.every:
            self.met.append(np.stack([np.minimum(near, x), np.maximum(near, x)], axis=1))
        parts = np.unique(np.r_[self.part[near], self.part[x]])
        if len(parts) > 1:
            self.part[np.isin(self.part, parts)] = parts[0]
        return 1 - inter / (self.sizes[x] + self.sizes[rows] - inter)

    def join(self, rows: np.ndarray, depth: int = 0) -> None:
        """Find every link among ``rows``, without ``every`` those that connect two parts."""
        if len(rows) < 2 or (not self.every and (self.part[rows] == self.part[rows[0]]).all()):
            return
        if len(rows) > 4 * PIVOTS and depth < 8:
            chosen = rows[np.argsort(mix(rows.astype(np.uint64) + np.uint64(depth * 7919)))[:PIVOTS]]
            distance = np.stack([self.against(int(p), rows) for p in chosen])
            home = distance.min(axis=0)
            slack = 2 * (1 - PERCENT / 100) + 1e-9
            cells = [rows[d <= home + slack] for d in distance]
            if max(map(len, cells)) <= 0.7 * len(rows) and sum(map(len, cells)) <= 3 * len(rows):
                for cell in cells:
                    self.join(cell, depth + 1)
                return
        names, counts = np.unique(self.part[rows], return_counts=True)
        inside = (self.part[rows] == names[counts.argmax()]) & (not self.every)
        outside = rows[~inside]
        for k, x in enumerate(outside.tolist()):
            rest = np.r_[outside[k + 1 :], rows[inside]]
            # A link needs sizes within the threshold, and one that connects a partner in another part.
            least, most = np.minimum(self.sizes[rest], self.sizes[x]), np.maximum(self.sizes[rest], self.sizes[x])
            rest = rest[(100 * least >= PERCENT * most) & (self.every | (self.part[rest] != self.part[x]))]
            if len(rest):
                self.against(x, rest)

    def links(self) -> np.ndarray:
        """The distinct links met, as pairs of rows."""
        pairs = np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *self.met]), axis=0)
        return pairs[pairs[:, 0] != pairs[:, 1]]


def _gaps(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as their gaps, high bytes first and apart, so that a shuffle compresses them."""
    return np.diff(values, prepend=np.uint32(0)).astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_gaps(data: np.ndarray) -> np.ndarray:
    gaps = np.ascontiguousarray(data.reshape(4, -1).T).view(">u4").reshape(-1)
    return np.cumsum(gaps, dtype=np.uint64).astype(np.uint32)


def _shared_shingles(docs: DataFrame, by_gaps: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of shingles that more than one row holds, and rough levels of their frequency.

    Every row's distinct shingles go, as 32-bit prefixes of their hashes, to the task of their
    range; each task returns its slice of both tables, 20 MB in all whatever the input. A clear
    bit proves a shingle to be held once; a set one may be wrong, which costs time only.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(LEVEL_BITS, max(6, (4 * partitions - 1).bit_length()))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held) if held else np.zeros(0, dtype=np.uint32))
            cuts = np.searchsorted(values >> np.uint32(32 - bits), np.arange((1 << bits) + 1))
            used = np.flatnonzero(np.diff(cuts))
            parts = [values[cuts[k] : cuts[k + 1]] for k in used.tolist()]
            blobs = [_gaps(x) if by_gaps else x.tobytes() for x in parts]
            return pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int32()), "held": pa.array(blobs, pa.binary())})

        for batch in batches:
            for _, s in shingle_sets(batch.column("text")):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                waiting += len(s)
                if waiting > FLUSH:
                    yield flush()
                    held, waiting = [], 0
        yield flush()

    def count(group: pa.Table) -> pa.Table:
        number = group["slice"][0].as_py()
        if by_gaps:
            parts = [_from_gaps(np.frombuffer(x.as_buffer(), dtype=np.uint8)) for x in group["held"]]
        else:
            parts = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in group["held"]]
        values = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        n = np.diff(np.r_[first, len(values)])
        values, n = values[first][n > 1], n[n > 1]
        cell = (values >> np.uint32(32 - MAP_BITS)).astype(np.int64) - (number << (MAP_BITS - bits))
        seen = np.zeros(1 << (MAP_BITS - bits), dtype=bool)
        seen[cell] = True
        level = np.zeros(1 << (LEVEL_BITS - bits), dtype=np.uint8)
        often = n >= 16
        place = (values[often] >> np.uint32(32 - LEVEL_BITS)).astype(np.int64) - (number << (LEVEL_BITS - bits))
        np.maximum.at(level, place, np.minimum(np.log2(n[often]) * 1.5, 60).astype(np.uint8))
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (np.packbits(seen), level)]
        return pa.table([pa.array([number], pa.int32()), *packed], names=["slice", "map", "level"])

    rows = docs.select(whole().alias("text")).mapInArrow(deal, "slice int, held binary")
    slices = rows.groupBy("slice").applyInArrow(count, "slice int, map binary, level binary").collect()
    bitmap = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
    level = np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    for r in slices:
        for table, part in ((bitmap, r["map"]), (level, r["level"])):
            width = len(table) >> bits
            table[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(part, dtype=np.uint8)
    return bitmap, level


def shingle_rows(docs: DataFrame, tables: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: doc_id, text key, set size, set signature, and its pivots.

    Pivots are the rarest shingles of the set, less those that no other row holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bitmap, level = shared.value
        for batch in batches:
            sizes = np.zeros(len(batch), dtype=np.int64)
            names = np.zeros(len(batch), dtype=np.int64)
            prefixes: list[np.ndarray] = []
            for r, s in shingle_sets(batch.column("text")):
                sizes[r] = n = len(s)
                names[r] = np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)
                if not n:
                    prefixes.append(s)
                    continue
                cell = s >> np.uint64(64 - MAP_BITS)
                held = bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1
                rank = held * (1 + level[(s >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)])
                key = (rank.astype(np.uint64) << np.uint64(58)) | (mix(s) >> np.uint64(6))
                count = n - -(-PERCENT * n // 100) + 1
                chosen = np.argpartition(key, count - 1)[:count] if count < n else np.arange(n)
                prefixes.append(s[chosen[held[chosen] > 0]])
            cuts = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, dtype=np.int64)
            columns = {
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n": pa.array(sizes),
                "node": pa.array(names), "prefix": pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, text_key long, n long, node long, prefix array<long>"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", whole()).alias("text_key"), whole().alias("text")
    )
    return rows.mapInArrow(run, schema)


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``region``, ``node`` and ``shingles`` of the texts whose key is in ``members``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column("text"))]
            cuts = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            shingles = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("region"), batch.column("node"), shingles], ["region", "node", "shingles"]
            )

    keyed = docs.select(F.xxhash64("doc_id", whole()).alias("text_key"), whole().alias("text"))
    rows = keyed.join(members, "text_key").select("region", "node", "text")
    return rows.mapInArrow(run, "region long, node long, shingles array<long>")


def _join_small(regions: DataFrame, every: bool) -> DataFrame:
    """Edges (u, v) that connect what the links of each region connect; with ``every``, all links."""

    def run(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_numpy()
        nodes, first = np.unique(nodes, return_index=True)
        lists = group["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten().to_numpy().view(np.uint64)
        cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        region = Region([flat[cuts[i] : cuts[i + 1]] for i in first.tolist()], every)
        region.join(np.arange(len(nodes)))
        if every:
            u, v = region.links().T
            return pa.table({"u": nodes[u], "v": nodes[v]})
        return pa.table({"u": nodes, "v": nodes[region.part]})

    return regions.groupBy("region").applyInArrow(run, "u long, v long").where("u <> v")


def _divide(large: DataFrame, limit: int, level: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Cells of regions above ``limit`` texts (with ``size``), and the links found on the way."""
    seed = F.lit(level)
    chunks = F.ceil(2 * F.col("size") / limit).cast("int")
    # About 2 * PIVOTS pivots per region, by hash, whatever its size.
    pivots = large.where(uniform(seed, F.col("node")) * F.col("size") < 2 * PIVOTS)
    pivots = pivots.select(
        F.col("region").alias("p_region"), F.col("node").alias("p_node"), F.col("shingles").alias("p_shingles"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("p_chunk"),
    )
    texts = large.withColumn("chunk", F.pmod(F.xxhash64(seed, "node"), chunks).cast("int"))

    def run(texts: pa.Table, pivots: pa.Table) -> pa.Table:
        lists = [*pivots["p_shingles"].to_numpy(), *texts["shingles"].to_numpy()]
        sets = [np.asarray(x).view(np.uint64) for x in lists]
        names = pivots["p_node"].to_numpy()
        p, n = len(pivots), len(texts)
        kids, near = [[0]] * n, [[]] * n
        if p and n:
            region = Region(sets)
            rows = np.arange(p, p + n)
            inter = np.stack([region.shared(k, rows) for k in range(p)])
            joint = region.sizes[:p, None] + region.sizes[None, p:] - inter
            distance = 1 - inter / joint
            inside = distance <= distance.min(axis=0) + 2 * (1 - PERCENT / 100) + 1e-9
            links = 100 * inter >= PERCENT * joint
            # A pivot is named by its node, so all chunks name the cells alike.
            kids = [names[inside[:, j]].tolist() for j in range(n)]
            near = [names[links[:, j]].tolist() for j in range(n)]
        kids, near = (pa.array(x, pa.list_(pa.int64())) for x in (kids, near))
        return pa.table({"region": texts["region"], "node": texts["node"], "kids": kids, "near": near})

    placed = stored(
        texts.groupBy("region", "chunk")
        .cogroup(pivots.groupBy("p_region", "p_chunk"))
        .applyInArrow(run, "region long, node long, kids array<long>, near array<long>"),
        "placed",
    )
    links = stored(placed.select(F.col("node").alias("u"), F.explode("near").alias("v")).where("u <> v").distinct(), "links")
    cells = placed.select("region", "node", F.explode("kids").alias("kid"))
    shape = cells.groupBy("region", "kid").agg(F.count(F.lit(1)).alias("n"))
    shape = shape.groupBy("region").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    whole_size = placed.groupBy("region").agg(F.count(F.lit(1)).alias("total"))
    shape = stored(shape.join(whole_size, "region").withColumn(
        "good", (F.col("most") <= 0.7 * F.col("total")) & (F.col("all") <= 3 * F.col("total")) & F.lit(level < 6)), "shape")

    divided = cells.join(shape.where("good").select("region"), "region")
    divided = divided.select("region", "node", F.xxhash64("region", "kid").alias("cell"))
    # Regions that pivots cannot divide: texts outside the largest connected part, in blocks,
    # meet all texts in blocks.
    dense = placed.join(shape.where("NOT good").select("region", "total"), "region").select("region", "node", "total")
    parts = components(links)
    dense = dense.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node"))
    largest = dense.groupBy("region", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = largest.groupBy("region").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    dense = stored(dense.join(largest, "region"), "dense")
    blocks = F.ceil(2 * F.col("total") / F.lit(limit * 0.8)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(77), "node"), blocks).cast("int")
    outside = F.lit(True) if every else F.col("part") != F.col("main")
    columns = F.sequence(F.lit(0), blocks - 1)
    used = dense.where(outside).select("region", block.alias("row")).distinct()
    as_row = dense.where(outside).select("region", "node", block.alias("row"), F.explode(columns).alias("column"))
    as_column = dense.select("region", "node", block.alias("column")).join(used, "region").select(
        "region", "node", "row", "column")
    met = as_row.unionByName(as_column).select("region", "node", F.xxhash64("region", "row", "column").alias("cell"))
    cells = divided.unionByName(met).distinct()
    out = large.drop("size").join(cells, ["region", "node"]).select(F.col("cell").alias("region"), "node", "shingles")
    return out, links


def _linked(docs: DataFrame, region_docs: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with their set's ``node``, and edges (u, v) of distinct sets: enough for components, or all links."""
    rows = stored(shingle_rows(docs, _shared_shingles(docs)), "shingles")
    sets = rows.where("n > 0")
    # Equal sets are one node; the arrays of copies meet in the map side of the aggregation.
    nodes = sets.groupBy("node").agg(F.first("prefix").alias("prefix"))
    cells = nodes.select("node", F.explode("prefix").alias("shingle"))
    shared = cells.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("pivot")).where("k > 1")
    near = cells.join(shared.select("shingle", "pivot"), "shingle").where("node <> pivot")
    candidates = stored(near.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), "candidates")
    clusters = components(candidates).withColumnRenamed("root", "region")
    keys = sets.groupBy("node").agg(F.min("text_key").alias("text_key"))
    # Rows with one id and text share a key; each set is in its region once, whatever its copies.
    every_row = _sets(docs, clusters.join(keys, "node"))
    regions = stored(every_row.groupBy("region", "node").agg(F.first("shingles").alias("shingles")), "regions")

    edges, level = None, 0
    while True:
        sized = stored(regions.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "sizes")
        large = sized.where(F.col("size") > region_docs)
        more = not large.isEmpty()
        small = regions.join(sized.where(F.col("size") <= region_docs), "region").drop("size") if more else regions
        found = stored(_join_small(small, every), "links")
        edges = found if edges is None else edges.unionByName(found)
        if not more:
            break
        regions, links = _divide(regions.join(large, "region"), region_docs, level, every)
        regions, edges, level = stored(regions, "regions"), edges.unionByName(links), level + 1
    if every:
        edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    return rows, edges


def link_pairs(docs: DataFrame, region_docs: int = REGION_DOCS) -> tuple[DataFrame, DataFrame]:
    """All links: members (doc_id, text_key, node) of every class of equal sets, and the pairs (u, v), u < v, of linked classes.

    The documents of one class are linked with each other and with all those of a linked class.
    """
    rows, edges = _linked(docs, region_docs, every=True)
    return rows.where("n > 0").select("doc_id", "text_key", "node"), edges


def similar(docs: DataFrame, region_docs: int = REGION_DOCS, links: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, text_key; with ``links`` also n_links, the rows it is linked with."""
    rows, edges = _linked(docs, region_docs, links)
    parts = components(edges)
    named = rows.join(parts.select("node", "root"), "node", "left")
    named = named.withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    ids = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(ids, "root", "left")
    counted = []
    if links:
        copies = rows.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
        both = edges.union(edges.select("v", "u")).toDF("node", "other")
        others = both.join(copies.toDF("other", "others"), "other").groupBy("node").agg(F.sum("others").alias("others"))
        n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
        out = out.join(copies.join(others, "node", "left"), "node", "left")
        counted = [n_links.alias("n_links")]
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key",
        *counted,
    )


def one_of_each_group(docs: DataFrame, region_docs: int = REGION_DOCS) -> DataFrame:
    """``docs`` without the near copies: of each component the row with the smallest doc_id stays.

    Rows without an id, and rows that share the kept id and text, all stay.
    """
    gone = similar(docs, region_docs).where("component_id <> doc_id").select("text_key").distinct()
    keyed = docs.withColumn("_text_key", F.xxhash64(F.col("doc_id").cast("long"), whole()))
    return keyed.join(gone, keyed["_text_key"] == gone["text_key"], "left_anti").drop("_text_key")
