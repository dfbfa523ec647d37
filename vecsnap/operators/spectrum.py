"""Facts about all pairs of a graph or a vector table, without a row per pair.

Common-neighbour counts of all pairs become a histogram: a neighbour of few vertices makes its pairs
itself, neighbours of very many (hubs) are met as 0/1 matrices, block of vertices by block. Inner
products of all pairs are rounded and counted block by block. Eigenvalues with their multiplicities come
from a block Krylov space whose matrix-vector products are joins and sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.kernels.arrow import to_matrix
from vecsnap.operators.graph import both_ways, degrees
from vecsnap.operators.sets import _large_overlaps
from vecsnap.session import written

# Above this degree a vertex is a hub; beyond MAX_HUBS hubs the limit rises.
HUB_DEGREE, MAX_HUBS, BLOCK_VERTICES = 256, 4096, 2048
# Pairs with a light common neighbour, for each edge, up to which these become rows beside the hubs.
LIGHT_PAIRS = 8
# Blocks into which a table of vectors is cut, while these have no more vectors than the limit;
# products that a task counts at once, and distinct rounded values that it counts by number.
PRODUCT_BLOCKS, MAX_BLOCK, PRODUCTS, MOST_BINS = 48, 65_536, 1 << 16, 1 << 18


def _block_pairs(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """Every row in all pairs of blocks ``i <= j`` that hold its block; ``first`` and ``second`` say as which."""
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    other = rows.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return other.select(
        *rows.columns, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
        (F.col("b") <= F.col("o")).alias("first"), (F.col("b") >= F.col("o")).alias("second"),
    )


def neighbour_histogram(
    edges: DataFrame, hub_degree: int = HUB_DEGREE, max_hubs: int = MAX_HUBS, block_vertices: int = BLOCK_VERTICES
) -> DataFrame:
    """``(adjacent, shared, n_pairs)``: pairs of vertices by their number of common neighbours.

    ``edges (a, b)`` are distinct with a < b. Pairs that share nothing follow from the totals. Where there are
    no hubs, or others make too many pairs, neighbours are met as the items of sets, and no pair is a row.
    """
    edges = written(edges.select("a", "b"), "edges")
    deg = written(degrees(edges), "degrees")
    facts = deg.agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("d")).first()
    n, n_edges = facts["n"], (facts["d"] or 0) // 2
    limit = max(hub_degree, -(-2 * n_edges // max_hubs))
    d = F.col("degree").cast("double")
    light = deg.agg(F.sum(F.when(d <= limit, d * (d - 1) / 2)).alias("pairs"), F.count_if(d > limit).alias("hubs")).first()
    if not light["hubs"] or (light["pairs"] or 0) > LIGHT_PAIRS * n_edges:
        sets = both_ways(edges).join(deg, "v").select(F.col("v").alias("s"), F.col("w").alias("x"), F.col("degree").alias("size"))
        met = _large_overlaps(sets, 0, per_set=False, near=True)
        # Two vertices find each other.
        counted = met.groupBy(F.col("other_large").alias("near"), F.col("shared").cast("bigint").alias("c"))
        return _with_rest(counted.agg((F.sum("n") / 2).cast("bigint").alias("n")), n, n_edges)
    links = both_ways(edges).join(deg, "v")
    light = links.where(F.col("degree") <= limit).select("v", "w")
    wedges = light.join(light.select("v", F.col("w").alias("x")), "v").where("w < x")
    shared = wedges.groupBy(F.col("w").alias("a"), F.col("x").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    near = edges.withColumn("near", F.lit(True))
    hubs = deg.where(F.col("degree") > limit).select("v").collect()
    number = links.sparkSession.createDataFrame([(r["v"], k) for k, r in enumerate(hubs)], "v bigint, hub int")
    rows = links.join(F.broadcast(number), "v").groupBy(F.col("w").alias("vertex")).agg(F.collect_list("hub").alias("hubs"))
    rows = written(rows, "hubs")
    n_rows, n_hubs = rows.count(), len(hubs)
    blocks = max(1, -(-n_rows // block_vertices))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    # All pairs with a light common neighbour, and all edges: what the blocks have to add.
    known = shared.join(near, ["a", "b"], "full").select("a", "b", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("near", F.lit(False)).alias("near"))
    has = rows.select("vertex", F.lit(True).alias("has"))
    known = known.join(has.toDF("a", "ha"), "a", "left").join(has.toDF("b", "hb"), "b", "left")
    inside = F.coalesce(F.col("ha") & F.col("hb"), F.lit(False))
    known = written(known.select("a", "b", "c", "near", inside.alias("inside")), "known")
    outside = known.where("NOT inside AND c > 0").groupBy("near", "c").agg(F.count(F.lit(1)).alias("n"))

    def count(vertices: pa.Table, known: pa.Table) -> pa.Table:
        names, lists = vertices.column("vertex").to_numpy(), vertices.column("hubs").combine_chunks()
        matrix = np.zeros((len(names), n_hubs), dtype=np.float32)
        matrix[np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
        first, second = (np.flatnonzero(vertices.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
        total = (matrix[first] @ matrix[second].T).astype(np.int64)
        flag = np.zeros(total.shape, dtype=bool)
        if known.num_rows:
            at = [dict(zip(names[side].tolist(), range(len(side)))) for side in (first, second)]
            a, b = known.column("a").to_pylist(), known.column("b").to_pylist()
            swap = [x not in at[0] or y not in at[1] for x, y in zip(a, b)]
            r = np.array([at[0][y if s else x] for x, y, s in zip(a, b, swap)])
            c = np.array([at[1][x if s else y] for x, y, s in zip(a, b, swap)])
            np.add.at(total, (r, c), known.column("c").to_numpy())
            flag[r, c] = known.column("near").to_numpy(zero_copy_only=False)
            if np.array_equal(first, second):
                total[c, r], flag[c, r] = total[r, c], flag[r, c]
        keep = np.triu(np.ones(total.shape, dtype=bool), 1) if np.array_equal(first, second) else np.ones(total.shape, dtype=bool)
        out = [(bool(f), k, m) for f in (False, True) for k, m in enumerate(np.bincount(total[keep & (flag == f)]).tolist()) if m and k]
        near, c, m = zip(*out) if out else ((), (), ())
        return pa.table({"near": pa.array(near, pa.bool_()), "c": pa.array(c, pa.int64()), "n": pa.array(m, pa.int64())})

    # Written in both directions, an edge or wedge within one block would be met twice.
    ij = [block("a").alias("ba"), block("b").alias("bb")]
    dealt = known.where("inside").select("a", "b", "c", "near", *ij)
    dealt = dealt.select("a", "b", "c", "near", F.least("ba", "bb").alias("oi"), F.greatest("ba", "bb").alias("oj"))
    paired = _block_pairs(rows, "vertex", blocks)
    within = paired.groupBy("i", "j").cogroup(dealt.groupBy("oi", "oj")).applyInArrow(count, "near boolean, c bigint, n bigint")
    counted = within.unionByName(outside).groupBy("near", "c").agg(F.sum("n").alias("n"))
    return _with_rest(counted, n, n_edges)


def _with_rest(counted: DataFrame, n: int, n_edges: int) -> DataFrame:
    """Counts ``(near, c, n)`` of the pairs that share something, and those of the pairs that do not."""
    counted = written(counted, "histogram")
    spark = counted.sparkSession
    totals = spark.createDataFrame([(True, n_edges), (False, n * (n - 1) // 2 - n_edges)], "near boolean, all bigint")
    rest = totals.join(counted.groupBy("near").agg(F.sum("n").alias("some")), "near", "left")
    rest = rest.select("near", F.lit(0).cast("bigint").alias("c"), (F.col("all") - F.coalesce("some", F.lit(0))).alias("n")).where("n > 0")
    return counted.unionByName(rest).select(F.col("near").alias("adjacent"), F.col("c").alias("shared"), F.col("n").alias("n_pairs"))


def rounded_products(
    vectors: DataFrame, pairs: DataFrame, id_col: str, column: str, dim: int, digits: int = 6, block_vertices: int | None = None
) -> DataFrame:
    """``(adjacent, product, n_pairs)``: rounded inner products of all pairs of vectors and how often they occur.

    ``pairs (a, b)`` are the adjacent ones, in any direction; ids are distinct. Each pair of blocks is
    a task that counts its own products, so only distinct values of a task are exchanged.
    """
    kind = vectors.schema[column].dataType.simpleString()
    # Floats travel as they are; products are those of doubles either way.
    v = F.col(column) if kind == "array<float>" else F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vertex"), v.alias("v"))
    n = rows.count()
    block_vertices = block_vertices or min(MAX_BLOCK, max(BLOCK_VERTICES, -(-n // PRODUCT_BLOCKS)))
    blocks = max(1, -(-n // block_vertices))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    ends = pairs.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).distinct()
    near = ends.select("a", "b", F.least(block("a"), block("b")).alias("oi"), F.greatest(block("a"), block("b")).alias("oj"))
    scale = 10.0**digits

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rounded products and how often they occur; few of them are counted by number."""
        low, high = (keys.min(), keys.max()) if keys.size else (0.0, 0.0)
        if not high - low < MOST_BINS:
            return np.unique(keys, return_counts=True)
        times = np.bincount((keys - low).astype(np.int64).reshape(-1))
        held = np.flatnonzero(times)
        return held + low, times[held]

    def count(vectors: pa.Table, near: pa.Table) -> pa.Table:
        x, names = to_matrix(vectors.column("v").combine_chunks(), dim), vectors.column("vertex").to_numpy()
        first, second = (np.flatnonzero(vectors.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
        same = np.array_equal(first, second)
        at = [dict(zip(names[side].tolist(), range(len(side)))) for side in (first, second)]
        marked = set()
        for a, b in zip(near.column("a").to_pylist(), near.column("b").to_pylist()):
            for p, q in ((a, b), (b, a)):
                if p in at[0] and q in at[1] and not (same and at[0][p] >= at[1][q]):
                    marked.add((at[0][p], at[1][q]))
        flagged = np.array(sorted(marked), dtype=np.int64).reshape(-1, 2)
        found: dict[tuple[bool, float], int] = {}
        right, step = x[second].T, max(1, PRODUCTS // max(1, len(second)))
        for low in range(0, len(first), step):
            keys = x[first[low : low + step]] @ right
            keys *= scale
            np.rint(keys, out=keys)
            r, c = flagged[slice(*np.searchsorted(flagged[:, 0], (low, low + step)))].T
            own = keys[r - low, c]
            if same:
                keys = keys[np.arange(len(second))[None, :] > np.arange(low, low + len(keys))[:, None]]
            for f, sign, part in ((False, 1, keys), (False, -1, own), (True, 1, own)):
                for value, m in zip(*(z.tolist() for z in counted(part))):
                    found[f, value] = found.get((f, value), 0) + sign * m
        found = {key: m for key, m in found.items() if m}
        near, value = zip(*found) if found else ((), ())
        value = np.array(value, dtype=np.float64) / scale + 0.0
        return pa.table({"near": pa.array(near, pa.bool_()), "value": pa.array(value, pa.float64()), "n": pa.array(list(found.values()), pa.int64())})

    paired = _block_pairs(rows, "vertex", blocks).groupBy("i", "j").cogroup(near.groupBy("oi", "oj"))
    counts = paired.applyInArrow(count, "near boolean, value double, n bigint")
    return counts.groupBy(F.col("near").alias("adjacent"), F.col("value").alias("product")).agg(F.sum("n").alias("n_pairs"))


def eigenvalues(edges: DataFrame, most: int = 8, block: int = 4, digits: int = 6, seed: int = 5) -> DataFrame:
    """Distinct eigenvalues of an adjacency matrix and their multiplicities: ``(eigenvalue, multiplicity)``.

    For graphs with at most ``most`` distinct eigenvalues. A few random vectors are multiplied by the
    matrix again and again (a join with the edges and a sum); what the products span holds every
    eigenvalue. The multiplicities follow from the traces of the powers 0, 1, 2, 3, ..., which are
    sums over the vertices: exact whole numbers as long as there are no more values than powers.
    Raises where the space does not close within ``most`` steps.
    """
    links = written(both_ways(edges.select("a", "b")), "links")
    vertices = links.select("v").distinct()
    # Random signs of a vertex: as good as normal numbers here, and the same on every cluster.
    sign = lambda k: F.when(F.pmod(F.xxhash64("v", F.lit(seed + k)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    x = vertices.select("v", F.array(*[sign(k) for k in range(block)]).alias("x"))
    basis, powers = None, []
    for step in range(most + 1):
        x = written(x, "krylov")
        powers.append(x.select("v", F.col("x").alias(f"x{step}")))
        sums = [F.sum(F.get("x", F.lit(k))).alias(f"s{k}") for k in range(block)]
        moved = links.join(x.withColumnRenamed("v", "w"), "w").groupBy("v").agg(*sums)
        # Scaled, so that powers of the matrix stay in range.
        scale = float(moved.agg(F.max(F.greatest(F.lit(1.0), *[F.abs(f"s{k}") for k in range(block)]))).first()[0]) if step else 1.0
        x = moved.select("v", F.array(*[F.col(f"s{k}") / scale for k in range(block)]).alias("x"))
    basis = powers[0]
    for p in powers[1:]:
        basis = basis.join(p, "v")
    width = block * (most + 1)
    flat = written(basis.select("v", F.concat(*[f"x{s}" for s in range(most + 1)]).alias("y")), "basis")
    # The basis against itself and against the matrix times it: two small matrices of sums.
    moved = links.join(flat.withColumnRenamed("v", "w"), "w")
    ay = moved.groupBy("v").agg(F.array(*[F.sum(F.get("y", F.lit(k))) for k in range(width)]).alias("ay"))
    gram, image = _cross_sums(flat.join(ay, "v"), width)
    norms = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    gram, image = gram / np.outer(norms, norms), image / np.outer(norms, norms)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-10 * values[-1]
    half = vectors[:, keep] / np.sqrt(values[keep])
    ritz = np.sort(np.linalg.eigvalsh((half.T @ image @ half + half.T @ image.T @ half) / 2))
    distinct = [float(ritz[0])]
    for value in ritz[1:]:
        if value - distinct[-1] > 1e-5 * max(1.0, abs(ritz).max()):
            distinct.append(float(value))
    if len(distinct) > most:
        raise ValueError(f"more than {most} distinct eigenvalues")
    n = vertices.count()
    traces = [n, 0, links.count()]
    if len(distinct) > 3:
        traces += _traces(links, len(distinct) - 3)
    system = np.vander(distinct, len(distinct), increasing=True).T
    times = np.linalg.solve(system, np.array(traces[: len(distinct)], dtype=float))
    whole = np.rint(times)
    if np.abs(times - whole).max() > 1e-2 or whole.sum() != n:
        raise ValueError("the traces give no whole multiplicities: more distinct eigenvalues than found")
    rows = [(round(value, digits) + 0.0, int(m)) for value, m in zip(distinct, whole)]
    return edges.sparkSession.createDataFrame(rows, "eigenvalue double, multiplicity bigint")


def _cross_sums(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows of y y' and y (ay)', one partial pair of small matrices per task."""

    def run(batches):
        total = np.zeros((2, width, width))
        for batch in batches:
            y, ay = to_matrix(batch.column("y"), width), to_matrix(batch.column("ay"), width)
            total += np.stack([y.T @ y, y.T @ ay])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.reshape(-1)], pa.list_(pa.float64()))], ["k", "m"])

    parts = df.select("y", "ay").mapInArrow(run, "k bigint, m array<double>").select(F.posexplode("m").alias("at", "x"))
    out = np.zeros(2 * width * width)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return tuple(out.reshape(2, width, width))


def _traces(links: DataFrame, more: int) -> list[int]:
    """Traces of the powers 3, 4, ... of the matrix: closed walks, counted by joining walks of half the length."""
    walks = {1: links.select(F.col("v").alias("s"), F.col("w").alias("t"), F.lit(1).cast("bigint").alias("n"))}
    for k in range(2, (more + 4) // 2 + 1):
        step = walks[k - 1].join(links, F.col("t") == F.col("v")).groupBy("s", F.col("w").alias("u")).agg(F.sum("n").alias("n"))
        walks[k] = written(step.select("s", F.col("u").alias("t"), "n"), "walks")
    out = []
    for k in range(3, 3 + more):
        a, b = walks[k // 2], walks[k - k // 2]
        both = a.join(b.select(F.col("s").alias("t"), F.col("t").alias("s"), F.col("n").alias("m")), ["s", "t"])
        out.append(int(both.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]))
    return out
