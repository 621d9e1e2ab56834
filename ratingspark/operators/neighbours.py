"""The most similar items of each item, exactly, without comparing all of them.

Equal vectors share one list, so what is compared are distinct vectors, each with its few
smallest item ids. They are dealt into cells around pivots, some of the vectors themselves, and:

1. Each cell is compared with itself. This gives every vector a floor, its last listed similarity.
2. Two cells are compared only if one of them holds a vector that the other may improve: by the
   triangle inequality for angles, no vector within angle r of pivot q is nearer to x than
   angle(x, q) - r. Within the pair only vectors that pass this test meet the other cell.
   Cells travel in groups: a task gets two groups and goes through their pairs of cells, nearest
   first, so that floors rise on the way. A vector is sent once for each group that has a cell to
   compare, and the number of groups follows from memory and cores, not from the number of cells.

A product of two vectors serves both of them, so even vectors without any structure, which no
bound can tell apart, cost little more than half of all products.

A vector that a great share of the items has (an indicator level) is a hot group: its items find
it by a broadcast of the hot groups, of which there are at most ``MAX_HOT``, and its smallest ids are found
in parts, of which each hands on its few smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ratingspark.operators.best import RANK_DIGITS, BestLists
from ratingspark.operators.half_steps import _matrix
from ratingspark.operators.layout import balanced_labels
from ratingspark.session import cut_lineage

CELL = 256  # vectors of a cell, at least
BLOCK_BYTES = 64 << 20  # vectors of a block; larger cells are cut
PIVOTS, PIVOT_BYTES = 1_024, 32 << 20
STRIP = 512  # vectors compared at once, on either side
CORE_TILES = 4  # tiles of two groups of blocks for each core, at least
HOT_ROWS, MAX_HOT = 50_000, 1_000
SLACK = 1e-8  # room for rounding of the bounds and of the ranking
NEAR = "gid long, near array<struct<dst: long, sim: double>>, floor double, products long"


def _groups(vectors: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct vectors (gid, unit); items (item_id, gid, parts); ids of the hot groups."""
    groups = cut_lineage(vectors.groupBy("unit").agg(F.min("item_id").alias("gid"), F.count("*").alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    bar = max(hot_rows, -(-total // MAX_HOT))
    hot = groups.where(F.col("n") > bar).select("unit", "gid", F.ceil(F.col("n") / F.lit(float(bar))).cast("int").alias("parts"))
    hot_ids = [r.gid for r in hot.select("gid").collect()]
    if hot_ids:
        marked = vectors.join(F.broadcast(hot), "unit", "left")  # at most MAX_HOT rows
        cold = marked.where(F.col("gid").isNull()).select("item_id", "unit").join(groups.select("unit", "gid"), "unit")
        members = marked.where(F.col("gid").isNotNull()).select("item_id", "gid", "parts").unionByName(
            cold.select("item_id", "gid", F.lit(1).alias("parts")))
    else:
        members = vectors.join(groups.select("unit", "gid"), "unit").select("item_id", "gid", F.lit(1).alias("parts"))
    return groups.select("gid", "unit"), cut_lineage(members), hot_ids


def _smallest_ids(members: DataFrame, keep: int) -> DataFrame:
    """(gid, ids): the ``keep`` smallest item ids of each group, ascending."""
    part = members.withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts").cast("long")))
    inner = Window.partitionBy("gid", "part").orderBy("item_id")
    few = part.withColumn("place", F.row_number().over(inner)).where(F.col("place") <= keep)
    outer = Window.partitionBy("gid").orderBy("item_id")
    few = few.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= keep)
    return few.groupBy("gid").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))


def _angles(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles to unit directions; of a zero vector a right angle."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.arccos(np.clip((x / np.where(length > 0, length, 1)) @ directions.T, -1, 1))


def _bound(angle: np.ndarray, radius: np.ndarray | float) -> np.ndarray:
    """No vector within ``radius`` of a direction at ``angle`` is more similar than this (lengths are at most one)."""
    return np.maximum(np.cos(np.clip(angle - radius, 0, np.pi)), 0.0) + SLACK


class _Side:
    """Vectors of one block in a task, with the ids that stand for them."""

    def __init__(self, table: pa.Table, keep: int):
        self.gid, self.unit = table["gid"].to_numpy(), _matrix(table["unit"])
        lists = table["ids"].combine_chunks()
        self.counts = pa.compute.list_value_length(lists).to_numpy()
        self.flat, self.starts = lists.flatten().to_numpy(), np.r_[0, np.cumsum(self.counts)]
        self.best = BestLists(table["floor"].to_numpy(), keep)

    def offer(self, rows: np.ndarray, other: "_Side", columns: np.ndarray, sims: np.ndarray) -> None:
        """Vectors ``columns`` of ``other`` are candidates of ``rows``: ``sims`` has a row for each."""
        at, of = np.nonzero(sims >= self.best.floor[rows][:, None] - SLACK)
        found, column = sims[at, of], columns[of]
        counts = other.counts[column]
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = other.flat[np.repeat(other.starts[column], counts) + step]
        self.best.add(np.repeat(rows[at], counts), ids, np.repeat(found, counts))

    def lists(self, products: int, whole: bool) -> pa.Table:
        filled = self.best.scores > -np.inf
        rows = np.arange(len(self.gid)) if whole else np.flatnonzero(filled.any(axis=1))
        offsets = pa.array(np.r_[0, np.cumsum(filled[rows].sum(axis=1))].astype(np.int32))
        near = pa.StructArray.from_arrays(
            [pa.array(self.best.ids[rows][filled[rows]], pa.int64()), pa.array(self.best.scores[rows][filled[rows]], pa.float64())], names=["dst", "sim"])
        counted = np.zeros(len(rows), np.int64)
        counted[:1] = products
        return pa.table({"gid": self.gid[rows], "near": pa.ListArray.from_arrays(offsets, near), "floor": self.best.floor[rows], "products": counted})


def _compare(left: _Side, right: _Side, rows: np.ndarray, columns: np.ndarray, same: bool = False) -> int:
    """Offer every product of ``rows`` and ``columns`` to both sides; the number of products."""
    products = 0
    for a in range(0, len(rows), STRIP):
        own = rows[a:a + STRIP]
        for b in range(a if same else 0, len(columns), STRIP):
            other = columns[b:b + STRIP]
            sims = left.unit[own] @ right.unit[other].T
            products += sims.size
            left.offer(own, right, other, sims)
            if not same or a != b:
                right.offer(other, left, own, sims.T)
    return products


def _within(keep: int):
    def task(table: pa.Table) -> pa.Table:
        side = _Side(table.sort_by("gid"), keep)
        rows = np.arange(len(side.gid))
        return side.lists(_compare(side, side, rows, rows, same=True), whole=True)

    return task


def _may_improve(a: np.ndarray, b: np.ndarray, pivots: np.ndarray, cell_of: np.ndarray, radius: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """Whether block ``a[i]`` holds a vector that ``b[j]`` may improve, or the other way round; empty blocks have the floor inf."""
    bound = _bound(_angles(pivots[cell_of[a]], pivots[cell_of[b]]), radius[a][:, None] + radius[b])
    return (bound >= np.minimum(lowest[a][:, None], lowest[b])) & (lowest[a][:, None] < np.inf) & (lowest[b] < np.inf)


def _group_blocks(pivots: np.ndarray, cell_of: np.ndarray, sizes: np.ndarray, n_groups: int) -> np.ndarray:
    """The group of each block: about equally many vectors, cells along a chain of nearest pivots."""
    place, at, apart = np.zeros(len(pivots), np.int64), 0, -(pivots @ pivots.T)
    for turn in range(len(pivots)):
        place[at] = turn
        apart[:, at] = np.inf
        at = int(apart[at].argmin())
    order = np.lexsort((np.arange(len(cell_of)), place[cell_of]))
    middle = np.cumsum(sizes[order]) - sizes[order] / 2
    group_of = np.zeros(len(cell_of), np.int64)
    group_of[order] = np.minimum(n_groups - 1, middle * n_groups / max(1, sizes.sum()))
    return group_of


def _between(keep: int, pivots: np.ndarray, cell_of: np.ndarray, radius: np.ndarray, lowest: np.ndarray, group_of: np.ndarray):
    """Blocks of the two groups of a tile (or of one): nearest pairs first, only vectors that the other block may improve."""

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("gid", "ascending")])
        blocks, first = np.unique(table["block"].to_numpy(), return_index=True)
        rows = dict(zip(blocks.tolist(), np.split(np.arange(table.num_rows), first[1:])))
        side = _Side(table, keep)
        groups = np.unique(group_of[blocks])
        left, right = blocks[group_of[blocks] == groups[0]], blocks[group_of[blocks] == groups[-1]]
        near = _may_improve(left, right, pivots, cell_of, radius, lowest)
        if len(groups) == 1:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        products = 0
        for pair in np.argsort(-np.sum(pivots[cell_of[left[i]]] * pivots[cell_of[right[j]]], axis=1), kind="stable"):
            a, b = int(left[i[pair]]), int(right[j[pair]])
            open_a, open_b = (
                _bound(_angles(side.unit[rows[x]], pivots[cell_of[y]][None, :])[:, 0], radius[y]) >= side.best.floor[rows[x]]
                for x, y in ((a, b), (b, a)))
            products += _compare(side, side, rows[a][open_a], rows[b])
            products += _compare(side, side, rows[a][~open_a], rows[b][open_b])
        out = side.lists(0, whole=False)
        count = pa.table({"gid": pa.array([None], pa.int64()), "near": pa.array([[]], out.schema.field("near").type),
                          "floor": pa.array([0.0]), "products": pa.array([products], pa.int64())})
        return pa.concat_tables([count, out])

    return task


def neighbour_lists(vectors: DataFrame, topk: int, hot_rows: int = HOT_ROWS, cell: int = CELL) -> tuple[DataFrame, DataFrame, list[int]]:
    """Lists of the topk+1 nearest items of each distinct vector, with itself; the items; the hot groups."""
    spark = vectors.sparkSession
    keep = topk + 1
    points, members, hot_ids = _groups(vectors, hot_rows)
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("d")).first()
    points = points.join(_smallest_ids(members, keep), "gid")
    if not shape.n:
        return spark.createDataFrame([], NEAR), members, hot_ids
    d = max(1, shape.d)
    n_cells = max(1, min(PIVOTS, PIVOT_BYTES // (8 * d), shape.n // max(cell, 4 * keep)))
    rows = points.orderBy(F.xxhash64("gid"), "gid").limit(n_cells).select("unit").collect()
    pivots = np.array([r.unit for r in rows], float).reshape(n_cells, -1)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_matrix(pa.Table.from_batches([batch])["unit"]), pivots) if batch.num_rows else np.zeros((0, n_cells))
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int64()), pa.array(angles[np.arange(len(near)), near])], names=["gid", "unit", "ids", "cell", "angle"])

    dealt = cut_lineage(points.select("gid", "unit", "ids").mapInArrow(
        deal, "gid long, unit array<double>, ids array<long>, cell long, angle double"))
    cap = max(cell, BLOCK_BYTES // (8 * d))
    sizes = {r.cell: -(-r.n // cap) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    first = {c: sum(sizes[x] for x in sorted(sizes) if x < c) for c in sizes}
    table = F.create_map(*[F.lit(int(x)) for c in sizes for x in (c, first[c])]), F.create_map(*[F.lit(int(x)) for c in sizes for x in (c, sizes[c])])
    cell_key = F.col("cell").cast("int")
    dealt = dealt.withColumn("block", table[0][cell_key] + F.pmod(F.xxhash64("gid"), table[1][cell_key].cast("long")))
    n_blocks = sum(sizes.values())

    inner = dealt.withColumn("floor", F.lit(float("-inf"))).groupBy("block").applyInArrow(_within(keep), NEAR)
    if n_blocks == 1:
        return inner, members, hot_ids
    lists = cut_lineage(inner)
    floored = dealt.join(lists.select("gid", "floor"), "gid")
    cell_of, radius, lowest, rows_of = np.zeros(n_blocks, np.int64), np.zeros(n_blocks), np.full(n_blocks, np.inf), np.zeros(n_blocks)
    for r in floored.groupBy("block").agg(
            F.first("cell").alias("cell"), F.max("angle").alias("radius"), F.min("floor").alias("low"), F.count("*").alias("n")).collect():
        cell_of[r.block], radius[r.block], lowest[r.block], rows_of[r.block] = r.cell, r.radius, r.low, r.n
    # A row is sent to one tile per group that may improve it, so groups are as few as memory and cores allow.
    cores = spark.sparkContext.defaultParallelism
    n_groups = min(n_blocks, max(-(-shape.n // cap), math.ceil(math.sqrt(2 * CORE_TILES * cores))))
    group_of = _group_blocks(pivots, cell_of, rows_of, n_groups)
    n_tiles = n_groups * (n_groups + 1) // 2
    labels = balanced_labels(spark, n_tiles, n_tiles) or list(range(n_tiles))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles in which each row takes part: its group with each group of which a block may improve its own or be improved."""
        label, every = np.array(labels, np.int32), np.arange(n_blocks)
        partners: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = []
            for block in batch.column("block").to_pylist():
                if block not in partners:
                    near = _may_improve(np.array([block]), every, pivots, cell_of, radius, lowest)[0]
                    near[block] = False
                    others = np.unique(group_of[near])
                    low, high = np.minimum(others, group_of[block]), np.maximum(others, group_of[block])
                    partners[block] = label[high * (high + 1) // 2 + low]
                lists.append(partners[block])
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32))
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*batch.schema.names, "tiles"])

    rows = floored.select("block", "gid", "unit", "ids", "floor").mapInArrow(
        tiles, "block long, gid long, unit array<double>, ids array<long>, floor double, tiles array<int>")
    outer = rows.select(F.explode("tiles").alias("tile"), "block", "gid", "unit", "ids", "floor").repartition(n_tiles, "tile") \
        .groupBy("tile").applyInArrow(_between(keep, pivots, cell_of, radius, lowest, group_of), NEAR)
    outer = cut_lineage(outer)
    order = Window.partitionBy("gid").orderBy(F.round("near.sim", RANK_DIGITS).desc(), "near.dst")
    merged = (
        lists.unionByName(outer.where(F.col("gid").isNotNull()))
        .select("gid", F.explode("near").alias("near"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= keep)
        .groupBy("gid")
        .agg(F.collect_list("near").alias("near"))
        .select("gid", "near", F.lit(0.0).alias("floor"), F.lit(0).cast("long").alias("products"))
    )
    # The counts of products stay with rows of no vector.
    counts = lists.unionByName(outer).agg(F.sum("products").alias("products")).select(
        F.lit(None).cast("long").alias("gid"), F.lit(None).cast("array<struct<dst: long, sim: double>>").alias("near"), F.lit(0.0).alias("floor"), "products")
    return merged.unionByName(counts), members, hot_ids


def products_report(vectors: DataFrame, topk: int, **options) -> DataFrame:
    """One row: distinct vectors and the products taken of them."""
    lists, _, _ = neighbour_lists(vectors, topk, **options)
    return lists.agg(F.count("gid").alias("n_vectors"), F.sum("products").alias("n_products"))


def top_neighbours(vectors: DataFrame, topk: int, **options) -> DataFrame:
    """The ``topk`` most similar items of each item: (src, dst, sim), no zeros."""
    lists, members, hot_ids = neighbour_lists(vectors, topk, **options)
    lists = lists.where(F.col("gid").isNotNull()).select("gid", "near")
    own = members.select(F.col("item_id").alias("src"), "gid")
    if hot_ids:
        hot = F.col("gid").isin(hot_ids)
        # At most MAX_HOT lists.
        rows = own.where(~hot).join(lists.where(~hot), "gid").unionByName(own.where(hot).join(F.broadcast(lists.where(hot)), "gid"))
    else:
        rows = own.join(lists, "gid")
    # The item itself stands in its own row with similarity zero.
    entry = lambda sim, dst: F.struct(
        (-F.round(sim, RANK_DIGITS)).alias("rank"), dst.alias("dst"), sim.alias("sim")
    )
    others = F.filter("near", lambda e: e["dst"] != F.col("src"))
    row = F.concat(
        F.transform(others, lambda e: entry(e["sim"], e["dst"])),
        F.array(entry(F.lit(0.0), F.col("src"))),
    )
    return (
        rows.select("src", F.explode(F.slice(F.sort_array(row), 1, topk)).alias("e"))
        .where((F.col("e.dst") != F.col("src")) & (F.col("e.sim") != 0))
        .select("src", F.col("e.dst").alias("dst"), F.col("e.sim").alias("sim"))
    )
