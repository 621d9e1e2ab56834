"""Approximate nearest neighbours with balanced posting lists.

Centroids come from k-means on a bounded sample; their number grows with the table
(one list for about ``list_size`` vectors, at most ``max_lists``). They are linked to a
neighbour graph, which every task searches in memory. A vector is put on the list
of its nearest centroid and, as a boundary vector, on those at most ``1 + closure`` times as
far, ``copies`` in all. A list longer than ``4 * list_size`` is split into parts that
are all searched, so no task meets a long list. A query searches the lists whose
centroids are at most ``1 + ratio`` times as far as its nearest, and at least
``least_lists``; the graph walk ends where nothing within that distance is left to visit.

Equal vectors are merged before they are indexed: tasks keep the k + 1 smallest
ids of a vector, which is all that a search of k can return. So a vector that a third of
all rows hold is one entry. Every valid row is in the index; distances are those
of the original vectors in double precision. Fewer than k candidates give fewer rows.

Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
rows without an id and vectors of another length than the most common (ties: the
longer). Rows of one id count as one; the nearest of them is reported. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratingspark.llm.common import store


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (array of double) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", number) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _merge(keep: int):
    """Rows (ids, v): one row for each run of equal vectors, with its ``keep`` smallest ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids = None, []
        for batch in batches:
            out_ids, out_v = [], []
            for own, vector in zip(batch.column("ids").to_pylist(), _matrix(batch.column("v"))):
                key = vector.tobytes()
                if key != current:
                    if current is not None:
                        out_ids.append(ids)
                        out_v.append(current)
                    current, ids = key, []
                ids = sorted({*ids, *own})[:keep]
            if out_ids:
                yield _rows(out_ids, out_v)
        if current is not None:
            yield _rows([ids], [current])

    return run


def _combine(keep: int):
    """The same within each batch, whatever its order: less to shuffle of frequent vectors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for doc, vector in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("v")) + 0.0):
                found.setdefault(vector.tobytes(), []).append(doc)
            if found:
                yield _rows([sorted(set(i))[:keep] for i in found.values()], list(found))

    return run


def _rows(ids: list[list[int]], vectors: list[bytes]) -> pa.RecordBatch:
    v = [np.frombuffer(x, np.float64) for x in vectors]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.list_(pa.int64())), pa.array(v, pa.list_(pa.float64()))], names=["ids", "v"])


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: ``ids`` (its ``keep`` smallest) and ``v``."""
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = vectors.mapInArrow(_combine(keep), "ids array<long>, v array<double>")
    return some.withColumn("h", F.xxhash64("v")).repartition(width, "h").sortWithinPartitions("h", "v").select("ids", "v") \
        .mapInArrow(_merge(keep), "ids array<long>, v array<double>")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def balanced_means(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """``n`` centroids; after each round the emptiest tenth is reseeded inside the fullest lists."""
    rng = np.random.default_rng(0)
    n = min(n, len(sample))
    centers = sample[rng.choice(len(sample), n, replace=False)]
    for step in range(rounds):
        owner = np.concatenate([squared(part, centers).argmin(1) for part in np.array_split(sample, -(-len(sample) // 2000))])
        size = np.bincount(owner, minlength=n)
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, sample)
        centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers)
        if step < rounds - 2:
            order = np.argsort(size, kind="stable")
            for small, big in zip(order[:n // 10], order[::-1]):
                if size[big] > 2 * max(1, size[small]):
                    centers[small] = sample[rng.choice(np.flatnonzero(owner == big))]
    return centers


class CentroidGraph:
    """Centroids linked to their nearest ones and, so that all can be reached, in a ring."""

    def __init__(self, centers: np.ndarray, degree: int = 24):
        self.centers = centers
        n = len(centers)
        degree = min(degree, n - 1)
        near = np.concatenate([np.argsort(squared(part, centers), axis=1)[:, 1:degree + 1] for part in np.array_split(centers, -(-n // 1000))]) \
            if n > 1 else np.zeros((1, 0), int)
        own = np.arange(n)[:, None]
        before, after = np.roll(own, 1), np.roll(own, -1)
        # A link that is there already points to the node itself.
        before = np.where((near == before).any(1, keepdims=True), own, before)
        after = np.where((near == after).any(1, keepdims=True) | (after == before), own, after)
        self.links = np.column_stack([near, before, after])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def distances(self, vectors: np.ndarray, row: np.ndarray, node: np.ndarray, block: int = 50_000) -> np.ndarray:
        """Distances of the pairs (row, node), some at a time."""
        out = np.empty(len(row))
        for begin in range(0, len(row), block):
            part = slice(begin, begin + block)
            offset = vectors[row[part]] - self.centers[node[part]]
            out[part] = np.sqrt(np.einsum("ij,ij->i", offset, offset))
        return out

    def closest(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest centroids found and their distances (infinite where there are fewer), nearest first.

        Each row keeps its best ``4 * k`` centroids (16 at least) and walks on until all of
        them are expanded; a step costs the same whatever the number of centroids.
        """
        beam, rows, first = max(16, 4 * k), np.arange(len(vectors)), len(self.entries)
        seen = np.zeros((len(vectors), len(self.centers)), bool)
        seen[:, self.entries] = True
        node = np.zeros((len(vectors), beam), int)
        distance = np.full(node.shape, np.inf)
        node[:, :first] = self.entries
        distance[:, :first] = np.sqrt(squared(vectors, self.centers[self.entries]))
        done = np.zeros(node.shape, bool)
        while True:
            open_ = np.where(done, np.inf, distance)
            best = open_.argmin(1)
            active = np.flatnonzero(open_[rows, best] < np.inf)
            if not len(active):
                order = np.argsort(distance, axis=1, kind="stable")[:, :k]
                return np.take_along_axis(node, order, 1), np.take_along_axis(distance, order, 1)
            at = best[active]
            done[active, at] = True
            links = self.links[node[active, at]]
            row, place = np.nonzero(~seen[active[:, None], links])
            found = links[row, place]
            seen[active[row], found] = True
            reached = np.full(links.shape, np.inf)
            reached[row, place] = self.distances(vectors, active[row], found)
            every = np.hstack([distance[active], reached])
            keep = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            distance[active] = np.take_along_axis(every, keep, 1)
            node[active] = np.take_along_axis(np.hstack([node[active], links]), keep, 1)
            done[active] = np.take_along_axis(np.hstack([done[active], np.zeros(links.shape, bool)]), keep, 1)

    def search(self, vectors: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances to the centroids visited (infinite for others), walking in waves while any lies within reach."""
        least = min(least, len(self.centers))
        distance = np.full((len(vectors), len(self.centers)), np.inf)
        distance[:, self.entries] = np.sqrt(squared(vectors, self.centers[self.entries]))
        done = np.zeros(distance.shape, bool)
        while True:
            row, node = np.nonzero(~done & (distance < np.inf) & (distance <= self.reach(distance, ratio, least)[:, None]))
            if not len(row):
                return distance
            done[row, node] = True
            wanted = np.zeros(distance.shape, bool)
            for column in self.links.T:
                wanted[row, column[node]] = True
            row, node = np.nonzero(wanted & (distance == np.inf))
            distance[row, node] = self.distances(vectors, row, node)

    @staticmethod
    def reach(distance: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """How far a list may be: ``1 + ratio`` times the nearest, or the ``least``-th."""
        nearest = np.partition(distance, least - 1, axis=1)[:, :least]
        return np.maximum((1 + ratio) * nearest.min(1), nearest.max(1))


def _assign(graph: CentroidGraph, closure: float, copies: int):
    """Rows (ids, v) → one row for each list that the vector is on."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                lists, near = graph.closest(_matrix(part.column("v")), copies)
                row, place = np.nonzero((near <= (1 + closure) * near[:, :1]) & (near < np.inf))
                chosen = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[row, place].astype(np.int32)), chosen.column("ids"), chosen.column("v")], names=["list", "ids", "v"])

    return run


def _route(graph: CentroidGraph, ratio: float, least: int):
    """Queries (vec_id, v) → one row for each list to search."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, min(200, 2_000_000 // len(graph.centers)))
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                distance = graph.search(_matrix(part.column("v")), ratio, least)
                row, lists = np.nonzero(distance <= graph.reach(distance, ratio, min(least, distance.shape[1]))[:, None])
                chosen = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), chosen.column("vec_id"), chosen.column("v")], names=["list", "vec_id", "v"])

    return run


class Best:
    """The best ``k`` ids of each query over the lists that a task has scanned, as arrays of bounded length."""

    def __init__(self, k: int, limit: int = 1_000_000):
        self.k, self.limit, self.rows, self.parts = k, limit, 0, []

    def add(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> pa.RecordBatch | None:
        """Take in rows; beyond ``limit`` they are cut to the best and, if still many, given back."""
        self.parts.append((query, found, score))
        self.rows += len(query)
        if self.rows <= self.limit:
            return None
        self._cut()
        return self.take() if self.rows > self.limit // 2 else None

    def _cut(self) -> None:
        query, found, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((found, score, query))
        query, found, score = query[order], found[order], score[order]
        # Equal ids of a query have equal distances, so they stand side by side.
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1]) | (score[1:] != score[:-1])
        query, found, score = query[new], found[new], score[new]
        begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
        best = place < self.k
        self.parts, self.rows = [(query[best], found[best], score[best])], int(best.sum())

    def take(self) -> pa.RecordBatch | None:
        """The rows held, which are then forgotten."""
        if not self.rows:
            return None
        self._cut()
        columns, self.parts, self.rows = self.parts[0], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _scan_lists(k: int, block: int = 512):
    """Rows (list, part, query, ids, v), of each part the vectors before the queries: best ``k`` of the task for each query."""
    def best(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, own: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        count = np.array([len(i) for i in ids])
        flat, start = np.concatenate(ids).astype(np.int64), np.cumsum(count) - count
        n = min(k + 9, len(vectors))
        for begin in range(0, len(queries), block):
            asked = queries[begin:begin + block]
            top = np.argpartition(squared(asked, vectors), n - 1, axis=1)[:, :n]
            offset = asked[:, None] - vectors[top]
            exact = np.sqrt((offset * offset).sum(-1)).ravel()
            top = top.ravel()
            several = count[top]
            entry = np.repeat(np.arange(len(top)), several)
            found = flat[start[top][entry] + np.arange(len(entry)) - (np.cumsum(several) - several)[entry]]
            query = np.array(own[begin:begin + block], np.int64)[entry // n]
            other = found != query
            yield query[other], found[other], exact[entry[other]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, vectors, ids = None, [], []
        matrix = None
        held = Best(k)
        for batch in batches:
            spots = list(zip(batch.column("list").to_pylist(), batch.column("part").to_pylist()))
            queries, own_ids, v = batch.column("query").to_pylist(), batch.column("ids").to_pylist(), _matrix(batch.column("v"))
            row = 0
            while row < len(spots):
                if spots[row] != where:
                    where, vectors, ids, matrix = spots[row], [], [], None
                stop = row
                asking = queries[row] is not None
                while stop < len(spots) and spots[stop] == where and (queries[stop] is not None) == asking:
                    stop += 1
                if not asking:
                    vectors.append(v[row:stop].copy())
                    ids += own_ids[row:stop]
                elif ids:
                    matrix = np.concatenate(vectors) if matrix is None else matrix
                    for rows in best(matrix, ids, v[row:stop], queries[row:stop]):
                        if out := held.add(*rows):
                            yield out
                row = stop
        if out := held.take():
            yield out

    return run


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
            list_size: int = 128, max_lists: int = 16_384, sample: int = 40_000, closure: float = 0.12,
            copies: int = 4, ratio: float = 0.2, least_lists: int = 8) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows found for each row of ``queries``.

    k-means sees ``sample`` distinct vectors, those of smallest hash.
    """
    every = valid_vectors(table, vec_id, embedding)
    common = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dimension = common[0]["n"] if common else 0
    every = every.filter(F.size("v") == dimension)
    asked = valid_vectors(queries, vec_id, embedding).filter(F.size("v") == dimension)
    distinct = store(distinct_vectors(every, k + 1))
    n = distinct.count()
    spark = table.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    graph = CentroidGraph(balanced_means(np.array([r["v"] for r in rows]), max(1, min(max_lists, n // list_size))))
    on_lists = store(distinct.mapInArrow(_assign(graph, closure, copies), "list int, ids array<long>, v array<double>"))
    # One row for each list: at most ``max_lists``.
    parts = on_lists.groupBy("list").count().select("list", F.ceil(F.col("count") / (4 * list_size)).cast("int").alias("n_parts"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = on_lists.join(F.broadcast(parts), "list").select(
        "list", F.pmod(F.xxhash64("v"), F.col("n_parts")).cast("int").alias("part"), F.lit(None).cast("long").alias("query"), "ids", "v")
    routed = asked.mapInArrow(_route(graph, ratio, least_lists), "list int, vec_id long, v array<double>") \
        .join(F.broadcast(parts), "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.col("vec_id").alias("query"),
            F.array().cast("array<long>").alias("ids"), "v")
    found = stored.unionByName(routed).repartition(width, "list", "part") \
        .sortWithinPartitions("list", "part", F.col("query").asc_nulls_first()) \
        .mapInArrow(_scan_lists(k), "query_id long, vec_id long, score double")
    # A query has at most k rows from each task that searched for it, more only where a task's rows exceed a bound.
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, table.filter(F.col("vec_id") % 100 == 0))
