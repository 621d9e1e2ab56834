"""Item similarity graph from one feature, and its use in the item step."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratingspark.functions.keyed_sums import sum_vectors
from ratingspark.functions.vectors import dot, sum_squares
from ratingspark.operators.half_steps import OTHER, _Block, _by_run, _list_array, _matrix, _state_rows, pack
from ratingspark.operators.layout import Layout, build_layout
from ratingspark.operators.neighbours import top_neighbours
from ratingspark.plans.config import Run
from ratingspark.session import shuffle_width, shuffled


def unit_vectors(features: DataFrame, feature: str, eps: float) -> DataFrame:
    """(item_id, unit): each vector over (its norm + eps)."""
    x = F.col("x").cast("array<double>")
    norm = F.sqrt(sum_squares(x)) + F.lit(eps)
    return (
        features.where(F.col("feature") == feature)
        .withColumn("norm", norm)
        .select("item_id", F.transform(x, lambda v: v / F.col("norm")).alias("unit"))
    )


def symmetrize(edges: DataFrame) -> DataFrame:
    """Larger of the two directions; a direction that was dropped counts as 0."""
    both = edges.unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
    )
    largest = both.groupBy("src", "dst").agg(F.max("sim").alias("top"), F.count("*").alias("ways"))
    sim = F.when(F.col("ways") > 1, F.col("top")).otherwise(F.greatest(F.col("top"), F.lit(0.0)))
    return largest.select("src", "dst", sim.alias("sim")).where(F.col("sim") != 0)


def edge_violations(edges: DataFrame, items: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(rule, src, dst) of edges that no graph of ``items`` can have, one row per rule and directed edge.

    Both ends have to be items, an edge stands once, has its reverse with the same similarity,
    is no loop and is finite. One grouping by unordered pair answers all but the first;
    no pair is compared with another.
    """
    forward = F.coalesce(F.col("src") <= F.col("dst"), F.lit(True))  # a missing end is an unknown one
    pairs = edges.select(
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("b"),
        forward.alias("forward"), F.col("sim").cast("double").alias("sim"))
    finite = F.col("sim").isNotNull() & ~F.isnan("sim") & (F.abs("sim") < float("inf"))
    of = lambda side, value: F.when(F.col("forward") if side else ~F.col("forward"), value)
    # A grouped row is wide, and Spark would merge partitions by their packed size; dealt out so, a task holds its share of rows.
    pairs = pairs.repartition(shuffle_width(edges.sparkSession), "a", "b")
    sides = pairs.groupBy("a", "b").agg(*[
        expression.alias(name + tag) for tag, side in (("_ab", True), ("_ba", False)) for name, expression in (
            ("n", F.count(of(side, F.lit(1)))), ("low", F.min(of(side, F.col("sim")))), ("high", F.max(of(side, F.col("sim")))),
            ("bad", F.count_if(of(side, ~finite))))])
    known = items.select("item_id").distinct()
    for end in ("a", "b"):
        sides = sides.join(known.select(F.col("item_id").alias(end), F.lit(True).alias("known_" + end)), end, "left")
    loop = F.col("a").eqNullSafe(F.col("b"))
    unlike = (F.abs(F.col("low_ab") - F.col("low_ba")) > tolerance) | (F.abs(F.col("high_ab") - F.col("high_ba")) > tolerance)
    one_way = ~loop & ((F.col("n_ab") == 0) | (F.col("n_ba") == 0) | F.coalesce(unlike, F.lit(True)))
    unknown = F.col("known_a").isNull() | F.col("known_b").isNull()

    def rows(tag: str, src: str, dst: str) -> DataFrame:
        here = F.col("n" + tag) > 0
        rules = F.filter(F.array(
            F.when(here & unknown, "unknown end"), F.when(here & (F.col("n" + tag) > 1), "repeated"), F.when(here & one_way, "one way"),
            F.when(here & loop, "self"), F.when(here & (F.col("bad" + tag) > 0), "not finite")), lambda r: r.isNotNull())
        return F.transform(rules, lambda r: F.struct(r.alias("rule"), F.col(src).alias("src"), F.col(dst).alias("dst")))

    both = F.concat(rows("_ab", "a", "b"), rows("_ba", "b", "a"))
    return sides.select(F.explode(both).alias("e")).select("e.*")


def check_edges(name: str, edges: DataFrame, items: DataFrame) -> None:
    """Raise, with examples, if ``edges`` is no symmetric graph of ``items``."""
    bad = edge_violations(edges, items).take(5)
    if bad:
        raise ValueError(f"edges of graph {name!r}: " + ", ".join(f"{r.rule} {r.src} -> {r.dst}" for r in bad))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("sim").alias("degree"))


def similarity_graph(features: DataFrame, feature: str, topk: int, eps: float) -> DataFrame:
    return symmetrize(top_neighbours(unit_vectors(features, feature, eps), topk))


def neighbour_sums(layout: Layout, items: DataFrame, ranks: dict[int, int]) -> DataFrame:
    """(run_id, id, graph): degree, then weighted sum of neighbour vectors."""
    routed = layout.routed(pack(items))
    state = _state_rows(OTHER, routed)

    def pull(edges: pa.Table, state: pa.Table) -> pa.Table:
        block = _Block(edges)
        ids, starts = np.unique(block.own, return_index=True)
        split = block.split[starts] if len(ids) else block.split
        tables = []
        for run_id, _, other in _by_run(state):
            if not len(ids):
                break
            _, at = block.positions(ids, other["id"].to_numpy())
            vectors = _matrix(other["packed"], 1 + ranks[run_id])[at, 1:]
            weighted = np.c_[block.rating, block.rating[:, None] * vectors]
            tables.append(
                pa.table(
                    [
                        pa.array(np.full(len(ids), run_id, dtype=np.int32)),
                        pa.array(ids),
                        pa.array(split),
                        _list_array(np.add.reduceat(weighted, starts, axis=0), len(ids)),
                    ],
                    names=["run_id", "id", "split", "vec"],
                )
            )
        empty = pa.schema(
            [("run_id", pa.int32()), ("id", pa.int64()), ("split", pa.bool_()), ("vec", pa.list_(pa.float64()))]
        ).empty_table()
        return pa.concat_tables(tables) if tables else empty

    part = (
        layout.ratings.groupBy("block")
        .cogroup(state.groupBy("block"))
        .applyInArrow(pull, "run_id int, id long, split boolean, vec array<double>")
    )
    if layout.hot is None:
        total = part.select("run_id", "id", "vec")
    else:
        part = part.persist()
        layout.keep(part)
        total = part.where(~F.col("split")).select("run_id", "id", "vec").unionByName(
            sum_vectors(part.where("split"), ["run_id", "id"])
        )
    return total.withColumnRenamed("vec", "graph")


def full_graph_sums(units: DataFrame, items: DataFrame) -> DataFrame:
    """Like ``neighbour_sums`` for the complete graph, without any edge.

    With all cosines kept, S = X X' minus its diagonal, so S V = X (X' V) minus
    the diagonal part: two passes over the items instead of all pairs.
    """
    joined = shuffled(items).join(units.withColumnRenamed("item_id", "id"), "id")
    rows = joined.select("run_id", "vec", "unit")

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for run_id in np.unique(table["run_id"].to_numpy()):
                part = table.filter(pa.array(table["run_id"].to_numpy() == run_id))
                unit, vec = _matrix(part["unit"]), _matrix(part["vec"])
                flat = (unit.T @ np.c_[np.ones(len(vec)), vec]).ravel()
                totals[run_id] = totals.get(run_id, 0.0) + flat
        for run_id, flat in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([run_id], pa.int32()), _list_array(flat[None, :], 1)], names=["run_id", "vec"]
            )

    sums = sum_vectors(rows.mapInArrow(outer, "run_id int, vec array<double>"), ["run_id"])
    totals = {r.run_id: np.array(r.vec) for r in sums.collect()}  # d x (k + 1) numbers per run

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for run_id in np.unique(table["run_id"].to_numpy()):
                part = table.filter(pa.array(table["run_id"].to_numpy() == run_id))
                unit, vec = _matrix(part["unit"]), _matrix(part["vec"])
                reach = unit @ totals[int(run_id)].reshape(unit.shape[1], -1)
                reach -= np.sum(unit * unit, axis=1)[:, None] * np.c_[np.ones(len(vec)), vec]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["run_id"].combine_chunks(),
                        part["id"].combine_chunks(),
                        _list_array(reach, len(vec)),
                    ],
                    names=["run_id", "id", "graph"],
                )

    return joined.select("run_id", "id", "vec", "unit").mapInArrow(
        apply, "run_id int, id long, graph array<double>"
    )


class GraphStore:
    """Graphs in use, one per (feature, topk, eps), built when first needed."""

    def __init__(self, features: DataFrame | None, edges: dict[str, DataFrame]):
        self.features = features
        self.edges = edges
        self.names: set[str] = set()
        self.n_items = 0
        if features is not None:
            rows = features.groupBy("feature").agg(F.count("*").alias("n")).collect()
            self.names = {r.feature for r in rows}
            self.n_items = max((r.n for r in rows), default=0)
        self.layouts: dict[tuple, Layout] = {}
        self.units: dict[tuple, DataFrame] = {}

    def _layout(self, key: tuple) -> Layout:
        feature, topk, eps = key
        edges = self.edges.get(feature)
        if edges is None:
            edges = similarity_graph(self.features, feature, topk, eps)
        edges = edges.persist()
        stats = degrees(edges).agg(F.min("degree").alias("low"), F.count("*").alias("n")).first()
        if stats.low is not None and stats.low < 0:
            warnings.warn(f"graph of {feature!r} has negative degrees; the item system may be indefinite")
        table = edges.select("src", "dst", F.col("sim").alias("rating"), F.lit(-1).alias("fold"))
        layout = build_layout(table, "src", "dst", edges.count())
        edges.unpersist()
        return layout

    def usable(self, runs: list[Run]) -> set[int]:
        """Ids of the runs that use a graph; a missing feature switches it off."""
        found = set()
        for run in runs:
            if not run.config.uses_graph:
                continue
            if run.config.graph_feature in self.names or run.config.graph_feature in self.edges:
                found.add(run.run_id)
            else:
                warnings.warn(f"graph feature {run.config.graph_feature!r} not found; run {run.run_id} uses no graph")
        return found

    def attach(self, items: DataFrame, active: list[Run], using: set[int]) -> DataFrame:
        """Items with ``graph`` (degree, neighbour sum) for the runs in ``using``."""
        by_key: dict[tuple, list[Run]] = {}
        for run in active:
            if run.run_id in using:
                by_key.setdefault(run.config.graph_key, []).append(run)
        pulls = None
        for key, runs in by_key.items():
            feature, topk, eps = key
            part = items.where(F.col("run_id").isin([r.run_id for r in runs])).select("run_id", "id", "vec", "bias")
            given = feature in self.edges
            if not given and (not topk or topk >= self.n_items):
                if key not in self.units:
                    self.units[key] = unit_vectors(self.features, feature, eps).persist()
                sums = full_graph_sums(self.units[key], part)
            else:
                if key not in self.layouts:
                    self.layouts[key] = self._layout(key)
                layout = self.layouts[key]
                layout.drop_scratch()
                sums = neighbour_sums(layout, part, {r.run_id: r.config.n_factors for r in runs})
            pulls = sums if pulls is None else pulls.unionByName(sums)
        if pulls is None:
            return items
        none = F.concat(F.array(F.lit(0.0)), F.transform("vec", lambda v: F.lit(0.0)))
        wanted = F.col("run_id").isin(sorted(using))
        return shuffled(items).join(pulls, ["run_id", "id"], "left").withColumn(
            "graph", F.when(wanted, F.coalesce("graph", none))
        )

    def release(self) -> None:
        for layout in self.layouts.values():
            layout.release()
        for df in self.units.values():
            df.unpersist()


def cosine_row_sums(features: DataFrame, feature: str, eps: float) -> DataFrame:
    """(src, degree): row sums of the complete cosine matrix, zero diagonal."""
    units = unit_vectors(features, feature, eps)
    total = sum_vectors(units.select(F.lit(0).alias("all"), F.col("unit").alias("vec")), ["all"])
    # One row: the sum of all unit vectors.
    return units.join(F.broadcast(total.select(F.col("vec").alias("total")))).select(
        F.col("item_id").alias("src"),
        (dot(F.col("unit"), F.col("total")) - sum_squares(F.col("unit"))).alias("degree"),
    )
