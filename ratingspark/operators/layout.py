"""Ratings clustered for one side of the alternating fit.

A half step needs, for every user (or item), the state of all items (or users)
on the other side. Joining that state to each rating would shuffle one vector
per rating. Instead the ratings are clustered once into blocks, and each
iteration ships a state row at most once per block that mentions it.

A user or item with more than ``max_rows`` ratings is cut into several parts,
so no block depends on how popular its members are; the sums over the parts are
added up afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratingspark.session import shuffled, width_for

MAX_ROWS = 1_000_000  # ratings of one block, and of one part of a cut entity
MAX_LABELS = 4_096
BROADCAST_ROWS = 200_000


@dataclass
class Layout:
    ratings: DataFrame  # block, own, other, rating, fold, split
    route: DataFrame  # other, block, n: which blocks need which state rows, and for how many ratings
    hot: DataFrame | None  # own, block: where the parts of cut entities lie
    labels: list[int] | None
    n_blocks: int
    block_rows: int  # about how many ratings a block holds
    width: int = 0  # partitions of ``ratings`` and ``route``
    scratch: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame) -> None:
        """Remember a cached intermediate result until the step is written."""
        self.scratch.append(df)

    def drop_scratch(self) -> None:
        while self.scratch:
            self.scratch.pop().unpersist()

    def block_of(self, own: Column, part: Column | int = 0) -> Column:
        part = F.lit(part) if isinstance(part, int) else part
        slot = F.pmod(F.xxhash64(own, part.cast("int")), F.lit(self.n_blocks)).cast("int")
        if self.labels is None:
            return slot
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), slot + 1)

    def own_blocks(self, state: DataFrame) -> DataFrame:
        """``state`` (keyed by ``id``) with the block or blocks that hold it."""
        if self.hot is None:
            return state.withColumn("block", self.block_of(F.col("id")))
        # Only blocks that hold ratings of a cut entity, each once: two parts may share a block.
        hot = self.hot.select(F.col("own").alias("id"), F.col("block").alias("hot_block"))
        placed = state.join(hot, "id", "left")
        return placed.withColumn("block", F.coalesce("hot_block", self.block_of(F.col("id")))).drop("hot_block")

    def routed(self, state: DataFrame) -> DataFrame:
        """``state`` (keyed by ``id``) of the other side, once for each block that needs it."""
        return shuffled(state).join(self.route.select(F.col("other").alias("id"), "block"), "id")

    def side_by_side(self, state: DataFrame) -> DataFrame:
        """``state`` (run_id, id, packed), one row per id: the vectors of all runs in the order of ``run_id``.

        Dealt like the route, so that joining the two moves nothing; a row that goes to many blocks has its keys once, not once per run.
        """
        runs = F.array_sort(F.collect_list(F.struct("run_id", "packed")))
        rows = state.repartition(self.width, "id").groupBy("id").agg(runs.alias("runs"))
        return rows.select("id", F.flatten("runs.packed").alias("packed"))

    def others(self) -> DataFrame:
        """(other, count): ids of the other side and their ratings, without a shuffle."""
        return self.route.groupBy("other").agg(F.sum("n").alias("count"))

    def release(self) -> None:
        self.drop_scratch()
        self.ratings.unpersist()
        self.route.unpersist()
        if self.hot is not None:
            self.hot.unpersist()


def balanced_labels(spark: SparkSession, n_blocks: int, width: int) -> list[int] | None:
    """Block numbers that hash partitioning spreads evenly over ``width`` partitions.

    Hashing 0..n-1 into about n partitions leaves a third of them empty. With
    very many blocks the law of large numbers does the job and no list is used.
    """
    if n_blocks > MAX_LABELS:
        return None
    per_slot = -(-n_blocks // width)
    tried = max(64, width * (per_slot + 12) * 3)
    rows = (
        spark.range(tried, numPartitions=1)
        .select(F.col("id").cast("int").alias("label"))
        .select("label", F.pmod(F.hash("label"), F.lit(width)).alias("slot"))
        .collect()
    )
    slots: dict[int, list[int]] = {}
    for row in rows:
        slots.setdefault(row.slot, []).append(row.label)
    labels = [
        slots[s][turn]
        for turn in range(per_slot)
        for s in range(width)
        if turn < len(slots.get(s, ()))
    ]
    return labels[:n_blocks] if len(labels) >= n_blocks else None


def build_layout(
    ratings: DataFrame, own: str, other: str, n_rows: int, max_rows: int = MAX_ROWS, counts: DataFrame | None = None
) -> Layout:
    """Cluster ``ratings`` (user_id, item_id, rating, fold) by ``own``.

    ``counts`` (own, count), if known, spares counting the ratings of each owner.
    """
    spark = ratings.sparkSession
    width = width_for(spark, n_rows)
    n_blocks = width * max(1, -(-n_rows // (width * max_rows)))
    labels = balanced_labels(spark, n_blocks, width)

    base = ratings.select(
        F.col(own).alias("own"), F.col(other).alias("other"), "rating", "fold"
    )
    hot = (
        (base.groupBy("own").count() if counts is None else counts)
        .where(F.col("count") > max_rows)
        .select("own", F.ceil(F.col("count") / F.lit(float(max_rows))).cast("int").alias("parts"))
        .persist()
    )
    cut = not hot.isEmpty()
    if not cut:
        layout = Layout(None, None, None, labels, n_blocks, -(-n_rows // n_blocks), width)
        placed = base.withColumn("split", F.lit(False)).withColumn("part", F.lit(0))
    else:
        layout = Layout(None, None, None, labels, n_blocks, -(-n_rows // n_blocks), width)
        # There are at most n_rows / max_rows such entities.
        small = F.broadcast(hot) if n_rows // max_rows <= BROADCAST_ROWS else hot
        placed = (
            base.join(small, "own", "left")
            .withColumn("split", F.col("parts").isNotNull())
            .withColumn(
                "part",
                F.pmod(F.xxhash64("other"), F.coalesce(F.col("parts"), F.lit(1))).cast("int"),
            )
            .drop("parts")
        )
    placed = placed.withColumn("block", layout.block_of(F.col("own"), F.col("part"))).drop("part")
    layout.ratings = (
        placed.repartition(width, "block")
        .sortWithinPartitions("block")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    layout.ratings.count()  # the cached partitioning is known only once it is filled
    hot.unpersist()
    if cut:
        layout.hot = layout.ratings.where("split").select("own", "block").distinct().persist()
    layout.route = (
        layout.ratings.groupBy("other", "block")
        .agg(F.count("*").alias("n"))
        .repartition(width, "other")
        .sortWithinPartitions("other")  # kept so, each half step merges without sorting it again
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    layout.route.count()
    return layout


def require_unique(layout: Layout) -> None:
    """Raise if some user has two ratings of an item.

    Both lie in the same block, also when the user or item is cut into parts, so the grouping needs
    no shuffle beyond that of the layout.
    """
    twice = layout.ratings.groupBy("block", "own", "other").count().where("count > 1").take(3)
    if twice:
        raise ValueError("ratings given more than once: " + ", ".join(f"({r.own}, {r.other}) {r['count']} times" for r in twice))
