"""Ratings as rows (user_id, item_id, rating): scans, universes and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ratingspark.functions.vectors import finite_or_null, is_finite
from ratingspark.session import cut_lineage, shuffle_width

RATINGS_SCHEMA = "user_id long, item_id long, rating double"


def read_ratings(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan a ratings table; entries without a finite rating are absent."""
    return observed(spark.read.schema(RATINGS_SCHEMA).options(**options).format(fmt).load(path))


def observed(ratings: DataFrame, value: str = "rating") -> DataFrame:
    return ratings.where(is_finite(F.col(value)))


def melt(wide: DataFrame, row: str, values: Column, base: int = 0) -> DataFrame:
    """Rows of a matrix, given as arrays, to (row, col, rating) of observed cells."""
    cells = wide.select(row, F.posexplode(values).alias("col", "rating"))
    cells = cells.withColumn("rating", finite_or_null(F.col("rating").cast("double")))
    return cells.where(F.col("rating").isNotNull()).withColumn("col", F.col("col") + base)


def merge_ratings(train: DataFrame, test: DataFrame) -> DataFrame:
    """Union of two rating sets; where both have an entry, ``test`` wins."""
    keys = ["user_id", "item_id"]
    left = train.select(*keys, F.col("rating").alias("old"))
    right = observed(test).select(*keys, F.col("rating").alias("new"))
    return left.join(right, keys, "full_outer").select(*keys, F.coalesce("new", "old").alias("rating"))


def counts_per(ratings: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """Number of ratings of every user or item, 0 for the unrated."""
    counts = ratings.groupBy(key).agg(F.count("*").alias("n"))
    return universe.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """0-based position of each row in a total order, without a single-task sort.

    The sorted partitions are written first, so that their boundaries cannot
    change between counting and numbering.
    """
    width = shuffle_width(df.sparkSession)
    ordered = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ordered.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    position = F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)
    return (  # ``starts`` has one row per shuffle partition
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, position)
        .drop("_part", "_row", "_start")
    )


def flat_index(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Row-major cell number: position of the user times n_items plus that of the item.

    Ratings of users or items outside the universe keep their row; the number is NULL.
    """
    rows = global_rank(users.select("user_id"), ["user_id"], "user_pos")
    cols = global_rank(items.select("item_id"), ["item_id"], "item_pos")
    n_items = items.agg(F.count("*").alias("n_items"))
    return (
        ratings.join(rows, "user_id", "left")
        .join(cols, "item_id", "left")
        .join(F.broadcast(n_items))
        .withColumn("flat_index", F.col("user_pos") * F.col("n_items") + F.col("item_pos"))
    )
