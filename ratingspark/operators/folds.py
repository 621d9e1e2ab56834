"""Entrywise cross-validation folds over the observed ratings."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ratingspark.functions.portable import order_key
from ratingspark.sources.ratings import global_rank, observed
from ratingspark.session import shuffle_width

KEYS = ["user_id", "item_id"]
META_SCHEMA = "n_users long, n_items long, n_splits int, seed long"


def fold_of_rank(rank: Column, total: Column, n_splits: int) -> Column:
    """Near-equal split: the first ``total mod n_splits`` folds get one extra row."""
    size = F.floor(total / F.lit(n_splits))
    extra = total % F.lit(n_splits)
    edge = extra * (size + 1)
    late = extra + F.floor((rank - edge) / F.greatest(size, F.lit(1)))
    return F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(late).cast("int")


def with_ranges(ratings: DataFrame, seed: int = 42) -> DataFrame:
    """Observed ratings with ``_range``, the range of their digest of (seed, user, item).

    Equal ranges hold nearly equal shares of the rows whatever the skew of users or items.
    """
    n_ranges = 64 * shuffle_width(ratings.sparkSession)
    head = F.conv(F.substring(order_key(seed, F.col("user_id"), F.col("item_id")), 1, 8), 16, 10).cast("long")
    return observed(ratings).withColumn("_range", F.floor(head * F.lit(n_ranges) / F.lit(4294967296)).cast("int"))


def assign_folds(ratings: DataFrame, n_splits: int = 5, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """``ratings`` with a ``fold`` column in 0..n_splits-1.

    Shuffled order is the order of a digest of (seed, user, item). Ranks come from counting
    ranges of it (``with_ranges``; a table that has them, say a cached one, is taken as it is) and
    numbering within them. All rows of a range have one fold unless a fold ends inside
    it, so only the rows of such ranges, at most ``n_splits - 1``, are shuffled and numbered.
    """
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    if not shuffle:
        ranked = global_rank(observed(ratings), KEYS)
        total = F.broadcast(ranked.agg(F.count("*").alias("_total")))
        ranked = ranked.join(total)
        fold = fold_of_rank(F.col("rank"), F.col("_total"), n_splits)
        return ranked.select(*ratings.columns, fold.alias("fold"))
    rows = ratings if "_range" in ratings.columns else with_ranges(ratings, seed)
    columns = [c for c in ratings.columns if c != "_range"]
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_range", "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.orderBy(F.lit(1)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    first, last = (fold_of_rank(r, F.col("_total"), n_splits) for r in (F.col("_start"), F.col("_start") + F.col("_size") - 1))
    known = starts.select("_range", "_start", "_total", first.alias("_first"), last.alias("_last")).toArrow()  # n_ranges rows
    same = pc.equal(known["_first"], known["_last"])
    whole, cut = (F.broadcast(ratings.sparkSession.createDataFrame(known.filter(keep))) for keep in (same, pc.invert(same)))
    placed = rows.join(whole, "_range").select(*columns, F.col("_first").alias("fold"))
    within = Window.partitionBy("_range").orderBy("_key", *KEYS)
    ranked = rows.join(cut, "_range").withColumn("_key", order_key(seed, F.col("user_id"), F.col("item_id"))).withColumn(
        "rank", F.col("_start") + F.row_number().over(within) - 1
    )
    fold = fold_of_rank(F.col("rank"), F.col("_total"), n_splits)
    return placed.unionByName(ranked.select(*columns, fold.alias("fold")))


def train_split(folded: DataFrame, fold: int) -> DataFrame:
    return folded.where(F.col("fold") != fold)


def valid_split(folded: DataFrame, fold: int) -> DataFrame:
    return folded.where(F.col("fold") == fold)


def train_by_keys(ratings: DataFrame, valid_keys: DataFrame) -> DataFrame:
    """Observed ratings whose key is not listed."""
    return observed(ratings).join(valid_keys.select(*KEYS), KEYS, "left_anti")


def valid_by_keys(ratings: DataFrame, valid_keys: DataFrame) -> DataFrame:
    """Listed keys with their rating; NULL where there is none."""
    return valid_keys.select(*KEYS).join(ratings.select(*KEYS, "rating"), KEYS, "left")


def fold_check(folded: DataFrame) -> DataFrame:
    """One row: rows, distinct keys and whether the folds partition them."""
    per_key = folded.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count("fold").alias("placed"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        (F.sum("placed") == F.count("*")).alias("is_partition"),
    )


def save_folds(folded: DataFrame, path: str, n_users: int, n_items: int, n_splits: int, seed: int) -> None:
    folded.select(*KEYS, "fold").write.mode("overwrite").partitionBy("fold").parquet(f"{path}/folds")
    meta = folded.sparkSession.createDataFrame([(n_users, n_items, n_splits, seed)], META_SCHEMA)
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_folds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    folds = spark.read.schema("user_id long, item_id long, fold int").parquet(f"{path}/folds")
    return folds, spark.read.schema(META_SCHEMA).json(f"{path}/meta")


def fold_guard(folds: DataFrame, meta: DataFrame, ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """One row of differences between saved folds and the data; all zero if they fit."""
    unknown = folds.join(ratings.select(*KEYS), KEYS, "left_anti").agg(F.count("*").alias("unknown_keys"))
    shape = users.agg(F.count("*").alias("_m")).join(items.agg(F.count("*").alias("_n")))
    return meta.join(shape).join(unknown).select(
        (F.col("_m") - F.col("n_users")).alias("user_gap"),
        (F.col("_n") - F.col("n_items")).alias("item_gap"),
        "unknown_keys",
    )


def require_matching_folds(*args: DataFrame) -> None:
    row = fold_guard(*args).first()
    if row is None or any(value != 0 for value in row):
        raise ValueError(f"the folds were built for other data: {row}")
