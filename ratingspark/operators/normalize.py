"""Imputation and normalization of item features.

A feature table is (feature, item_id, x) with x an array of numbers. Column
statistics are gathered in one aggregation over all features and come back as
one small row per feature; the item rows themselves are never regrouped.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratingspark.functions.vectors import finite_or_null, is_finite, sum_of, sum_squares

METHODS = ("none", "row_l1", "row_l2", "col_zscore", "col_minmax")
IMPUTES = ("none", "col_median")
DTYPES = {"float32": "float", "float64": "double"}
DEFAULT_EPS = 1e-8
SKETCH_ACCURACY = 10_000


def scalar_feature(df: DataFrame, feature: str, item: str, value: Column) -> DataFrame:
    """A one-number-per-item attribute as a feature of one column."""
    return df.select(F.lit(feature).alias("feature"), F.col(item).alias("item_id"), F.array(value.cast("double")).alias("x"))


def indicator_feature(df: DataFrame, feature: str, item: str, category: str) -> DataFrame:
    """One 0/1 column per distinct value of ``category``, in sorted order."""
    levels = df.select(category).where(F.col(category).isNotNull()).distinct()
    levels = levels.agg(F.sort_array(F.collect_list(category)).alias("levels"))
    # One row: the list of levels, which is as wide as the feature itself.
    return df.join(F.broadcast(levels)).select(
        F.lit(feature).alias("feature"),
        F.col(item).alias("item_id"),
        F.transform("levels", lambda level: (F.col(category) == level).cast("double")).alias("x"),
    )


def nullify(features: DataFrame) -> DataFrame:
    """NaN and infinite values become NULL."""
    return features.withColumn("x", F.transform(F.col("x").cast("array<double>"), finite_or_null))


def nonfinite_counts(features: DataFrame) -> DataFrame:
    bad = F.size(F.filter(F.col("x").cast("array<double>"), lambda v: ~is_finite(v)))
    return features.groupBy("feature").agg(F.sum(bad).alias("n_bad"))


def require_finite(features: DataFrame) -> None:
    bad = nonfinite_counts(features).where(F.col("n_bad") > 0).collect()
    if bad:
        raise ValueError(f"features with NaN or infinite values: {[r.feature for r in bad]}")


def _columns(features: DataFrame) -> DataFrame:
    return features.select("feature", F.posexplode("x").alias("col", "value"))


def column_medians(features: DataFrame) -> DataFrame:
    """Exact median of the finite values per (feature, col); 0 if there is none.

    A sketch brackets the median, whose error is bounded by the accuracy; the
    exact one is then found among the few distinct values inside the bracket.
    """
    cells = _columns(nullify(features))
    slack = 2.0 / SKETCH_ACCURACY
    bracket = cells.groupBy("feature", "col").agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", [0.5 - slack, 0.5 + slack], SKETCH_ACCURACY).alias("band"),
    )
    near = cells.where(F.col("value").isNotNull()).join(F.broadcast(bracket), ["feature", "col"])  # one row per column
    low, high = F.element_at("band", 1), F.element_at("band", 2)
    below = near.groupBy("feature", "col").agg(F.count_if(F.col("value") < low).alias("below"))
    inside = (
        near.where(F.col("value").between(low, high))
        .groupBy("feature", "col", "n", "value")
        .agg(F.count("*").alias("times"))
    )
    up_to = Window.partitionBy("feature", "col").orderBy("value")
    placed = inside.join(F.broadcast(below), ["feature", "col"]).withColumn("upto", F.col("below") + F.sum("times").over(up_to))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # 0-based middle ranks
    middle = placed.groupBy("feature", "col").agg(
        ((F.min(F.when(F.col("upto") > first, F.col("value"))) + F.min(F.when(F.col("upto") > second, F.col("value")))) / 2)
        .alias("median")
    )
    return bracket.join(F.broadcast(middle), ["feature", "col"], "left").select(
        "feature", "col", F.coalesce("median", F.lit(0.0)).alias("median")
    )


def _as_rows(stats: DataFrame, *names: str) -> DataFrame:
    """One row per feature, each statistic an array in column order."""
    packed = stats.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("col", *names))).alias("s"))
    return packed.select("feature", *[F.col(f"s.{n}").alias(n) for n in names])


def impute_medians(features: DataFrame) -> DataFrame:
    clean = nullify(features)
    medians = _as_rows(column_medians(features), "median")
    filled = F.zip_with("x", "median", lambda value, median: F.coalesce(value, median))
    # One row per feature: shuffled, all rows of a feature would meet in one task.
    return clean.join(F.broadcast(medians), "feature").withColumn("x", filled).drop("median")


def _scale_rows(features: DataFrame, size: Column, eps: float) -> DataFrame:
    bounded = F.greatest(size, F.lit(eps))
    return features.withColumn("_size", bounded).withColumn("x", F.transform("x", lambda v: v / F.col("_size"))).drop("_size")


def _scale_columns(features: DataFrame, method: str, eps: float) -> DataFrame:
    cells = _columns(features).groupBy("feature", "col")
    if method == "col_zscore":
        stats = cells.agg(F.avg("value").alias("shift"), F.stddev_pop("value").alias("scale"))
        stats = stats.withColumn("scale", F.when(F.col("scale") < eps, 1.0).otherwise(F.col("scale")))
    else:
        stats = cells.agg(F.min("value").alias("shift"), (F.max("value") - F.min("value")).alias("scale"))
        stats = stats.withColumn("scale", F.greatest("scale", F.lit(eps)))
    pairs = F.arrays_zip("shift", "scale")
    scaled = F.zip_with("x", pairs, lambda value, s: (value - s["shift"]) / s["scale"])
    out = features.join(F.broadcast(_as_rows(stats, "shift", "scale")), "feature").withColumn("x", scaled).drop("shift", "scale")
    if method == "col_zscore":
        out = out.withColumn("x", F.transform("x", lambda v: F.coalesce(finite_or_null(v), F.lit(0.0))))
    return out


def normalize_feature(
    features: DataFrame,
    method: str = "none",
    *,
    impute: str = "none",
    eps: float = DEFAULT_EPS,
    dtype: str = "float32",
) -> DataFrame:
    """Impute (or check), scale and cast every feature in the table alike."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if impute not in IMPUTES:
        raise ValueError(f"unknown impute {impute!r}")
    rows = features.select("feature", "item_id", F.col("x").cast("array<double>").alias("x"))
    if impute == "col_median":
        rows = impute_medians(rows)
    else:
        require_finite(rows)
    if method == "row_l1":
        rows = _scale_rows(rows, sum_of(F.col("x"), F.abs), eps)
    elif method == "row_l2":
        rows = _scale_rows(rows, F.sqrt(sum_squares(F.col("x"))), eps)
    elif method != "none":
        rows = _scale_columns(rows, method, eps)
    return rows.select("feature", "item_id", F.col("x").cast(f"array<{DTYPES[dtype]}>").alias("x"))


def normalize_features(
    features: DataFrame,
    *,
    method: str = "none",
    impute: str = "none",
    eps: float = DEFAULT_EPS,
    dtype: str = "float32",
    overrides: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Shared settings with overrides per feature.

    Features with equal settings are handled in one pass. The element type of
    the result is double as soon as any feature asks for float64.
    """
    base = {"method": method, "impute": impute, "eps": eps, "dtype": dtype}
    names = [r.feature for r in features.select("feature").distinct().orderBy("feature").collect()]
    groups: dict[tuple, list[str]] = {}
    for name in names:
        own = dict((overrides or {}).get(name, {}))
        unknown = set(own) - set(base)
        if unknown:
            raise TypeError(f"unknown settings for feature {name!r}: {sorted(unknown)}")
        groups.setdefault(tuple({**base, **own}.items()), []).append(name)
    parts = [
        normalize_feature(features.where(F.col("feature").isin(members)), **dict(settings))
        for settings, members in groups.items()
    ]
    if any(dict(s)["dtype"] == "float64" for s in groups):
        parts = [p.withColumn("x", F.col("x").cast("array<double>")) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def coverage(features: DataFrame, items: DataFrame) -> DataFrame:
    """Per feature: items without a row, rows without an item, repeated items."""
    names = features.select("feature").distinct()
    rows = features.groupBy("feature", "item_id").agg(F.count("*").alias("n"))
    known = items.select("item_id").withColumn("known", F.lit(1))
    n_items = items.agg(F.count("*").alias("n_items"))
    seen = rows.join(known, "item_id", "left").groupBy("feature").agg(
        F.count("known").alias("covered"),
        F.count_if(F.col("known").isNull()).alias("n_unknown"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
    )
    return names.join(seen, "feature").join(F.broadcast(n_items)).select(
        "feature", (F.col("n_items") - F.col("covered")).alias("n_missing"), "n_unknown", "n_repeated"
    )
