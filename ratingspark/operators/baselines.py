"""Predictions from means alone: the rank-0 part of the model.

Means over "all folds but this one" come from totals minus the fold's own sums,
so the ratings are not repeated once per fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ratingspark.plans.config import EPS
from ratingspark.session import cut_lineage


def user_bias(ratings: DataFrame, penalty: float) -> DataFrame:
    """(user_id, b_u): shrunken mean deviation from the global mean."""
    return _bias(ratings.join(F.broadcast(_mean(ratings))), "user_id", "b_u", F.col("rating") - F.col("mu"), penalty)


def item_bias(ratings: DataFrame, users: DataFrame, penalty: float) -> DataFrame:
    """(item_id, b_i): shrunken mean of what the user biases leave."""
    rows = ratings.join(F.broadcast(_mean(ratings))).join(users, "user_id")
    return _bias(rows, "item_id", "b_i", F.col("rating") - F.col("mu") - F.col("b_u"), penalty)


def _mean(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.avg("rating").alias("mu"))  # one row


def _bias(rows: DataFrame, key: str, name: str, left, penalty: float) -> DataFrame:
    return rows.groupBy(key).agg((F.sum(left) / (F.count("*") + penalty + EPS)).alias(name))


def fold_means(folded: DataFrame) -> DataFrame:
    """(fold, mu): mean rating outside each fold; one row per fold."""
    sums = folded.groupBy("fold").agg(F.count("*").alias("n"), F.sum("rating").alias("s"))
    everything = Window.partitionBy(F.lit(0))
    mu = (F.sum("s").over(everything) - F.col("s")) / (F.sum("n").over(everything) - F.col("n"))
    return sums.select("fold", mu.alias("mu"))


def _outside(folded: DataFrame, key: str, prefix: str) -> DataFrame:
    """Count and sum per (key, fold) of the key's ratings outside the fold."""
    sums = folded.groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum("rating").alias("s"))
    whole = Window.partitionBy(key)  # one row per fold
    return sums.select(
        key,
        "fold",
        (F.sum("n").over(whole) - F.col("n")).alias(f"n_{prefix}"),
        (F.sum("s").over(whole) - F.col("s")).alias(f"s_{prefix}"),
    )


def held_out_guesses(folded: DataFrame, settings: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(variant, user_id, item_id, fold, rating, prediction) for every rating.

    A setting is (name, user penalty, item penalty); None leaves the bias out.
    The prediction uses only ratings of other folds.
    """
    folded = cut_lineage(folded)  # read four times below; its folds come from a sort of all ratings
    rows = (
        folded.join(_outside(folded, "user_id", "u"), ["user_id", "fold"])
        .join(_outside(folded, "item_id", "i"), ["item_id", "fold"])
        .join(F.broadcast(fold_means(folded)), "fold")
    )

    def bias(side: str, penalty: float | None):
        if penalty is None:
            return F.lit(0.0)
        n = F.col(f"n_{side}")
        return (F.col(f"s_{side}") - F.col("mu") * n) / (n + penalty + EPS)

    guesses = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), (F.col("mu") + bias("u", lu) + bias("i", li)).alias("prediction"))
            for name, lu, li in settings
        ]
    )
    return rows.select("user_id", "item_id", "fold", "rating", F.explode(guesses).alias("g")).select(
        "g.variant", "user_id", "item_id", "fold", "rating", "g.prediction"
    )


def item_errors(guesses: DataFrame) -> DataFrame:
    """(variant, fold, item_id, n, sq_err): additive errors for later grouping."""
    left = F.col("rating") - F.col("prediction")
    return guesses.groupBy("variant", "fold", "item_id").agg(
        F.count("*").alias("n"), F.sum(left * left).alias("sq_err")
    )


def fold_scores(guesses: DataFrame) -> DataFrame:
    """(variant, fold, rmse)."""
    left = F.col("rating") - F.col("prediction")
    return guesses.groupBy("variant", "fold").agg(F.sqrt(F.avg(left * left)).alias("rmse"))
