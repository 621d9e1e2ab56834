"""One rating model: fit, predict, recommend, save and load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratingspark.operators.scoring import completed_rows, predict_pairs
from ratingspark.operators.topn import recommend
from ratingspark.plans.config import ModelConfig, Run
from ratingspark.plans.fit import HISTORY_SCHEMA, fit_runs, prepare


@dataclass(frozen=True)
class FittedModel:
    """Immutable result of a fit. State tables carry ``run_id`` 0."""

    config: ModelConfig
    users: DataFrame  # run_id, user_id, u, b_u
    items: DataFrame  # run_id, item_id, v, b_i, z
    mu: float
    history: DataFrame  # run_id, iter, mu, train_rmse, norms
    projections: dict[str, list[list[float]]]

    def _items(self, use_features: bool) -> DataFrame:
        return self.items if use_features else self.items.withColumn("z", F.col("v"))

    def _given(self, features: DataFrame) -> DataFrame:
        """Items under ``features`` (feature, item_id, x) instead of those of the fit.

        A feature that is not given adds nothing; an item without a row of a given feature, likewise.
        """
        rows = features.groupBy("feature").agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).collect()
        for row in rows:
            if row.feature not in self.projections:
                raise ValueError(f"the model knows no feature {row.feature!r}")
            width = len(self.projections[row.feature])
            if (row.low, row.high) != (width, width):
                raise ValueError(f"feature {row.feature!r} has {row.low} to {row.high} numbers, the model {width}")
        items = self.items.withColumn("z", F.col("v"))
        for row in rows:
            weights = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in self.projections[row.feature]])  # width x rank
            part = features.where(F.col("feature") == row.feature).select("item_id", F.col("x").cast("array<double>").alias("x"))
            moved = F.aggregate(
                F.arrays_zip(F.col("x").alias("x"), weights.alias("w")), F.col("z"),
                lambda z, e: F.zip_with(z, e["w"], lambda a, w: a + e["x"] * w))
            items = items.join(part, "item_id", "left").withColumn("z", F.when(F.col("x").isNull(), F.col("z")).otherwise(moved)).drop("x")
        return items

    def predict(self, pairs: DataFrame, use_features: bool = True, features: DataFrame | None = None) -> DataFrame:
        """``pairs`` (user_id, item_id, ...) with a ``prediction`` column.

        ``features`` (feature, item_id, x) stand in for those of the fit, all or some of them.
        """
        means = self.users.sparkSession.createDataFrame([(0, self.mu)], "run_id int, mu double")
        keyed = pairs.withColumn("run_id", F.lit(0))
        items = self._items(use_features) if features is None else self._given(features)
        return predict_pairs(self.users, items, means, keyed).drop("run_id")

    def predict_all(self, use_features: bool = True) -> DataFrame:
        return completed_rows(self.users, self._items(use_features), self.mu)

    def recommend(self, n: int, rated: DataFrame | None = None) -> DataFrame:
        return recommend(self.users, self.items, self.mu, n, rated)

    def save(self, path: str) -> None:
        self.users.write.mode("overwrite").parquet(f"{path}/users")
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        self.history.write.mode("overwrite").parquet(f"{path}/history")
        spark = self.users.sparkSession
        meta = [(json.dumps(asdict(self.config)), self.mu, json.dumps(self.projections))]
        spark.createDataFrame(meta, "config string, mu double, projections string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        meta = spark.read.parquet(f"{path}/meta").first()
        return FittedModel(
            ModelConfig(**json.loads(meta.config)),
            spark.read.parquet(f"{path}/users"),
            spark.read.parquet(f"{path}/items"),
            meta.mu,
            spark.read.schema(HISTORY_SCHEMA).parquet(f"{path}/history"),
            json.loads(meta.projections),
        )


class RatingModel:
    """Estimator: ``RatingModel(config).fit(ratings, features)``."""

    def __init__(self, config: ModelConfig):
        if config is None:
            raise ValueError("a ModelConfig is needed")
        self.config = config
        self.fitted: FittedModel | None = None

    def fit(
        self,
        ratings: DataFrame,
        features: DataFrame | None = None,
        *,
        users: DataFrame | None = None,
        items: DataFrame | None = None,
        edges: dict[str, DataFrame] | None = None,
        tol: float | None = 1e-3,
        min_iters: int = 5,
        resume: str | None = None,
    ) -> FittedModel:
        """``resume`` names a shared folder from which a fit that was broken off goes on."""
        data = prepare(ratings, users, items, features, edges)
        try:
            result = fit_runs(data, [Run(0, self.config, None, tol, min_iters)], resume=resume)
        finally:
            data.release()
        weights = result.weights.get(0)
        projections = {name: weights[a:b].tolist() for name, a, b in result.slices}
        self.fitted = FittedModel(
            self.config, result.users, result.items, result.mu[0], result.history_frame(), projections
        )
        return self.fitted

    def predict(self, pairs: DataFrame, features: DataFrame | None = None) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit the model before predicting")
        return self.fitted.predict(pairs, features=features)
