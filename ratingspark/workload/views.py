"""Ratings, features and score tables as views over the given tables.

Each view exists twice: as a DataFrame for the queries and as a SQL common
table expression for their twins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratingspark.functions.vectors import rounded
from ratingspark.operators.baselines import held_out_guesses
from ratingspark.operators.folds import assign_folds
from ratingspark.operators.normalize import indicator_feature, normalize_features, scalar_feature
from ratingspark.session import checkpoint_dir

N_FOLDS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def r6(name: str, digits: int = 6):
    return rounded(F.col(name), digits).alias(name)


# ------------------------------------------------------------------ ratings

RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, AVG(l_quantity) / 10.0 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
COLD = """wide_users AS (SELECT c_custkey AS user_id FROM customer UNION ALL SELECT -1 - s_suppkey FROM supplier),
wide_items AS (SELECT p_partkey AS item_id FROM part UNION ALL SELECT -1 - s_suppkey FROM supplier)"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Mean quantity per customer and part as a rating from 0.1 to 5."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(
        (F.avg("l_quantity") / 10.0).alias("rating")
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))


def with_cold(spark: SparkSession, sf: str, universe: DataFrame) -> DataFrame:
    """``universe`` and one id without any rating for each supplier, below zero."""
    return universe.unionAll(table(spark, sf, "supplier").select(-1 - F.col("s_suppkey")))


FOLDED = f"""{RATINGS}, folded AS (
  SELECT *, CAST(ntile({N_FOLDS}) OVER (
    ORDER BY md5(concat_ws(':', '42', user_id, item_id)), user_id, item_id) - 1 AS INTEGER) AS fold
  FROM ratings)"""


def folded(spark: SparkSession, sf: str) -> DataFrame:
    return assign_folds(ratings(spark, sf), N_FOLDS, 42)


# ----------------------------------------------------------------- features

SCALARS = """raw AS (SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part),
feats AS (SELECT item_id,
  (size - (SELECT avg(size) FROM raw)) / (SELECT stddev_pop(size) FROM raw) AS x_size,
  (price - (SELECT min(price) FROM raw)) / (SELECT max(price) - min(price) FROM raw) AS x_price
  FROM raw)"""


def scalar_features(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    raw = scalar_feature(part, "price", "p_partkey", F.col("p_retailprice")).unionByName(
        scalar_feature(part, "size", "p_partkey", F.col("p_size"))
    )
    return normalize_features(
        raw,
        dtype="float64",
        overrides={"size": {"method": "col_zscore"}, "price": {"method": "col_minmax"}},
    )


def type_feature(spark: SparkSession, sf: str) -> DataFrame:
    return indicator_feature(table(spark, sf, "part"), "type", "p_partkey", "p_type")


def brand_feature(spark: SparkSession, sf: str) -> DataFrame:
    return indicator_feature(table(spark, sf, "part"), "brand", "p_partkey", "p_brand")


def size_feature(spark: SparkSession, sf: str, missing: bool = False) -> DataFrame:
    """``missing`` hides the largest sizes, as gaps to fill."""
    value = F.col("p_size").cast("double")
    if missing:
        value = F.when(F.col("p_size") < 45, value)
    return scalar_feature(table(spark, sf, "part"), "size", "p_partkey", value)


def embedding_feature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("emb").alias("feature"), F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


# ------------------------------------------------------------- score tables

SETTINGS: list[tuple[str, float | None, float | None]] = [
    ("full", 5.0, 5.0),
    ("no_items", 5.0, None),
    ("no_users", None, 5.0),
    ("means", None, None),
    ("shrunk", 50.0, 50.0),
    ("free", 0.5, 0.5),
]
TRIALS: list[tuple[str, float | None, float | None]] = [(str(t), 0.5 * 2**t, 80.0 / 2**t) for t in range(8)]


def guesses_sql(settings) -> str:
    def bias(side: str, penalty: float | None) -> str:
        if penalty is None:
            return "0.0"
        return f"(s_{side} - mu * n_{side}) / (n_{side} + {penalty!r} + 1e-10)"

    union = " UNION ALL ".join(
        f"SELECT '{name}' AS variant, user_id, item_id, fold, rating, mu + {bias('u', lu)} + {bias('i', li)} AS prediction FROM based"
        for name, lu, li in settings
    )
    return f"""{FOLDED},
fold_sums AS (SELECT fold, count(*) AS n, sum(rating) AS s FROM folded GROUP BY 1),
fold_mu AS (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS mu FROM fold_sums),
by_u AS (SELECT user_id, fold, sum(count(*)) OVER (PARTITION BY user_id) - count(*) AS n_u,
         sum(sum(rating)) OVER (PARTITION BY user_id) - sum(rating) AS s_u FROM folded GROUP BY 1, 2),
by_i AS (SELECT item_id, fold, sum(count(*)) OVER (PARTITION BY item_id) - count(*) AS n_i,
         sum(sum(rating)) OVER (PARTITION BY item_id) - sum(rating) AS s_i FROM folded GROUP BY 1, 2),
based AS (SELECT f.*, n_u, s_u, n_i, s_i, mu FROM folded f JOIN by_u USING (user_id, fold)
          JOIN by_i USING (item_id, fold) JOIN fold_mu USING (fold)),
guesses AS ({union}),
scores AS (SELECT variant, fold, sqrt(avg((rating - prediction) * (rating - prediction))) AS rmse FROM guesses GROUP BY 1, 2)"""


def guesses(spark: SparkSession, sf: str, settings=None) -> DataFrame:
    return held_out_guesses(folded(spark, sf), settings or SETTINGS)


CURVE_STEPS = 12
CURVES = f"""{FOLDED}, ks AS (SELECT unnest(range({N_FOLDS})) AS k), steps AS (SELECT unnest(range(1, {CURVE_STEPS + 1})) AS iter),
dev AS (SELECT k, item_id, rating - avg(rating) OVER (PARTITION BY k) AS d FROM folded JOIN ks ON fold <> k),
per_item AS (SELECT k, item_id, count(*) AS n, sum(d) AS s, sum(d * d) AS q, sum(d) / (count(*) + 5.0) AS b FROM dev GROUP BY 1, 2),
curves AS (SELECT p_type AS variant, CAST(k AS INTEGER) AS fold, CAST(iter AS INTEGER) AS iter,
  sqrt(sum(q - 2 * (1 - pow(0.5, iter)) * b * s + pow(1 - pow(0.5, iter), 2) * b * b * n) / sum(n)) AS train_rmse
  FROM per_item JOIN part ON p_partkey = item_id CROSS JOIN steps GROUP BY 1, 2, 3)"""


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """(variant, fold, iter, train_rmse): error per part type as item biases are phased in."""
    rows = folded(spark, sf)
    per_fold = rows.groupBy("item_id", "fold").agg(
        F.count("*").alias("n"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q")
    )
    # Sums outside each fold are the item's totals minus the fold's own.
    total = per_fold.groupBy("item_id").agg(*[F.sum(c).alias(f"{c}_all") for c in "nsq"])
    grid = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1))))
    outside = grid.join(per_fold, ["item_id", "fold"], "left").select(
        "item_id", "fold",
        *[(F.col(f"{c}_all") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in "nsq"],
    )
    mu = outside.groupBy("fold").agg((F.sum("s") / F.sum("n")).alias("mu"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("variant"))
    centred = outside.join(F.broadcast(mu), "fold").join(part, "item_id").select(
        "variant", "fold", "n",
        (F.col("s") - F.col("mu") * F.col("n")).alias("s"),
        (F.col("q") - 2 * F.col("mu") * F.col("s") + F.col("mu") ** 2 * F.col("n")).alias("q"),
    )
    b = F.col("s") / (F.col("n") + 5.0)
    summed = centred.groupBy("variant", "fold").agg(
        F.sum("q").alias("q"), F.sum(b * F.col("s")).alias("bs"), F.sum(b * b * F.col("n")).alias("bb"), F.sum("n").alias("n")
    )
    w = 1 - F.pow(F.lit(0.5), F.col("iter"))
    return summed.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(CURVE_STEPS)))).select(
        "variant", "fold", "iter",
        F.sqrt((F.col("q") - 2 * w * F.col("bs") + w * w * F.col("bb")) / F.col("n")).alias("train_rmse"),
    )
