"""Queries on ratings, features, folds and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingspark.functions.vectors import is_finite
from ratingspark.operators import baselines, folds, metrics, normalize
from ratingspark.session import cut_lineage
from ratingspark.sources import ratings as source
from ratingspark.workload import views as v
from ratingspark.workload.registry import query

KEYS = ["user_id", "item_id"]


def _ratings_out(df):
    return df.select(*KEYS, v.r6("rating"))


@query("scan_ratings", f"WITH {v.RATINGS} SELECT user_id, item_id, round(rating, 6) + 0.0 AS rating FROM ratings")
def scan_ratings(spark, sf):
    return _ratings_out(v.ratings(spark, sf))


@query(
    "melt_observed",
    """WITH wide AS (SELECT l_orderkey, l_linenumber, [l_quantity, nullif(l_discount, 0), nullif(l_tax, 0)] AS m FROM lineitem)
SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(col AS INTEGER) AS col, m[col + 1] AS rating
FROM wide, range(3) AS r(col) WHERE m[col + 1] IS NOT NULL""",
)
def melt_observed(spark, sf):
    lines = v.table(spark, sf, "lineitem")
    none = F.lit(float("nan"))
    wide = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.array(
            "l_quantity",
            F.when(F.col("l_discount") == 0, none).otherwise(F.col("l_discount")),
            F.when(F.col("l_tax") == 0, none).otherwise(F.col("l_tax")),
        ).alias("m"),
    )
    return source.melt(wide, "row_id", F.col("m")).select("row_id", "col", "rating")


@query(
    "filter_observed",
    """SELECT event_id, user_id, round(value, 6) + 0.0 AS value FROM events WHERE value IS NOT NULL AND isfinite(value)""",
)
def filter_observed(spark, sf):
    events = v.table(spark, sf, "events")
    return source.observed(events, "value").select("event_id", "user_id", v.r6("value"))


@query(
    "merge_ratings",
    f"""WITH {v.RATINGS}, test AS (SELECT user_id, item_id, rating + 1 AS rating FROM ratings WHERE rating > 2.5),
train AS (SELECT * FROM ratings WHERE rating < 4)
SELECT user_id, item_id, round(coalesce(b.rating, a.rating), 6) + 0.0 AS rating
FROM train a FULL JOIN test b USING (user_id, item_id)""",
)
def merge_ratings(spark, sf):
    rows = v.ratings(spark, sf)
    test = rows.where("rating > 2.5").withColumn("rating", F.col("rating") + 1)
    return _ratings_out(source.merge_ratings(rows.where("rating < 4"), test))


@query(
    "flat_index",
    f"""WITH {v.RATINGS}, u AS (SELECT c_custkey AS user_id, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer),
i AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS q FROM part)
SELECT user_id, item_id, p * (SELECT count(*) FROM part) + q AS flat_index, q AS item_pos
FROM ratings JOIN u USING (user_id) JOIN i USING (item_id)""",
)
def flat_index(spark, sf):
    coded = source.flat_index(v.ratings(spark, sf), v.users(spark, sf), v.items(spark, sf))
    # Decode the column again, as a reader of saved indices would.
    return coded.select(*KEYS, "flat_index", F.pmod("flat_index", "n_items").alias("item_pos"))


@query("global_mean", f"WITH {v.RATINGS} SELECT count(*) AS n, round(avg(rating), 6) AS mu FROM ratings")
def global_mean(spark, sf):
    return v.ratings(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mu"))


@query(
    "item_counts",
    f"WITH {v.RATINGS}, {v.COLD} SELECT item_id, count(rating) AS n FROM wide_items LEFT JOIN ratings USING (item_id) GROUP BY 1",
)
def item_counts(spark, sf):
    return source.counts_per(v.ratings(spark, sf), v.with_cold(spark, sf, v.items(spark, sf)), "item_id")


@query(
    "user_counts",
    f"WITH {v.RATINGS}, {v.COLD} SELECT user_id, count(rating) AS n FROM wide_users LEFT JOIN ratings USING (user_id) GROUP BY 1",
)
def user_counts(spark, sf):
    return source.counts_per(v.ratings(spark, sf), v.with_cold(spark, sf, v.users(spark, sf)), "user_id")


@query(
    "item_reg",
    f"""WITH {v.RATINGS}, {v.COLD}, c AS (SELECT item_id, count(rating) AS n FROM wide_items LEFT JOIN ratings USING (item_id) GROUP BY 1)
SELECT item_id, round(6.0, 6) AS reg_uniform, round(6.0 / sqrt(n + 1.0), 6) AS reg_inverse_sqrt FROM c""",
)
def item_reg(spark, sf):
    counts = source.counts_per(v.ratings(spark, sf), v.with_cold(spark, sf, v.items(spark, sf)), "item_id")
    return counts.select(
        "item_id",
        F.round(F.lit(6.0), 6).alias("reg_uniform"),
        F.round(6.0 / F.sqrt(F.col("n") + 1.0), 6).alias("reg_inverse_sqrt"),
    )


# ----------------------------------------------------------------- features

LEVELS = "SELECT DISTINCT {c} AS level FROM part"


def _indicator_sql(column: str, name: str) -> str:
    return f"""lv AS (SELECT list(DISTINCT {column} ORDER BY {column}) AS ls FROM part),
onehot AS (SELECT p_partkey AS item_id, list_transform(ls, lambda l: CASE WHEN l = {column} THEN 1.0 ELSE 0.0 END) AS x FROM part, lv)"""


def _cells(features, digits: int = 6):
    """One row per number, so that both engines compare plain values."""
    return features.select("feature", "item_id", F.posexplode("x").alias("col", "value")).select(
        "feature", "item_id", "col", (F.round(F.col("value").cast("double"), digits) + 0.0).alias("value")
    )


def _cells_sql(source_sql: str, feature: str, value: str = "x") -> str:
    return f"""{source_sql}
SELECT '{feature}' AS feature, item_id, CAST(i AS INTEGER) AS col, round(CAST({value}[i + 1] AS DOUBLE), 6) + 0.0 AS value
FROM scaled, unnest(range(len({value}))) AS r(i)"""


@query(
    "scan_features",
    f"""WITH {_indicator_sql('p_type', 'type')}, scaled AS (
SELECT 'type' AS feature, item_id, x FROM onehot UNION ALL SELECT 'size', p_partkey, [CAST(p_size AS DOUBLE)] FROM part
UNION ALL SELECT 'emb', vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings)
SELECT feature, item_id, CAST(i AS INTEGER) AS col, round(x[i + 1], 6) + 0.0 AS value FROM scaled, unnest(range(len(x))) AS r(i)""",
)
def scan_features(spark, sf):
    both = v.type_feature(spark, sf).unionByName(v.size_feature(spark, sf))
    return _cells(both.unionByName(v.embedding_feature(spark, sf)))


BROKEN = """broken AS (SELECT l_orderkey * 10 + l_linenumber AS item_id,
  CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE l_quantity END AS value FROM lineitem)"""


def _broken(spark, sf):
    value = (
        F.when(F.col("l_tax") == 0, float("inf")).when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_quantity"))
    )
    lines = v.table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return normalize.scalar_feature(lines, "quantity", "line", value)


@query("nonfinite_count", f"WITH {BROKEN} SELECT 'quantity' AS feature, CAST(count(*) FILTER (NOT isfinite(value)) AS BIGINT) AS n_bad FROM broken")
def nonfinite_count(spark, sf):
    return normalize.nonfinite_counts(_broken(spark, sf))


@query(
    "nullify_nonfinite",
    f"WITH {BROKEN} SELECT item_id, CASE WHEN isfinite(value) THEN value END AS value FROM broken",
)
def nullify_nonfinite(spark, sf):
    return normalize.nullify(_broken(spark, sf)).select("item_id", F.col("x")[0].alias("value"))


@query(
    "impute_median",
    f"""WITH {BROKEN}, m AS (SELECT median(value) AS med FROM broken WHERE isfinite(value))
SELECT item_id, CASE WHEN isfinite(value) THEN value ELSE med END AS value FROM broken, m""",
)
def impute_median(spark, sf):
    return normalize.impute_medians(_broken(spark, sf)).select("item_id", F.col("x")[0].alias("value"))


@query(
    "feature_coverage",
    """WITH f AS (SELECT p_partkey AS item_id FROM part WHERE p_size < 40 UNION ALL SELECT p_partkey FROM part WHERE p_size < 5
UNION ALL SELECT -s_suppkey - 1 FROM supplier), g AS (SELECT item_id, count(*) AS n FROM f GROUP BY 1)
SELECT 'size' AS feature, (SELECT count(*) FROM part) - count(*) FILTER (p_partkey IS NOT NULL) AS n_missing,
count(*) FILTER (p_partkey IS NULL) AS n_unknown, count(*) FILTER (n > 1) AS n_repeated FROM g LEFT JOIN part ON p_partkey = item_id""",
)
def feature_coverage(spark, sf):
    part, supplier = v.table(spark, sf, "part"), v.table(spark, sf, "supplier")
    rows = lambda df: normalize.scalar_feature(df, "size", "p_partkey", F.col("p_size"))
    odd = supplier.select((-F.col("s_suppkey") - 1).alias("p_partkey"), F.lit(1).alias("p_size"))
    features = rows(part.where("p_size < 40")).unionByName(rows(part.where("p_size < 5"))).unionByName(rows(odd))
    return normalize.coverage(features, v.items(spark, sf))


@query(
    "norm_none",
    _cells_sql("WITH scaled AS (SELECT p_partkey AS item_id, [CAST(p_retailprice AS FLOAT)] AS x FROM part)", "price"),
)
def norm_none(spark, sf):
    price = normalize.scalar_feature(v.table(spark, sf, "part"), "price", "p_partkey", F.col("p_retailprice"))
    return _cells(normalize.normalize_feature(price))


@query(
    "norm_row_l1",
    _cells_sql(
        """WITH scaled AS (SELECT vec_id AS item_id, list_transform(embedding, lambda e:
CAST(CAST(e AS DOUBLE) / greatest(list_sum(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)))), 1e-8) AS FLOAT)) AS x FROM embeddings)""",
        "emb",
    ),
)
def norm_row_l1(spark, sf):
    return _cells(normalize.normalize_feature(v.embedding_feature(spark, sf), "row_l1"))


@query(
    "norm_row_l2",
    _cells_sql(
        f"""WITH {_indicator_sql('p_type', 'type')}, scaled AS (SELECT item_id, list_transform(x, lambda e:
CAST(e / greatest(sqrt(list_sum(list_transform(x, lambda y: y * y))), 1e-8) AS FLOAT)) AS x FROM onehot)""",
        "type",
    ),
)
def norm_row_l2(spark, sf):
    return _cells(normalize.normalize_feature(v.type_feature(spark, sf), "row_l2"))


@query(
    "norm_col_zscore",
    """SELECT 'emb' AS feature, item_id, CAST(col AS INTEGER) AS col, round(CAST(CAST((e - avg(e) OVER w) /
CASE WHEN stddev_pop(e) OVER w < 1e-8 THEN 1 ELSE stddev_pop(e) OVER w END AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM
(SELECT vec_id AS item_id, i AS col, CAST(embedding[i + 1] AS DOUBLE) AS e FROM embeddings, unnest(range(len(embedding))) AS r(i))
WINDOW w AS (PARTITION BY col)""",
)
def norm_col_zscore(spark, sf):
    return _cells(normalize.normalize_feature(v.embedding_feature(spark, sf), "col_zscore"))


@query(
    "norm_col_minmax",
    _cells_sql(
        """WITH scaled AS (SELECT p_partkey AS item_id, [CAST((p_retailprice - min(p_retailprice) OVER ()) /
greatest(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 1e-8) AS FLOAT)] AS x FROM part)""",
        "price",
    ),
)
def norm_col_minmax(spark, sf):
    price = normalize.scalar_feature(v.table(spark, sf, "part"), "price", "p_partkey", F.col("p_retailprice"))
    return _cells(normalize.normalize_feature(price, "col_minmax"))


@query(
    "norm_multi",
    f"""WITH {_indicator_sql('p_brand', 'brand')}, med AS (SELECT median(p_size) AS m FROM part WHERE p_size < 45),
filled AS (SELECT p_partkey AS item_id, CASE WHEN p_size < 45 THEN CAST(p_size AS DOUBLE) ELSE m END AS s FROM part, med),
scaled AS (SELECT 'brand' AS feature, item_id, list_transform(x, lambda e: CAST(e / greatest(list_sum(x), 1e-8) AS FLOAT)) AS x FROM onehot
UNION ALL SELECT 'size', item_id, [CAST((s - avg(s) OVER ()) / stddev_pop(s) OVER () AS FLOAT)] FROM filled)
SELECT feature, item_id, CAST(i AS INTEGER) AS col, round(CAST(x[i + 1] AS DOUBLE), 6) + 0.0 AS value FROM scaled, unnest(range(len(x))) AS r(i)""",
)
def norm_multi(spark, sf):
    raw = v.brand_feature(spark, sf).unionByName(v.size_feature(spark, sf, missing=True))
    overrides = {"brand": {"method": "row_l1"}, "size": {"method": "col_zscore"}, "absent": {"method": "row_l2"}}
    return _cells(normalize.normalize_features(raw, impute="col_median", overrides=overrides))


# -------------------------------------------------------------------- folds


@query("make_folds", f"WITH {v.FOLDED} SELECT user_id, item_id, fold FROM folded")
def make_folds(spark, sf):
    return v.folded(spark, sf).select(*KEYS, "fold")


@query(
    "make_folds_ordered",
    f"""WITH {v.RATINGS} SELECT user_id, item_id, CAST(ntile(7) OVER (ORDER BY user_id, item_id) - 1 AS INTEGER) AS fold FROM ratings""",
)
def make_folds_ordered(spark, sf):
    return folds.assign_folds(v.ratings(spark, sf), 7, shuffle=False).select(*KEYS, "fold")


@query("folds_roundtrip", f"WITH {v.FOLDED} SELECT user_id, item_id, fold, 5 AS n_splits, CAST(42 AS BIGINT) AS seed FROM folded")
def folds_roundtrip(spark, sf):
    path = v.scratch_path(spark, "folds")
    folds.save_folds(v.folded(spark, sf), path, v.users(spark, sf).count(), v.items(spark, sf).count(), 5, 42)
    saved, meta = folds.load_folds(spark, path)
    return saved.join(F.broadcast(meta)).select(*KEYS, "fold", "n_splits", "seed")


@query(
    "fold_guard",
    f"""WITH {v.RATINGS} SELECT (SELECT count(*) FROM customer) - (SELECT count(DISTINCT user_id) FROM ratings WHERE rating < 2) AS user_gap,
(SELECT count(*) FROM part) - (SELECT count(DISTINCT item_id) FROM ratings WHERE rating < 2) AS item_gap,
(SELECT count(*) FROM ratings WHERE rating >= 2) AS unknown_keys""",
)
def fold_guard(spark, sf):
    rows = v.ratings(spark, sf)
    low = rows.where("rating < 2")
    shape = low.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"))
    return folds.fold_guard(v.folded(spark, sf), shape, low, v.users(spark, sf), v.items(spark, sf))


@query("fold_check", f"WITH {v.FOLDED} SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT (user_id, item_id)) AS n_keys, true AS is_partition FROM folded")
def fold_check(spark, sf):
    return folds.fold_check(v.folded(spark, sf))


@query("train_split", f"WITH {v.FOLDED} SELECT user_id, item_id, round(rating, 6) + 0.0 AS rating FROM folded WHERE fold <> 2")
def train_split(spark, sf):
    rows = v.folded(spark, sf)
    return _ratings_out(folds.train_by_keys(rows, folds.valid_split(rows, 2)))


@query(
    "valid_split",
    f"""WITH {v.FOLDED} SELECT user_id, item_id, CASE WHEN rating < 4 THEN round(rating, 6) + 0.0 END AS rating FROM folded WHERE fold = 2""",
)
def valid_split(spark, sf):
    rows = v.folded(spark, sf)  # listed keys without a rating come back with NULL
    return _ratings_out(folds.valid_by_keys(rows.where("rating < 4"), folds.valid_split(rows, 2)))


# ------------------------------------------------------------------- errors

MEANS = v.guesses_sql(v.SETTINGS)


@query("rmse", f"WITH {MEANS} SELECT variant, round(sqrt(avg((rating - prediction) ** 2)), 6) AS rmse FROM guesses GROUP BY 1")
def rmse(spark, sf):
    return metrics.rmse(v.guesses(spark, sf), "variant").select("variant", F.round("rmse", 6).alias("rmse"))


@query(
    "rmse_on_keys",
    f"WITH {MEANS} SELECT round(sqrt(avg((rating - prediction) ** 2)), 6) AS rmse FROM guesses WHERE variant = 'full' AND fold = 1",
)
def rmse_on_keys(spark, sf):
    rows = v.folded(spark, sf)
    guesses = v.guesses(spark, sf, v.SETTINGS[:1])
    return metrics.rmse_on_keys(rows, guesses, folds.valid_split(rows, 1)).select(F.round("rmse", 6).alias("rmse"))


@query(
    "user_bias",
    f"""WITH {v.RATINGS}, m AS (SELECT avg(rating) AS mu FROM ratings)
SELECT user_id, round(sum(rating - mu) / (count(*) + 3.0 + 1e-10), 6) + 0.0 AS b_u FROM ratings, m GROUP BY 1""",
)
def user_bias(spark, sf):
    return baselines.user_bias(v.ratings(spark, sf), 3.0).select("user_id", v.r6("b_u"))


@query(
    "item_bias",
    f"""WITH {v.RATINGS}, m AS (SELECT avg(rating) AS mu FROM ratings),
b AS (SELECT user_id, sum(rating - mu) / (count(*) + 3.0 + 1e-10) AS b_u FROM ratings, m GROUP BY 1)
SELECT item_id, round(sum(rating - mu - b_u) / (count(*) + 2.0 + 1e-10), 6) + 0.0 AS b_i
FROM ratings JOIN b USING (user_id), m GROUP BY 1""",
)
def item_bias(spark, sf):
    rows = v.ratings(spark, sf)
    return baselines.item_bias(rows, baselines.user_bias(rows, 3.0), 2.0).select("item_id", v.r6("b_i"))


COUNTS = "counts AS (SELECT p_partkey AS item_id, count(rating) AS n FROM part LEFT JOIN ratings ON p_partkey = item_id GROUP BY 1)"
COLD_COUNTS = f"{v.COLD}, counts AS (SELECT item_id, count(rating) AS n FROM wide_items LEFT JOIN ratings USING (item_id) GROUP BY 1)"
BINS = """raw_edges AS (SELECT quantile_cont(n, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM counts),
edges AS (SELECT list_reduce(list_transform(e, lambda y: [CAST(y AS DOUBLE)]), lambda a, b:
  list_concat(a, [CASE WHEN b[1] <= a[-1] THEN a[-1] + 1e-9 ELSE b[1] END])) AS e FROM raw_edges),
bins AS (SELECT item_id, n, CAST(greatest(0, least(4, len(list_filter(e, lambda y: y <= n)) - 1)) AS INTEGER) AS bin FROM counts, edges)"""
QUANTILE = f"{COUNTS}, {BINS}"
COLD_QUANTILE = f"{COLD_COUNTS}, {BINS}"


def _counts(spark, sf, cold=True):
    universe = v.items(spark, sf)
    return source.counts_per(v.ratings(spark, sf), v.with_cold(spark, sf, universe) if cold else universe, "item_id")


def _edge_rows(edges):
    return edges.select(F.posexplode("edges").alias("j", "edge")).select("j", v.r6("edge", 9))


@query("pop_edges_quantile", f"WITH {v.RATINGS}, {COLD_QUANTILE} SELECT CAST(i AS INTEGER) AS j, round(e[i + 1], 9) AS edge FROM edges, range(6) AS r(i)")
def pop_edges_quantile(spark, sf):
    return _edge_rows(metrics.bin_edges(_counts(spark, sf), 5))


@query(
    "pop_edges_uniform",
    f"""WITH {v.RATINGS}, {COLD_COUNTS} SELECT CAST(i AS INTEGER) AS j, round(lo + (hi - lo) * i / 4.0, 9) AS edge
FROM (SELECT min(n) AS lo, max(n) AS hi FROM counts), range(5) AS r(i)""",
)
def pop_edges_uniform(spark, sf):
    return _edge_rows(metrics.bin_edges(_counts(spark, sf), 4, "uniform"))


@query("pop_bins", f"WITH {v.RATINGS}, {COLD_QUANTILE} SELECT item_id, n, bin FROM bins")
def pop_bins(spark, sf):
    return metrics.popularity_bins(_counts(spark, sf), 5)


@query("valid_by_popbin", f"WITH {v.FOLDED}, {QUANTILE} SELECT user_id, item_id, bin FROM folded JOIN bins USING (item_id) WHERE fold = 0")
def valid_by_popbin(spark, sf):
    bins = metrics.popularity_bins(_counts(spark, sf, cold=False), 5)
    return folds.valid_split(v.folded(spark, sf), 0).join(bins, "item_id").select(*KEYS, "bin")


BY_BIN = f"""{MEANS}, {QUANTILE}, grid AS (SELECT variant, fold, CAST(b AS INTEGER) AS bin FROM scores, range(5) AS r(b)),
found AS (SELECT variant, fold, bin, sqrt(avg((rating - prediction) ** 2)) AS rmse FROM guesses JOIN bins USING (item_id) GROUP BY 1, 2, 3),
by_bin AS (SELECT variant, fold, bin, rmse FROM grid LEFT JOIN found USING (variant, fold, bin))"""


def _by_bin(spark, sf):
    errors = cut_lineage(baselines.item_errors(v.guesses(spark, sf)))  # read for the groups and for the bins
    bins = metrics.popularity_bins(_counts(spark, sf, cold=False), 5)
    groups = errors.select("variant", "fold").distinct()
    return metrics.rmse_by_bin(errors, bins, groups, 5)


@query("rmse_by_popbin", f"WITH {BY_BIN} SELECT variant, fold, bin, round(rmse, 6) AS rmse FROM by_bin")
def rmse_by_popbin(spark, sf):
    return _by_bin(spark, sf).select("variant", "fold", "bin", F.round("rmse", 6).alias("rmse"))


@query(
    "popbin_mean",
    f"""WITH {BY_BIN} SELECT variant, {', '.join(f"round(avg(rmse) FILTER (bin = {b}), 6) AS rmse_pop_{b + 1}" for b in range(5))}
FROM by_bin GROUP BY 1""",
)
def popbin_mean(spark, sf):
    wide = metrics.mean_by_bin(_by_bin(spark, sf), 5)
    return wide.select("variant", *[F.round(f"rmse_pop_{b + 1}", 6).alias(f"rmse_pop_{b + 1}") for b in range(5)])


STOPS = f"""{v.CURVES}, gains AS (SELECT *, lag(train_rmse, 2) OVER (PARTITION BY variant, fold ORDER BY iter) - train_rmse AS gain FROM curves),
stops AS (SELECT variant, fold, coalesce(min(iter) FILTER (gain <= 2e-4 AND iter >= 5), max(iter)) AS stop_iter,
  coalesce(bool_or(gain <= 2e-4 AND iter >= 5), false) AS converged FROM gains GROUP BY 1, 2)"""


@query("early_stop", f"WITH {STOPS} SELECT * FROM stops")
def early_stop(spark, sf):
    return metrics.early_stops(v.curves(spark, sf), ["variant", "fold"], 2e-4, 5)


@query(
    "convergence",
    f"""WITH {STOPS}, cut AS (SELECT c.* FROM curves c JOIN stops USING (variant, fold) WHERE iter <= stop_iter),
k AS (SELECT variant, count(DISTINCT fold) AS n_folds FROM cut GROUP BY 1)
SELECT variant, iter, round(avg(train_rmse), 6) AS rmse_mean, round(stddev_pop(train_rmse), 6) AS rmse_std, any_value(n_folds) AS n_folds
FROM cut JOIN k USING (variant) GROUP BY 1, 2""",
)
def convergence(spark, sf):
    curves = v.curves(spark, sf)
    stops = metrics.early_stops(curves, ["variant", "fold"], 2e-4, 5)
    cut = curves.join(stops, ["variant", "fold"]).where(F.col("iter") <= F.col("stop_iter"))
    path = v.scratch_path(spark, "convergence")
    metrics.convergence(cut).write.partitionBy("variant").json(path)
    saved = spark.read.schema("iter int, rmse_mean double, rmse_std double, n_folds long, variant string").json(path)
    return saved.select("variant", "iter", F.round("rmse_mean", 6).alias("rmse_mean"), F.round("rmse_std", 6).alias("rmse_std"), "n_folds")
