"""Queries on the factor model: half steps, fits, graph and predictions."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratingspark.functions import portable
from ratingspark.functions.vectors import rounded
from ratingspark.operators import folds, graph, metrics, neighbours, scoring, systems, topn
from ratingspark.operators.half_steps import SOLVED, half_step, run_steps
from ratingspark.plans.config import ModelConfig, Run, with_fold
from ratingspark.plans.fit import MOVED_CELLS, FitInput, FitResult, _enriched, _initial_state, fit_runs, prepare
from ratingspark.session import cut_lineage, free_shuffles, shuffle_width
from ratingspark.workload import views as v
from ratingspark.workload.rank_one import fit_sql, history_sql, normal_sql
from ratingspark.workload.registry import query

ONE = ModelConfig(1, 2, 5.0, 6.0, 3.0, 2.0, "inverse_sqrt", update_w_every=1)
PLAIN = [Run(0, ONE, None, None)]
FEATURED = [Run(0, replace(ONE, lambda_w={"size": 5.0, "price": 10.0}), None, None)]
LINKED = [Run(0, replace(ONE, alpha=0.5, graph_feature="type", S_topk=5), None, None)]
TWO = [Run(0, ONE, None, None), Run(1, replace(ONE, lambda_u=50.0, lambda_bi=None, pop_reg_mode=None), None, None)]
BATCH = with_fold(TWO, v.N_FOLDS)
PAIR_CELLS = 12  # numbers of a pair on its way to its item: keys, rating, the user's vector and bias
FOUR = ModelConfig(4, 6, 5.0, 6.0, 3.0, 2.0, "inverse_sqrt")


def _first(column: str):
    return rounded(F.element_at(column, 1)).alias(column)


def _data(spark: SparkSession, sf: str, features: str = "", cold: bool = False) -> FitInput:
    """Clustered ratings of one session, shared by the queries that use them."""
    key = (spark.sparkContext.applicationId, sf, features, cold)
    if key not in _DATA:
        given = folds.with_ranges(v.ratings(spark, sf), 42).persist(StorageLevel.MEMORY_AND_DISK)  # read for sizes, then for folds
        rows = folds.assign_folds(given, v.N_FOLDS, 42).persist(StorageLevel.MEMORY_AND_DISK)
        rows.count()
        given.unpersist()
        wide = (lambda ids: v.with_cold(spark, sf, ids)) if cold else (lambda ids: ids)
        table = {"": lambda: None, "scalars": lambda: v.scalar_features(spark, sf), "type": lambda: v.type_feature(spark, sf)}
        _DATA[key] = prepare(rows, wide(v.users(spark, sf)), wide(v.items(spark, sf)), table[features]())
        rows.unpersist()
    return _DATA[key]


_DATA: dict[tuple, FitInput] = {}


def _user_half(data: FitInput, runs: list[Run]) -> tuple[DataFrame, DataFrame]:
    """Items at the start, users after the first half step."""
    users = cut_lineage(_initial_state(data.users, "user_id", "U", runs))
    items = cut_lineage(_initial_state(data.items, "item_id", "V", runs))
    mu = {r.run_id: data.mean_outside(r.fold) for r in runs}
    new_users = half_step(data.by_user, users, _enriched(items), run_steps(runs, mu, "user"))
    return items, cut_lineage(new_users.select("run_id", "id", "vec", "bias"))


def _item_half(data: FitInput, runs: list[Run]) -> DataFrame:
    """Items after the second half step."""
    items, new_users = _user_half(data, runs)
    mu = {r.run_id: data.mean_outside(r.fold) for r in runs}
    linked = data.graphs.usable(runs)
    own = data.graphs.attach(items, runs, linked)
    new_items = half_step(data.by_item, own, new_users, run_steps(runs, mu, "item", graphs=linked))
    return new_items.where(F.col("kind") == SOLVED)


@query(
    "init_factors",
    f"""WITH k AS (SELECT unnest(range(3)) AS dim)
SELECT c_custkey AS id, 'U' AS tag, CAST(dim AS INTEGER) AS dim, round({normal_sql(42, 'U', 'c_custkey', 'dim')}, 6) + 0.0 AS value FROM customer, k
UNION ALL SELECT p_partkey, 'V', dim, round({normal_sql(42, 'V', 'p_partkey', 'dim')}, 6) + 0.0 FROM part, k""",
)
def init_factors(spark, sf):
    def start(universe, key, tag):
        vec = portable.initial_factor(42, tag, F.col(key), 3)
        return universe.select(F.col(key).alias("id"), F.lit(tag).alias("tag"), F.posexplode(vec).alias("dim", "value"))

    both = start(v.users(spark, sf), "user_id", "U").unionByName(start(v.items(spark, sf), "item_id", "V"))
    return both.select("id", "tag", "dim", v.r6("value"))


@query("user_step", f"WITH {fit_sql(PLAIN, 1)} SELECT user_id, round(u, 6) + 0.0 AS u, round(b_u, 6) + 0.0 AS b_u FROM users1")
def user_step(spark, sf):
    users = _user_half(_data(spark, sf), PLAIN)[1]
    return users.select(F.col("id").alias("user_id"), F.col("vec").alias("u"), F.col("bias").alias("b_u")).select(
        "user_id", _first("u"), v.r6("b_u")
    )


ITEM_OUT = "SELECT item_id, round(v, 6) + 0.0 AS v, round(b_i, 6) + 0.0 AS b_i"


def _items_out(items):
    renamed = items.select(F.col("id").alias("item_id"), F.col("vec").alias("v"), F.col("bias").alias("b_i"))
    return renamed.select("item_id", _first("v"), v.r6("b_i"))


@query("item_step", f"WITH {fit_sql(PLAIN, 1)} {ITEM_OUT} FROM items1")
def item_step(spark, sf):
    return _items_out(_item_half(_data(spark, sf), PLAIN))


@query(
    "cold_passthrough",
    f"WITH {fit_sql(PLAIN, 2, cold=True)} {ITEM_OUT} FROM items2",
)
def cold_passthrough(spark, sf):
    fit = fit_runs(_data(spark, sf, cold=True), PLAIN)
    return fit.items.select("item_id", _first("v"), v.r6("b_i"))


@query(
    "ridge_solve",
    f"""WITH {fit_sql(BATCH, 1)} SELECT run_id, user_id, round(u, 6) + 0.0 AS u FROM users1""",
)
def ridge_solve(spark, sf):
    users = _user_half(_data(spark, sf), BATCH)[1]
    return users.select("run_id", F.col("id").alias("user_id"), F.col("vec").alias("u")).select("run_id", "user_id", _first("u"))


@query(
    "solve_report",
    """WITH s AS (SELECT c_nationkey AS id, c_nationkey % 3 AS kind, count(*)::DOUBLE AS n, sum(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 1 + c_custkey % 7 END)::DOUBLE AS b,
sum(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE (1 + c_custkey % 7) * (1 + c_custkey % 7) END)::DOUBLE - CASE WHEN c_nationkey % 3 = 1 THEN 100 * count(*) ELSE 0 END AS d,
sum(c_custkey % 5)::DOUBLE AS p, sum(c_custkey % 11)::DOUBLE AS q FROM customer GROUP BY 1)
SELECT id, CASE WHEN n * d = b * b THEN 'singular' WHEN n * d > b * b THEN 'definite' ELSE 'indefinite' END AS status,
round(CASE WHEN n * d = b * b THEN (p + q) / (4 * n) ELSE (p * d - b * q) / (n * d - b * b) END, 9) + 0.0 AS x0,
round(CASE WHEN n * d = b * b THEN (p + q) / (4 * n) ELSE (n * q - b * p) / (n * d - b * b) END, 9) + 0.0 AS x1 FROM s WHERE n > 2""",
)
def solve_report(spark, sf):
    """A line through the customers of each nation: every third nation's system is singular, every third indefinite."""
    kind, x = F.col("c_nationkey") % 3, 1 + F.col("c_custkey") % 7
    rows = v.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("id"), kind.alias("kind"), F.when(kind == 0, 1).otherwise(x).alias("x"), F.col("c_custkey").alias("c"))
    sums = rows.groupBy("id", "kind").agg(
        F.count("*").alias("n"), F.sum("x").alias("b"), F.sum(F.col("x") * F.col("x")).alias("d"), F.sum(F.col("c") % 5).alias("p"), F.sum(F.col("c") % 11).alias("q"))
    last = F.col("d") - F.when(F.col("kind") == 1, 100 * F.col("n")).otherwise(0)
    table = sums.where("n > 2").select("id", F.array("n", "b", "b", last).alias("lhs"), F.array("p", "q").alias("rhs"))
    return systems.solve_report(table, 2, "id").select(
        "id", "status", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")).select("id", "status", v.r6("x0", 9), v.r6("x1", 9))


@query(
    "als_fit_k1",
    f"""WITH {fit_sql(TWO, 2)} SELECT run_id, 'U' AS side, user_id AS id, round(u, 6) + 0.0 AS factor, round(b_u, 6) + 0.0 AS bias FROM users2
UNION ALL SELECT run_id, 'V', item_id, round(v, 6) + 0.0, round(b_i, 6) + 0.0 FROM items2""",
)
def als_fit_k1(spark, sf):
    fit = fit_runs(_data(spark, sf), TWO)
    side = lambda df, tag, key, vec, bias: df.select(
        "run_id", F.lit(tag).alias("side"), F.col(key).alias("id"),
        rounded(F.element_at(vec, 1)).alias("factor"), rounded(F.col(bias)).alias("bias"),
    )
    return side(fit.users, "U", "user_id", "u", "b_u").unionByName(side(fit.items, "V", "item_id", "v", "b_i"))


HISTORY_OUT = "SELECT run_id, iter, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("mu", "train_rmse", "u_norm", "v_norm", "bu_norm", "bi_norm")
) + " FROM history"


@query("fit_history", f"WITH {fit_sql(BATCH, 2)}, {history_sql(2)} {HISTORY_OUT}")
def fit_history(spark, sf):
    history = fit_runs(_data(spark, sf), BATCH).history_frame()
    return history.select("run_id", "iter", *[v.r6(c) for c in history.columns[2:]])


@query(
    "mu_step",
    f"""WITH {fit_sql(FEATURED, 2, features=True)} SELECT run_id, round(mu, 6) AS mu, round(rmse, 6) AS train_rmse FROM means2""",
)
def mu_step(spark, sf):
    last = fit_runs(_data(spark, sf, "scalars"), FEATURED).history_frame().where("iter = 2")
    return last.select("run_id", v.r6("mu"), v.r6("train_rmse"))


@query(
    "w_step",
    f"""WITH {fit_sql(FEATURED, 2, features=True)} SELECT run_id, 'price' AS feature, round(w_price, 6) + 0.0 AS w FROM w2
UNION ALL SELECT run_id, 'size', round(w_size, 6) + 0.0 FROM w2""",
)
def w_step(spark, sf):
    fit = fit_runs(_data(spark, sf, "scalars"), FEATURED)
    rows = [(r, name, float(w[a, 0])) for r, w in fit.weights.items() for name, a, _ in fit.slices]
    return spark.createDataFrame(rows, "run_id int, feature string, w double").select("run_id", "feature", v.r6("w"))


@query(
    "enriched_items",
    f"""WITH {fit_sql(FEATURED, 2, features=True)} SELECT item_id, round(v, 6) + 0.0 AS v, round(v + f, 6) + 0.0 AS z FROM items2""",
)
def enriched_items(spark, sf):
    fit = fit_runs(_data(spark, sf, "scalars"), FEATURED)
    return fit.items.select("item_id", _first("v"), _first("z"))


NORMS = "round(sqrt(sum({x} * {x})), 6)"


@query(
    "param_norms",
    f"""WITH {fit_sql(FEATURED, 1, features=True)}, {history_sql(1)}
SELECT round(u_norm, 6) AS u_norm, round(v_norm, 6) AS v_norm, round(bu_norm, 6) AS bu_norm, round(bi_norm, 6) AS bi_norm FROM history""",
)
def param_norms(spark, sf):
    runs = [Run(0, replace(FEATURED[0].config, n_iters=1), None, None)]
    history = fit_runs(_data(spark, sf, "scalars"), runs).history_frame()
    return history.select(*[v.r6(c) for c in ("u_norm", "v_norm", "bu_norm", "bi_norm")])


# -------------------------------------------------------------- predictions


@query(
    "train_rmse",
    f"""WITH {fit_sql(BATCH, 2)} SELECT run_id, round(rmse, 6) AS train_rmse FROM means2""",
)
def train_rmse(spark, sf):
    """From predictions of the training rows, not from the fit's own history."""
    data = _data(spark, sf)
    fit = fit_runs(data, BATCH)
    means = spark.createDataFrame(sorted(fit.mu.items()), "run_id int, mu double")
    plan = spark.createDataFrame([(r.run_id, r.fold) for r in BATCH], "run_id int, held int")
    runs = F.broadcast(plan)  # one row per run
    rows = data.by_user.ratings.select(F.col("own").alias("user_id"), F.col("other").alias("item_id"), "rating", "fold")
    errors = []
    size = max(1, MOVED_CELLS // (PAIR_CELLS * data.n_rows))  # runs whose pairs are moved together; all, unless the tables are large
    for first in range(0, len(BATCH), size):
        some = F.col("run_id").isin([r.run_id for r in BATCH[first:first + size]])
        pairs = rows.join(runs.where(some), rows.fold != runs.held).drop("held", "fold")
        scored = scoring.predict_pairs(fit.users.where(some), fit.items.where(some), means, pairs)
        errors.append(metrics.rmse(scored, "run_id").select("run_id", F.round("rmse", 6).alias("train_rmse")))
        if size < len(BATCH):
            errors[-1] = cut_lineage(errors[-1])  # one row per run
            free_shuffles(spark)
    return reduce(DataFrame.unionByName, errors)


@query(
    "predict_pairs",
    f"""WITH {fit_sql(FEATURED, 2, features=True)} SELECT user_id, item_id, round(mu + b_u + b_i + u * (v + i.f), 6) + 0.0 AS prediction
FROM folded JOIN users2 USING (user_id) JOIN items2 i USING (item_id), means2""",
)
def predict_pairs(spark, sf):
    data = _data(spark, sf, "scalars")
    fit = fit_runs(data, FEATURED)
    means = spark.createDataFrame([(0, fit.mu[0])], "run_id int, mu double")
    pairs = data.by_user.ratings.select(F.lit(0).alias("run_id"), F.col("own").alias("user_id"), F.col("other").alias("item_id"))
    return scoring.predict_pairs(fit.users, fit.items, means, pairs).select("user_id", "item_id", v.r6("prediction"))


@query(
    "predict_all",
    f"""WITH {fit_sql(PLAIN, 2)} SELECT user_id, count(*) AS n_items, round(avg(p), 6) AS pred_mean, round(min(p), 6) AS pred_min,
round(max(p), 6) AS pred_max FROM (SELECT user_id, mu + b_u + b_i + u * v AS p FROM users2, items2, means2) GROUP BY 1""",
)
def predict_all(spark, sf):
    """Every cell of the completed matrix is computed; each user's row is then summed up."""
    fit = fit_runs(_data(spark, sf), PLAIN)
    rows = scoring.completed_summary(fit.users, fit.items, fit.mu[0])
    return rows.select("user_id", "n_items", v.r6("pred_mean"), v.r6("pred_min"), v.r6("pred_max"))


@query(
    "recommend_topn",
    f"""WITH {fit_sql(PLAIN, 2)} SELECT user_id, item_id, round(score, 6) + 0.0 AS score, CAST(r AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM (
SELECT user_id, item_id, mu + b_u + b_i + u * v AS score FROM users2, items2, means2) ANTI JOIN ratings USING (user_id, item_id)) WHERE r <= 10""",
)
def recommend_topn(spark, sf):
    fit = fit_runs(_data(spark, sf), PLAIN)
    best = topn.recommend(fit.users, fit.items, fit.mu[0], 10, v.ratings(spark, sf))
    return best.select("user_id", "item_id", v.r6("score"), "rank")


@query(
    "recommend_pairs",
    """SELECT (SELECT count(*) FROM customer) AS n_users, (SELECT count(*) FROM customer) * (SELECT count(*) FROM part) AS n_pairs,
TRUE AS bounds_at_most_all, TRUE AS scored_under_half""",
)
def recommend_pairs(spark, sf):
    """How many pairs the search for the ten best of each user scores, at rank 4."""
    fit = fit_runs(_data(spark, sf), [Run(0, FOUR, None, None)])
    lists = topn.best_lists(fit.users, fit.items, fit.mu[0], 10, v.ratings(spark, sf))
    report = topn.pairs_report(lists, v.items(spark, sf).count())
    return report.select("n_users", "n_pairs", (F.col("walked") <= F.col("n_pairs")).alias("bounds_at_most_all"),
                         (2 * F.col("scored") < F.col("n_pairs")).alias("scored_under_half"))


@query("als_fit")
def als_fit(spark, sf):
    """A rank-4 fit with features and graph, early stopping on."""
    config = replace(FOUR, alpha=0.5, graph_feature="type", S_topk=20, lambda_w={"type": 5.0}, update_w_every=2)
    fit = fit_runs(_data(spark, sf, "type"), [Run(0, config, None, 1e-3, 5)])
    return fit.items.select("item_id", F.round("b_i", 6).alias("b_i"), F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@query("held_out_rmse")
def held_out_rmse(spark, sf):
    """Error of a rank-4 model with biases on each held-out fold."""
    runs = with_fold([Run(0, replace(FOUR, n_iters=3), None, None)], v.N_FOLDS)
    fit = fit_runs(_data(spark, sf), runs, score=True)
    n_sum = fit.held_out.groupBy("run_id").agg(F.sum("n").alias("n"), F.sum("sq_err").alias("sq"))
    return n_sum.select(F.col("run_id").alias("fold"), "n", F.round(F.sqrt(F.col("sq") / F.col("n")), 6).alias("rmse"))


# -------------------------------------------------------------------- graph


def edges_sql(vectors: str, topk: int) -> str:
    """Brute-force graph over all pairs, from a CTE vec(item_id, x)."""
    return f"""{vectors},
unit AS (SELECT item_id, list_transform(x, lambda e: e / (sqrt(list_dot_product(x, x)) + 1e-8)) AS x FROM vec),
cosines AS (SELECT a.item_id AS src, b.item_id AS dst, CASE WHEN a.item_id = b.item_id THEN 0.0 ELSE list_dot_product(a.x, b.x) END AS sim FROM unit a, unit b),
kept AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS r FROM cosines)
  WHERE r <= {topk} AND src <> dst AND round(sim, 9) <> 0),
both_ways AS (SELECT * FROM kept UNION ALL SELECT dst, src, sim FROM kept),
edges AS (SELECT src, dst, sim FROM (SELECT src, dst, CASE WHEN count(*) > 1 THEN max(sim) ELSE greatest(max(sim), 0) END AS sim
  FROM both_ways GROUP BY 1, 2) WHERE sim <> 0)"""


TYPE_VEC = """lv AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS ls FROM part),
vec AS (SELECT p_partkey AS item_id, list_transform(ls, lambda l: CASE WHEN l = p_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x FROM part, lv)"""
EMB_VEC = "vec AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
TYPE_EDGES, EMB_EDGES = edges_sql(TYPE_VEC, 5), edges_sql(EMB_VEC, 10)


def _edges(spark, sf, name, topk, whole=True):
    feature = v.type_feature(spark, sf) if name == "type" else v.embedding_feature(spark, sf)
    kept = graph.top_neighbours(graph.unit_vectors(feature, name, 1e-8), topk)
    return graph.symmetrize(kept) if whole else kept


@query("item_cosine", f"WITH {EMB_EDGES} SELECT src, round(sum(sim), 6) + 0.0 AS degree FROM cosines GROUP BY 1")
def item_cosine(spark, sf):
    """Row sums of the complete cosine matrix, without listing its cells."""
    return graph.cosine_row_sums(v.embedding_feature(spark, sf), "emb", 1e-8).select("src", v.r6("degree"))


@query("graph_topk", f"WITH {EMB_EDGES} SELECT src, dst, round(sim, 6) + 0.0 AS sim FROM kept")
def graph_topk(spark, sf):
    return _edges(spark, sf, "emb", 10, whole=False).select("src", "dst", v.r6("sim"))


@query("graph_topk_indicators", f"WITH {TYPE_EDGES} SELECT src, dst, round(sim, 6) + 0.0 AS sim FROM kept")
def graph_topk_indicators(spark, sf):
    return _edges(spark, sf, "type", 5, whole=False).select("src", "dst", v.r6("sim"))


@query(
    "graph_products",
    f"""WITH {TYPE_VEC}, d AS (SELECT count(DISTINCT x) AS n FROM vec) SELECT 'type' AS feature, n AS n_vectors, TRUE AS under_all_pairs FROM d, part GROUP BY ALL HAVING n < count(*)
UNION ALL SELECT 'emb', count(*), TRUE FROM (SELECT DISTINCT embedding FROM embeddings)""",
)
def graph_products(spark, sf):
    """Distinct vectors of a graph, and whether fewer products than pairs of items were taken (cells of 64 at least)."""
    out = None
    for name, table in (("type", v.type_feature(spark, sf)), ("emb", v.embedding_feature(spark, sf))):
        units = graph.unit_vectors(table, name, 1e-8).persist()
        n_items = units.count()
        row = neighbours.products_report(units, 10, cell=64).select(
            F.lit(name).alias("feature"), "n_vectors", (F.col("n_products") < 0.8 * n_items * n_items).alias("under_all_pairs"))
        out = row if out is None else out.unionByName(row)
    return out


@query("graph_symmetric", f"WITH {EMB_EDGES} SELECT src, dst, round(sim, 6) + 0.0 AS sim FROM edges")
def graph_symmetric(spark, sf):
    return _edges(spark, sf, "emb", 10).select("src", "dst", v.r6("sim"))


@query("graph_degree", f"WITH {TYPE_EDGES} SELECT src, round(sum(sim), 6) AS degree FROM edges GROUP BY 1")
def graph_degree(spark, sf):
    return graph.degrees(_edges(spark, sf, "type", 5)).select("src", v.r6("degree"))


@query(
    "edge_violations",
    """WITH e AS (SELECT ps.a AS src, ps.b AS dst, ps.s AS sim FROM (
SELECT l_partkey AS a, l_suppkey AS b, min(l_quantity)::DOUBLE AS s FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_suppkey, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 0.5 ELSE min(l_quantity)::DOUBLE END FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey, l_suppkey) ps),
once AS (SELECT src, dst, count(*) AS n, min(sim) AS low, max(sim) AS high FROM e GROUP BY 1, 2),
bad AS (SELECT 'repeated' AS rule, src, dst FROM once WHERE n > 1 UNION ALL SELECT 'self', src, dst FROM once WHERE src = dst
UNION ALL SELECT 'one way', a.src, a.dst FROM once a LEFT JOIN once b ON a.src = b.dst AND a.dst = b.src
  WHERE a.src <> a.dst AND (b.src IS NULL OR abs(a.low - b.low) > 1e-9 OR abs(a.high - b.high) > 1e-9)
UNION ALL SELECT 'unknown end', src, dst FROM once WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0)
  OR dst NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0))
SELECT rule, count(*) AS n_edges, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM bad GROUP BY 1""",
)
def edge_violations(spark, sf):
    """What is wrong with edges between parts and suppliers taken as a graph of parts: counts by rule."""
    lines = v.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").repartition(shuffle_width(spark), "l_partkey", "l_suppkey")
    pair = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").cast("double").alias("s"))
    back = pair.where("l_partkey % 7 <> 0").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_partkey") % 5 == 0, 0.5).otherwise(F.col("s")).alias("sim"))
    edges = pair.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("s").alias("sim")).unionByName(back)
    found = graph.edge_violations(edges, v.items(spark, sf).where("item_id % 9 <> 0"))
    return found.groupBy("rule").agg(F.count("*").alias("n_edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


LINKED_SQL = fit_sql(LINKED, 1, edges=TYPE_EDGES)


@query(
    "graph_pull",
    f"""WITH {LINKED_SQL} SELECT item_id, round(coalesce(d, 0), 6) + 0.0 AS degree, round(coalesce(pull, 0), 6) + 0.0 AS pull
FROM items0 LEFT JOIN pull1 USING (run_id, item_id)""",
)
def graph_pull(spark, sf):
    data = _data(spark, sf, "type")
    items = cut_lineage(_initial_state(data.items, "item_id", "V", LINKED))
    pulled = data.graphs.attach(items, LINKED, {0})
    return pulled.select(
        F.col("id").alias("item_id"),
        rounded(F.element_at("graph", 1)).alias("degree"),
        rounded(F.element_at("graph", 2)).alias("pull"),
    )


@query("item_step_graph", f"WITH {LINKED_SQL} {ITEM_OUT} FROM items1")
def item_step_graph(spark, sf):
    return _items_out(_item_half(_data(spark, sf, "type"), LINKED))
