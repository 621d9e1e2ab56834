"""Queries on parameter tables, studies, ablations and their tests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratingspark.operators import stats
from ratingspark.operators.baselines import fold_scores
from ratingspark.operators.folds import assign_folds
from ratingspark.plans import ablation, parzen, study
from ratingspark.plans.config import RUNS_SCHEMA
from ratingspark.plans.fit import fit_runs
from ratingspark.session import cut_lineage
from ratingspark.workload import views as v
from ratingspark.workload.models import BATCH, FOUR, _data
from ratingspark.workload.rank_one import fit_sql, uniform_sql
from ratingspark.workload.registry import query

NAMES = ["price", "size"]


# ---------------------------------------------------------------- parameters


def _u(name: str) -> str:
    return uniform_sql(42, "grid." + name, "trial")


def _penalty(name: str) -> str:
    return f"1e-4 * pow(1e8, {_u(name)})"


GRID = f"""grid AS (SELECT trial, CAST(floor({_u('n_factors')} * 150) + 1 AS INTEGER) AS n_factors, 100 AS n_iters,
{_penalty('lambda_u')} AS lambda_u, {_penalty('lambda_v')} AS lambda_v, {_penalty('lambda_bu')} AS lambda_bu, {_penalty('lambda_bi')} AS lambda_bi,
CASE WHEN {_u('pop_reg_mode')} >= 0.5 THEN 'inverse_sqrt' END AS pop_reg_mode,
CAST(floor({_u('update_w_every')} * 60) + 1 AS INTEGER) AS update_w_every, {_u('alpha')} * 100 AS alpha,
CAST(floor({_u('S_topk')} * 610) + 1 AS INTEGER) AS "S_topk", 1e-10 * pow(1e6, {_u('S_eps')}) AS "S_eps",
CASE WHEN floor({_u('graph_feature')} * 2) = 0 THEN 'price' ELSE 'size' END AS graph_feature,
{_penalty('lambda_w_price')} AS lw_price, {_penalty('lambda_w_size')} AS lw_size FROM (SELECT s_suppkey AS trial FROM supplier))"""
DOUBLES = ["lambda_u", "lambda_v", "lambda_bu", "lambda_bi", "alpha"]


def _grid(spark: SparkSession, sf: str, space: study.SearchSpace = study.SearchSpace()) -> DataFrame:
    """One trial per supplier."""
    trials = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("trial"))
    return study.param_grid(trials, NAMES, space=space)


def _flat(params: DataFrame, *keys: str) -> DataFrame:
    weight = lambda f: F.round(F.try_element_at("lambda_w", F.lit(f)), 6).alias(f"lw_{f}")
    return params.select(
        *keys, "n_factors", "n_iters", *[v.r6(c) for c in DOUBLES], "pop_reg_mode", "update_w_every",
        "S_topk", v.r6("S_eps", 12), "graph_feature", weight("price"), weight("size"),
    )


FLAT = "n_factors, n_iters, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in DOUBLES) + (
    ', pop_reg_mode, update_w_every, "S_topk", round("S_eps", 12) + 0.0 AS "S_eps", graph_feature, '
    "round(lw_price, 6) AS lw_price, round(lw_size, 6) AS lw_size"
)


@query("param_grid", f"WITH {GRID} SELECT trial, {FLAT} FROM grid")
def param_grid(spark, sf):
    return _flat(_grid(spark, sf), "trial")


@query(
    "normalize_params",
    f"""WITH {GRID}, shape AS (SELECT (SELECT count(*) FROM nation) AS m, (SELECT count(*) FROM part) AS n),
clipped AS (SELECT * REPLACE (CAST(greatest(1, least(n_factors, m, n)) AS INTEGER) AS n_factors,
CAST(greatest(1, least("S_topk", greatest(1, n - 1))) AS INTEGER) AS "S_topk",
greatest(1, least(update_w_every, n_iters)) AS update_w_every, CASE WHEN graph_feature = 'size' THEN alpha ELSE 0 END AS alpha,
CASE WHEN graph_feature = 'size' THEN 'size' ELSE '__none__' END AS graph_feature) FROM grid, shape)
SELECT trial, {FLAT} FROM clipped""",
)
def normalize_params(spark, sf):
    """Shape of a matrix of nations and parts, with only the size feature at hand."""
    return _flat(
        study.normalize_params(_grid(spark, sf), v.table(spark, sf, "nation"), v.items(spark, sf), ["size"]), "trial"
    )


@query(
    "runs_table",
    f"""WITH {GRID}, g AS (SELECT * REPLACE (CASE WHEN pop_reg_mode IS NULL THEN 0.0 ELSE lambda_bu END AS lambda_bu,
CASE WHEN alpha < 50 THEN 0.0 ELSE alpha END AS alpha) FROM grid),
r AS (SELECT * REPLACE (coalesce(nullif(lambda_bu, 0), lambda_u) AS lambda_bu, CASE WHEN alpha > 0 THEN graph_feature END AS graph_feature,
CASE WHEN alpha > 0 THEN "S_topk" END AS "S_topk") FROM g) SELECT trial, {FLAT} FROM r""",
)
def runs_table(spark, sf):
    grid = (
        _grid(spark, sf)
        .withColumn("lambda_bu", F.when(F.col("pop_reg_mode").isNull(), 0.0).otherwise(F.col("lambda_bu")))
        .withColumn("alpha", F.when(F.col("alpha") < 50, 0.0).otherwise(F.col("alpha")))
    )
    return _flat(study.model_parameters(grid), "trial")


@query(
    "load_params",
    f"""WITH {GRID} SELECT n_factors, round(lambda_u, 6) AS lambda_u, update_w_every, graph_feature, round(lw_size, 6) AS lw_size
FROM grid ORDER BY lambda_u, trial LIMIT 1""",
)
def load_params(spark, sf):
    """The trial of least penalty, saved as best parameters and read back."""
    path = v.scratch_path(spark, "best")
    grid = _grid(spark, sf)
    row = grid.agg(F.min_by(F.struct(*grid.columns[1:]), F.struct("lambda_u", "trial")).alias("params"))
    row.coalesce(1).write.json(path)
    return study.load_params(spark, path).select(
        F.col("n_factors").cast("int").alias("n_factors"), v.r6("lambda_u"),
        F.col("update_w_every").cast("int").alias("update_w_every"), "graph_feature",
        F.round("lambda_w.size", 6).alias("lw_size"),
    )


# -------------------------------------------------------------------- study

TRIAL_SCORES = f"""{v.guesses_sql(v.TRIALS)},
trial_scores AS (SELECT CAST(variant AS BIGINT) AS trial, fold, rmse, 10 + CAST(variant AS INTEGER) AS iters FROM scores),
medians AS (SELECT fold, median(rmse) AS med FROM trial_scores WHERE trial < 3 GROUP BY 1),
behind AS (SELECT trial, fold, min(rmse) OVER (PARTITION BY trial ORDER BY fold) AS best FROM trial_scores WHERE trial >= 3),
pruned AS (SELECT trial, min(fold) AS pruned_at FROM behind JOIN medians USING (fold) WHERE best > med GROUP BY 1),
trials AS (SELECT trial, CASE WHEN max(pruned_at) IS NULL THEN 'COMPLETE' ELSE 'PRUNED' END AS state,
CASE WHEN max(pruned_at) IS NULL THEN avg(rmse) ELSE arg_max(rmse, fold) END AS value, avg(iters) AS mean_iters,
count(*) FILTER (iters < 15) AS early_stopped_folds, count(*) AS folds_done FROM trial_scores LEFT JOIN pruned USING (trial)
WHERE pruned_at IS NULL OR fold <= pruned_at GROUP BY 1)"""


def _trial_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of eight shrinkage settings; the first three count as start-up trials."""
    trial = F.col("variant").cast("long")
    return cut_lineage(fold_scores(v.guesses(spark, sf, v.TRIALS))).select(  # a row per trial and fold, read several times
        trial.alias("trial"), "fold", "rmse", (trial + 10).cast("int").alias("iters"),
        F.lit(15).alias("n_iters"), F.lit(v.N_FOLDS).alias("n_folds"),
    )


def _pruned(scores: DataFrame) -> DataFrame:
    return study.median_rule(scores.where("trial >= 3"), scores.where("trial < 3"), 3)


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    scores = _trial_scores(spark, sf)
    done = scores.join(_pruned(scores), "trial", "left")
    return study.summarize_trials(done.where("pruned_at IS NULL OR fold <= pruned_at"))


@query("prune_runs", f"WITH {TRIAL_SCORES} SELECT trial, pruned_at FROM pruned")
def prune_runs(spark, sf):
    return _pruned(_trial_scores(spark, sf))


@query(
    "trials_table",
    f"""WITH {TRIAL_SCORES} SELECT trial, state, round(value, 6) AS value, mean_iters, early_stopped_folds, folds_done FROM trials""",
)
def trials_table(spark, sf):
    """Written as CSV with lists as JSON text, and read again."""
    path = v.scratch_path(spark, "trials")
    study.trials_for_csv(_trials(spark, sf)).coalesce(1).write.option("header", True).csv(path)
    saved = spark.read.option("header", True).csv(path)
    return saved.select(
        F.col("trial").cast("long").alias("trial"),
        "state",
        F.round(F.col("value").cast("double"), 6).alias("value"),
        F.col("mean_iters").cast("double").alias("mean_iters"),
        F.col("early_stopped_folds").cast("long").alias("early_stopped_folds"),
        F.size(F.from_json("fold_rmse", "array<double>")).cast("long").alias("folds_done"),
    )


@query(
    "study_summary",
    f"""WITH {TRIAL_SCORES} SELECT round(min(value) FILTER (state = 'COMPLETE'), 6) AS best_value,
(SELECT trial FROM trials WHERE state = 'COMPLETE' ORDER BY value, trial LIMIT 1) AS best_trial, count(*) AS n_trials,
count(*) FILTER (state = 'COMPLETE') AS n_complete, count(*) FILTER (state = 'PRUNED') AS n_pruned FROM trials""",
)
def study_summary(spark, sf):
    path = v.scratch_path(spark, "summary")
    study.study_summary(_trials(spark, sf)).coalesce(1).write.json(path)
    saved = spark.read.schema("best_value double, best_trial long, n_trials long, n_complete long, n_pruned long").json(path)
    return saved.withColumn("best_value", F.round("best_value", 6))


@query(
    "best_trial",
    f"""WITH {TRIAL_SCORES} SELECT trial, round(value, 6) AS value, mean_iters FROM trials WHERE state = 'COMPLETE' ORDER BY trials.value, trial LIMIT 1""",
)
def best_trial(spark, sf):
    return study.best_trial(_trials(spark, sf)).select("trial", F.round("value", 6).alias("value"), "mean_iters")


@query(
    "cv_score",
    f"""WITH {fit_sql(BATCH, 2)}, guess AS (SELECT run_id, rating - (mu + b_u + b_i + u * (v + i.f)) AS e FROM folded f JOIN runs r ON f.fold = r.fold
JOIN users2 USING (run_id, user_id) JOIN items2 i USING (run_id, item_id) JOIN means2 USING (run_id)),
s AS (SELECT run_id, sqrt(avg(e * e)) AS rmse FROM guess GROUP BY 1)
SELECT CAST(run_id // {v.N_FOLDS} AS BIGINT) AS trial, round(avg(rmse), 6) AS value, 2.0 AS mean_iters, CAST(0 AS BIGINT) AS early_stopped_folds,
round(list_sum(list_transform(list(rmse ORDER BY run_id), lambda e, i: e * i)), 6) AS in_fold_order FROM s GROUP BY 1""",
)
def cv_score(spark, sf):
    """Two settings on five folds; the fold list enters through an order-sensitive sum."""
    fit = fit_runs(_data(spark, sf), BATCH, score=True)
    names = {r.run_id: (r.run_id // v.N_FOLDS,) for r in BATCH}
    scores = study.run_scores(fit, names, "trial long").withColumn("n_folds", F.lit(v.N_FOLDS))
    weighted = F.aggregate(
        F.zip_with("fold_rmse", F.sequence(F.lit(1), F.lit(v.N_FOLDS)), lambda e, i: e * i), F.lit(0.0), lambda a, x: a + x
    )
    return study.summarize_trials(scores).select(
        "trial", F.round("value", 6).alias("value"), "mean_iters", "early_stopped_folds",
        F.round(weighted, 6).alias("in_fold_order"),
    )


# Search space of study_resume: low ranks, one neighbour list per feature.
LOW_RANKS = study.SearchSpace(n_factors=(1, 3), n_iters=2, topk=(10, 10), graph_eps=(1e-8, 1e-8))


def _side(good: str) -> str:
    """Kernels of one side and what a density at ``p`` is."""
    return f"""list(x ORDER BY x) FILTER ({good}) AS c, 0.6 * greatest(1.06 * coalesce(stddev_pop(x) FILTER ({good}), 0)
* pow(greatest(count(x) FILTER ({good}), 1), -0.2), 1.0 / least(100, count(x) FILTER ({good}) + 1)) AS w"""


DENSITY = """(1 + coalesce(list_sum(list_transform(c, lambda m: exp(-abs((p - m) / w)) / (w * pow(1 + exp(-abs((p - m) / w)), 2))
/ (1 / (1 + exp(-(1 - m) / w)) - 1 / (1 + exp(m / w))))), 0)) / (coalesce(len(c), 0) + 1)"""


@query(
    "parzen_ratio",
    f"""WITH {GRID}, t AS (SELECT grid.*, s_acctbal AS value, trial % 4 <> 0 AS done FROM grid JOIN supplier ON trial = s_suppkey),
ranked AS (SELECT *, done AND row_number() OVER (ORDER BY CASE WHEN done THEN 0 ELSE 1 END, value, trial)
<= least(ceil(0.1 * count(*) FILTER (done) OVER ()), 25) AS good FROM t),
rows AS (SELECT param, good, greatest(0, least(1, x)) AS x FROM ranked, LATERAL (VALUES ('n_factors', (n_factors - 0.5) / 150),
('lambda_u', ln(lambda_u / 1e-4) / ln(1e8)), ('alpha', alpha / 100), ('lambda_w_size', ln(lw_size / 1e-4) / ln(1e8))) AS u(param, x)),
sides AS (SELECT param, 1 AS sign, {_side('good')} FROM rows GROUP BY 1 UNION ALL SELECT param, -1, {_side('NOT good')} FROM rows GROUP BY 1)
SELECT param, p AS point, round(sum(sign * ln({DENSITY})), 6) + 0.0 AS log_ratio
FROM sides, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p) GROUP BY 1, 2""",
)
def parzen_ratio(spark, sf):
    """How much likelier parameters are among the good trials; account balances stand for values."""
    value = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("trial"), F.col("s_acctbal").cast("double").alias("value"))
    state = F.when(F.col("trial") % 4 != 0, "COMPLETE").otherwise("PRUNED")
    axes = [a for a in parzen.axes(study.SearchSpace(), NAMES) if a.name in ("n_factors", "lambda_u", "alpha", "lambda_w_size")]
    row = parzen.densities(parzen.split_trials(_grid(spark, sf).join(value, "trial").withColumn("state", state)), axes)
    points = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    each = row.select("*", points.alias("point")).select("point", F.explode(F.create_map(*[
        x for a in axes for x in (F.lit(a.name), parzen.log_ratio(F.col("point"), F.col("of_" + a.name)))])).alias("param", "log_ratio"))
    return each.select("param", "point", v.r6("log_ratio"))


@query("tune_study")
def tune_study(spark, sf):
    """As many trials as suppliers over the whole search space, in waves proposed from the finished ones, with pruning between folds."""
    search = study.ModelBased(v.table(spark, sf, "supplier").count())
    result = study.run_study(
        assign_folds(v.ratings(spark, sf), 3), v.scalar_features(spark, sf), search, 3,
        users=v.users(spark, sf), items=v.items(spark, sf), save_every=4,
    )
    return result.trials.select("trial", "state", F.round("value", 6).alias("value"), "mean_iters", "n_factors")


@query("study_resume")
def study_resume(spark, sf):
    """A study that runs out of time after its start-up trials and goes on from its saved scores."""
    path = v.scratch_path(spark, "study")
    where = dict(users=v.users(spark, sf), items=v.items(spark, sf), path=path)
    folded = assign_folds(v.ratings(spark, sf), 3)
    trials = _grid(spark, sf, LOW_RANKS)
    study.run_study(folded, None, trials, 3, timeout_sec=0.0, **where)
    result = study.run_study(folded, None, trials, 3, **where)
    return result.trials.select("trial", "state", F.round("value", 6).alias("value"), "mean_iters")


# ----------------------------------------------------------------- ablation

BASES = f"""{GRID}, bases AS (SELECT * REPLACE (CASE WHEN pop_reg_mode IS NULL THEN 0.0 ELSE lw_price END AS lw_price,
CASE WHEN alpha < 30 THEN 0.0 ELSE alpha END AS alpha) FROM grid),
variants AS (
SELECT *, 0 AS position, 'full' AS variant FROM bases
UNION ALL SELECT * REPLACE (0.0 AS lw_price, 0.0 AS lw_size), 1, 'no_features' FROM bases WHERE lw_price > 0 OR lw_size > 0
UNION ALL SELECT * REPLACE (0.0 AS lw_size), 2, 'only_price' FROM bases WHERE lw_price > 0
UNION ALL SELECT * REPLACE (0.0 AS lw_price), 3, 'only_size' FROM bases WHERE lw_size > 0
UNION ALL SELECT * REPLACE (0.0 AS alpha, '__none__' AS graph_feature), 4, 'no_graph' FROM bases WHERE alpha > 0
UNION ALL SELECT * REPLACE ('price' AS graph_feature), 5, 'graph_feature=price' FROM bases WHERE alpha > 0 AND graph_feature <> 'price'
UNION ALL SELECT * REPLACE ('size' AS graph_feature), 6, 'graph_feature=size' FROM bases WHERE alpha > 0 AND graph_feature <> 'size'
UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS pop_reg_mode), 7, 'no_pop_reg' FROM bases WHERE pop_reg_mode IS NOT NULL)"""


def _variants(spark, sf):
    """Variants of each supplier's trial; some use one feature or no graph."""
    grid = _grid(spark, sf).withColumnRenamed("trial", "study")
    price = F.when(F.col("pop_reg_mode").isNull(), 0.0).otherwise(F.element_at("lambda_w", F.lit("price")))
    bases = grid.withColumn(
        "lambda_w",
        F.map_from_arrays(F.array(F.lit("price"), F.lit("size")), F.array(price, F.element_at("lambda_w", F.lit("size")))),
    ).withColumn("alpha", F.when(F.col("alpha") < 30, 0.0).otherwise(F.col("alpha")))
    return ablation.variant_grid(bases, NAMES)


@query("variant_grid", f"WITH {BASES} SELECT trial AS study, position, variant, {FLAT} FROM variants")
def variant_grid(spark, sf):
    return _flat(_variants(spark, sf), "study", "position", "variant")


@query(
    "variant_dedupe",
    f"""WITH {BASES} SELECT study, variant FROM (SELECT trial AS study, variant, row_number() OVER (PARTITION BY trial, n_factors, alpha,
graph_feature, pop_reg_mode, lw_price, lw_size ORDER BY position) AS r FROM variants) WHERE r = 1""",
)
def variant_dedupe(spark, sf):
    return ablation.dedupe_variants(_variants(spark, sf)).select("study", "variant")


SCORES = v.guesses_sql(v.SETTINGS)
SUMMARY = f"""{SCORES}, summary AS (SELECT variant, avg(rmse) AS rmse_mean, coalesce(stddev_samp(rmse), 0) AS rmse_std,
avg(10.0 + fold) AS mean_iters, count(*) FILTER (10 + fold < 13) AS early_stopped_folds FROM scores GROUP BY 1)"""


def _scores(spark, sf):
    return cut_lineage(fold_scores(v.guesses(spark, sf)))  # a row per variant and fold, read several times


def _summary(spark, sf):
    scores = _scores(spark, sf).withColumns(
        {"seconds": F.lit(0.0), "iters": F.col("fold") + 10, "n_iters": F.lit(13)}
    )
    return stats.summarize_variants(scores)


@query(
    "variant_summary",
    f"WITH {SUMMARY} SELECT variant, round(rmse_mean, 6) AS rmse_mean, round(rmse_std, 6) AS rmse_std, mean_iters, early_stopped_folds FROM summary",
)
def variant_summary(spark, sf):
    return _summary(spark, sf).select("variant", v.r6("rmse_mean"), v.r6("rmse_std"), "mean_iters", "early_stopped_folds")


@query(
    "variant_ranking",
    f"WITH {SUMMARY} SELECT variant, CAST(row_number() OVER (ORDER BY round(rmse_mean, 9), variant) AS INTEGER) AS place FROM summary",
)
def variant_ranking(spark, sf):
    order = Window.partitionBy(F.lit(0)).orderBy(F.round("rmse_mean", 9), "variant")  # one row per variant
    return _summary(spark, sf).select("variant", F.row_number().over(order).alias("place"))


DIFFS = f"""{SCORES}, diffs AS (SELECT a.variant, a.fold, a.rmse - b.rmse AS d FROM scores a JOIN scores b ON a.fold = b.fold AND b.variant = 'full'
WHERE a.variant <> 'full')"""
CDF = """(SELECT coalesce(sum(factorial(n::INTEGER) / (factorial(i::INTEGER) * factorial((n - i)::INTEGER))), 0) / pow(2, n) FROM unnest(range(CAST({k} AS BIGINT) + 1)) AS r(i))"""
TESTS = f"""{DIFFS}, counted AS (SELECT variant, count(*) FILTER (abs(d) > 1e-8) AS n, count(*) FILTER (d > 1e-8) AS k, avg(d) AS delta_mean FROM diffs GROUP BY 1),
tests AS (SELECT variant, n, k, delta_mean, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * least({CDF.format(k='k')},
CASE WHEN k > 0 THEN 1 - {CDF.format(k='k - 1')} ELSE 1.0 END)) END AS p_raw FROM counted)"""


@query("paired_delta", f"WITH {DIFFS} SELECT variant, round(avg(d), 6) + 0.0 AS delta_mean FROM diffs GROUP BY 1")
def paired_delta(spark, sf):
    diffs = stats.paired_differences(_scores(spark, sf))
    return diffs.groupBy("variant").agg(F.avg("diff").alias("delta_mean")).select("variant", v.r6("delta_mean"))


@query("sign_test", f"WITH {TESTS} SELECT variant, n AS n_pairs, k AS n_positive, round(p_raw, 9) AS p_raw FROM tests")
def sign_test(spark, sf):
    tests = stats.compare_to_baseline(_scores(spark, sf))
    return tests.select("variant", "n_pairs", "n_positive", F.round("p_raw", 9).alias("p_raw"))


@query(
    "fdr_bh",
    f"""WITH {TESTS}, ranked AS (SELECT variant, p_raw, p_raw * count(*) OVER () / row_number() OVER w AS a, row_number() OVER w AS r FROM tests
WINDOW w AS (ORDER BY p_raw, variant))
SELECT variant, round(p_raw, 9) AS p_raw, round(least(1.0, min(a) OVER (ORDER BY r DESC)), 9) AS p_fdr FROM ranked""",
)
def fdr_bh(spark, sf):
    tests = stats.benjamini_hochberg(stats.compare_to_baseline(_scores(spark, sf)))
    return tests.select("variant", F.round("p_raw", 9).alias("p_raw"), F.round("p_fdr", 9).alias("p_fdr"))


def _best(spark: SparkSession, graph: bool) -> DataFrame:
    config = replace(
        FOUR, n_factors=2, n_iters=3, lambda_w={"price": 10.0, "size": 5.0},
        alpha=0.5 if graph else 0.0, graph_feature="size", S_topk=10,
    )
    row = tuple(getattr(config, f.name) for f in RUNS_SCHEMA.fields[2:])
    return spark.createDataFrame([row], ablation_schema())


def ablation_schema():
    return RUNS_SCHEMA[2:]


def _ablation(spark, sf, graph: bool, path: str | None = None):
    return ablation.run_ablation(
        v.folded(spark, sf), v.scalar_features(spark, sf), _best(spark, graph), v.N_FOLDS,
        users=v.users(spark, sf), items=v.items(spark, sf), path=path,
    )


@query("eval_variants")
def eval_variants(spark, sf):
    """Held-out error and iterations of each variant and fold."""
    return _ablation(spark, sf, graph=False).scores.select("variant", "fold", F.round("rmse", 6).alias("rmse"), "iters")


@query("ablation_study")
def ablation_study(spark, sf):
    table = _ablation(spark, sf, graph=True).table
    drop = [c for c in table.columns if c.startswith("time_")]
    numbers = [f.name for f in table.schema.fields if f.dataType.typeName() == "double"]
    return table.withColumns({c: F.round(c, 6) for c in numbers}).drop(*drop)


@query("ablation_table")
def ablation_table(spark, sf):
    """The saved JSON document, one row per variant again."""
    path = v.scratch_path(spark, "ablation")
    _ablation(spark, sf, graph=False, path=path)
    saved = spark.read.json(f"{path}/ablations_json").select("seed", "matrix_shape", F.explode("results").alias("r"))
    return saved.select(
        "seed", F.element_at("matrix_shape", 1).alias("n_users"), F.element_at("matrix_shape", 2).alias("n_items"),
        "r.variant", F.round("r.rmse_mean", 6).alias("rmse_mean"), F.round("r.rmse_pop_1", 6).alias("rmse_pop_1"),
        F.round("r.p_fdr", 6).alias("p_fdr"), "r.param_lambda_w_size",
    )
