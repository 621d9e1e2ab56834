"""Hyperparameter study: a table of trials, scored by cross-validation."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ratingspark.functions.portable import uniform
from ratingspark.operators.normalize import require_finite
from ratingspark.operators.folds import require_matching_folds
from ratingspark.plans.config import DEFAULT_SEED, NO_GRAPH, PARAMETERS, RUNS_SCHEMA, ModelConfig, Run, config_from_row
from ratingspark.plans.fit import FitInput, FitResult, fit_runs, prepare
from ratingspark.plans.parzen import propose

# Bounds of the search space and stopping rule of studies.
RANK_RANGE = (1, 150)
N_ITERS = 100
PENALTY_RANGE = (1e-4, 1e4)
UPDATE_EVERY_RANGE = (1, 60)
ALPHA_RANGE = (0.0, 100.0)
TOPK_RANGE = (1, 610)
GRAPH_EPS_RANGE = (1e-10, 1e-4)
STUDY_TOL = 1e-4
STUDY_MIN_ITERS = 10


def _whole(u: Column, low: int, high: int) -> Column:
    return (F.floor(u * F.lit(high - low + 1)) + low).cast("int")


def _log_range(u: Column, low: float, high: float) -> Column:
    return F.lit(low) * F.pow(F.lit(high / low), u)


@dataclass(frozen=True)
class SearchSpace:
    """Bounds of a random search, both ends included; ``n_iters`` is fixed."""

    n_factors: tuple[int, int] = RANK_RANGE
    n_iters: int = N_ITERS
    penalty: tuple[float, float] = PENALTY_RANGE
    update_w_every: tuple[int, int] = UPDATE_EVERY_RANGE
    alpha: tuple[float, float] = ALPHA_RANGE
    topk: tuple[int, int] = TOPK_RANGE
    graph_eps: tuple[float, float] = GRAPH_EPS_RANGE


def param_grid(
    trials: DataFrame, feature_names: list[str], seed: int = DEFAULT_SEED, space: SearchSpace = SearchSpace()
) -> DataFrame:
    """Random-search parameters for each ``trial``, from a hash of its number."""

    def draw(name: str) -> Column:
        return uniform(seed, "grid." + name, F.col("trial"))

    def penalty(name: str) -> Column:
        return _log_range(draw(name), *space.penalty)

    choices = feature_names or [NO_GRAPH]
    graph = F.element_at(F.array(*[F.lit(c) for c in choices]), _whole(draw("graph_feature"), 1, len(choices)))
    lambda_w = F.map_from_arrays(
        F.array(*[F.lit(f) for f in feature_names]).cast("array<string>"),
        F.array(*[penalty("lambda_w_" + f) for f in feature_names]).cast("array<double>"),
    )
    return trials.select(
        "trial",
        _whole(draw("n_factors"), *space.n_factors).alias("n_factors"),
        F.lit(space.n_iters).alias("n_iters"),
        penalty("lambda_u").alias("lambda_u"),
        penalty("lambda_v").alias("lambda_v"),
        penalty("lambda_bu").alias("lambda_bu"),
        penalty("lambda_bi").alias("lambda_bi"),
        F.when(draw("pop_reg_mode") >= 0.5, "inverse_sqrt").alias("pop_reg_mode"),
        _whole(draw("update_w_every"), *space.update_w_every).alias("update_w_every"),
        (F.lit(space.alpha[0]) + draw("alpha") * (space.alpha[1] - space.alpha[0])).alias("alpha"),
        _whole(draw("S_topk"), *space.topk).alias("S_topk"),
        _log_range(draw("S_eps"), *space.graph_eps).alias("S_eps"),
        graph.alias("graph_feature"),
        lambda_w.alias("lambda_w"),
    )


def normalize_params(params: DataFrame, users: DataFrame, items: DataFrame, feature_names: list[str]) -> DataFrame:
    """Clip parameters to the data: rank, neighbours, projection interval, graph."""
    shape = users.agg(F.count("*").alias("_m")).join(items.agg(F.count("*").alias("_n")))  # one row
    known = F.col("graph_feature").isin(feature_names) if feature_names else F.lit(False)
    known = F.coalesce(known, F.lit(False))
    return (
        params.join(F.broadcast(shape))
        .withColumn("n_factors", F.greatest(F.lit(1), F.least("n_factors", "_m", "_n")).cast("int"))
        .withColumn("S_topk", F.greatest(F.lit(1), F.least(F.col("S_topk"), F.greatest(F.lit(1), F.col("_n") - 1))).cast("int"))
        .withColumn("update_w_every", F.greatest(F.lit(1), F.least("update_w_every", "n_iters")).cast("int"))
        .withColumn("alpha", F.when(known, F.col("alpha")).otherwise(0.0))
        .withColumn("graph_feature", F.when(known, F.col("graph_feature")).otherwise(NO_GRAPH))
        .drop("_m", "_n")
    )


def model_parameters(params: DataFrame) -> DataFrame:
    """What a parameter row means to the model: fallbacks applied, idle graph off."""
    graph = (F.col("alpha") > 0) & (F.col("graph_feature") != NO_GRAPH)
    return (
        params.withColumn("lambda_bu", F.coalesce(F.nullif("lambda_bu", F.lit(0.0)), "lambda_u"))
        .withColumn("lambda_bi", F.coalesce(F.nullif("lambda_bi", F.lit(0.0)), "lambda_v"))
        .withColumn("alpha", F.when(graph, F.col("alpha")).otherwise(0.0))
        .withColumn("graph_feature", F.when(graph, F.col("graph_feature")))
        .withColumn("S_topk", F.when(graph, F.col("S_topk")))
    )


def summarize_trials(scores: DataFrame) -> DataFrame:
    """One row per trial from (trial, fold, rmse, iters, n_iters, n_folds).

    A trial with fewer folds than planned was pruned; its value is its last score.
    """
    rows = F.sort_array(F.collect_list(F.struct("fold", "rmse", "iters")))  # one entry per fold
    return (
        scores.groupBy("trial")
        .agg(
            rows.alias("rows"),
            F.avg("rmse").alias("mean_rmse"),
            F.avg("iters").alias("mean_iters"),
            F.count_if(F.col("iters") < F.col("n_iters")).alias("early_stopped_folds"),
            F.max("n_iters").alias("target_n_iters"),
            F.max("n_folds").alias("n_folds"),
        )
        .select(
            "trial",
            F.when(F.size("rows") == F.col("n_folds"), "COMPLETE").otherwise("PRUNED").alias("state"),
            F.when(F.size("rows") == F.col("n_folds"), F.col("mean_rmse"))
            .otherwise(F.element_at("rows", -1)["rmse"]).alias("value"),
            "mean_iters", "early_stopped_folds", "target_n_iters",
            F.col("rows.iters").alias("iters_per_fold"),
            F.col("rows.rmse").alias("fold_rmse"),
        )
    )


def median_rule(scores: DataFrame, finished: DataFrame, n_startup: int) -> DataFrame:
    """Trials whose best score so far is worse than the median of finished trials.

    ``scores`` and ``finished`` are (trial, fold, rmse); the result is (trial,
    pruned_at), the first fold at which a trial falls behind. No trial is
    pruned before ``n_startup`` trials are finished.
    """
    medians = finished.groupBy("fold").agg(
        F.percentile("rmse", F.lit(0.5)).alias("median"), F.count("*").alias("n_finished")
    )
    best = F.min("rmse").over(
        Window.partitionBy("trial").orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    behind = scores.withColumn("best", best).join(F.broadcast(medians), "fold")  # one row per fold
    return (
        behind.where((F.col("n_finished") >= n_startup) & (F.col("best") > F.col("median")))
        .groupBy("trial")
        .agg(F.min("fold").alias("pruned_at"))
    )


def best_trial(trials: DataFrame) -> DataFrame:
    """The complete trial with the least value, the earliest one among equals."""
    done = trials.where(F.col("state") == "COMPLETE")
    row = F.struct(*[F.col(c) for c in trials.columns])
    return done.agg(F.min_by(row, F.struct("value", "trial")).alias("best")).where("best IS NOT NULL").select("best.*")


def study_summary(trials: DataFrame) -> DataFrame:
    done = F.col("state") == "COMPLETE"
    return trials.agg(
        F.min(F.when(done, F.col("value"))).alias("best_value"),
        F.min_by("trial", F.when(done, F.struct("value", "trial"))).alias("best_trial"),
        F.count("*").alias("n_trials"),
        F.count_if(done).alias("n_complete"),
        F.count_if(F.col("state") == "PRUNED").alias("n_pruned"),
    )


def trials_for_csv(trials: DataFrame) -> DataFrame:
    """Trials with nested columns as JSON text."""
    nested = [f.name for f in trials.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return trials.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in trials.columns])


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Best parameters from JSON, either plain or under ``params``, one column for each parameter.

    Projection penalties may be a map ``lambda_w`` or flat keys ``lambda_w_<feature>``; absent
    parameters are NULL.
    """
    kinds = {f.name: f.dataType for f in RUNS_SCHEMA.fields if f.name in PARAMETERS}
    whole = spark.read.option("wholetext", True).text(path).select("value")
    body = F.coalesce(F.get_json_object("value", "$.params"), F.col("value"))
    fields = F.from_json(body, "map<string,string>")
    flat = F.map_filter(fields, lambda k, x: k.startswith("lambda_w_") & x.isNotNull())
    flat = F.transform_values(F.transform_keys(flat, lambda k, x: F.substring(k, 10, 1_000)), lambda k, x: x.cast("double"))
    given = F.coalesce(F.from_json(fields["lambda_w"], "map<string,double>"), F.from_json(F.lit("{}"), "map<string,double>"))
    columns = [
        (F.map_concat(given, F.map_filter(flat, lambda k, x: ~F.map_contains_key(given, k))) if name == "lambda_w"
         else fields[name].cast(kind)).alias(name)
        for name, kind in kinds.items()
    ]
    return whole.where(F.trim("value") != "").select(*columns)


def fold_rmse(fit: FitResult) -> DataFrame:
    """(run_id, rmse) on each run's own fold."""
    return fit.held_out.groupBy("run_id").agg(F.sqrt(F.sum("sq_err") / F.sum("n")).alias("rmse"))


def run_scores(fit: FitResult, names: dict[int, tuple], schema: str) -> DataFrame:
    """Held-out scores with the keys of each run: names[run_id] is one row of ``schema``."""
    spark = fit.users.sparkSession
    done = fit.iterations()
    rows = [(r.run_id, *names[r.run_id], r.fold, done[r.run_id], r.config.n_iters, fit.seconds[r.run_id]) for r in fit.runs]
    keys = spark.createDataFrame(rows, f"run_id int, {schema}, fold int, iters int, n_iters int, seconds double")
    return fold_rmse(fit).join(keys, "run_id")


@dataclass(frozen=True)
class StudyResult:
    trials: DataFrame
    summary: DataFrame
    best: DataFrame
    path: str | None


def run_study(
    folded: DataFrame,
    features: DataFrame | None,
    params: DataFrame | ModelBased,
    n_folds: int,
    *,
    users: DataFrame | None = None,
    items: DataFrame | None = None,
    path: str | None = None,
    study: str = "study",
    save_every: int = 50,
    timeout_sec: float | None = None,
    tol: float | None = STUDY_TOL,
    min_iters: int = STUDY_MIN_ITERS,
    seed: int = DEFAULT_SEED,
    folds_seed: int = DEFAULT_SEED,
    saved_folds: tuple[DataFrame, DataFrame] | None = None,
) -> StudyResult:
    """Fit and score the trials of ``params`` (trial + parameter columns, or a model-based search).

    Trials are fitted together, fold after fold. After each fold the median
    rule drops the trials that fall behind the finished ones. With ``path`` the
    scores of every group of ``save_every`` trials are written with the tables
    made of them, and a restarted study skips the trials found there. Tables that
    cannot be written between groups are a warning, at the end an error.
    A group is a folder of its own that counts once its success marker stands and is
    replaced when written again, so a crash at any point leaves each trial at most once.

    A ``ModelBased`` search draws its first trials at random; the parameters of every later group
    are proposed from all trials finished by then.
    """
    spark = folded.sparkSession
    data = prepare(folded, users, items, features)
    try:
        if saved_folds is not None:
            require_matching_folds(*saved_folds, folded, data.users, data.items)
        if features is not None:
            require_finite(features)
        names = [name for name, _, _ in data.slices]
        searching = isinstance(params, ModelBased)
        settings: dict[int, ModelConfig] = {}
        known: list[tuple] = []  # trial and parameters as proposed

        def settle(table: DataFrame) -> None:
            table = table.select("trial", *PARAMETERS)
            known.extend(tuple(r) for r in table.collect())  # one row per trial
            clipped = normalize_params(table, data.users, data.items, names).orderBy("trial")
            settings.update({r.trial: config_from_row(r, seed) for r in clipped.select("trial", *PARAMETERS).collect()})

        if searching:
            trials = list(range(params.n_trials))
        else:
            settle(params)
            trials = sorted(settings)
        context = {
            "study": F.lit(study), "seed": F.lit(seed), "folds_seed": F.lit(folds_seed), "n_folds": F.lit(n_folds),
            "es_tol": F.lit(tol).cast("double"), "es_min_iters": F.lit(min_iters),
            "matrix_shape": F.array(F.lit(data.users.count()), F.lit(data.items.count())),
            "feature_names": F.array(*[F.lit(x) for x in names]).cast("array<string>"),
        }
        rows = [tuple(r) for r in _saved(spark, path, "scores", SCORES_SCHEMA)]
        if searching:
            kept = [tuple(r) for r in _saved(spark, path, "params", TRIALS_SCHEMA)]
            if kept:
                settle(spark.createDataFrame(kept, TRIALS_SCHEMA))
        waiting = sorted(set(trials) - {r[0] for r in rows})
        n_startup = min(5, max(2, len(trials) // 6))
        began = time.monotonic()
        size = max(1, save_every)
        left = max(0, n_startup - sum(1 for n in _count(rows).values() if n == n_folds))
        groups, rest = [waiting[:left]], waiting[left:]
        groups += [rest[i : i + size] for i in range(0, len(rest), size)]
        groups = [g for g in groups if g]
        for number, group in enumerate(groups):
            if timeout_sec is not None and number and time.monotonic() - began > timeout_sec:
                break
            new = [t for t in group if t not in settings]
            if new:
                settle(params.next_trials(spark, new, names, _trials(spark, rows, known) if rows else None, seed))
            found = _score_group(data, settings, group, n_folds, rows, n_startup, tol, min_iters)
            rows += found
            if path:
                if new:
                    _save_group(spark.createDataFrame([k for k in known if k[0] in set(new)], TRIALS_SCHEMA), path, "params", group[0])
                _save_group(spark.createDataFrame(found, SCORES_SCHEMA), path, "scores", group[0])
                if number + 1 < len(groups):
                    _save_between(_result(spark, rows, known, path), path, study, context)
    finally:
        data.release()
    result = _result(spark, rows, known, path)
    if path:
        save_study(result, path, study, context)
    return result


@dataclass(frozen=True)
class ModelBased:
    """A search of ``n_trials`` trials; the first group is drawn at random, later ones are proposed."""

    n_trials: int
    space: SearchSpace = SearchSpace()
    candidates: int = 24

    def next_trials(self, spark: SparkSession, trials: list[int], feature_names: list[str], finished: DataFrame | None, seed: int) -> DataFrame:
        new = spark.createDataFrame([(t,) for t in trials], "trial long")
        if finished is None:
            return param_grid(new, feature_names, seed, self.space)
        return propose(new, finished, feature_names, self.space, seed, self.candidates)


def _trials(spark: SparkSession, rows: list[tuple], known: list[tuple]) -> DataFrame:
    return summarize_trials(spark.createDataFrame(rows, SCORES_SCHEMA)).join(spark.createDataFrame(known, TRIALS_SCHEMA), "trial")


def _result(spark: SparkSession, rows: list[tuple], known: list[tuple], path: str | None) -> StudyResult:
    trials = _trials(spark, rows, known)
    return StudyResult(trials, study_summary(trials), best_trial(trials), path)


def _save_between(result: StudyResult, path: str, study: str, context: dict[str, Column]) -> None:
    try:
        save_study(result, path, study, context)
    except Exception as error:  # the scores are safe, the next group writes the tables again
        warnings.warn(f"tables of study {study} not written: {error}", stacklevel=2)


SCORES_SCHEMA = "trial long, fold int, rmse double, iters int, n_iters int, n_folds int, seconds double"


TRIALS_SCHEMA = T.StructType([T.StructField("trial", T.LongType()), *[RUNS_SCHEMA[name] for name in PARAMETERS]])


def _save_group(rows: DataFrame, path: str, kind: str, group: int) -> None:
    """Write a group in a folder of its own; written again, it takes the place of the first attempt."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}/group={group:08d}")


def _saved(spark: SparkSession, path: str | None, kind: str, schema) -> list:
    """Rows of the groups whose success marker stands."""
    if not path:
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{path}/{kind}/group=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    folders = [str(f.getPath().getParent()) for f in found or []]
    return spark.read.schema(schema).parquet(*folders).collect() if folders else []  # trials x folds


def _score_group(
    data: FitInput, settings, group, n_folds, rows, n_startup, tol, min_iters
) -> list[tuple]:
    """Scores of a group of trials. Before the rule applies, all folds go in one batch."""
    spark = data.ratings.sparkSession
    complete = {t for t, n in _count(rows).items() if n == n_folds}
    finished = [(r[0], r[1], r[2]) for r in rows if r[0] in complete]
    prunes = len(complete) >= n_startup
    waves = [[fold] for fold in range(n_folds)] if prunes else [list(range(n_folds))]
    active, found = list(group), []
    for wave in waves:
        plan = [(trial, fold) for trial in active for fold in wave]
        runs = [Run(i, settings[trial], fold, tol, min_iters) for i, (trial, fold) in enumerate(plan)]
        fit = fit_runs(data, runs, score=True)
        done = fit.iterations()
        for row in fold_rmse(fit).collect():  # one row per run
            r = row.run_id
            found.append((*plan[r], row.rmse, done[r], runs[r].config.n_iters, n_folds, fit.seconds[r]))
        fit.discard()
        if prunes and wave[-1] < n_folds - 1:
            schema = "trial long, fold int, rmse double"
            now = spark.createDataFrame([f[:3] for f in found], schema)
            gone = {r.trial for r in median_rule(now, spark.createDataFrame(finished, schema), n_startup).collect()}
            active = [t for t in active if t not in gone]
        if not active:
            break
    return found


def _count(rows: list[tuple]) -> dict[int, int]:
    counts: dict[int, int] = {}
    for row in rows:
        counts[row[0]] = counts.get(row[0], 0) + 1
    return counts


def save_study(result: StudyResult, path: str, study: str, context: dict[str, Column]) -> None:
    """Trials as CSV; summary and best parameters as JSON, each with the settings of the study."""
    def one(df: DataFrame):
        return df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False)

    one(trials_for_csv(result.trials).orderBy("trial")).option("header", True).csv(f"{path}/{study}_trials")
    attributes = ["mean_iters", "early_stopped_folds", "target_n_iters", "iters_per_fold", "fold_rmse"]
    best = result.best.select(
        F.col("value").alias("best_value"),
        F.col("trial").alias("best_trial"),
        F.struct(*PARAMETERS).alias("params"),
        F.struct(*attributes).alias("user_attrs"),
    )
    one(best.withColumns(context)).json(f"{path}/{study}_best_params")
    summary = result.summary.join(best.select("best_trial", "user_attrs"), "best_trial", "left")  # one row
    one(summary.withColumns(context)).json(f"{path}/{study}_summary")
