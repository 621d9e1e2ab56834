"""Model-based search and the log of a study."""

import math

import pytest
from pyspark.sql import functions as F

from ratingspark.operators import baselines
from ratingspark.operators.folds import assign_folds
from ratingspark.plans import parzen, study
from ratingspark.plans.config import PARAMETERS
from ratingspark.workload import studies

SPACE = study.SearchSpace(n_factors=(1, 2), n_iters=1, topk=(3, 3))


@pytest.fixture(scope="module")
def folded(spark):
    rows = [(u, i, 1.0 + (u * 7 + i * 3) % 5) for u in range(12) for i in range(9) if (u + i) % 3]
    return assign_folds(spark.createDataFrame(rows, "user_id long, item_id long, rating double"), 2).persist()


def finished(spark, n=60):
    """Trials whose value is least at a fifth of the penalty's range and with popularity-scaled penalties."""
    grid = study.param_grid(spark.range(n).withColumnRenamed("id", "trial"), ["a"])
    unit = F.log(F.col("lambda_u") / 1e-4) / math.log(1e8)
    value = F.abs(unit - 0.2) + F.when(F.col("pop_reg_mode").isNull(), 0.5).otherwise(0.0)
    return grid.withColumn("value", value).withColumn("state", F.when(F.col("trial") % 10 == 9, "PRUNED").otherwise("COMPLETE"))


def test_densities_have_mass_one_and_split_counts(spark):
    split = parzen.split_trials(finished(spark))
    assert split.where("good").count() == 6 and split.where("good and state = 'PRUNED'").count() == 0
    worst = split.where("good").agg(F.max("value")).first()[0]
    assert split.where("not good and state = 'COMPLETE'").agg(F.min("value")).first()[0] >= worst
    axes = [a for a in parzen.axes(study.SearchSpace(), ["a"]) if a.name in ("lambda_u", "alpha")]
    row = parzen.densities(split, axes)
    steps = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(3999))).alias("i")).withColumn("x", (F.col("i") + 0.5) / 4000)
    for name in ("of_lambda_u", "of_alpha"):
        for side in ("good", "bad"):
            mass = steps.agg(F.avg(parzen.density(F.col("x"), F.col(name)[side], F.col(name)[side + "_width"]))).first()[0]
            assert abs(mass - 1) < 1e-4


def test_proposals_go_where_trials_were_good(spark):
    new = spark.range(1000, 1080).withColumnRenamed("id", "trial")
    rows = parzen.propose(new, finished(spark), ["a"], study.SearchSpace()).collect()
    again = parzen.propose(new, finished(spark).repartition(5), ["a"], study.SearchSpace()).collect()
    assert sorted(rows) == sorted(again) and rows[0].asDict().keys() == study.param_grid(new, ["a"]).first().asDict().keys()
    units = [math.log(r.lambda_u / 1e-4) / math.log(1e8) for r in rows]
    assert sum(abs(u - 0.2) < 0.15 for u in units) > 60  # at random: 24
    assert sum(r.pop_reg_mode == "inverse_sqrt" for r in rows) > 60
    assert all(1 <= r.n_factors <= 150 and 1 <= r.update_w_every <= 60 and 0 <= r.alpha <= 100 and 1 <= r.S_topk <= 610 for r in rows)
    assert all(1e-4 <= x <= 1e4 * (1 + 1e-9) for r in rows for x in (r.lambda_u, r.lambda_v, r.lambda_bu, r.lambda_bi, r.lambda_w["a"]))
    assert all(r.graph_feature == "a" and r.n_iters == 100 for r in rows)
    first = parzen.propose(new, finished(spark).where("trial < 0"), [], study.SearchSpace()).first()
    assert first.graph_feature == "__none__" and first.lambda_w == {}


def test_search_goes_on_where_it_stopped(spark, folded, tmp_path):
    search = study.ModelBased(6, SPACE)
    whole = study.run_study(folded, None, search, 2, save_every=2, tol=None)
    key = lambda result: sorted((r.trial, r.state, round(r.value, 9), round(r.lambda_u, 9)) for r in result.trials.collect())
    path = str(tmp_path / "s")
    part = study.run_study(folded, None, search, 2, save_every=2, tol=None, path=path, timeout_sec=0.0)
    assert part.trials.count() == 2
    assert key(study.run_study(folded, None, search, 2, save_every=2, tol=None, path=path)) == key(whole)
    first = whole.trials.where("trial < 2").select("trial", *PARAMETERS)
    random = study.param_grid(spark.range(2).withColumnRenamed("id", "trial"), [], space=SPACE)
    assert sorted(map(str, first.collect())) == sorted(map(str, random.select("trial", *PARAMETERS).collect()))

    # A group without its marker does not count, and written again it stands once.
    import pathlib
    folder = max(pathlib.Path(path, "scores").glob("group=*"))
    (folder / "_SUCCESS").unlink()
    assert len(study._saved(spark, path, "scores", study.SCORES_SCHEMA)) < 12
    assert key(study.run_study(folded, None, search, 2, save_every=2, tol=None, path=path)) == key(whole)
    saved = study._saved(spark, path, "scores", study.SCORES_SCHEMA)
    assert len(saved) == len({(r.trial, r.fold) for r in saved})
    study._save_group(spark.createDataFrame(saved[:2], study.SCORES_SCHEMA), path, "scores", 999)
    study._save_group(spark.createDataFrame(saved[:2], study.SCORES_SCHEMA), path, "scores", 999)
    assert len(study._saved(spark, path, "scores", study.SCORES_SCHEMA)) == len(saved) + 2


def test_written_files_hold_the_study(spark, folded, tmp_path):
    path = str(tmp_path / "s")
    grid = study.param_grid(spark.range(3).withColumnRenamed("id", "trial"), [], space=SPACE)
    result = study.run_study(folded, None, grid, 2, path=path, study="x", tol=None)
    best = spark.read.json(f"{path}/x_best_params").first()
    want = result.best.first()
    assert (best.best_trial, round(best.best_value, 12)) == (want.trial, round(want.value, 12))
    assert best.params.n_factors == want.n_factors and best.matrix_shape == [12, 9]
    summary = spark.read.json(f"{path}/x_summary").first()
    assert (summary.n_trials, summary.n_complete, summary.best_trial) == (3, 3, want.trial)
    assert spark.read.option("header", True).csv(f"{path}/x_trials").count() == 3
    assert study.load_params(spark, f"{path}/x_best_params").first().n_factors == want.n_factors


def test_folds_and_scores_are_worked_out_once(spark, sf):
    """A guess reads the folded ratings four times, a study its scores; neither goes back to the tables each time."""
    rows = [(u, i, 1.0 + (u * i) % 5) for u in range(12) for i in range(9)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    guesses = baselines.held_out_guesses(assign_folds(ratings, 3), [("full", 5.0, 5.0), ("means", None, None)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" not in plan(guesses) and guesses.count() == 2 * len(rows)
    assert guesses.where("prediction IS NULL").count() == 0
    assert "l_quantity" not in plan(studies._trials(spark, sf)) and "prediction" not in plan(studies._scores(spark, sf))


def test_tune_study_searches_the_whole_space(spark, monkeypatch, tmp_path):
    """A space of ranks up to 3 and two iterations left little of the study."""
    given = {}

    def run_study(folded, features, search, n_folds, **rest):
        given.update(search=search)
        return study.StudyResult(spark.createDataFrame(
            [(0, "COMPLETE", 1.0, 2.0, 1)], "trial long, state string, value double, mean_iters double, n_factors int"), None, None, None)

    monkeypatch.setattr(study, "run_study", run_study)
    spark.range(7).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 3, 5.0), (2, 4, 6.0)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 10.0), (2, 2, 20.0), (2, 1, 30.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    assert studies.tune_study(spark, str(tmp_path)).count() == 1
    assert given["search"] == study.ModelBased(7, study.SearchSpace())
    assert given["search"].space.n_factors == (1, 150) and given["search"].space.n_iters == 100
