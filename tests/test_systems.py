"""Solved systems with their statuses, and the time of runs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingspark.operators import graph, systems
from ratingspark.plans.config import ModelConfig, Run
from ratingspark.plans.fit import fit_runs, prepare


def batch():
    rng = np.random.default_rng(0)
    half = rng.normal(size=(6, 4, 4))
    lhs = half @ half.transpose(0, 2, 1) + 0.1 * np.eye(4)
    lhs[1] = np.diag([1.0, 2.0, 0.0, 3.0])
    lhs[2] = np.diag([1.0, -2.0, 1.0, 1.0])
    lhs[3, 0, 0] = np.nan
    lhs[4] = np.outer([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0])
    return lhs, rng.normal(size=(6, 4))


def test_one_bad_system_does_not_stop_the_others():
    lhs, rhs = batch()
    x, status = systems.solve_systems(lhs, rhs)
    assert [systems.STATUS[s] for s in status] == ["definite", "singular", "indefinite", "not finite", "singular", "definite"]
    for i in (0, 2, 5):
        assert np.allclose(lhs[i] @ x[i], rhs[i])
    for i in (1, 4):
        assert np.allclose(x[i], np.linalg.lstsq(lhs[i], rhs[i], rcond=None)[0])
    assert np.isnan(x[3]).all()
    assert systems.solve_systems(lhs[:0], rhs[:0])[0].shape == (0, 4)
    tiny = np.array([[[1.0, 1.0], [1.0, 1.0 + 1e-10]]])
    assert systems.solve_systems(tiny, np.ones((1, 2)))[1][0] == systems.DEFINITE


def test_report_as_rows(spark):
    lhs, rhs = batch()
    rows = [(i, a.ravel().tolist(), b.tolist()) for i, (a, b) in enumerate(zip(lhs, rhs))]
    got = systems.solve_report(spark.createDataFrame(rows, "id long, lhs array<double>, rhs array<double>").repartition(3), 4, "id")
    assert {r.id: r.status for r in got.collect()} == dict(enumerate(["definite", "singular", "indefinite", "not finite", "singular", "definite"]))


@pytest.fixture(scope="module")
def data(spark):
    rows = [(u, i, 1.0 + (u * 7 + i * 3) % 5, (u + i) % 2) for u in range(60) for i in range(50) if (u + i) % 3]
    return prepare(spark.createDataFrame(rows, "user_id long, item_id long, rating double, fold int"))


def test_wide_runs_take_longer_and_clean_runs_have_no_issues(data):
    runs = [Run(0, ModelConfig(2, 2, 5.0, 6.0), 0, None), Run(1, ModelConfig(50, 2, 5.0, 6.0), 0, None)]
    fit = fit_runs(data, runs)
    scored = fit_runs(data, runs[:1], score=True)
    assert 0 < fit.seconds[0] < fit.seconds[1] and scored.seconds[0] > 0
    assert scored.held_out.agg(F.sum("seconds")).first()[0] > 0
    assert fit.solve_issues().count() == 0


def test_indefinite_items_are_reported_and_others_go_on(spark):
    """Negative edges make some item systems indefinite; the fit goes on and says which."""
    rows = [(u, i, 1.0 + (u * 7 + i * 3) % 5) for u in range(12) for i in range(8)]
    table = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    edges = spark.createDataFrame([(0, 1, -1e6), (1, 0, -1e6)], "src long, dst long, sim double")
    data = prepare(table, edges={"g": edges})
    config = ModelConfig(2, 1, 5.0, 6.0, alpha=1.0, graph_feature="g")
    fit = fit_runs(data, [Run(0, config, None, None)])
    found = {(r.iter, r.side, r.id, r.status) for r in fit.solve_issues().collect()}
    assert found == {(1, "item", 0, "indefinite"), (1, "item", 1, "indefinite")}
    assert fit.items.where("isnan(b_i) or b_i is null").count() == 0


# ------------------------------------------------------------- checked input


def test_edges_are_checked(spark):
    rows = [(u, i, 1.0 + (u + i) % 5) for u in range(6) for i in range(5)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    items = spark.range(5).withColumnRenamed("id", "item_id")
    nan = float("nan")
    schema = "src long, dst long, sim double"
    cases = {
        "one way": [(0, 1, 0.5)], "repeated": [(0, 1, 0.5), (0, 1, 0.5), (1, 0, 0.5)], "unknown end": [(0, 888, 0.5), (888, 0, 0.5)],
        "self": [(2, 2, 1.0)], "not finite": [(0, 1, nan), (1, 0, nan)],
    }
    for rule, extra in cases.items():
        edges = spark.createDataFrame([(3, 4, 0.1), (4, 3, 0.1), *extra], schema)
        found = {(r.rule, r.src, r.dst) for r in graph.edge_violations(edges, items).collect()}
        assert {r for r, *_ in found} >= {rule} and {(s, d) for _, s, d in found} <= {(s, d) for s, d, _ in extra}
        if rule in ("unknown end", "one way"):
            with pytest.raises(ValueError, match=rule):
                prepare(ratings, edges={"g": edges})
    uneven = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.4)], schema)
    assert {(r.rule, r.src, r.dst) for r in graph.edge_violations(uneven, items).collect()} == {("one way", 0, 1), ("one way", 1, 0)}
    good = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], schema)
    assert graph.edge_violations(good, items).count() == 0 and graph.edge_violations(good.where("false"), items).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0.5), (0, 1, None)], schema)
    assert {r.rule for r in graph.edge_violations(nulls, items).collect()} >= {"unknown end", "not finite"}


def test_repeated_ratings_are_refused(spark):
    rows = [(u, i, 1.0 + (u + i) % 5) for u in range(6) for i in range(5)]
    ratings = spark.createDataFrame([*rows, (2, 3, 4.0)], "user_id long, item_id long, rating double")
    with pytest.raises(ValueError, match=r"\(2, 3\) 2 times"):
        prepare(ratings)
    with pytest.raises(ValueError, match="more than once"):
        prepare(ratings, max_rows=2)


def test_edges_are_dealt_by_pair_into_a_set_number_of_tasks(spark):
    """Merged by packed size, a task would hold wide grouped rows of many partitions at once."""
    edges = spark.range(1_000).selectExpr("id AS src", "id + 1 AS dst", "0.5D AS sim")
    found = graph.edge_violations(edges, spark.range(1_001).withColumnRenamed("id", "item_id"))
    assert f"hashpartitioning(a, b, {spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in re.sub(
        r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
    assert found.groupBy("rule").count().collect() == [("one way", 1_000)]
