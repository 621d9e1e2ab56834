"""A fit that is broken off and started again, and predictions with other features."""

import math

import pytest
from pyspark.sql import functions as F

from ratingspark.plans import fit as fitting
from ratingspark.plans.config import ModelConfig, Run
from ratingspark.plans.fit import fit_runs, prepare
from ratingspark.plans.model import RatingModel


@pytest.fixture(scope="module")
def data(spark):
    rows = [(u, i, 1.0 + (u * 7 + i * 3) % 5, (u + i) % 2) for u in range(14) for i in range(10) if (u + i) % 3]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double, fold int")
    features = spark.createDataFrame([("a", i, [float(i % 3), float(i)]) for i in range(10)], "feature string, item_id long, x array<double>")
    return prepare(ratings, features=features)


RUNS = [Run(0, ModelConfig(2, 4, 5.0, 6.0, lambda_w={"a": 2.0}, update_w_every=2), 0, None), Run(1, ModelConfig(2, 2, 3.0, 4.0), 1, None)]


def state(fit):
    users = {(r.run_id, r.user_id): (*r.u, r.b_u) for r in fit.users.collect()}
    items = {(r.run_id, r.item_id): (*r.v, *r.z, r.b_i) for r in fit.items.collect()}
    return {("u", *k): v for k, v in users.items()} | {("i", *k): v for k, v in items.items()} | {("mu", k): (v,) for k, v in fit.mu.items()}


def test_a_broken_off_fit_goes_on(spark, data, tmp_path, monkeypatch):
    path = str(tmp_path / "fit")
    whole = fit_runs(data, RUNS)
    real, calls = fitting._measures, []

    def breaks(users, items):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("driver lost")
        return real(users, items)

    monkeypatch.setattr(fitting, "_measures", breaks)
    with pytest.raises(RuntimeError, match="driver lost"):
        fit_runs(data, RUNS, resume=path)
    again = fit_runs(data, RUNS, resume=path)
    assert len(calls) == 5  # three iterations, the broken one, and that one once more
    want, got = state(whole), state(again)
    assert set(want) == set(got)
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for k in want for a, b in zip(want[k], got[k]))
    assert again.iterations() == whole.iterations() == {0: 4, 1: 2}
    assert len(list((tmp_path / "fit" / "batch=00000").glob("iter=*"))) == 1
    third = fit_runs(data, RUNS, resume=path)  # all is done: nothing is computed anew
    assert len(calls) == 5 and state(third).keys() == want.keys()
    with pytest.raises(ValueError, match="another fit"):
        fit_runs(data, RUNS[:1], resume=path)


def test_predictions_with_given_features(spark):
    rows = [(u, i, 1.0 + (u * 7 + i * 3) % 5) for u in range(14) for i in range(10) if (u + i) % 3]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    schema = "feature string, item_id long, x array<double>"
    table = [("a", i, [float(i % 3), float(i)]) for i in range(10)] + [("b", i, [float(i % 2)]) for i in range(10)]
    features = spark.createDataFrame(table, schema)
    model = RatingModel(ModelConfig(2, 2, 5.0, 6.0, lambda_w={"a": 2.0, "b": 2.0})).fit(ratings, features, tol=None)
    pairs = spark.createDataFrame([(u, i) for u in range(3) for i in range(10)], "user_id long, item_id long")
    values = lambda df: {(r.user_id, r.item_id): r.prediction for r in df.collect()}
    same = lambda a, b: a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    assert same(values(model.predict(pairs, features=features)), values(model.predict(pairs)))
    assert same(values(model.predict(pairs, features=features.where("false"))), values(model.predict(pairs, use_features=False)))
    moved = spark.createDataFrame([("a", 4, [9.0, -1.0])], schema)
    got, base = values(model.predict(pairs, features=moved)), values(model.predict(pairs, use_features=False))
    users = {r.user_id: r.u for r in model.users.collect()}
    w = model.projections["a"]
    for (u, i), p in got.items():
        extra = sum(users[u][k] * (9.0 * w[0][k] - w[1][k]) for k in range(2)) if i == 4 else 0.0
        assert math.isclose(p, base[u, i] + extra, abs_tol=1e-9)
    with pytest.raises(ValueError, match="knows no feature"):
        model.predict(pairs, features=moved.withColumn("feature", F.lit("c")))
    with pytest.raises(ValueError, match="the model 2"):
        model.predict(pairs, features=spark.createDataFrame([("a", 4, [9.0])], schema))
