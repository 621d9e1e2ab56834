from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationary import gradients
from ratingspark.functions.portable import initial_projection
from ratingspark.operators.graph import full_graph_sums, neighbour_sums, unit_vectors
from ratingspark.operators.half_steps import half_step, held_out_errors, run_steps
from ratingspark.plans.config import ModelConfig, Run, with_fold
from ratingspark.plans.fit import _initial_state, fit_runs, prepare
from ratingspark.plans.model import FittedModel, RatingModel
from ratingspark.session import cut_lineage

M, N = 30, 20
BASE = dict(lambda_u=0.7, lambda_v=0.9, lambda_bu=0.5, lambda_bi=0.4)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(7)
    mask = rng.random((M, N)) < 0.4
    mask[3], mask[:, 5] = False, False  # an unrated user and an unrated item
    mask[:, 2] = True  # an item that everyone but user 3 rated
    mask[3, 2] = False
    values = rng.normal(3, 1, (M, N))
    fold = rng.integers(0, 3, (M, N))
    X = {"a": rng.random((N, 3)), "b": rng.normal(size=(N, 1))}
    rows = [(int(u), int(i), float(values[u, i]), int(fold[u, i])) for u, i in zip(*np.nonzero(mask))]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double, fold int")
    features = spark.createDataFrame(
        [(f, i, x[i].tolist()) for f, x in X.items() for i in range(N)],
        "feature string, item_id long, x array<double>",
    )
    users = spark.range(M).withColumnRenamed("id", "user_id")
    items = spark.range(N).withColumnRenamed("id", "item_id")
    return dict(values=values, mask=mask, fold=fold, X=X, ratings=ratings, features=features, users=users, items=items)


def start(spark, world, cfg):
    def table(frame, key, tag, size):
        rows = _initial_state(frame, key, tag, [Run(0, cfg)]).collect()
        out = np.zeros((size, cfg.n_factors))
        for r in rows:
            out[r.id] = r.vec
        return out

    U = table(world["users"], "user_id", "U", M)
    V = table(world["items"], "item_id", "V", N)
    return U, V


def arrays(fit, run_id=0):
    U, V, Z = (np.zeros((s, 0)) for s in (M, N, N))
    users = {r.user_id: r for r in fit.users.where(F.col("run_id") == run_id).collect()}
    items = {r.item_id: r for r in fit.items.where(F.col("run_id") == run_id).collect()}
    U = np.array([users[u].u for u in range(M)])
    V = np.array([items[i].v for i in range(N)])
    Z = np.array([items[i].z for i in range(N)])
    return U, V, Z, np.array([users[u].b_u for u in range(M)]), np.array([items[i].b_i for i in range(N)])


def close(got, want):
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-8)


def states(spark, world, data, cfg, mask_fold, n, features):
    """State before the first and after each of the first ``n`` iterations, and the fits."""
    u, v = start(spark, world, cfg)
    values = world["values"][world["mask"] & ((world["fold"] != mask_fold) if mask_fold is not None else True)]
    w = {f: initial_projection(42, f, x.shape[1], cfg.n_factors) for f, x in features.items()}
    out, fits = [dict(u=u, v=v, bu=np.zeros(M), bi=np.zeros(N), mu=values.mean(), w=w)], []
    for iterations in range(1, n + 1):
        fit = fit_runs(data, [Run(0, replace(cfg, n_iters=iterations), mask_fold, None)], score=False)
        assert fit.users.count() == M and fit.items.count() == N
        u, v, _, bu, bi = arrays(fit)
        cuts = np.cumsum([x.shape[1] for x in features.values()])[:-1]
        w = dict(zip(features, np.split(np.asarray(fit.weights[0]), cuts))) if features else {}
        out.append(dict(u=u, v=v, bu=bu, bi=bi, mu=fit.mu[0], w=w))
        fits.append(fit)
    return out, fits


def rating_rows(world, mask_fold=None):
    mask = world["mask"] & ((world["fold"] != mask_fold) if mask_fold is not None else True)
    user, item = np.nonzero(mask)
    return user, item, world["values"][user, item]


@pytest.mark.parametrize("max_rows", [40, 6])
@pytest.mark.parametrize("pop,fold", [(None, None), ("inverse_sqrt", 1)])
def test_each_update_zeroes_its_gradient(spark, world, max_rows, pop, fold, monkeypatch):
    """Small limits cut most users and items into parts; conditions and row counts must hold all the same."""
    if pop is None:
        monkeypatch.setattr("ratingspark.operators.half_steps.GRAM_CELLS", 30)  # three owners at a time
    cfg = ModelConfig(3, 4, **BASE, pop_reg_mode=pop, update_w_every=1, lambda_w={"a": 0.3})
    data = prepare(world["ratings"], world["users"], world["items"], world["features"], max_rows=max_rows)
    chain, _ = states(spark, world, data, cfg, fold, 3, world["X"])
    for before, after in zip(chain, chain[1:]):
        assert max(gradients(before, after, rating_rows(world, fold), cfg, world["X"]).values()) < 1e-6
    data.release()


@pytest.mark.parametrize("topk,max_rows", [(4, 250_000), (None, 5)])
def test_graph_updates_zero_their_gradients(spark, world, topk, max_rows, monkeypatch):
    import ratingspark.operators.graph as graph_module

    build = graph_module.build_layout
    monkeypatch.setattr(graph_module, "build_layout", lambda *a: build(*a, max_rows=max_rows))
    cfg = ModelConfig(2, 3, **BASE, alpha=0.6, graph_feature="a", S_topk=topk, update_w_every=1)
    graph = dense_graph(world["X"]["a"], topk, cfg.S_eps)
    data = prepare(world["ratings"], world["users"], world["items"], world["features"])
    chain, _ = states(spark, world, data, cfg, None, 2, world["X"])
    for before, after in zip(chain, chain[1:]):
        assert max(gradients(before, after, rating_rows(world), cfg, world["X"], graph).values()) < 1e-6
    data.release()


def test_wide_features_are_solved_iteratively(spark, world, monkeypatch):
    from ratingspark.operators import projections

    cfg = ModelConfig(3, 2, **BASE, update_w_every=1, lambda_w={"a": 0.3, "b": 0.1})
    data = prepare(world["ratings"], world["users"], world["items"], world["features"])
    runs = with_fold([Run(0, cfg, None, None)], 2)
    direct = fit_runs(data, runs)
    monkeypatch.setattr(projections, "MAX_EQUATIONS", 1)
    wide = fit_runs(data, runs)
    for r in runs:
        np.testing.assert_allclose(wide.weights[r.run_id], direct.weights[r.run_id], rtol=1e-6, atol=1e-8)
        for got, want in zip(arrays(wide, r.run_id), arrays(direct, r.run_id)):
            np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose([h[2:4] for h in wide.history], [h[2:4] for h in direct.history], rtol=1e-7)
    data.release()


def dense_graph(x, topk, eps):
    unit = x / (np.sqrt((x * x).sum(1, keepdims=True)) + eps)
    S = unit @ unit.T
    np.fill_diagonal(S, 0.0)
    if topk and topk < len(S):
        for i, row in enumerate(S.copy()):
            order = sorted(range(len(row)), key=lambda j: (-round(row[j], 9), j))
            S[i, order[topk:]] = 0.0
    return np.maximum(S, S.T)


def test_batched_runs_equal_single_runs_and_stop_alone(spark, world):
    data = prepare(world["ratings"], world["users"], world["items"])
    slow = ModelConfig(2, 8, **BASE)
    fast = ModelConfig(3, 8, **{**BASE, "lambda_u": 1e4, "lambda_v": 1e4})
    runs = with_fold([Run(0, slow, None, 1e-3, 3), Run(0, fast, None, 1e-1, 3)], 3)
    batch = fit_runs(data, runs, score=True)
    done = batch.iterations()
    assert done[3] < 8 and max(done.values()) > min(done.values())
    for run in (runs[0], runs[4]):
        single = fit_runs(data, [run], score=True)
        assert single.iterations()[run.run_id] == done[run.run_id]
        for got, want in zip(arrays(single, run.run_id), arrays(batch, run.run_id)):
            close(got, want)
        pick = F.col("run_id") == run.run_id
        errors = lambda fit: sorted(tuple(r) for r in fit.held_out.where(pick).collect())
        assert [r[:3] for r in errors(single)] == [r[:3] for r in errors(batch)]
        U, V, Z, b_u, b_i = arrays(batch, run.run_id)
        held = world["mask"] & (world["fold"] == run.fold)
        us, its = np.nonzero(held)
        guess = (U[us] * Z[its]).sum(1) + batch.mu[run.run_id] + b_u[us] + b_i[its]
        close(sum(r[3] for r in errors(batch)), ((world["values"][us, its] - guess) ** 2).sum())
        assert sum(r[2] for r in errors(batch)) == held.sum()
    data.release()


def test_small_batches_give_the_same_result(spark, world, monkeypatch):
    import ratingspark.plans.fit as fit_module

    data = prepare(world["ratings"], world["users"], world["items"])
    runs = with_fold([Run(0, ModelConfig(2, 2, **BASE), None, None)], 3)
    whole = fit_runs(data, runs, score=True)
    monkeypatch.setattr(fit_module, "STATE_CELLS", 1)
    pieces = fit_runs(data, runs, score=True)
    for r in runs:
        for got, want in zip(arrays(pieces, r.run_id), arrays(whole, r.run_id)):
            close(got, want)
    assert pieces.held_out.count() == whole.held_out.count()
    data.release()


def test_unrated_rows_keep_their_start(spark, world):
    cfg = ModelConfig(2, 2, **BASE)
    model = RatingModel(cfg).fit(world["ratings"], users=world["users"], items=world["items"], tol=None)
    U0, V0 = start(spark, world, cfg)
    u3 = model.users.where("user_id = 3").first()
    i5 = model.items.where("item_id = 5").first()
    close(u3.u, U0[3]), close(i5.v, V0[5])
    assert u3.b_u == 0 and i5.b_i == 0


def test_model_predicts_saves_and_loads(spark, world, tmp_path):
    cfg = ModelConfig(2, 3, **BASE, lambda_w={"a": 1.0, "b": 1.0})
    model = RatingModel(cfg)
    with pytest.raises(RuntimeError):
        model.predict(world["ratings"])
    fitted = model.fit(world["ratings"], world["features"], users=world["users"], items=world["items"])
    pairs = world["ratings"].select("user_id", "item_id")
    first = {(r.user_id, r.item_id): r.prediction for r in model.predict(pairs).collect()}
    fitted.save(str(tmp_path / "model"))
    again = FittedModel.load(spark, str(tmp_path / "model"))
    assert again.config == cfg and set(again.projections) == {"a", "b"}
    assert {(r.user_id, r.item_id): r.prediction for r in again.predict(pairs).collect()} == first
    plain = {(r.user_id, r.item_id): r.prediction for r in again.predict(pairs, use_features=False).collect()}
    assert any(abs(plain[k] - first[k]) > 1e-6 for k in first)

    cells = {(r.user_id, i): p for r in fitted.predict_all().collect() for i, p in zip(r.item_ids, r.predictions)}
    assert len(cells) == M * N
    for key, value in first.items():
        assert cells[key] == pytest.approx(value, abs=1e-9)
    best = fitted.recommend(4, world["ratings"]).collect()
    rated = set(first)
    for user in range(M):
        order = sorted((-round(cells[user, i], 9), i) for i in range(N) if (user, i) not in rated)[:4]
        assert [r.item_id for r in sorted(best, key=lambda r: r["rank"]) if r.user_id == user] == [i for _, i in order]


def test_errors(spark, world):
    with pytest.raises(ValueError):
        RatingModel(None)
    with pytest.raises(ValueError):
        ModelConfig(2, 2, 1.0, 1.0, pop_reg_mode="linear")
    with pytest.raises(ValueError, match="expected one for each"):
        prepare(world["ratings"], world["users"], world["items"], world["features"].where("item_id > 0 OR feature = 'b'"))
    broken = world["features"].withColumn("x", F.transform("x", lambda x: F.when(x < 0.1, float("nan")).otherwise(x)))
    with pytest.raises(ValueError, match="not finite"):
        prepare(world["ratings"], world["users"], world["items"], broken)
    with pytest.raises(ValueError, match="no observed"):
        prepare(world["ratings"].withColumn("rating", F.lit(float("nan"))))


def test_missing_graph_feature_is_a_warning(spark, world):
    cfg = ModelConfig(2, 2, **BASE, alpha=1.0, graph_feature="nowhere")
    plain = ModelConfig(2, 2, **BASE)
    data = prepare(world["ratings"], world["users"], world["items"])
    with pytest.warns(UserWarning, match="not found"):
        got = fit_runs(data, [Run(0, cfg, None, None)])
    close(arrays(got)[1], arrays(fit_runs(data, [Run(0, plain, None, None)]))[1])
    data.release()


def test_planted_structure_is_recovered(spark, sf):
    from ratingspark.workload import views

    rows = views.ratings(spark, sf)
    planted = rows.withColumn(
        "rating",
        3 + F.cos(F.col("user_id") % 11) * F.cos(F.col("item_id") % 13) + 0.2 * ((F.col("item_id") % 6) - 2.5),
    )
    model = RatingModel(ModelConfig(2, 12, 0.1, 0.1, 0.1, 0.1)).fit(planted, tol=None)
    curve = [r.train_rmse for r in model.history.orderBy("iter").collect()]
    assert curve[-1] < 0.1 < curve[0]


def test_state_of_many_runs_is_not_broadcast(spark):
    """Size estimates see the universe, not the runs, so a large state would go whole through the driver."""
    ratings = spark.createDataFrame([(u, i, float(u + i)) for u in range(6) for i in range(5)], "user_id long, item_id long, rating double")
    data = prepare(ratings)
    runs = [Run(r, ModelConfig(2, 1, 1.0, 1.0, 1.0, 1.0, None), None, None) for r in range(20)]
    users = cut_lineage(_initial_state(data.users, "user_id", "U", runs))
    items = cut_lineage(_initial_state(data.items, "item_id", "V", runs))
    steps = run_steps(runs, {r.run_id: 0.0 for r in runs}, "user")
    for result in (half_step(data.by_user, users, items, steps), held_out_errors(data.by_user, users, items, steps)):
        assert "BroadcastExchange" not in result._jdf.queryExecution().executedPlan().toString()
    data.release()


def test_prepare_fills_both_universes(spark):
    """Items were read from the ratings again after these had left the cache."""
    ratings = spark.createDataFrame([(1, 1, 2.0), (2, 3, 4.0)], "user_id long, item_id long, rating double")
    data = prepare(ratings)
    for table in (data.users, data.items):
        relation = table._jdf.queryExecution().withCachedData()
        assert relation.cacheBuilder().isCachedColumnBuffersLoaded()
    data.release()


def test_ratings_are_clustered_by_item_when_first_asked_for(spark, world):
    """From those clustered by user, with the counts of the route; users and items without ratings stay known."""
    data = prepare(world["ratings"], world["users"], world["items"], max_rows=6)
    assert data._by_item is None
    keys = lambda df, own, other: sorted(tuple(r) for r in df.select(own, other, "rating", "fold").collect())
    assert keys(data.by_item.ratings, "other", "own") == keys(data.by_user.ratings, "own", "other")
    assert {r.other: r["count"] for r in data.by_user.others().collect()} == {
        r.item_id: r["count"] for r in world["ratings"].groupBy("item_id").count().collect()}
    assert data.by_item.hot is not None
    assert data.users.count() == data.users.distinct().count() and data.items.count() == data.items.distinct().count()
    data.release()


def test_state_moves_side_by_side_and_leaves_the_disk(spark, world, monkeypatch):
    """One row per id goes to a block for all runs; the state of an iteration goes when the next one stands."""
    import os

    from ratingspark.plans import fit as fit_module
    from ratingspark.session import checkpoint_dir

    cfg = ModelConfig(2, 3, **BASE)
    runs = [Run(0, cfg, 0, None), Run(1, replace(cfg, n_factors=3), 1, None)]
    data = prepare(world["ratings"], world["users"], world["items"])
    state = _initial_state(data.items, "item_id", "V", runs).withColumn("packed", F.concat(F.array("bias"), "vec"))
    wide = data.by_user.side_by_side(state)
    assert wide.count() == N and {r.n for r in wide.select(F.size("packed").alias("n")).collect()} == {3 + 4}
    first = {r.id: r.packed for r in wide.collect()}
    for row in state.where("run_id = 1").collect():
        assert first[row.id][3:] == row.packed

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    whole = fit_runs(data, runs, score=True)
    assert len(set(os.listdir(folder)) - before) == len(whole.stored) == 3  # users, items, held-out errors; none of earlier iterations
    monkeypatch.setattr(fit_module, "MOVED_CELLS", 1)
    monkeypatch.setattr(fit_module, "FREED_CELLS", 1)
    single = fit_runs(data, runs, score=True)
    assert len(single.stored) == 3 * len(runs)
    assert np.allclose([h[2:] for h in sorted(whole.history)], [h[2:] for h in sorted(single.history)], rtol=1e-12)
    errors = lambda fit: sorted((r.run_id, r.item_id, r.n, round(r.sq_err, 9)) for r in fit.held_out.collect())
    assert errors(whole) == errors(single)
    single.discard()
    whole.discard()
    assert set(os.listdir(folder)) <= before
    data.release()
