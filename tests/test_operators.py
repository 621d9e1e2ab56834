import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingspark.functions import portable
from ratingspark.functions.keyed_sums import sum_vectors
from ratingspark.operators import folds, graph, metrics, neighbours, normalize, stats
from ratingspark.plans import ablation, study
from ratingspark.plans.config import RUNS_SCHEMA, ModelConfig, Run, runs_from_table, runs_table
from ratingspark.plans.fit import batches
from ratingspark.sources import ratings as source

NAN, INF = float("nan"), float("inf")


def feature(spark, rows, name="f"):
    return spark.createDataFrame([(name, i, list(map(float, x))) for i, x in enumerate(rows)], "feature string, item_id long, x array<double>")


def values(df):
    return [list(r.x) for r in df.orderBy("item_id").collect()]


def approx(rows, tol=1e-6):
    return [pytest.approx(r, abs=tol) for r in rows]


# ------------------------------------------------------------- normalization


def test_rows_of_the_docstring_example(spark):
    genres = feature(spark, [(1, 0, 0), (0, 1, 0), (1, 0, 1)])
    assert values(normalize.normalize_feature(genres, "row_l2"))[2] == pytest.approx([0.70710678, 0, 0.70710678])
    assert values(normalize.normalize_feature(genres, "row_l1"))[2] == pytest.approx([0.5, 0, 0.5])


def test_columns_of_the_docstring_example(spark):
    years = feature(spark, [(1995,), (2002,), (2010,)])
    z = values(normalize.normalize_feature(years, "col_zscore", dtype="float64"))
    assert z == approx([[-1.19664225], [-0.05439283], [1.25103507]], 1e-8)
    assert values(normalize.normalize_feature(years, "col_minmax")) == approx([[0], [0.46666667], [1]])


@pytest.mark.parametrize(
    "rows, method, want",
    [
        ([(4,), (4,), (4,)], "col_zscore", [[0], [0], [0]]),
        ([(4,), (4,), (4,)], "col_minmax", [[0], [0], [0]]),
        ([(0, 0, 0)], "row_l1", [[0, 0, 0]]),
        ([(0, 0, 0)], "row_l2", [[0, 0, 0]]),
    ],
)
def test_degenerate_features(spark, rows, method, want):
    assert values(normalize.normalize_feature(feature(spark, rows), method)) == want


def test_median_imputation(spark):
    gaps = feature(spark, [(1, NAN), (NAN, NAN), (3, -INF), (INF, NAN)])
    assert values(normalize.impute_medians(gaps)) == [[1, 0], [2, 0], [3, 0], [2, 0]]
    with pytest.raises(ValueError, match="NaN"):
        normalize.normalize_feature(gaps)


def test_median_is_exact_on_many_values(spark):
    rng = random.Random(3)
    for size in (1, 2, 30_001, 40_000):
        numbers = [rng.gauss(0, 1) if i % 3 else 0.25 for i in range(size)]
        got = normalize.column_medians(feature(spark, [(x,) for x in numbers])).first().median
        ordered = sorted(numbers)
        assert got == (ordered[(size - 1) // 2] + ordered[size // 2]) / 2


def test_settings_are_checked(spark):
    f = feature(spark, [(1,)])
    for bad in (dict(method="x"), dict(impute="x")):
        with pytest.raises(ValueError):
            normalize.normalize_feature(f, **bad)
    with pytest.raises(TypeError):
        normalize.normalize_features(f, overrides={"f": {"scale": 2}})
    assert normalize.normalize_features(f, overrides={"other": {"scale": 2}}).count() == 1
    assert normalize.normalize_feature(f).schema["x"].dataType.simpleString() == "array<float>"


# --------------------------------------------------------------------- folds


def ratings(spark, rows):
    return spark.createDataFrame([(u, i, float(r)) for u, i, r in rows], "user_id long, item_id long, rating double")


@pytest.mark.parametrize("n, k, sizes", [(7, 3, [3, 2, 2]), (11, 4, [3, 3, 3, 2]), (3, 5, [1, 1, 1])])
@pytest.mark.parametrize("shuffle", [True, False])
def test_fold_sizes(spark, n, k, sizes, shuffle):
    rows = ratings(spark, [(j % 3, j, 1) for j in range(n)])
    out = folds.assign_folds(rows, k, 42, shuffle)
    counts = {r.fold: r["count"] for r in out.groupBy("fold").count().collect()}
    assert counts == dict(enumerate(sizes))
    assert folds.fold_check(out).first().is_partition


def test_folds_do_not_depend_on_row_order_or_partitions(spark):
    rows = ratings(spark, [(u, i, u + i) for u in range(20) for i in range(10)])
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "item_id", "fold").collect())
    first = key(folds.assign_folds(rows, 3))
    assert key(folds.assign_folds(rows.orderBy(F.rand(1)).repartition(7), 3)) == first
    assert key(folds.assign_folds(rows, 3, seed=1)) != first
    ordered = folds.assign_folds(rows, 4, shuffle=False)
    assert [r.fold for r in ordered.orderBy("user_id", "item_id").collect()] == [j // 50 for j in range(200)]


@pytest.mark.parametrize("k", [1, 3, 7, 400])
def test_folds_follow_the_digest_order_and_only_cut_ranges_are_numbered(spark, k):
    """A table that has its ranges is taken as it is; the repeated rows lie at an end of a fold or not."""
    import hashlib

    rows = ratings(spark, [(u, i, 1) for u in range(30) for i in range(10)] + [(3, 4, 2)] * 9)
    ranged = folds.with_ranges(rows, 5).persist()
    out = folds.assign_folds(ranged, k, 5)
    assert out.columns == ["user_id", "item_id", "rating", "fold"]
    keys = sorted((hashlib.md5(f"5:{r.user_id}:{r.item_id}".encode()).hexdigest(), r.user_id, r.item_id) for r in rows.collect())
    edges = np.cumsum([0] + [len(keys) // k + (f < len(keys) % k) for f in range(k)])
    want = sorted((u, i, int(np.searchsorted(edges, at, "right")) - 1) for at, (_, u, i) in enumerate(keys))
    assert sorted((r.user_id, r.item_id, r.fold) for r in out.collect()) == want
    assert folds.assign_folds(rows.limit(0), k).count() == 0
    ranged.unpersist()


def test_saved_folds_must_fit_the_data(spark, tmp_path):
    rows = ratings(spark, [(u, i, 1) for u in range(4) for i in range(3)])
    out = folds.assign_folds(rows, 3)
    folds.save_folds(out, str(tmp_path / "a" / "b"), 4, 3, 3, 42)
    saved, meta = folds.load_folds(spark, str(tmp_path / "a" / "b"))
    users, items = rows.select("user_id").distinct(), rows.select("item_id").distinct()
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, out.select("user_id", "item_id", "fold").collect()))
    folds.require_matching_folds(saved, meta, rows, users, items)
    with pytest.raises(ValueError):
        folds.require_matching_folds(saved, meta, rows.where("user_id > 0"), users, items)
    with pytest.raises(ValueError):
        folds.require_matching_folds(saved, meta, rows, users.where("user_id > 0"), items)


def test_train_and_valid_make_up_the_ratings(spark):
    out = folds.assign_folds(ratings(spark, [(u, i, 1) for u in range(5) for i in range(5)]), 3)
    for k in range(3):
        keys = folds.valid_split(out, k)
        both = folds.train_by_keys(out, keys).select("user_id", "item_id").union(keys.select("user_id", "item_id"))
        assert both.count() == both.distinct().count() == 25


def test_merge_prefers_the_second_set(spark):
    merged = source.merge_ratings(ratings(spark, [(1, 1, 3), (1, 2, 4)]), ratings(spark, [(1, 2, 5), (2, 1, 2), (1, 1, NAN)]))
    assert {(r.user_id, r.item_id): r.rating for r in merged.collect()} == {(1, 1): 3, (1, 2): 5, (2, 1): 2}


def test_global_rank_counts_every_row_once(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    ranked = source.global_rank(df, ["k"]).orderBy("k").collect()
    assert [r.rank for r in ranked] == list(range(1000))


# ------------------------------------------------------------------- metrics


def counts(spark, numbers):
    return spark.createDataFrame(list(enumerate(numbers)), "item_id long, n long")


def test_quantile_edges(spark):
    edges = metrics.bin_edges(counts(spark, [1, 1, 2, 5, 9, 9, 14, 20]), 5).first().edges
    assert edges == pytest.approx([1, 1.4, 4.4, 9, 12, 20])


def test_equal_counts_fall_into_the_first_bin(spark):
    same = counts(spark, [3, 3, 3])
    edges = metrics.bin_edges(same, 5).first().edges
    assert edges == pytest.approx([3 + j * 1e-9 for j in range(6)], abs=1e-12)
    assert {r.bin for r in metrics.popularity_bins(same, 5).collect()} == {0}


def test_top_edge_is_inclusive(spark):
    bins = metrics.popularity_bins(counts(spark, [0, 1, 2, 3, 4]), 2, "uniform")
    assert [r.bin for r in bins.orderBy("item_id").collect()] == [0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        metrics.bin_edges(bins, 2, "other")


def test_rmse_of_nothing(spark):
    pairs = spark.createDataFrame([(NAN, 1.0)], "rating double, prediction double")
    with pytest.raises(ValueError):
        metrics.compute_rmse(pairs)
    none = ratings(spark, [(1, 1, 1)])
    guess = none.withColumnRenamed("rating", "prediction")
    assert metrics.rmse_on_keys(none, guess, none.where("user_id = 2")).first().rmse is None
    assert metrics.rmse_on_keys(none, guess, none).first().rmse == 0


def test_early_stop_and_ragged_curves(spark):
    curve = [1, 0.9, 0.85, 0.8495, 0.8492, 0.8491]
    history = spark.createDataFrame([("x", t + 1, v) for t, v in enumerate(map(float, curve))], "variant string, iter int, train_rmse double")
    row = metrics.early_stops(history, ["variant"], 1e-3, 5).first()
    assert (row.stop_iter, row.converged) == (5, True)
    ragged = [("x", 0, 1, 1.0), ("x", 0, 2, 0.5), ("x", 1, 1, 1.0), ("x", 1, 2, 0.7), ("x", 1, 3, 0.6)]
    out = metrics.convergence(spark.createDataFrame(ragged, "variant string, fold int, iter int, train_rmse double")).orderBy("iter").collect()
    assert [r.rmse_mean for r in out] == pytest.approx([1, 0.6, 0.6])
    assert [r.rmse_std for r in out] == pytest.approx([0, 0.1, 0])
    assert {r.n_folds for r in out} == {2}


# --------------------------------------------------------------------- tests


@pytest.mark.parametrize("n, k, p", [(5, 5, 0.0625), (5, 0, 0.0625), (3, 3, 0.25), (4, 2, 1.0), (0, 0, 1.0)])
def test_sign_test_values(spark, n, k, p):
    df = spark.createDataFrame([(n, k)], "n long, k long")
    assert df.select(stats.sign_test(F.col("n"), F.col("k"))).first()[0] == p


def test_sign_test_of_many_folds(spark):
    cases = [(40, 11), (900, 400), (1200, 560), (3000, 1490)]
    df = spark.createDataFrame(cases, "n long, k long")
    for row in df.withColumn("p", stats.sign_test(F.col("n"), F.col("k"))).collect():
        lower = sum(math.comb(row.n, i) for i in range(row.k + 1)) / 2**row.n if row.n < 1000 else None
        exact = 2 * (lower if lower is not None else sum(math.comb(row.n, i) for i in range(row.k + 1)) * 10**20 // 2**row.n / 1e20)
        assert row.p == pytest.approx(min(1.0, exact), rel=1e-6)


def test_benjamini_hochberg(spark):
    p = [0.0625, 0.0625, 0.0625, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(f"v{i}", x) for i, x in enumerate(p)], "variant string, p_raw double")
    got = [r.p_fdr for r in stats.benjamini_hochberg(df).orderBy("variant").collect()]
    assert got == [0.125] * 3 + [1.0] * 3
    mixed = [0.01, 0.04, 0.03, 0.005, 0.8]
    df = spark.createDataFrame([(f"v{i}", x) for i, x in enumerate(mixed)], "variant string, p_raw double")
    out = stats.benjamini_hochberg(df).orderBy("p_raw").collect()
    assert [r.p_fdr for r in out] == pytest.approx([0.025, 0.025, 0.05, 0.05, 0.8])


def test_ties_and_single_folds(spark):
    scores = spark.createDataFrame(
        [("full", 0, 1.0), ("same", 0, 1.0 + 1e-9), ("worse", 0, 1.1)], "variant string, fold int, rmse double"
    )
    rows = {r.variant: r for r in stats.compare_to_baseline(scores).collect()}
    assert rows["same"].n_pairs == 0 and rows["same"].p_raw == 1.0
    assert rows["worse"].n_positive == 1
    filled = scores.withColumns({"seconds": F.lit(1.0), "iters": F.lit(3), "n_iters": F.lit(5)})
    assert {r.rmse_std for r in stats.summarize_variants(filled).collect()} == {0.0}


# --------------------------------------------------------------------- graph


def brute_force(rows, topk, eps=1e-8):
    unit = [[v / (math.sqrt(sum(x * x for x in r)) + eps) for v in r] for r in rows]
    n = len(rows)
    out = {}
    for i in range(n):
        sims = [0.0 if i == j else sum(a * b for a, b in zip(unit[i], unit[j])) for j in range(n)]
        for j in sorted(range(n), key=lambda j: (-round(sims[j], 9), j))[:topk]:
            if j != i and round(sims[j], 9) != 0:
                out[i, j] = sims[j]
    return out


@pytest.mark.parametrize("topk", [1, 3, 20])
@pytest.mark.parametrize("kind", ["dense", "indicators", "scalar", "repeated"])
def test_neighbours_equal_brute_force(spark, monkeypatch, topk, kind):
    rng = random.Random(topk)
    rows = {
        "dense": [[rng.gauss(0, 1) for _ in range(3)] for _ in range(40)],
        "indicators": [[float(rng.randrange(3) == c) for c in range(3)] for _ in range(40)],
        "scalar": [[rng.gauss(0, 1)] for _ in range(40)],
        "repeated": [[1.0, 0.5]] * 25 + [[rng.random(), -rng.random()] for _ in range(15)],
    }[kind]
    if kind == "dense":
        monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1)  # smallest blocks
        monkeypatch.setattr(neighbours, "STRIP", 3)
    want = brute_force(rows, topk)
    units = graph.unit_vectors(feature(spark, rows), "f", 1e-8)
    got = {(r.src, r.dst): r.sim for r in graph.top_neighbours(units, topk, hot_rows=5, cell=4).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_clustered_vectors_cost_few_products(spark):
    rng = random.Random(0)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    rows = [[c + 0.05 * rng.gauss(0, 1) for c in rng.choice(centres)] for _ in range(900)]
    units = graph.unit_vectors(feature(spark, rows), "f", 1e-8)
    got = {(r.src, r.dst): r.sim for r in graph.top_neighbours(units, 5, cell=40).collect()}
    want = brute_force(rows, 5)
    assert set(got) == set(want)
    report = neighbours.products_report(units, 5, cell=40).first()
    assert report.n_vectors == 900 and report.n_products < 0.25 * 900 ** 2
    whole = neighbours.products_report(graph.unit_vectors(feature(spark, [[rng.gauss(0, 1) for _ in range(24)] for _ in range(600)]), "f", 1e-8), 5, cell=60).first()
    assert whole.n_products < 0.65 * 600 ** 2


def test_vectors_are_sent_as_often_however_many_cells_there_are(spark, monkeypatch):
    def count_rows(*_):
        def task(table):
            import pyarrow as pa

            kind = pa.list_(pa.struct([("dst", pa.int64()), ("sim", pa.float64())]))
            return pa.table({"gid": pa.array([None], pa.int64()), "near": pa.array([[]], kind), "floor": [0.0], "products": [table.num_rows * 10**9]})

        return task

    monkeypatch.setattr(neighbours, "_between", count_rows)
    rng, sent = random.Random(5), {}
    for n in (700, 1_400):
        units = graph.unit_vectors(feature(spark, [[rng.gauss(0, 1) for _ in range(24)] for _ in range(n)]), "f", 1e-8)
        report = neighbours.products_report(units, 5, cell=24).first()
        sent[n] = report.n_products // 10**9
    assert 0 < sent[1_400] <= 2.1 * sent[700]  # four times as many when each pair of cells was a tile


def test_items_of_few_levels_are_dealt_evenly(spark):
    """A level with a third of all items is no single task's work."""
    levels = spark.range(60_000, numPartitions=12).select(
        F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 6).alias("level"))
    units = levels.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (i == F.col("level")).cast("double")).alias("unit"))
    near = graph.top_neighbours(units, 3, hot_rows=2_000)
    sizes = [r["count"] for r in near.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 180_000 and max(sizes) <= 5 * sorted(sizes)[len(sizes) // 2]
    assert {(r.dst) for r in near.where("src = 3").collect()} == {0, 6, 9}
    assert {(r.dst) for r in near.where("src = 59999").collect()} == {5, 11, 17}


def test_symmetrize_drops_one_way_negatives(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.4), (1, 3, 0.2), (3, 4, -0.1), (5, 6, -0.3), (6, 5, -0.2)], "src long, dst long, sim double")
    got = {(r.src, r.dst): r.sim for r in graph.symmetrize(edges).collect()}
    assert got == {(1, 2): 0.5, (2, 1): 0.5, (1, 3): 0.2, (3, 1): 0.2, (5, 6): -0.2, (6, 5): -0.2}


# ------------------------------------------------------------ studies, grids


def base(spark, **changes):
    cfg = ModelConfig(8, 10, 1.0, 2.0, None, 0.0, "inverse_sqrt", alpha=1.0, graph_feature="a", lambda_w={"a": 1.0, "b": 0.0})
    values = {n: getattr(cfg, n) for n in RUNS_SCHEMA.names[2:]} | changes
    return spark.createDataFrame([tuple(values.values())], RUNS_SCHEMA[2:]).withColumn("study", F.lit(0))


def test_variants_depend_on_what_the_base_uses(spark):
    grid = ablation.variant_grid(base(spark), ["a", "b"]).orderBy("position")
    assert [r.variant for r in grid.collect()] == ["full", "no_features", "only_a", "no_graph", "graph_feature=b", "no_pop_reg"]
    kept = ablation.dedupe_variants(grid).orderBy("position")
    assert [r.variant for r in kept.collect()] == ["full", "no_features", "no_graph", "graph_feature=b", "no_pop_reg"]
    bare = base(spark, alpha=0.0, pop_reg_mode=None, lambda_w={})
    assert [r.variant for r in ablation.variant_grid(bare, ["a", "b"]).collect()] == ["full"]
    assert [r.variant for r in ablation.variant_grid(bare, []).collect()] == ["full"]


def test_parameters_are_clipped(spark):
    users, items = spark.range(5), spark.range(9)
    row = study.normalize_params(base(spark, S_topk=100, update_w_every=50), users, items, ["b"]).first()
    assert (row.n_factors, row.S_topk, row.update_w_every, row.alpha, row.graph_feature) == (5, 8, 10, 0.0, "__none__")


def test_bias_penalties_fall_back(spark):
    row = study.model_parameters(base(spark)).first()
    assert (row.lambda_bu, row.lambda_bi) == (1.0, 2.0)
    cfg = ModelConfig(2, 2, 1.0, 2.0, None, 0.0)
    assert (cfg.user_bias_penalty, cfg.item_bias_penalty) == (1.0, 2.0)


def test_runs_survive_the_table(spark):
    runs = [Run(0, ModelConfig(2, 3, 1.0, 2.0, alpha=0.5, graph_feature="a", lambda_w={"a": 1.0}), 1, 1e-4, 10)]
    assert runs_from_table(runs_table(spark, runs), 1e-4, 10) == runs


def test_grid_stays_in_bounds(spark):
    rows = study.param_grid(spark.range(300).withColumnRenamed("id", "trial"), ["a"]).collect()
    assert {r.pop_reg_mode for r in rows} == {None, "inverse_sqrt"}
    for r in rows:
        assert 1 <= r.n_factors <= 150 and 1 <= r.update_w_every <= 60 and 1 <= r.S_topk <= 610
        assert 1e-4 <= r.lambda_w["a"] <= 1e4 and 1e-10 <= r.S_eps <= 1e-4 and 0 <= r.alpha <= 100
        assert r.graph_feature == "a" and r.n_iters == 100


def test_median_rule(spark):
    schema = "trial long, fold int, rmse double"
    finished = spark.createDataFrame([(t, f, 1.0 + t / 10) for t in range(3) for f in range(2)], schema)
    now = spark.createDataFrame([(7, 0, 1.05), (7, 1, 1.5), (8, 0, 1.2), (8, 1, 1.0)], schema)
    assert [(r.trial, r.pruned_at) for r in study.median_rule(now, finished, 3).collect()] == [(8, 0)]
    assert study.median_rule(now, finished, 4).count() == 0


def test_best_trial_ignores_pruned_and_prefers_the_first(spark):
    trials = spark.createDataFrame([(3, "COMPLETE", 1.0), (1, "COMPLETE", 1.0), (2, "PRUNED", 0.5)], "trial long, state string, value double")
    assert study.best_trial(trials).first().trial == 1
    row = study.study_summary(trials).first()
    assert (row.best_value, row.best_trial, row.n_complete, row.n_pruned) == (1.0, 1, 2, 1)
    assert study.best_trial(trials.where("state = 'PRUNED'")).count() == 0


def test_params_load_plain_or_nested(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"params": {"n_factors": 3}, "value": 1}')
    (tmp_path / "b.json").write_text('{"n_factors": 4}')
    assert study.load_params(spark, str(tmp_path / "a.json")).first().n_factors == 3
    assert study.load_params(spark, str(tmp_path / "b.json")).first().n_factors == 4


def test_batches_bound_the_rank(monkeypatch):
    monkeypatch.setattr("ratingspark.plans.fit.STATE_CELLS", 1200)
    runs = [Run(i, ModelConfig(k, 1, 1.0, 1.0)) for i, k in enumerate([4, 4, 4, 30, 1])]
    assert [[r.run_id for r in b] for b in batches(runs, 100)] == [[0, 1], [2], [3], [4]]


# ----------------------------------------------------------------- functions


def test_projection_start_equals_the_column_expression(spark):
    got = spark.range(4).select("id", portable.initial_factor(42, "W.f", F.col("id"), 3).alias("v")).orderBy("id").collect()
    want = portable.initial_projection(42, "f", 4, 3)
    assert [r.v for r in got] == [pytest.approx(list(row), abs=1e-12) for row in want]


def test_keyed_vector_sums(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vec"))
    got = {r.k: r.vec for r in sum_vectors(df, ["k"]).collect()}
    assert got == {k: [len(range(k, 1000, 3)), float(sum(range(k, 1000, 3)))] for k in range(3)}


def test_statistics_of_columns_move_no_rows(spark):
    """One row per feature is joined to all item rows; shuffled by feature these would meet in one task."""
    table = spark.createDataFrame([("a", i, [float(i), float("nan")]) for i in range(9)], "feature string, item_id long, x array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (normalize.impute_medians(table), normalize._scale_columns(table, "col_minmax", 1e-8)):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r.x for r in normalize.impute_medians(table).orderBy("item_id").collect()] == [[float(i), 0.0] for i in range(9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_completed_matrix_is_summed_up_in_cached_pieces(spark, monkeypatch):
    from ratingspark.operators import scoring

    monkeypatch.setattr(scoring, "USERS", 3)
    monkeypatch.setattr(scoring, "ITEMS", 4)
    users = [(u, [0.1 * u, 1.0 - u], 0.5 * u) for u in range(8)]
    items = [(i, [1.0 + i, 0.2 * i], -0.1 * i) for i in range(11)]
    left = spark.createDataFrame(users, "user_id long, u array<double>, b_u double")
    right = spark.createDataFrame(items, "item_id long, z array<double>, b_i double")
    want = {u: [sum(a * b for a, b in zip(x, z)) + bu + bi + 3.0 for _, z, bi in items] for u, x, bu in users}
    for r in scoring.completed_summary(left, right, 3.0).collect():
        row = want[r.user_id]
        assert r.n_items == 11 and abs(r.pred_mean - sum(row) / 11) < 1e-9
        assert abs(r.pred_min - min(row)) < 1e-9 and abs(r.pred_max - max(row)) < 1e-9
    for r in scoring.completed_rows(left, right, 3.0).collect():
        assert all(abs(p - want[r.user_id][i]) < 1e-9 for i, p in zip(r.item_ids, r.predictions))
