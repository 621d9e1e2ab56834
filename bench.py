"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ratingspark.operators import folds, graph, normalize, topn
from ratingspark.operators.metrics import mean_by_bin, popularity_bins, rmse_by_bin
from ratingspark.operators.baselines import item_errors
from ratingspark.operators.stats import benjamini_hochberg, compare_to_baseline
from ratingspark.operators.baselines import fold_scores
from ratingspark.plans.config import ModelConfig, Run, with_fold
from ratingspark.plans.fit import fit_runs, prepare
from ratingspark.session import build_session
from ratingspark.sources.ratings import counts_per
from ratingspark.workload import views as v

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RANK, ITERATIONS = 10, 10
BASE = dict(n_factors=RANK, lambda_u=5.0, lambda_v=6.0, lambda_bu=3.0, lambda_bi=2.0, pop_reg_mode="inverse_sqrt")


def write(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, run):
        began = time.perf_counter()
        result = run()
        took[name] = round(time.perf_counter() - began, 3)
        return result

    users, items = v.users(spark, SF), v.items(spark, SF)
    timed("scan_ratings", lambda: write(v.ratings(spark, SF)))
    timed("make_folds", lambda: write(v.folded(spark, SF)))
    raw = v.brand_feature(spark, SF).unionByName(v.size_feature(spark, SF, missing=True))
    timed("norm_multi", lambda: write(normalize.normalize_features(
        raw, impute="col_median", overrides={"brand": {"method": "row_l1"}, "size": {"method": "col_zscore"}})))
    guesses = v.guesses(spark, SF)
    timed("fdr_bh", lambda: benjamini_hochberg(compare_to_baseline(fold_scores(guesses))).collect())
    counts = counts_per(v.ratings(spark, SF), items, "item_id")

    def by_bin():
        errors = item_errors(guesses)
        groups = errors.select("variant", "fold").distinct()
        return mean_by_bin(rmse_by_bin(errors, popularity_bins(counts), groups, 5), 5).collect()

    timed("popbin_mean", by_bin)
    units = graph.unit_vectors(v.type_feature(spark, SF), "type", 1e-8)
    timed("graph_topk_type", lambda: write(graph.symmetrize(graph.top_neighbours(units, 50))))
    units = graph.unit_vectors(v.embedding_feature(spark, SF), "emb", 1e-8)
    timed("graph_topk_emb", lambda: write(graph.symmetrize(graph.top_neighbours(units, 50))))

    features = v.type_feature(spark, SF).unionByName(v.scalar_features(spark, SF))
    data = timed("prepare", lambda: prepare(v.folded(spark, SF), users, items, features))
    weights = {"type": 5.0, "size": 10.0, "price": 10.0}
    plain = ModelConfig(n_iters=ITERATIONS, **BASE)
    single = timed("fit_rank10_10_iterations", lambda: fit_runs(data, [Run(0, plain, None, None)]))
    timed("recommend_top10", lambda: write(
        topn.recommend(single.users, single.items, single.mu[0], 10, v.ratings(spark, SF))))

    full = ModelConfig(n_iters=5, lambda_w=weights, alpha=0.5, graph_feature="type", S_topk=50, **BASE)
    no_graph = ModelConfig(n_iters=5, lambda_w=weights, **BASE)
    no_pop = ModelConfig(n_iters=5, lambda_w=weights, **{**BASE, "pop_reg_mode": None})
    runs = with_fold([Run(i, c, None, None) for i, c in enumerate((full, no_graph, no_pop))], v.N_FOLDS)

    def study():
        fit = fit_runs(data, runs, score=True)
        return fit.held_out.groupBy("run_id").sum("sq_err").collect()

    timed("cv_15_fits_5_iterations", study)
    per_fit = round(took["cv_15_fits_5_iterations"] / len(runs), 3)
    comparator = spark_als(spark, data)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": SF, "ratings": data.n_rows, "seconds_per_cv_fit": per_fit,
        "comparator_mllib_als_rank10_10_iterations": comparator,
    }))


def spark_als(spark, data) -> float | None:
    """Seconds of Spark's own ALS (no biases, features or graph) at equal rank."""
    try:
        from pyspark.ml.recommendation import ALS
    except ImportError:
        return None
    rows = data.by_user.ratings.selectExpr("cast(own as int) user", "cast(other as int) item", "cast(rating as float) rating")
    began = time.perf_counter()
    model = ALS(rank=RANK, maxIter=ITERATIONS, regParam=0.1).fit(rows)
    model.itemFactors.count()
    return round(time.perf_counter() - began, 3)


if __name__ == "__main__":
    main()
