"""Model parameters and the table of runs that are fitted together."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession, types as T

# Numerical constants and defaults of the model.
EPS = 1e-10
NO_GRAPH = "__none__"
DEFAULT_SEED = 42
POP_MODES = (None, "inverse_sqrt")


@dataclass(frozen=True)
class ModelConfig:
    """Parameters of one model. ``graph`` edges come from ``graph_feature``."""

    n_factors: int
    n_iters: int
    lambda_u: float
    lambda_v: float
    lambda_bu: float | None = None
    lambda_bi: float | None = None
    pop_reg_mode: str | None = None
    random_state: int = DEFAULT_SEED
    update_w_every: int = 5
    alpha: float = 0.0
    graph_feature: str | None = None
    S_topk: int | None = 50
    S_eps: float = 1e-8
    lambda_w: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.pop_reg_mode not in POP_MODES:
            raise ValueError(f"unknown pop_reg_mode {self.pop_reg_mode!r}")
        if self.n_factors < 1 or self.n_iters < 1 or self.update_w_every < 1:
            raise ValueError("n_factors, n_iters and update_w_every must be at least 1")

    @property
    def user_bias_penalty(self) -> float:
        """A missing or zero penalty falls back to the factor penalty."""
        return self.lambda_bu or self.lambda_u

    @property
    def item_bias_penalty(self) -> float:
        return self.lambda_bi or self.lambda_v

    @property
    def uses_graph(self) -> bool:
        return self.alpha > 0 and self.graph_feature not in (None, NO_GRAPH)

    @property
    def graph_key(self) -> tuple[str, int | None, float]:
        return (self.graph_feature, self.S_topk, self.S_eps)


@dataclass(frozen=True)
class Run:
    """One fit: a parameter setting trained on every rating outside ``fold``."""

    run_id: int
    config: ModelConfig
    fold: int | None = None
    tol: float | None = 1e-3
    min_iters: int = 5

    def refits_projections(self, iteration: int) -> bool:
        every = self.config.update_w_every
        return iteration % every == 0 or iteration == self.config.n_iters - 1


RUNS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.IntegerType(), False),
        T.StructField("fold", T.IntegerType()),
        T.StructField("n_factors", T.IntegerType(), False),
        T.StructField("n_iters", T.IntegerType(), False),
        T.StructField("lambda_u", T.DoubleType(), False),
        T.StructField("lambda_v", T.DoubleType(), False),
        T.StructField("lambda_bu", T.DoubleType()),
        T.StructField("lambda_bi", T.DoubleType()),
        T.StructField("pop_reg_mode", T.StringType()),
        T.StructField("update_w_every", T.IntegerType(), False),
        T.StructField("alpha", T.DoubleType(), False),
        T.StructField("S_topk", T.IntegerType()),
        T.StructField("S_eps", T.DoubleType(), False),
        T.StructField("graph_feature", T.StringType()),
        T.StructField("lambda_w", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
PARAMETERS = [f.name for f in RUNS_SCHEMA if f.name not in ("run_id", "fold")]


def config_from_row(row: Row, seed: int = DEFAULT_SEED) -> ModelConfig:
    values = {name: row[name] for name in PARAMETERS}
    values["lambda_w"] = dict(values["lambda_w"] or {})
    if values["alpha"] <= 0 or values["graph_feature"] in (None, NO_GRAPH):
        values.update(alpha=0.0, graph_feature=None)
    return ModelConfig(random_state=seed, **values)


def runs_from_table(
    table: DataFrame, tol: float | None, min_iters: int, seed: int = DEFAULT_SEED
) -> list[Run]:
    """One ``Run`` per row; the table holds one row per planned fit."""
    rows = table.select(*[f.name for f in RUNS_SCHEMA]).orderBy("run_id").collect()
    return [Run(r.run_id, config_from_row(r, seed), r.fold, tol, min_iters) for r in rows]


def runs_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    rows = []
    for run in runs:
        cfg = run.config
        rows.append((run.run_id, run.fold, *[getattr(cfg, name) for name in PARAMETERS]))
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def with_fold(runs: list[Run], n_folds: int) -> list[Run]:
    """Every run once per fold, ``run_id`` = position * n_folds + fold."""
    return [
        replace(run, run_id=i * n_folds + fold, fold=fold)
        for i, run in enumerate(runs)
        for fold in range(n_folds)
    ]
