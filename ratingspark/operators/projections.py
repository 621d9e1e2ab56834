"""Feature projections: the equations of all runs, solved on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratingspark.functions.keyed_sums import sum_vectors
from ratingspark.operators.half_steps import (
    EQUATIONS,
    RESULT_SCHEMA,
    SOLVED,
    _list_array,
    _matrix,
    _residuals,
    _unflatten,
)
from ratingspark.plans.config import EPS, Run
from ratingspark.session import shuffled

MAX_EQUATIONS = 4_000  # unknowns of one run that a task may solve directly
CG_TOLERANCE = 1e-11  # relative residual at which the iterative solve ends

Slices = list[tuple[str, int, int]]


def stack_features(features: DataFrame) -> tuple[DataFrame, Slices]:
    """All feature vectors of an item side by side, and where each one starts."""
    widths = (
        features.groupBy("feature")
        .agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"))
        .orderBy("feature")
        .collect()
    )
    slices, start = [], 0
    for row in widths:
        if row.lo != row.hi:
            raise ValueError(f"feature {row.feature!r} has rows of different length")
        slices.append((row.feature, start, start + row.hi))
        start += row.hi
    names = [name for name, _, _ in slices]
    wide = features.groupBy("item_id").pivot("feature", names).agg(F.first("x"))
    stacked = wide.select("item_id", F.concat(*[F.col(f"`{n}`") for n in names]).cast("array<double>").alias("x"))
    return stacked, slices


def check_features(features: DataFrame, items: DataFrame) -> None:
    """Each item exactly once per feature, and every value finite."""
    n_items = items.count()
    report = (
        features.join(items.select("item_id").withColumn("known", F.lit(1)), "item_id", "left")
        .groupBy("feature")
        .agg(
            F.count("*").alias("rows"),
            F.count("known").alias("known"),
            F.countDistinct("item_id").alias("items"),
            F.count_if(
                F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
            ).alias("bad"),
        )
        .collect()
    )
    for row in report:
        if row.known != n_items or row["items"] != row.rows or row.rows != n_items:
            raise ValueError(f"feature {row.feature!r} has {row.rows} rows; expected one for each of {n_items} items")
        if row.bad:
            raise ValueError(f"feature {row.feature!r} has {row.bad} rows with values that are not finite")


def solve_projections(
    result: DataFrame, runs: dict[int, Run], weights: dict[int, np.ndarray], slices: Slices
) -> dict[int, tuple[np.ndarray, float, float, float]]:
    """New weights and (n, sum of residuals, sum of squares) per run.

    Features do not see each other's new weights: each is solved against the
    residual left by the old ones.
    """
    due = sorted({run_id for run_id in weights})
    penalties = {r: [runs[r].config.lambda_w.get(name, 0.0) for name, _, _ in slices] for r in due}

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        run_id = table["run_id"][0].as_py()
        old = weights[run_id]
        d, k = old.shape
        n, err, sq_err = table["sums"][0].as_py()
        rows = _matrix(table["sums"].slice(1))
        normal = rows[:, : d * k * k].reshape(d, d, k, k).transpose(0, 2, 1, 3)
        toward = rows[:, d * k * k : d * k * k + k]
        reach = rows[:, d * k * k + k :]
        new = np.empty_like(old)
        through = np.einsum("aibj,bj->ai", normal, old, optimize=True)
        for (_, start, end), penalty in zip(slices, penalties[run_id]):
            width = (end - start) * k
            own = normal[start:end, :, start:end, :].reshape(width, width)
            rhs = toward[start:end] - through[start:end]
            rhs = rhs.ravel() + own @ old[start:end].ravel()
            lhs = own + (penalty + EPS) * np.eye(width)
            try:
                part = np.linalg.solve(lhs, rhs)
            except np.linalg.LinAlgError:
                part = np.linalg.lstsq(lhs, rhs, rcond=None)[0]
            new[start:end] = part.reshape(end - start, k)
        bent = np.einsum("aibj,bj->ai", normal, new, optimize=True)
        sq_err = sq_err - 2 * np.sum(new * toward) + np.sum(new * bent)
        err = err - np.sum(new * reach)
        return pa.table(
            [
                pa.array([run_id], pa.int32()),
                _list_array(new.reshape(1, -1), 1),
                pa.array([float(n)]),
                pa.array([float(err)]),
                pa.array([float(sq_err)]),
            ],
            names=["run_id", "w", "n", "err", "sq_err"],
        )

    equations = sum_vectors(result.where(F.col("kind") == EQUATIONS), ["run_id", "id"], "sums")
    solved = equations.groupBy("run_id").applyInArrow(
        solve, "run_id int, w array<double>, n double, err double, sq_err double"
    )
    out = {}
    for row in solved.collect():  # one row per run
        shape = weights[row.run_id].shape
        out[row.run_id] = (np.array(row.w).reshape(shape), row.n, row.err, row.sq_err)
    return out


def _per_column(rows: DataFrame, term, ranks: dict[int, int], width: int) -> dict[int, np.ndarray]:
    """Sum over items of ``term(run_id, sums, vec, bias, x)``, a (width, m) matrix per run."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            run_ids = table["run_id"].to_numpy()
            for run_id in map(int, np.unique(run_ids)):
                part = table.filter(pa.array(run_ids == run_id))
                sums = _unflatten(_matrix(part["sums"]), ranks[run_id])
                new = term(run_id, sums, _matrix(part["vec"]), part["bias"].to_numpy(), _matrix(part["x"]))
                totals[run_id] = totals[run_id] + new if run_id in totals else new
        for run_id, total in totals.items():
            used = np.flatnonzero(np.any(total != 0, axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), run_id, dtype=np.int32)),
                    pa.array(used.astype(np.int32)),
                    _list_array(total[used], len(used)),
                ],
                names=["run_id", "col", "vec"],
            )

    parts = rows.mapInArrow(add_up, "run_id int, col int, vec array<double>")
    out: dict[int, np.ndarray] = {}
    for row in sum_vectors(parts, ["run_id", "col"]).collect():  # as large as the weights themselves
        matrix = out.setdefault(row.run_id, np.zeros((width, len(row.vec))))
        matrix[row.col] = row.vec
    return out


def iterate_projections(
    result: DataFrame,
    stacked: DataFrame,
    runs: dict[int, Run],
    weights: dict[int, np.ndarray],
    slices: Slices,
) -> dict[int, tuple[np.ndarray, float, float, float]]:
    """Like ``solve_projections`` for features too wide for one task.

    Conjugate gradients with a diagonal preconditioner, on all runs and features
    at once. The equations are never built: each round multiplies by them item
    by item, from the sums of the item step.
    """
    due, width = sorted(weights), slices[-1][2]
    ranks = {r: runs[r].config.n_factors for r in due}
    owner = np.concatenate([np.full(end - start, f) for f, (_, start, end) in enumerate(slices)])
    ridge = {
        r: np.array([runs[r].config.lambda_w.get(name, 0.0) + EPS for name, _, _ in slices])[owner][:, None] for r in due
    }
    rows = (
        result.where((F.col("kind") == SOLVED) & F.col("run_id").isin(due) & (F.col("n") > 0))
        .select("run_id", "id", "vec", "bias", "sums")
        .join(stacked.withColumnRenamed("item_id", "id"), "id")
        .select("run_id", "vec", "bias", "sums", "x")
        .persist()
    )

    def through(gram, x, w):
        """x (outer) G w'x for each feature by itself."""
        out = np.zeros((x.shape[1], gram.shape[1]))
        for _, start, end in slices:
            part = x[:, start:end]
            out[start:end] = part.T @ np.einsum("iab,ib->ia", gram, part @ w[start:end])
        return out

    def start_term(run_id, sums, vec, bias, x):
        """Right-hand side, product with the old weights, and the diagonal."""
        old, gram = weights[run_id], sums["G"]
        toward = sums["c"] - bias[:, None] * sums["s"] - np.einsum("iab,ib->ia", gram, vec + x @ old)
        own = through(gram, x, old)
        diagonal = (x * x).T @ np.einsum("iaa->ia", gram)
        return np.c_[x.T @ toward + own, own, diagonal]

    begin = _per_column(rows, start_term, ranks, width)
    state = {}
    for r in due:
        k = ranks[r]
        rhs, own, diagonal = np.split(begin.get(r, np.zeros((width, 3 * k))), 3, axis=1)
        left = rhs - own - ridge[r] * weights[r]
        scale = 1.0 / (diagonal + ridge[r])
        state[r] = dict(w=weights[r].copy(), left=left, scale=scale, way=scale * left, size=_by_feature(rhs * rhs, slices))
    for _ in range(width * max(ranks.values())):
        ways = {r: s["way"] for r, s in state.items() if np.any(_open(s, slices))}
        if not ways:
            break
        wanted = rows.where(F.col("run_id").isin(sorted(ways)))
        product = _per_column(wanted, lambda r, sums, vec, bias, x: through(sums["G"], x, ways[r]), ranks, width)
        for r, way in ways.items():
            s = state[r]
            active = _open(s, slices)
            image = product.get(r, np.zeros_like(way)) + ridge[r] * way
            slope = _by_feature(way * image, slices)
            before = _by_feature(s["left"] * s["scale"] * s["left"], slices)
            step = np.where(active & (slope > 0), before / np.where(slope > 0, slope, 1.0), 0.0)[owner][:, None]
            s["w"] += step * way
            s["left"] = s["left"] - step * image
            after = _by_feature(s["left"] * s["scale"] * s["left"], slices)
            turn = np.where(active & (before > 0), after / np.where(before > 0, before, 1.0), 0.0)[owner][:, None]
            s["way"] = np.where(active[owner][:, None], s["scale"] * s["left"] + turn * way, 0.0)

    unfinished = {r: [slices[f][0] for f in np.flatnonzero(_open(s, slices))] for r, s in state.items() if np.any(_open(s, slices))}
    if unfinished:
        rows.unpersist()
        raise ArithmeticError(f"projection equations not solved to {CG_TOLERANCE}, by run: {unfinished}; raise lambda_w or drop dependent columns")

    def measure(run_id, sums, vec, bias, x):
        err, sq_err = _residuals(sums, bias, vec + x @ state[run_id]["w"])
        out = np.zeros((width, 3))
        out[0] = sums["n"].sum(), err.sum(), sq_err.sum()
        return out

    measured = _per_column(rows, measure, ranks, width)
    rows.unpersist()
    return {r: (state[r]["w"], *measured[r][0]) for r in due if r in measured}


def _by_feature(values: np.ndarray, slices: Slices) -> np.ndarray:
    return np.array([values[start:end].sum() for _, start, end in slices])


def _open(s: dict, slices: Slices) -> np.ndarray:
    """Which features have not converged yet."""
    return _by_feature(s["left"] ** 2, slices) > CG_TOLERANCE**2 * s["size"]


def with_shift(items: DataFrame, stacked: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """Set ``shift`` = the feature part of each item vector under ``weights``."""
    columns = ["kind", "run_id", "id", "vec", "bias", "n", "err", "sq_err"]
    have = [c for c in columns if c in items.columns]
    joined = shuffled(items.select(*have)).join(stacked.withColumnRenamed("item_id", "id"), "id").select(*have, "x")
    schema = joined.drop("x").schema.add(RESULT_SCHEMA["shift"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by("run_id")
            run_ids = table["run_id"].to_numpy()
            edges = np.flatnonzero(np.diff(run_ids)) + 1
            for start, end in zip(np.r_[0, edges], np.r_[edges, len(run_ids)]):
                part = table.slice(start, end - start)
                shift = _matrix(part["x"]) @ weights[int(run_ids[start])]
                part = part.drop_columns("x").append_column("shift", _list_array(shift, end - start))
                yield from part.combine_chunks().to_batches()

    return joined.mapInArrow(apply, schema)
