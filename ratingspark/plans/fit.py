"""Alternating fit of many runs together.

The run id is an ordinary key of the state tables. Ratings are stored once,
with their fold; a run of fold k skips the rows of that fold inside the tasks.
Each iteration is two shuffles of state rows, never of ratings.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ratingspark.functions import portable
from ratingspark.functions.vectors import add, finite_or_null, sum_squares
from ratingspark.operators.graph import GraphStore, check_edges
from ratingspark.operators.half_steps import SOLVED, half_step, held_out_errors, run_steps
from ratingspark.operators.layout import MAX_ROWS, Layout, build_layout, require_unique
from ratingspark.operators import projections
from ratingspark.operators.systems import DEFINITE, STATUS
from ratingspark.operators.projections import (
    check_features,
    iterate_projections,
    solve_projections,
    stack_features,
    with_shift,
)
from ratingspark.plans.config import Run
from ratingspark.plans.manifest import fit_key, load_state, save_state
from ratingspark.session import cut_lineage, discard_stored, free_shuffles, shuffled

STATE_CELLS = 160_000_000  # numbers of state a task may hold for its block
MOVED_CELLS = 1_500_000_000  # numbers of state that a half step may move between tasks, 12 GB, if it can
FREED_CELLS = 10_000_000  # moved numbers after which shuffle files that nothing needs any more are removed

HISTORY_SCHEMA = (
    "run_id int, iter int, mu double, train_rmse double, "
    "u_norm double, v_norm double, bu_norm double, bi_norm double"
)


@dataclass
class FitResult:
    """Fitted state of all runs, as DataFrames keyed by ``run_id``."""

    runs: list[Run]
    users: DataFrame  # run_id, user_id, u, b_u
    items: DataFrame  # run_id, item_id, v, b_i, z (= v plus feature part)
    mu: dict[int, float]
    history: list[tuple]
    weights: dict[int, np.ndarray]
    slices: list[tuple[str, int, int]]
    seconds: dict[int, float]  # of tasks, for half steps and held-out predictions
    held_out: DataFrame | None = None  # run_id, item_id, n, sq_err, seconds
    issues: list[DataFrame] = field(default_factory=list)
    stored: list[DataFrame] = field(default_factory=list)  # what the tables above are read from

    def discard(self) -> None:
        """Delete the stored tables, once nothing is read from the result any more."""
        for table in self.stored:
            discard_stored(table)
        self.stored = []

    def history_frame(self) -> DataFrame:
        return self.users.sparkSession.createDataFrame(self.history, HISTORY_SCHEMA)

    def solve_issues(self) -> DataFrame:
        """Systems that were not definite: (run_id, iter, side, id, status)."""
        none = self.users.sparkSession.createDataFrame([], "run_id int, iter int, side string, id long, status string")
        return reduce(DataFrame.unionByName, self.issues, none)

    def iterations(self) -> dict[int, int]:
        done: dict[int, int] = {}
        for row in self.history:
            done[row[0]] = max(done.get(row[0], 0), row[1])
        return done


@dataclass
class FitInput:
    """Everything about the data that does not change between runs."""

    ratings: DataFrame
    users: DataFrame
    items: DataFrame
    n_rows: int
    fold_sums: dict[int | None, tuple[int, float]]
    by_user: Layout
    max_rows: int
    stacked: DataFrame | None
    slices: list[tuple[str, int, int]]
    graphs: GraphStore
    scratch: list[DataFrame] = field(default_factory=list)
    _by_item: Layout | None = None

    @property
    def by_item(self) -> Layout:
        """Ratings clustered by item, from those clustered by user, when first asked for."""
        if self._by_item is None:
            rows = self.by_user.ratings.select(F.col("own").alias("user_id"), F.col("other").alias("item_id"), "rating", "fold")
            counts = self.by_user.others().withColumnRenamed("other", "own")
            self._by_item = build_layout(rows, "item_id", "user_id", self.n_rows, self.max_rows, counts)
        return self._by_item

    def mean_outside(self, fold: int | None) -> float:
        """Mean rating of all rows outside ``fold``."""
        n = sum(c for f, (c, _) in self.fold_sums.items() if fold is None or f != fold)
        total = math.fsum(s for f, (_, s) in self.fold_sums.items() if fold is None or f != fold)
        if n == 0:
            raise ValueError("no observed ratings to train on")
        return total / n

    def release(self) -> None:
        self.by_user.release()
        if self._by_item is not None:
            self._by_item.release()
        self.graphs.release()
        for df in self.scratch:
            df.unpersist()


def prepare(
    ratings: DataFrame,
    users: DataFrame | None = None,
    items: DataFrame | None = None,
    features: DataFrame | None = None,
    edges: dict[str, DataFrame] | None = None,
    max_rows: int = MAX_ROWS,
) -> FitInput:
    """Cluster the ratings by user (by item when first asked for) and check ratings, features and edges.

    ``ratings`` is (user_id, item_id, rating) and optionally ``fold``;
    ``features`` is (feature, item_id, x); ``edges`` maps a graph feature to a
    ready-made edge table (src, dst, sim), used instead of building one.
    """
    fold = F.col("fold").cast("int") if "fold" in ratings.columns else F.lit(None).cast("int")
    base = (
        ratings.select(
            F.col("user_id").cast("long").alias("user_id"),
            F.col("item_id").cast("long").alias("item_id"),
            finite_or_null(F.col("rating").cast("double")).alias("rating"),
            F.coalesce(fold, F.lit(-1)).alias("fold"),
        )
        .where(F.col("rating").isNotNull())
    )
    if not ratings.is_cached:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    sums = base.groupBy("fold").agg(F.count("*").alias("n"), F.sum("rating").alias("total")).collect()
    n_rows = sum(r.n for r in sums)
    if n_rows == 0:
        raise ValueError("no observed ratings")

    def universe(given: DataFrame | None, key: str, rated: DataFrame) -> DataFrame:
        if given is None:
            return rated.toDF(key).distinct()
        return given.select(F.col(key).cast("long").alias(key)).union(rated).distinct()

    if items is None and features is not None:
        items = features.select("item_id").distinct()
    counts = base.groupBy(F.col("user_id").alias("own")).count().persist()
    by_user = build_layout(base, "user_id", "item_id", n_rows, max_rows, counts)
    require_unique(by_user)
    all_users = universe(users, "user_id", counts.select("own")).persist()
    all_items = universe(items, "item_id", by_user.others().select("other")).persist()
    for known in (all_users, all_items):  # filled while the counts they are read from are still cached
        known.count()
    counts.unpersist()
    base.unpersist()
    scratch = [all_users, all_items]
    stacked, slices = None, []
    if features is not None:
        check_features(features, all_items)
        stacked, slices = stack_features(features)
        stacked = stacked.persist()
        scratch.append(stacked)
    for name, table in (edges or {}).items():
        check_edges(name, table, all_items)
    graphs = GraphStore(features, edges or {})
    return FitInput(
        base, all_users, all_items, n_rows, {r.fold: (r.n, r.total) for r in sums},
        by_user, max_rows, stacked, slices, graphs, scratch,
    )


def batches(runs: list[Run], block_rows: int, n_rows: int = 0) -> list[list[Run]]:
    """Groups of runs whose state fits a task together, and the disk while it is moved.

    A block needs at most one state row per rating, whatever the popularity of
    its members, so rows times the summed ranks bounds what a task holds, and
    all ratings times the summed ranks what a half step moves.
    """
    budget = min(STATE_CELLS // max(1, block_rows), MOVED_CELLS // max(1, n_rows))
    out: list[list[Run]] = []
    room = 0
    for run in runs:
        need = run.config.n_factors + 2
        if not out or room < need:
            out.append([])
            room = budget
        out[-1].append(run)
        room -= need
    return out


def _initial_state(universe: DataFrame, key: str, tag: str, runs: list[Run]) -> DataFrame:
    """(run_id, id, vec, bias): runs of equal seed and rank start alike."""
    groups: dict[tuple[int, int], list[int]] = {}
    for run in runs:
        groups.setdefault((run.config.random_state, run.config.n_factors), []).append(run.run_id)
    starts = F.array(
        *[
            F.struct(
                F.lit(seed).cast("long").alias("seed"),
                F.lit(rank).alias("rank"),
                F.array(*[F.lit(r) for r in ids]).alias("ids"),
            )
            for (seed, rank), ids in groups.items()
        ]
    )
    return (
        universe.select(F.col(key).alias("id"), F.explode(starts).alias("start"))
        .select(
            "id",
            F.col("start.ids").alias("ids"),
            portable.initial_factor(F.col("start.seed"), tag, F.col("id"), F.col("start.rank")).alias("vec"),
        )
        .select(F.explode("ids").alias("run_id"), "id", "vec", F.lit(0.0).alias("bias"))
    )


def _enriched(items: DataFrame) -> DataFrame:
    """Items as the user side sees them: own vector plus feature part."""
    if "shift" not in items.columns:
        return items.select("run_id", "id", "vec", "bias")
    vec = F.when(F.col("shift").isNull(), F.col("vec")).otherwise(add(F.col("vec"), F.col("shift")))
    return items.select("run_id", "id", vec.alias("vec"), "bias")


def _measures(users: DataFrame, items: DataFrame) -> tuple[dict, dict]:
    """Squared norms, error sums, task seconds and doubtful systems per run, in one job."""

    def sums(df: DataFrame, side: str) -> DataFrame:
        errors = side == "item"
        return df.groupBy("run_id").agg(
            F.lit(side).alias("side"),
            F.sum(sum_squares(F.col("vec"))).alias("vec2"),
            F.sum(F.col("bias") * F.col("bias")).alias("bias2"),
            (F.sum("n") if errors else F.lit(0)).cast("double").alias("n"),
            (F.sum("err") if errors else F.lit(0.0)).alias("err"),
            (F.sum("sq_err") if errors else F.lit(0.0)).alias("sq_err"),
            F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
            F.count_if(F.col("status") != DEFINITE).alias("doubtful"),
        )

    found: dict[str, dict] = {"user": {}, "item": {}}
    for row in sums(users, "user").unionByName(sums(items, "item")).collect():
        found[row.side][row.run_id] = row
    return found["user"], found["item"]


def _doubtful(df: DataFrame, side: str, iteration: int) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return df.where(F.col("status") != DEFINITE).select(
        "run_id", F.lit(iteration).alias("iter"), F.lit(side).alias("side"), "id", names[F.col("status")].alias("status"))


def _converged(curve: list[float], run: Run) -> bool:
    """Training error fell by at most ``tol`` over the last two iterations."""
    if run.tol is None or len(curve) < max(3, run.min_iters):
        return False
    return curve[-3] - curve[-1] <= run.tol


def _fit_batch(data: FitInput, runs: list[Run], resume: str | None = None) -> FitResult:
    by_id = {run.run_id: run for run in runs}
    mu = {run.run_id: data.mean_outside(run.fold) for run in runs}
    weights: dict[int, np.ndarray] = {}
    for run in runs:
        if data.slices:
            cfg = run.config
            weights[run.run_id] = np.concatenate(
                [
                    portable.initial_projection(cfg.random_state, name, end - start, cfg.n_factors)
                    for name, start, end in data.slices
                ]
            )
    linked = data.graphs.usable(runs)
    shift = ["shift"] if data.slices else []
    active = list(runs)
    curves: dict[int, list[float]] = {run.run_id: [] for run in runs}
    history: list[tuple] = []
    seconds = {run.run_id: 0.0 for run in runs}
    done_users: list[DataFrame] = []
    done_items: list[DataFrame] = []
    issues: list[DataFrame] = []
    iteration, moved = 0, 0
    user_table = item_table = None  # the stored tables behind ``users`` and ``items``
    stored: list[DataFrame] = []

    def succeed(old: DataFrame | None, new: DataFrame) -> DataFrame:
        """Delete the table that ``new`` replaces and, now and then, free what it took to get there."""
        nonlocal moved
        if old is not None:
            discard_stored(old)
        moved += data.n_rows * sum(run.config.n_factors + 1 for run in active)
        if moved > FREED_CELLS:
            moved = 0
            free_shuffles(new.sparkSession)
        return new

    saved = load_state(data.ratings.sparkSession, resume, fit_key(data, runs)) if resume else None
    if saved is None:
        users = _initial_state(data.users, "user_id", "U", runs)
        items = _initial_state(data.items, "item_id", "V", runs)
        if data.slices:
            items = with_shift(items, data.stacked, weights)
        users = user_table = cut_lineage(users)
        items = item_table = cut_lineage(items)
    else:
        iteration, mu, weights, curves, history, seconds = (
            saved.iteration, saved.mu, saved.weights, saved.curves, saved.history, saved.seconds)
        users, items, done_users, done_items = saved.users, saved.items, saved.done_users, saved.done_items
        active = [run for run in runs if run.run_id in saved.active]
    while active:
        due = {r.run_id for r in active if data.slices and r.refits_projections(iteration)}
        users = cut_lineage(
            half_step(data.by_user, users, _enriched(items), run_steps(active, mu, "user"))
            .select("run_id", "id", "vec", "bias", "status", "seconds")
        )
        data.by_user.drop_scratch()
        user_table = succeed(user_table, users)
        wide = {r for r in due if data.slices[-1][2] * by_id[r].config.n_factors > projections.MAX_EQUATIONS}
        direct = due - wide
        own = data.graphs.attach(items.select("run_id", "id", "vec", "bias", *shift), active, linked)
        if direct:
            wanted = F.col("run_id").isin(sorted(direct))
            own = shuffled(own).join(data.stacked.withColumnRenamed("item_id", "id"), "id").withColumn(
                "x", F.when(wanted, F.col("x"))
            )
        steps = run_steps(active, mu, "item", direct, linked, bool(shift), wide)
        result = cut_lineage(half_step(data.by_item, own, users, steps))
        data.by_item.drop_scratch()
        item_table = succeed(item_table, result)
        solved = result.where(F.col("kind") == SOLVED)
        items = solved.select("run_id", "id", "vec", "bias", "shift", "n", "err", "sq_err")
        refit = {}
        if due:
            if direct:
                refit.update(solve_projections(result, by_id, {r: weights[r] for r in direct}, data.slices))
            if wide:
                old = {r: weights[r] for r in wide}
                refit.update(iterate_projections(result, data.stacked, by_id, old, data.slices))
            weights.update({r: new for r, (new, _, _, _) in refit.items()})
            stale = items.where(~F.col("run_id").isin(sorted(due)))
            fresh = with_shift(items.where(F.col("run_id").isin(sorted(due))), data.stacked, weights)
            items = fresh if len(due) == len(active) else fresh.unionByName(stale)

        user_sums, item_sums = _measures(users, solved)
        for side, table, found in (("user", users, user_sums), ("item", solved, item_sums)):
            if any(row.doubtful for row in found.values()):
                issues.append(cut_lineage(_doubtful(table, side, iteration + 1)))
                stored.append(issues[-1])
        stopped = []
        for run in active:
            r, u, i = run.run_id, user_sums[run.run_id], item_sums[run.run_id]
            n, err, sq_err = refit[r][1:] if r in refit else (i.n, i.err, i.sq_err)
            if n == 0:
                raise ValueError(f"run {r} has no observed ratings outside fold {run.fold}")
            mean_err = err / n
            mu[r] += mean_err
            rmse = math.sqrt(max(sq_err / n - mean_err**2, 0.0))
            if not math.isfinite(rmse):
                warnings.warn(f"run {r} diverged at iteration {iteration + 1}")
            curves[r].append(rmse)
            history.append(
                (r, iteration + 1, mu[r], rmse, math.sqrt(u.vec2), math.sqrt(i.vec2),
                 math.sqrt(u.bias2), math.sqrt(i.bias2))
            )
            seconds[r] += u.seconds + i.seconds
            if iteration + 1 >= run.config.n_iters or _converged(curves[r], run) or not math.isfinite(rmse):
                stopped.append(r)
        if stopped:
            gone = F.col("run_id").isin(stopped)
            active = [run for run in active if run.run_id not in set(stopped)]
            if active:  # the tables of this iteration go with the next one
                stored += [cut_lineage(users.where(gone)), cut_lineage(items.where(gone))]
                done_users.append(stored[-2])
                done_items.append(stored[-1])
            else:
                stored += [user_table, item_table]
                done_users.append(users.where(gone))
                done_items.append(items.where(gone))
            users, items = users.where(~gone), items.where(~gone)
        iteration += 1
        if resume:
            save_state(resume, fit_key(data, runs), iteration, users, items, (done_users[-1], done_items[-1]) if stopped else None,
                       [run.run_id for run in active], mu, weights, curves, history, seconds)

    final_users = reduce(DataFrame.unionByName, done_users).select(
        "run_id", F.col("id").alias("user_id"), F.col("vec").alias("u"), F.col("bias").alias("b_u")
    )
    done = reduce(DataFrame.unionByName, done_items)
    enriched = F.when(F.col("shift").isNull(), F.col("vec")).otherwise(add(F.col("vec"), F.col("shift")))
    final_items = done.withColumn("z", enriched)
    final_items = final_items.select(
        "run_id", F.col("id").alias("item_id"), F.col("vec").alias("v"), F.col("bias").alias("b_i"), "z"
    )
    return FitResult(runs, final_users, final_items, mu, history, weights, data.slices, seconds, None, issues, stored)


def score_held_out(data: FitInput, fit: FitResult) -> DataFrame:
    """(run_id, item_id, n, sq_err): errors of each run on its own fold."""
    steps = run_steps(fit.runs, fit.mu, "user")
    users = fit.users.select("run_id", F.col("user_id").alias("id"), F.col("u").alias("vec"), F.col("b_u").alias("bias"))
    items = fit.items.select("run_id", F.col("item_id").alias("id"), F.col("z").alias("vec"), F.col("b_i").alias("bias"))
    return held_out_errors(data.by_user, users, items, steps)


def fit_runs(data: FitInput, runs: list[Run], score: bool = False, resume: str | None = None) -> FitResult:
    """Fit every run; with ``score`` also measure it on its held-out fold.

    With ``resume``, a folder that all machines share, the state is saved after each iteration, and
    the same fit started again goes on behind the last one whose manifest stands. The folder has to
    stay as long as the result is used. (``solve_issues`` then has those since the restart.)
    """
    parts = []
    block_rows = max(data.by_user.block_rows, data.by_item.block_rows)
    for number, group in enumerate(batches(runs, block_rows, data.n_rows)):
        part = _fit_batch(data, group, f"{resume}/batch={number:05d}" if resume else None)
        if score:
            part.held_out = cut_lineage(score_held_out(data, part))
            part.stored.append(part.held_out)
            if data.n_rows * sum(run.config.n_factors + 1 for run in group) > FREED_CELLS:
                free_shuffles(part.held_out.sparkSession)
            for row in part.held_out.groupBy("run_id").agg(F.sum("seconds").alias("seconds")).collect():  # one row per run
                part.seconds[row.run_id] += row.seconds
        parts.append(part)
    merged = parts[0]
    for part in parts[1:]:
        merged = FitResult(
            merged.runs + part.runs,
            merged.users.unionByName(part.users),
            merged.items.unionByName(part.items),
            {**merged.mu, **part.mu},
            merged.history + part.history,
            {**merged.weights, **part.weights},
            merged.slices,
            {**merged.seconds, **part.seconds},
            merged.held_out.unionByName(part.held_out) if score else None,
            merged.issues + part.issues,
            merged.stored + part.stored,
        )
    return merged
