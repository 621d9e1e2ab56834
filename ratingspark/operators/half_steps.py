"""The two halves of one alternating iteration, over all runs at once.

For an entity with observations z (state of the other side) and residuals y,
everything the update needs is additive over its ratings:

    n, t = sum y, q = sum y^2, s = sum z, c = sum z y, G = sum z z'

so an entity that was cut into parts is solved from the sum of its parts. The
training error and the equations for the feature projections follow from the
same sums, which saves another pass over the ratings.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ratingspark.functions.keyed_sums import sum_vectors
from ratingspark.operators.layout import Layout
from ratingspark.operators.systems import DEFINITE, solve_systems
from ratingspark.plans.config import EPS, Run
from ratingspark.session import shuffled

VECTOR = T.ArrayType(T.DoubleType())
OWN, OTHER = 0, 1  # kinds of state rows
SOLVED, PARTIAL, EQUATIONS = 0, 1, 2  # kinds of result rows

# What a block receives besides its ratings: one packed vector per state row.
# other side, of all runs in turn:  bias, vec            own side: bias, vec [, shift] [, degree, pull] [, x]
# Columns that are mostly NULL arrays are far slower to send than one longer array.
STATE_COLUMNS = ["kind", "run_id", "id", "packed"]
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("run_id", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("vec", VECTOR),
        T.StructField("bias", T.DoubleType()),
        T.StructField("shift", VECTOR),
        T.StructField("n", T.LongType()),
        T.StructField("err", T.DoubleType()),  # sum of training residuals
        T.StructField("sq_err", T.DoubleType()),  # sum of their squares
        T.StructField("sums", VECTOR),  # sums of a part, of a feature column or of an item
        T.StructField("status", T.IntegerType()),  # of the solved system, see ``systems``
        T.StructField("seconds", T.DoubleType()),  # of a task for one run, on one row of it
    ]
)
RESULT_ARROW = to_arrow_schema(RESULT_SCHEMA)
GRAM_CELLS = 4_000_000  # numbers held at a time for products of vectors
SUMS_HEAD = 3  # n, t, q come first in ``sums``


@dataclass(frozen=True)
class RunStep:
    """What one run contributes to a half step besides its state rows."""

    k: int
    fold: int | None
    mu: float
    penalty: float
    bias_penalty: float
    by_popularity: bool
    alpha: float
    has_shift: bool
    has_graph: bool
    measures_error: bool
    projections_due: bool  # sum up the projection equations of the run
    keeps_sums: bool  # or hand on the sums of every item, for wide features


def run_steps(
    runs: list[Run],
    mu: dict[int, float],
    side: str,
    due: set[int] = frozenset(),
    graphs: set[int] = frozenset(),
    has_shift: bool = False,
    wide: set[int] = frozenset(),
) -> dict[int, RunStep]:
    steps = {}
    for run in runs:
        cfg = run.config
        items = side == "item"
        steps[run.run_id] = RunStep(
            k=cfg.n_factors,
            fold=run.fold,
            mu=mu[run.run_id],
            penalty=cfg.lambda_v if items else cfg.lambda_u,
            bias_penalty=cfg.item_bias_penalty if items else cfg.user_bias_penalty,
            by_popularity=items and cfg.pop_reg_mode == "inverse_sqrt",
            alpha=cfg.alpha,
            has_shift=items and has_shift,
            has_graph=items and run.run_id in graphs,
            measures_error=items,
            projections_due=items and run.run_id in due,
            keeps_sums=items and run.run_id in wide,
        )
    return steps


# ---------------------------------------------------------------- inside a task


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A list column of equal lengths as a matrix; ``width`` if there are no rows."""
    if len(column) == 0:
        return np.zeros((0, width))
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class _Block:
    """Ratings of one block in the order of their owner."""

    def __init__(self, ratings: pa.Table):
        own = ratings["own"].to_numpy()
        order = np.argsort(own, kind="stable")
        self.own = own[order]
        self.other = ratings["other"].to_numpy()[order]
        self.rating = ratings["rating"].to_numpy()[order]
        self.fold = ratings["fold"].to_numpy()[order]
        self.split = ratings["split"].to_numpy(zero_copy_only=False)[order]
        self._own_ids = self._other_ids = np.zeros(0, dtype=np.int64)
        self._own_at = self._other_at = np.zeros(0, dtype=np.int64)

    def own_positions(self, own_ids: np.ndarray) -> np.ndarray:
        """Row numbers of the owners; the same for all runs, so kept."""
        if len(self._own_at) != len(self.own) or not np.array_equal(own_ids, self._own_ids):
            self._own_ids, self._own_at = own_ids, np.searchsorted(own_ids, self.own)
        return self._own_at

    def positions(self, own_ids: np.ndarray, other_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of owner and other side, whose ids are ordered."""
        if len(self._other_at) != len(self.own) or not np.array_equal(other_ids, self._other_ids):
            self._other_ids, self._other_at = other_ids, np.searchsorted(other_ids, self.other)
        return self.own_positions(own_ids), self._other_at


def _by_run(state: pa.Table) -> Iterator[tuple[int, pa.Table, pa.Table]]:
    """(run, own rows, other rows), each ordered by id."""
    state = state.sort_by([("run_id", "ascending"), ("kind", "ascending"), ("id", "ascending")])
    code = state["run_id"].to_numpy().astype(np.int64) * 2 + state["kind"].to_numpy()
    edges = np.flatnonzero(np.diff(code)) + 1
    parts: dict[int, list[pa.Table]] = {}
    empty = state.slice(0, 0)
    for start, end in zip(np.r_[0, edges], np.r_[edges, len(code)]):
        if end > start:
            run_id, kind = divmod(int(code[start]), 2)
            parts.setdefault(run_id, [empty, empty])[kind] = state.slice(start, end - start)
    for run_id, (own, other) in parts.items():
        yield run_id, own, other


def _by_step(state: pa.Table, block: _Block, steps: dict[int, RunStep]) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(run, own rows ordered by id, ids, vectors and positions in them of the other side) of each run that has own rows."""
    other = state.filter(pc.equal(state["kind"], OTHER))
    order = sorted(steps)
    ends = np.cumsum([1 + steps[r].k for r in order])
    ids, seen = other["id"].to_numpy(), _matrix(other["packed"], int(ends[-1]))
    if seen.shape[1] != ends[-1]:
        raise ValueError(f"rows of the other side have {seen.shape[1]} numbers, not the {ends[-1]} of {len(order)} runs")
    by_id = np.argsort(ids, kind="stable")
    other_at = by_id[np.searchsorted(ids[by_id], block.other)] if len(ids) else np.zeros(0, np.int64)
    spans = dict(zip(order, zip(ends - [1 + steps[r].k for r in order], ends)))
    for run_id, own, _ in _by_run(state.filter(pc.equal(state["kind"], OWN))):
        yield run_id, own, ids, seen[:, slice(*spans[run_id])], other_at


def _grams(z: np.ndarray, n: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """z'z per owner; owners with equally many rows share one stacked product."""
    for size in np.unique(n[n > 0]):
        owners = np.flatnonzero(n == size)
        step = max(1, GRAM_CELLS // (int(size) * z.shape[1]))
        for first in range(0, len(owners), step):
            some = owners[first : first + step]
            rows = z[starts[some][:, None] + np.arange(size)]
            out[some] = np.matmul(rows.transpose(0, 2, 1), rows)


def _sums(z: np.ndarray, y: np.ndarray, at: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Additive statistics per owner; rows come in the order of ``at``."""
    k = z.shape[1]
    n = np.bincount(at, minlength=size)
    ends = np.cumsum(n)
    out = {
        "n": n.astype(float),
        "t": np.bincount(at, weights=y, minlength=size),
        "q": np.bincount(at, weights=y * y, minlength=size),
        "s": np.zeros((size, k)),
        "c": np.zeros((size, k)),
        "G": np.zeros((size, k, k)),
    }
    if k == 1:
        col = z[:, 0]
        out["s"][:, 0] = np.bincount(at, weights=col, minlength=size)
        out["c"][:, 0] = np.bincount(at, weights=col * y, minlength=size)
        out["G"][:, 0, 0] = np.bincount(at, weights=col * col, minlength=size)
        return out
    present = np.flatnonzero(n)
    if len(present):
        starts = ends[present] - n[present]
        out["s"][present] = np.add.reduceat(z, starts, axis=0)
        out["c"][present] = np.add.reduceat(z * y[:, None], starts, axis=0)
    _grams(z, n, ends - n, out["G"])
    return out


def _flatten(sums: dict[str, np.ndarray], pick: np.ndarray) -> np.ndarray:
    head = np.stack([sums["n"][pick], sums["t"][pick], sums["q"][pick]], axis=1)
    gram = sums["G"][pick]
    return np.concatenate([head, sums["s"][pick], sums["c"][pick], gram.reshape(len(gram), -1)], axis=1)


def _unflatten(flat: np.ndarray, k: int) -> dict[str, np.ndarray]:
    head = SUMS_HEAD
    return {
        "n": flat[:, 0],
        "t": flat[:, 1],
        "q": flat[:, 2],
        "s": flat[:, head : head + k],
        "c": flat[:, head + k : head + 2 * k],
        "G": flat[:, head + 2 * k :].reshape(len(flat), k, k),
    }


def _quadratic(gram: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ia,iab,ib->i", v, gram, v, optimize=True)


def _solve(step: RunStep, sums: dict[str, np.ndarray], own: dict[str, np.ndarray | None]):
    """Updated vectors and biases, and how each system went; owners without ratings keep theirs."""
    vec, bias = own["vec"].copy(), own["bias"].copy()
    rated = sums["n"] > 0
    status = np.full(len(vec), DEFINITE, dtype=np.int32)
    if not rated.any():
        return vec, bias, status
    n, s = sums["n"][rated], sums["s"][rated]
    penalty = step.penalty / np.sqrt(n + 1.0) if step.by_popularity else np.full(len(n), step.penalty)
    ridge = penalty + EPS
    rhs = sums["c"][rated] - bias[rated, None] * s
    if step.has_graph:
        ridge = ridge + step.alpha * own["degree"][rated]
        rhs = rhs + step.alpha * own["pull"][rated]
    lhs = sums["G"][rated] + ridge[:, None, None] * np.eye(step.k)
    vec[rated], status[rated] = solve_systems(lhs, rhs)
    left = sums["t"][rated] - np.einsum("ij,ij->i", s, vec[rated])
    bias[rated] = left / (n + step.bias_penalty + EPS)
    return vec, bias, status


def _residuals(sums: dict[str, np.ndarray], bias: np.ndarray, z: np.ndarray):
    """Sum and sum of squares of y - bias - z.u over each owner's ratings."""
    n, t, q, s, c = (sums[name] for name in "ntqsc")
    reach = np.einsum("ij,ij->i", s, z)
    err = t - n * bias - reach
    sq_err = (
        q - 2 * bias * t + n * bias**2 - 2 * np.einsum("ij,ij->i", c, z)
        + 2 * bias * reach + _quadratic(sums["G"], z)
    )
    return err, sq_err


def _projection_equations(sums, vec, bias, x) -> tuple[np.ndarray, np.ndarray]:
    """Sums over ratings for the features x (outer) u, given V and biases.

    Because x is constant per item, the design matrix of the ratings is never
    built: sum (x x') (outer) G, sum x (outer) residual direction, sum x (outer) s.
    """
    rated = sums["n"] > 0
    sums = {name: value[rated] for name, value in sums.items()}
    vec, bias, x = vec[rated], bias[rated], x[rated]
    k, d = vec.shape[1], x.shape[1]
    err, sq_err = _residuals(sums, bias, vec)
    head = np.array([sums["n"].sum(), err.sum(), sq_err.sum()])
    toward = sums["c"] - bias[:, None] * sums["s"] - np.einsum("iab,ib->ia", sums["G"], vec)
    rows = np.empty((d, d * k * k + 2 * k))
    gram = sums["G"].reshape(len(x), k * k)
    for col in range(d):  # one feature column at a time keeps memory at items x k^2
        used = np.flatnonzero(x[:, col])
        weighted = gram[used] * x[used, col][:, None]
        rows[col, : d * k * k] = (x[used].T @ weighted).ravel()
    rows[:, d * k * k : d * k * k + k] = x.T @ toward
    rows[:, d * k * k + k :] = x.T @ sums["s"]
    return head, rows


def _list_array(matrix: np.ndarray | None, length: int) -> pa.Array:
    if matrix is None:
        return pa.nulls(length, pa.list_(pa.float64()))
    width = matrix.shape[1]
    offsets = np.arange(length + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def _result(kind, run_id, ids, vec=None, bias=None, shift=None, n=None, err=None, sq_err=None, sums=None, status=None):
    size = len(ids)

    def column(values, type_):
        return pa.nulls(size, type_) if values is None else pa.array(values, type_)

    return pa.Table.from_arrays(
        [
            pa.array(np.full(size, kind, dtype=np.int32)),
            pa.array(np.full(size, run_id, dtype=np.int32)),
            pa.array(ids, pa.int64()),
            _list_array(vec, size),
            column(bias, pa.float64()),
            _list_array(shift, size),
            column(None if n is None else n.astype(np.int64), pa.int64()),
            column(err, pa.float64()),
            column(sq_err, pa.float64()),
            _list_array(sums, size),
            column(status, pa.int32()),
            pa.nulls(size, pa.float64()),
        ],
        schema=RESULT_ARROW,
    )


def _timed(tables: list[pa.Table], seconds: float) -> None:
    """Put the time of one run on the first row of its last result."""
    if tables and tables[-1].num_rows:
        column = pa.array([seconds] + [None] * (tables[-1].num_rows - 1), pa.float64())
        tables[-1] = tables[-1].set_column(tables[-1].schema.get_field_index("seconds"), "seconds", column)


class _Output:
    """Result rows of one group; the projection equations are summed per run."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.equations: dict[int, list[np.ndarray]] = {}

    def finish(self, run_id: int, step: RunStep, ids, sums, own) -> None:
        """Add the owners whose sums are complete."""
        vec, bias, status = _solve(step, sums, own)
        shift = own["shift"]
        err = sq_err = None
        if step.measures_error:
            err, sq_err = _residuals(sums, bias, vec if shift is None else vec + shift)
        flat = _flatten(sums, np.arange(len(ids))) if step.keeps_sums else None
        self.tables.append(_result(SOLVED, run_id, ids, vec, bias, shift, sums["n"], err, sq_err, flat, status))
        if step.projections_due and sums["n"].any():
            new = _projection_equations(sums, vec, bias, own["x"])
            old = self.equations.get(run_id)
            self.equations[run_id] = list(new) if old is None else [a + b for a, b in zip(old, new)]

    def drain(self) -> list[pa.Table]:
        for run_id, (head, rows) in self.equations.items():
            self.tables.append(_result(EQUATIONS, run_id, np.array([-1]), sums=head[None, :]))
            self.tables.append(_result(EQUATIONS, run_id, np.arange(len(rows)), sums=rows))
        self.equations = {}
        tables, self.tables = self.tables, []
        return tables


def _own_arrays(packed: np.ndarray, step: RunStep) -> dict[str, np.ndarray | None]:
    """Split packed own rows into their parts."""
    k, start = step.k, 1 + step.k
    out = {"bias": packed[:, 0], "vec": packed[:, 1:start], "shift": None, "degree": None, "pull": None, "x": None}
    if step.has_shift:
        out["shift"] = packed[:, start : start + k]
        start += k
    if step.has_graph:
        out["degree"], out["pull"] = packed[:, start], packed[:, start + 1 : start + 1 + k]
        start += 1 + k
    if step.projections_due:
        out["x"] = packed[:, start:]
    return out


def _pick(own: dict[str, np.ndarray | None], keep: np.ndarray) -> dict[str, np.ndarray | None]:
    return {name: None if value is None else value[keep] for name, value in own.items()}


def _slices(n_owners: int, k: int) -> Iterator[slice]:
    """Ranges of owners whose k x k sums fit in memory together."""
    step = max(1, GRAM_CELLS // (k * k))
    for first in range(0, n_owners, step):
        yield slice(first, min(n_owners, first + step))


def _block_update(steps: dict[int, RunStep]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def update(ratings: pa.Table, state: pa.Table) -> pa.Table:
        out = _Output()
        block = _Block(ratings)
        for run_id, own_rows, _, seen, other_at in _by_step(state, block, steps):
            step, began, before = steps[run_id], time.perf_counter(), len(out.tables)
            ids = own_rows["id"].to_numpy()
            own = _own_arrays(_matrix(own_rows["packed"], 1 + step.k), step)
            z, other_bias = np.ascontiguousarray(seen[:, 1:]), seen[:, 0]
            at = block.own_positions(ids)
            cut = np.zeros(len(ids), dtype=bool)
            cut[at[block.split]] = True
            rating = block.rating
            if step.fold is not None:
                keep = block.fold != step.fold
                at, other_at, rating = at[keep], other_at[keep], rating[keep]
            y = rating - step.mu - other_bias[other_at]
            for some in _slices(len(ids), step.k):
                rows = slice(*np.searchsorted(at, [some.start, some.stop]))
                sums = _sums(z[other_at[rows]], y[rows], at[rows] - some.start, some.stop - some.start)
                whole = ~cut[some]
                parts = np.flatnonzero(~whole)
                if len(parts):
                    out.tables.append(_result(PARTIAL, run_id, ids[some][parts], sums=_flatten(sums, parts)))
                    sums = {name: value[whole] for name, value in sums.items()}
                if whole.any():
                    out.finish(run_id, step, ids[some][whole], sums, _pick(_pick(own, some), whole))
            _timed(out.tables[before:] and out.tables, time.perf_counter() - began)
        tables = out.drain()
        return pa.concat_tables(tables) if tables else RESULT_ARROW.empty_table()

    return update


def _parts_update(steps: dict[int, RunStep]):
    """Same ending for the owners that were cut into parts and summed up again."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output()
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("run_id")
            runs = table["run_id"].to_numpy()
            for run_id in np.unique(runs):
                rows = table.filter(pa.array(runs == run_id))
                step, began = steps[int(run_id)], time.perf_counter()
                sums = _unflatten(_matrix(rows["sums"]), step.k)
                own = _own_arrays(_matrix(rows["packed"]), step)
                out.finish(int(run_id), step, rows["id"].to_numpy(), sums, own)
                _timed(out.tables, time.perf_counter() - began)
            tables, out.tables = out.tables, []
            for part in tables:
                yield from part.combine_chunks().to_batches()
        for part in out.drain():
            yield from part.combine_chunks().to_batches()

    return update


# ---------------------------------------------------------------- on DataFrames


def pack(df: DataFrame, *parts: str) -> DataFrame:
    """``packed`` = bias, vec and the named array columns that ``df`` has.

    A NULL part (a run without graph, a run whose projections rest) adds nothing.
    """
    empty = F.array().cast("array<double>")
    pieces = [F.array("bias"), F.col("vec")]
    pieces += [F.coalesce(F.col(p), empty) for p in parts if p in df.columns]
    return df.withColumn("packed", F.concat(*pieces))


def _state_rows(kind: int, df: DataFrame) -> DataFrame:
    run_id = "run_id" if "run_id" in df.columns else F.lit(-1).alias("run_id")  # rows of all runs
    return df.select(F.col("block").alias("block"), F.lit(kind).alias("kind"), run_id, "id", "packed")


def half_step(layout: Layout, own: DataFrame, other: DataFrame, steps: dict[int, RunStep]) -> DataFrame:
    """Update every owner in ``own`` from its ratings and the ``other`` side.

    ``own`` has (run_id, id, vec, bias) and, for items, may have shift, graph
    (degree followed by the neighbour sum) and x. ``other`` has (run_id, id,
    vec, bias). The result follows RESULT_SCHEMA.
    """
    own, other = pack(own, "shift", "graph", "x").select(*STATE_COLUMNS[1:]), pack(other)
    routed = layout.routed(layout.side_by_side(other))
    placed = layout.own_blocks(own)
    state = _state_rows(OWN, placed).unionByName(_state_rows(OTHER, routed))
    result = (
        layout.ratings.groupBy("block")
        .cogroup(state.groupBy("block"))
        .applyInArrow(_block_update(steps), RESULT_SCHEMA)
    )
    if layout.hot is None:
        return result
    layout.keep(result.persist())
    cut = result.where(F.col("kind") == PARTIAL)
    total = sum_vectors(cut, ["run_id", "id"], "sums")
    finished = total.join(shuffled(own), ["run_id", "id"]).mapInArrow(_parts_update(steps), RESULT_SCHEMA)
    return result.where(F.col("kind") != PARTIAL).unionByName(finished)


def held_out_errors(layout: Layout, users: DataFrame, items: DataFrame, steps: dict[int, RunStep]) -> DataFrame:
    """(run_id, item_id, n, sq_err, seconds) over the ratings of each run's own fold.

    Predictions are used where the ratings lie, so no vector is joined to a
    rating row; only one small sum per block, run and item leaves the task.
    """
    routed = layout.routed(layout.side_by_side(pack(items)))
    state = _state_rows(OWN, layout.own_blocks(pack(users))).unionByName(_state_rows(OTHER, routed))

    def score(ratings: pa.Table, state: pa.Table) -> pa.Table:
        block = _Block(ratings)
        out = {"run_id": [], "item_id": [], "n": [], "sq_err": [], "seconds": []}
        for run_id, own_rows, item_ids, z, other_at in _by_step(state, block, steps):
            step, began = steps[run_id], time.perf_counter()
            at = block.own_positions(own_rows["id"].to_numpy())
            held = block.fold == step.fold
            at, other_at = at[held], other_at[held]
            u = _matrix(own_rows["packed"], 1 + step.k)
            guess = np.einsum("ij,ij->i", u[at, 1:], z[other_at, 1:]) + step.mu + u[at, 0] + z[other_at, 0]
            sq_err = (block.rating[held] - guess) ** 2
            n = np.bincount(other_at, minlength=len(item_ids))
            seen = np.flatnonzero(n)
            out["run_id"].append(np.full(len(seen), run_id, dtype=np.int32))
            out["item_id"].append(item_ids[seen])
            out["n"].append(n[seen])
            out["sq_err"].append(np.bincount(other_at, weights=sq_err, minlength=len(item_ids))[seen])
            out["seconds"].append(np.zeros(len(seen)))
            out["seconds"][-1][:1] = time.perf_counter() - began
        return pa.table({name: np.concatenate(v) if v else np.zeros(0) for name, v in out.items()}).cast(
            pa.schema([("run_id", pa.int32()), ("item_id", pa.int64()), ("n", pa.int64()), ("sq_err", pa.float64()), ("seconds", pa.float64())])
        )

    part = (
        layout.ratings.groupBy("block")
        .cogroup(state.groupBy("block"))
        .applyInArrow(score, "run_id int, item_id long, n long, sq_err double, seconds double")
    )
    return part.groupBy("run_id", "item_id").agg(
        F.sum("n").alias("n"), F.sum("sq_err").alias("sq_err"), F.sum("seconds").alias("seconds"))
