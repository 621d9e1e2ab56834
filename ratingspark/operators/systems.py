"""Many small symmetric systems at once, each with a report of how it went."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEFINITE, SINGULAR, INDEFINITE, NOT_FINITE = 1, 2, 3, 4
STATUS = {DEFINITE: "definite", SINGULAR: "singular", INDEFINITE: "indefinite", NOT_FINITE: "not finite"}
#: A pivot or eigenvalue below this share (times the width) of the largest counts as zero.
TINY = 8 * np.finfo(float).eps


def solve_systems(lhs: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions and statuses of ``lhs`` (n, k, k), ``rhs`` (n, k).

    One Cholesky factorization of the whole batch tells whether all systems are definite. Only if not
    are eigenvalues taken: an indefinite system is solved as it is, a singular one by its
    solution of least norm, and one with numbers that are not finite gives NaN. No system stops the others.
    """
    n, k = rhs.shape
    status = np.full(n, DEFINITE, dtype=np.int32)
    x = np.full((n, k), np.nan)
    finite = np.isfinite(lhs).all(axis=(1, 2)) & np.isfinite(rhs).all(axis=1)
    status[~finite] = NOT_FINITE
    some = np.flatnonzero(finite)
    if not len(some):
        return x, status
    try:
        pivots = np.einsum("iaa->ia", np.linalg.cholesky(lhs[some])) ** 2
        doubtful = pivots.min(axis=1) <= k * TINY * pivots.max(axis=1)
    except np.linalg.LinAlgError:
        doubtful = np.ones(len(some), bool)
    check = some[doubtful]
    if len(check):
        values, vectors = np.linalg.eigh(lhs[check])
        zero = np.abs(values) <= k * TINY * np.abs(values).max(axis=1, keepdims=True)
        singular = zero.any(axis=1)
        status[check[(values.min(axis=1) < 0) & ~singular]] = INDEFINITE
        status[check[singular]] = SINGULAR
        turned = np.einsum("iab,ia->ib", vectors[singular], rhs[check[singular]])
        turned = np.where(zero[singular], 0.0, turned / np.where(zero[singular], 1.0, values[singular]))
        x[check[singular]] = np.einsum("iab,ib->ia", vectors[singular], turned)
    regular = np.flatnonzero(finite & (status != SINGULAR))
    x[regular] = np.linalg.solve(lhs[regular], rhs[regular][:, :, None])[:, :, 0]
    return x, status


def solve_report(systems: DataFrame, width: int, *keys: str) -> DataFrame:
    """``systems`` (keys, lhs array of width * width, rhs array of width): keys, status and solution ``x``."""
    rows = systems.select(*keys, F.col("lhs").cast("array<double>"), F.col("rhs").cast("array<double>"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("lhs", "rhs")]
            x, status = solve_systems(lists[0].reshape(-1, width, width), lists[1])
            offsets = pa.array((np.arange(len(x) + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keys], pa.array([STATUS[int(s)] for s in status], pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[*keys, "status", "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.mapInArrow(solve, f"{schema}, status string, x array<double>")
