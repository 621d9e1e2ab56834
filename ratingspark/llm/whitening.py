"""Embedding whitening: a covariance from squares alone, assembled for an eigendecomposition.

1. A component c becomes the integer x = floor(256 c). The fit list is each distinct x
   vector once; it is written once in the shared folder and discarded after the fit.
2. One pass sums the list: its length n and the sum S of every dimension.
3. A second pass centres exactly, y = n x - S, and adds up squares only: y_i^2 for every
   dimension and (y_i + y_j)^2 for every pair. As (y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j,
   differences of these sums give every cross-covariance. All arithmetic is on integers:
   squares are taken in limbs of 20 bits, so nothing is rounded at any n.
4. The d x d matrix of these sums is all that reaches the driver, for ``eigh``. A third pass
   over the list measures how far the whitened covariance is from the identity.
5. Rows are projected in one pass over the table, with the eigenvectors as constants.

Tasks emit one row for each pair of dimensions, whatever number of vectors they read;
Spark adds them up with a partial sum before its shuffle.

Awkward rows: vectors that are null or hold null or non-finite entries are left out, and so are
vectors of another length than the most frequent one (the longer of ties; lengths are
counted over the fit list). Repeated rows are each projected. Components beyond the 64-bit
range saturate. Components without variance (their eigenvalue is not above 1e-11 of the largest) are
not returned, so a table of equal vectors or of one gives no rows, as does an empty one.
A null ``vec_id`` stays null. ``deviation`` is exact as a decimal; where it passes 38 digits
it is null (in the query where it passes 64 bits). Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import discard, store

SCALE = 256
#: Limbs of squares: sums over 2^20 rows of products of two limbs fit 64 bits.
LIMB = 20
_MASK = (1 << LIMB) - 1
_LOW = 1 << 60
#: Cells of one side that a task works on at once.
CELLS = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``components`` hold a unit eigenvector in each row, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def grid(vector: Column) -> Column:
    """The integer vector, or null if it is null or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(whole, F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(0).cast("long")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        lists = batch.column("x")
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            part = lists.filter(pa.array(sizes == size)) if (sizes != size).any() else lists
            if size:
                step = max(1, CELLS // int(size))
                for begin in range(0, len(part), step):
                    yield int(size), _matrix(part.slice(begin, step))


def _split(totals: dict, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """Sums of any size as ``high`` * 2^60 + ``low``."""
    keys = [pa.array(column, kind) for column, kind in zip(zip(*totals), kinds)]
    high = pa.array([int(v) // _LOW for v in totals.values()], pa.decimal128(38, 0))
    low = pa.array([int(v) % _LOW for v in totals.values()], pa.int64())
    return pa.RecordBatch.from_arrays([*keys, high, low], names=[*names, "high", "low"])


def _column_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, position) -> sum; position -1 has the number of vectors."""
    totals: dict[tuple[int, int], int] = {}
    for size, x in _by_length(batches):
        found = [len(x), *((x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object))]
        for position, value in enumerate(found, -1):
            totals[size, position] = totals.get((size, position), 0) + int(value)
    if totals:
        yield _split(totals, ["length", "position"], [pa.int32(), pa.int32()])


def _centred(x: np.ndarray, n: int, sums: list[int], bound: int) -> np.ndarray:
    """n x - S, as 64-bit integers where every sum of two fits, else as Python's."""
    if bound < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(s: np.ndarray) -> np.ndarray:
    """Exact sums of squares of the columns of integers, as Python integers."""
    if s.dtype == object:
        return (s * s).sum(axis=0)
    total = np.zeros(s.shape[1], object)
    for begin in range(0, len(s), _MASK):
        part = s[begin:begin + _MASK]
        limbs = [part & _MASK, (part >> LIMB) & _MASK, part >> 2 * LIMB]
        if not ((limbs[2] != 0) & (limbs[2] != -1)).any() and (np.abs(part) < 1 << 2 * LIMB - 1).all():
            limbs = [part & _MASK, part >> LIMB]
        for a, left in enumerate(limbs):
            for b in range(a, len(limbs)):
                found = np.einsum("ij,ij->j", left, limbs[b]).astype(object)
                total += found * ((1 << LIMB * (a + b)) * (1 if a == b else 2))
    return total


def _pair_squares(n: int, sums: list[int], bound: int):
    """(i, j) -> sum of (y_i + y_j)^2 for i < j, of y_i^2 for i = j."""
    d = len(sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(d - i, object) for i in range(d)]
        seen = False
        for size, x in _by_length(batches):
            if size == d:
                seen = True
                y = _centred(x, n, sums, bound)
                for i in range(d):
                    pairs = np.concatenate([y[:, i:i + 1], y[:, i:i + 1] + y[:, i + 1:]], axis=1)
                    totals[i] += square_sums(pairs)
        if seen:
            for i in range(d):
                yield _split({(i, i + k): v for k, v in enumerate(totals[i])}, ["i", "j"], [pa.int32(), pa.int32()])

    return run


def _whole(df: DataFrame, *keys: str) -> dict[tuple, int]:
    """The exact sums by key."""
    rows = df.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return {tuple(r[k] for k in keys): int(r.high) * _LOW + int(r.low) for r in rows.collect()}


def _project(x: np.ndarray, model: Whitening, bound: int, count: int) -> np.ndarray:
    centred = (_centred(x, model.n, model.sums, bound) / model.n).astype(float)
    return centred @ model.components[:count].T / np.sqrt(model.eigenvalues[:count])


def _identity_sums(model: Whitening, bound: int, count: int):
    """(i, j) -> sum of products of whitened components."""
    d = len(model.sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count))
        for size, x in _by_length(batches):
            if size == d:
                w = _project(x, model, bound, count)
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                                         names=["i", "j", "total"])

    return run


def _bound(x: int, n: int, sums: list[int]) -> int:
    return n * x + max(map(abs, sums), default=0)


def covariance(squares: dict[tuple[int, int], int], n: int, d: int) -> np.ndarray:
    """The covariance matrix from sums of squares, by polarisation; each entry is rounded once."""
    v = np.zeros((d, d))
    for (i, j), total in squares.items():
        product = 2 * total if i == j else total - squares[i, i] - squares[j, j]
        v[i, j] = v[j, i] = product / (2 * n ** 3)
    return v


def fit(table: DataFrame, vector: str = "embedding", count: int = 4) -> Whitening | None:
    """The whitening of the distinct integer vectors of ``table``; None if nothing varies."""
    x = grid(F.col(vector))
    points = store(table.select(x.alias("x")).filter(F.col("x").isNotNull()).distinct())
    try:
        sums = _whole(points.mapInArrow(_column_sums, "length int, position int, high decimal(38,0), low long"), "length", "position")
        if not sums:
            return None
        n, d = max((v, length) for (length, position), v in sums.items() if position == -1)
        s = [sums[d, i] for i in range(d)]
        largest = points.filter(F.size("x") == d).agg(F.max(F.array_max(F.transform("x", lambda e: F.abs(e.cast("decimal(20,0)"))))).alias("m")).first().m
        bound = _bound(int(largest), n, s)
        squares = _whole(points.mapInArrow(_pair_squares(n, s, bound), "i int, j int, high decimal(38,0), low long"), "i", "j")
        v = covariance(squares, n, d)
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1].T
        kept = int((values > max(values[0], 0) * 1e-11).sum()) if values[0] > 0 else 0
        if not kept:
            return None
        signs = np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1))
        model = Whitening(n, s, values[:kept], (vectors * signs)[:kept], float(np.trace(v)), 0.0)
        count = min(count, kept)
        found = points.mapInArrow(_identity_sums(model, bound, count), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
        error = max(abs(r.total / n - (r.i == r.j)) for r in found.collect())
        return Whitening(n, s, model.eigenvalues, model.components, model.trace, float(error))
    finally:
        discard(points)


def _rows(model: Whitening, count: int):
    d = len(model.sums)
    explained = model.eigenvalues[:count] / model.trace

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // d)
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                x = _matrix(part.column("x"))
                bound = _bound(max(abs(int(x.min())), abs(int(x.max()))), model.n, model.sums)
                squares = square_sums(_centred(x, model.n, model.sums, bound).T)
                m = len(x)
                exact = pa.array([int(q) if q < 10 ** 38 else None for q in squares], pa.decimal128(38, 0))
                at = np.repeat(np.arange(m), count)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    exact.take(pa.array(at)), pa.array(_project(x, model, bound, count).ravel()), pa.array(np.tile(explained, m)),
                ], names=["vec_id", "component", "deviation", "whitened", "explained"])

    return run


def whiten(table: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding", count: int = 4) -> DataFrame:
    """Each vector's first ``count`` whitened components, with its exact squared deviation times n squared."""
    schema = "vec_id long, component int, deviation decimal(38,0), whitened double, explained double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    count = min(count, len(model.eigenvalues))
    x = table.select(F.col(vec_id).cast("long").alias("vec_id"), grid(F.col(vector)).alias("x"))
    return x.filter(F.size("x") == len(model.sums)).mapInArrow(_rows(model, count), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(table)
    return whiten(table, model).select(
        "vec_id", "component", F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained",
        F.lit(model.identity_error if model else 0.0).alias("identity_error"))
