"""Column expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(is_finite(value), value)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sum_of(a: Column, term=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda total, x: total + term(x))


def sum_squares(a: Column) -> Column:
    return sum_of(a, lambda x: x * x)


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for comparison across engines; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
