"""Seeded pseudo-random numbers that do not depend on partitioning.

A value is a pure function of (seed, tag, key...), read off an MD5 digest, so
a lost task recomputes the same number and any SQL engine can reproduce it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

INIT_SCALE = 0.1  # fixed value: spread of the initial factors


def _text(seed: int | Column) -> Column:
    return seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))


def _digest(seed: int | Column, tag: str, keys) -> Column:
    return F.md5(F.concat_ws(":", _text(seed), F.lit(tag), *[k.cast("string") for k in keys]))


def uniform(seed: int | Column, tag: str, *keys: Column) -> Column:
    """Uniform number in (0, 1) for the given key."""
    head = F.conv(F.substring(_digest(seed, tag, keys), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / 4294967296.0


def normal(seed: int | Column, tag: str, *keys: Column) -> Column:
    """Standard normal number for the given key (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, tag + ".r", *keys)))
    return radius * F.cos(2.0 * F.pi() * uniform(seed, tag + ".a", *keys))


def order_key(seed: int, *keys: Column) -> Column:
    """Digest that orders rows in a seeded random order."""
    return F.md5(F.concat_ws(":", _text(seed), *[k.cast("string") for k in keys]))


def initial_factor(seed: int | Column, tag: str, key: Column, rank: Column | int) -> Column:
    """Array of ``rank`` small normal numbers for one user, item or feature column."""
    last = (F.lit(rank) if isinstance(rank, int) else rank) - 1
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda dim: F.lit(INIT_SCALE) * normal(seed, tag, key, dim),
    )


def initial_projection(seed: int, feature: str, width: int, rank: int) -> np.ndarray:
    """The same numbers as ``initial_factor`` for the columns of one feature."""

    def uniform_of(tag: str, col: int, dim: int) -> float:
        text = f"{seed}:{tag}:{col}:{dim}"
        return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    out = np.empty((width, rank))
    for col in range(width):
        for dim in range(rank):
            radius = math.sqrt(-2.0 * math.log(uniform_of(f"W.{feature}.r", col, dim)))
            out[col, dim] = radius * math.cos(2.0 * math.pi * uniform_of(f"W.{feature}.a", col, dim))
    return INIT_SCALE * out
