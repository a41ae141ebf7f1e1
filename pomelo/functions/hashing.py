"""Seeded pseudo-random numbers that depend on the row only.

Every "random" operator draws from these, so a recomputed task draws the same
numbers and any SQL engine with md5 can repeat them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

SPAN = 4294967296  # 2 ** 32 values


def hash32(seed: int | str, *keys: Column | str) -> Column:
    """Unsigned 32-bit number from the first eight hex digits of an md5."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash60(seed: int | str, *keys: Column | str) -> Column:
    """Unsigned 60-bit number from the first 15 hex digits, for draws among very many."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Number in [0, 1)."""
    return hash32(seed, *keys) / F.lit(float(SPAN))


def uniform_value(seed: int | str, *keys) -> float:
    """The same number as :func:`uniform`, for constants such as weight matrices."""
    text = "|".join([*(str(k) for k in keys), str(seed)])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / SPAN


def xavier_bound(fan_in: int, fan_out: int) -> float:
    return (6.0 / (fan_in + fan_out)) ** 0.5


def xavier_matrix(rows: int, cols: int, seed: int | str) -> list[list[float]]:
    """Xavier-uniform matrix whose entries are functions of (row, column, seed)."""
    bound = xavier_bound(cols, rows)
    return [[(2.0 * uniform_value(seed, r, c) - 1.0) * bound for c in range(cols)]
            for r in range(rows)]
