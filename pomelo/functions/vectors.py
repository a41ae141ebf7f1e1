"""Vectors held as ``array<double>``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """Vector scaled to length 1; the zero vector stays as it is."""
    # the length as an element of an array is computed once, and not for every component
    over = lambda n: F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(_c(a))
    return F.element_at(F.transform(F.array(l2_norm(a)), over), 1)


def scale(a: Column | str, factor: Column) -> Column:
    return F.transform(_c(a), lambda x: x * factor)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def component_aggs(vec: Column | str, dim: int, how, prefix: str = "_d") -> list[Column]:
    """One aggregate per component.

    Aggregating ``dim`` plain doubles keeps the map-side combine and code
    generation, and moves one row per key instead of ``dim`` exploded rows.
    """
    v = _c(vec)
    return [how(v[i]).alias(f"{prefix}{i}") for i in range(dim)]


def pack(dim: int, prefix: str = "_d") -> Column:
    """The components of :func:`component_aggs` as one array again."""
    return F.array(*[F.col(f"{prefix}{i}") for i in range(dim)])


# vector tables up to this size may be broadcast: rows x components x 8 bytes
BROADCAST_BYTES = 64 * 1024 * 1024


def fits(rows: int | None, dim: int) -> bool:
    """Whether ``rows`` vectors are known to be below the broadcast limit."""
    return rows is not None and rows * (dim + 2) * 8 <= BROADCAST_BYTES


def small_side(vectors: DataFrame, rows: int | None, dim: int) -> DataFrame:
    """Broadcast hint for a vector table whose known size is small; else unchanged.

    ``rows`` comes from the id tables; beyond the limit, or if unknown, the join shuffles.
    """
    return F.broadcast(vectors) if fits(rows, dim) else vectors


def width(df: DataFrame) -> int:
    """Number of tasks that keeps the cluster busy; with dynamic allocation the cores in use
    may be few at first, so the shuffle width counts as well."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with unique keys dealt out over all cores, for work that is heavy per row."""
    return df.repartition(width(df), *keys)


def matvec(matrix: list[list[float]], bias: list[float] | None = None):
    """``column -> matrix . column (+ bias)`` on Arrow batches.

    The matrix is a constant of the model (dim x dim), not data.
    """
    weights = np.asarray(matrix, dtype=np.float64)
    shift = None if bias is None else np.asarray(bias, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def apply(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        out = np.stack(batch.to_numpy()).astype(np.float64) @ weights.T
        if shift is not None:
            out = out + shift
        return pd.Series(list(out))

    return apply
