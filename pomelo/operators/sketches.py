"""Statistics of growing tables from sketches that are kept per batch and merged.

A batch is read once and leaves one row: its number of rows, a HyperLogLog sketch of each key column and
a quantile sketch of each number column. Rows of many batches merge to that of their union, so a report over
all history reads one small row per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Binary logarithm of a key sketch's registers (relative error about 1.04 / sqrt(2 ** LG_K)), and size of a
# quantile sketch (rank error below RANK_ERROR with probability 0.99).
LG_K, KLL_K, RANK_ERROR = 12, 200, 0.0165


def batch_sketch(df: DataFrame, keys: list[str], numbers: list[str] = (), lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """One row: ``n_rows``, ``keys_<column>`` and ``values_<column>``. Nulls are left out of a column's sketch."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.hll_sketch_agg(c, lg_k).alias(f"keys_{c}") for c in keys],
                  *[F.kll_sketch_agg_double(F.col(c).cast("double"), kll_k).alias(f"values_{c}") for c in numbers])


def merged(sketches: DataFrame) -> DataFrame:
    """The row of the union of all batches, repeated rows counting each time."""
    how = {"keys_": F.hll_union_agg, "values_": F.kll_merge_agg_double}
    columns = [next(f for p, f in how.items() if c.startswith(p))(c).alias(c) for c in sketches.columns if c != "n_rows"]
    return sketches.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *columns)


def estimates(sketch: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``measure, column, at, estimate`` of a sketch row: rows, distinct keys, quantiles."""
    parts = [F.struct(F.lit("rows").alias("measure"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("at"),
                      F.col("n_rows").cast("double").alias("estimate"))]
    for c in sketch.columns:
        if c.startswith("keys_"):
            parts.append(F.struct(F.lit("distinct").alias("measure"), F.lit(c[5:]).alias("column"), F.lit(None).cast("double").alias("at"),
                                  F.hll_sketch_estimate(c).cast("double").alias("estimate")))
        elif c.startswith("values_"):
            # a sketch of no values has no quantiles
            parts += [F.struct(F.lit("quantile").alias("measure"), F.lit(c[7:]).alias("column"), F.lit(q).alias("at"),
                               F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(F.col(c), F.lit(q))).alias("estimate")) for q in quantiles]
    return sketch.select(F.explode(F.array(*parts)).alias("e")).select("e.*")


def rank_range(df: DataFrame, column: str, value: float) -> DataFrame:
    """Exact shares of a column's values below ``value`` and up to it: what an estimated quantile is held against."""
    return df.filter(F.col(column).isNotNull()).agg(F.avg((F.col(column) < value).cast("double")).alias("below"), F.avg((F.col(column) <= value).cast("double")).alias("upto"))
