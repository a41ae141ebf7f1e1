"""Global positions without a single-task window.

Three tools, from cheap to dear:

* :func:`order_cutoffs` finds the key of the row at given global positions with two
  narrow scans; a split by position then is a plain projection.
* :func:`take_first` keeps the first ``n`` rows of a total order that way.
* :func:`with_row_index` numbers every row: one range shuffle, one write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import materialize

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
# A sort-limit of this many narrow rows fits one task with ease; beyond it, cutoffs are used.
SORT_LIMIT_ROWS = 10_000


def with_row_index(df: DataFrame, order: list[Column | str], name: str = "row_idx") -> DataFrame:
    """Number rows 0, 1, 2, ... in ``order``, which must be total.

    Rows are range-partitioned on the whole key, so one frequent leading value is
    spread over many partitions. The position inside its partition is written with
    the row: a lost executor can not shift it. Only per-partition counts are summed.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    staged = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
          .withColumn("_mid", F.monotonically_increasing_id()),
        "indexed",
    )
    part = F.shiftright("_mid", _INDEX_BITS)
    counts = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per shuffle partition, hence bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (staged.withColumn("_part", part)
                  .join(F.broadcast(offsets), "_part")
                  .withColumn(name, F.col("_off") + local)
                  .drop("_part", "_off", "_mid"))


def at_or_before(keys: list[str], cutoff: Row | None) -> Column:
    """Row's key tuple <= cutoff tuple, as plain comparisons; no cutoff matches nothing."""
    if cutoff is None:
        return F.lit(False)
    head, *rest = keys
    value = F.lit(cutoff[head])
    if not rest:
        return F.col(head) <= value
    return (F.col(head) < value) | ((F.col(head) == value) & at_or_before(rest, cutoff))


def order_cutoffs(df: DataFrame, keys: list[str], bucket: Column,
                  positions: Callable[[int], list[int]], stored: bool = False) -> list[Row | None]:
    """Key tuples of the rows at 1-based ``positions(total)`` of the ascending order.

    ``keys`` are non-null columns forming a total order and ``bucket`` a coarse,
    non-decreasing function of the first one (day of a date, high bits of a hash).
    The keys are written once, unless ``df`` is ``stored`` and reading it again costs no join. A histogram over the buckets finds the bucket of each
    position, and only these buckets are ordered, all in one job unless one is large.
    The driver receives a row per position.
    """
    narrow = df.select(*keys, bucket.alias("_b"))
    if not stored:
        narrow = materialize(narrow, "keys")
    total = narrow.count()
    wanted = [min(p, total) for p in positions(total)]
    if not total:
        return [None for _ in wanted]
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = narrow.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    inside = F.lit(False)
    for p in wanted:
        inside = inside | ((F.col("_upto") >= p) & (F.col("_upto") - F.col("_n") < p))
    buckets = hist.filter(inside).collect()
    ranks = {}
    for p in wanted:
        if p > 0:
            home = next(b for b in buckets if b["_upto"] - b["_n"] < p <= b["_upto"])
            ranks[p] = (home, p - (home["_upto"] - home["_n"]))
    found: dict = {}
    small = {r[0]["_b"] for r in ranks.values() if r[0]["_n"] <= SORT_LIMIT_ROWS}
    if small:
        here = F.row_number().over(Window.partitionBy("_b").orderBy(*keys))
        at = F.lit(False)
        for home, rank in ranks.values():
            at = at | ((F.col("_b") == F.lit(home["_b"])) & (F.col("_rank") == rank))
        rows = narrow.filter(F.col("_b").isin(*small)).withColumn("_rank", here).filter(at)
        found = {(r["_b"], r["_rank"]): r for r in rows.collect()}
    indexed: dict = {}
    out: list[Row | None] = []
    for p in wanted:
        if p <= 0:
            out.append(None)
            continue
        home, rank = ranks[p]
        if home["_b"] in small:
            row = found[(home["_b"], rank)]
        else:
            if home["_b"] not in indexed:
                indexed[home["_b"]] = with_row_index(narrow.filter(F.col("_b") == F.lit(home["_b"])), keys)
            row = indexed[home["_b"]].filter(F.col("row_idx") == rank - 1).first()
        out.append(Row(**{k: row[k] for k in keys}))
    return out


def take_first(df: DataFrame, keys: list[str], n: int, bucket: Column) -> DataFrame:
    """First ``n`` rows of the ascending total order ``keys``."""
    if n <= 0:
        return df.limit(0)
    if n <= SORT_LIMIT_ROWS:
        return df.orderBy(*keys).limit(n)
    cutoff = order_cutoffs(df, keys, bucket, lambda total: [n])[0]
    return df.limit(0) if cutoff is None else df.filter(at_or_before(keys, cutoff))


def label_by_position(df: DataFrame, keys: list[str], bucket: Column,
                      bounds: Callable[[int], list[int]], labels: list[str],
                      name: str, stored: bool = False) -> DataFrame:
    """Label rows by the interval of their global position.

    ``bounds(total)`` gives the last position of every label but the final one.
    """
    cutoffs = order_cutoffs(df, keys, bucket, bounds, stored)
    chain = F
    for label, cutoff in zip(labels, cutoffs):
        chain = chain.when(at_or_before(keys, cutoff), F.lit(label))
    return df.withColumn(name, chain.otherwise(F.lit(labels[-1])))
