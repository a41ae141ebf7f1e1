"""Train / validation / test splits with exact sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash32
from .ordering import label_by_position, take_first

RATIOS = (0.70, 0.15, 0.15)
# dates missing from a review sort after all others
LAST_DAY = "9999-12-31"


def hash_bucket(column: str = "_hash") -> Column:
    """High 16 bits of a 32-bit hash: 65,536 even buckets."""
    return F.shiftright(F.col(column), 16)


def temporal_split(edges: DataFrame, ties: list[str], ratios=RATIOS, date: str = "date",
                   name: str = "split", stored: bool = False) -> DataFrame:
    """Oldest rows train, newest test; ``ties`` make the order total. ``stored`` edges are read, not written again."""
    df = edges.withColumn("_day", F.coalesce(F.to_date(date), F.lit(LAST_DAY).cast("date")))
    bounds = lambda n: [int(n * ratios[0]), int(n * (ratios[0] + ratios[1]))]
    return label_by_position(df, ["_day", *ties], F.col("_day"), bounds,
                             ["train", "val", "test"], name, stored).drop("_day")


def random_split(edges: DataFrame, keys: list[str], seed: int = 1, val: float = 0.15,
                 test: float = 0.15, name: str = "split") -> DataFrame:
    """Seeded random split; ``keys`` identify a row.

    Held-out sizes are rounded up, first for both parts together, then for the test part.
    """
    def bounds(n: int) -> list[int]:
        held = math.ceil(n * (val + test))
        n_test = math.ceil(held * (test / (val + test)))
        return [n - held, n - n_test]

    df = edges.withColumn("_hash", hash32(seed, *keys))
    return label_by_position(df, ["_hash", *keys], hash_bucket(), bounds,
                             ["train", "val", "test"], name).drop("_hash")


def supervision_split(edges: DataFrame, keys: list[str], seed: int = 7, share: float = 0.80,
                      name: str = "role", stored: bool = False) -> DataFrame:
    """Message-passing edges and disjoint supervision edges. ``stored`` edges are read, not written again."""
    df = edges.withColumn("_hash", hash32(seed, *keys))
    return label_by_position(df, ["_hash", *keys], hash_bucket(),
                             lambda n: [int(share * n)], ["message", "supervision"],
                             name, stored).drop("_hash")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows without replacement, all rows when there are fewer."""
    hashed = df.withColumn("_hash", hash32(seed, *keys))
    return take_first(hashed, ["_hash", *keys], n, hash_bucket()).drop("_hash")


def validation_size(n: int, share: float = 0.20, low: int = 0, high: int | None = None) -> int:
    """``share`` of ``n`` rows, kept between the limits that are given."""
    size = max(low, int(n * share))
    return size if high is None else min(high, size)


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Seeded random order: a range-partitioned sort on the hash."""
    return (df.withColumn("_hash", hash32(seed, *keys))
              .orderBy("_hash", *keys).drop("_hash"))


def part_of(split: DataFrame, part: str, users: DataFrame) -> DataFrame:
    """One part of a split edge table as (user_id, item_id in node space, rating)."""
    from .encode import item_node
    return (split.filter(F.col("split") == part)
                 .select(F.col("user_idx").alias("user_id"),
                         item_node("item_idx", users).alias("item_id"), "rating"))
