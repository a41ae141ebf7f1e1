"""Counts and distributions of an interaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import round_even
from .clean import keys_of


def split_counts(df: DataFrame, column: str = "split") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Users, items and rows of an interaction table."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(distinct("user_id").alias("n_users"), distinct("item_id").alias("n_items"),
                  F.count(F.lit(1)).alias("n_edges"))


def user_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("review_count"),
                                     round_even(F.avg("rating"), 2).alias("average_stars"))


def business_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.count(F.lit(1)).alias("review_count"),
                                     round_even(F.avg("rating"), 1).alias("stars"))


def rating_distribution(df: DataFrame) -> DataFrame:
    """Rows and percent per rating."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", round_even(F.col("n") * F.lit(100.0) / total, 2))


def per_key_spread(df: DataFrame, key: str) -> DataFrame:
    """Min, median and max of rows per key.

    The median is taken over the histogram of counts, whose size grows with the square
    root of the row count at most.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("freq"))
    return hist.agg(F.min("n").alias("min_n"),
                    F.percentile("n", 0.5, F.col("freq")).alias("median_n"),
                    F.max("n").alias("max_n"))


def quality_report(df: DataFrame, known_users: DataFrame, known_items: DataFrame) -> DataFrame:
    """One row: sparsity, rows per user and item, rating moments, share of ratings from 4,
    rows of users and items that are not known yet."""
    def per(key: str, tag: str) -> DataFrame:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.count(F.lit(1)).alias(f"n_{tag}s"), F.avg("n").alias(f"mean_per_{tag}"),
                          F.min("n").alias(f"min_per_{tag}"))

    def new_rows(known: DataFrame, key: str):
        return df.join(keys_of(known, key), key, "left_anti").select(F.count(F.lit(1))).scalar()

    users, items = per("user_id", "user"), per("item_id", "item")
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("rating").alias("rating_mean"),
                  F.stddev_samp("rating").alias("rating_std"),
                  (F.avg((F.col("rating") >= 4).cast("double")) * 100.0).alias("pct_from_4"))
    one = lambda frame, column: frame.select(column).scalar()
    n_users, n_items = one(users, "n_users"), one(items, "n_items")
    return base.select(
        "n_rows", n_users.alias("n_users"), n_items.alias("n_items"),
        (F.lit(1.0) - F.col("n_rows") / (n_users * n_items)).alias("sparsity"),
        one(users, "mean_per_user").alias("mean_per_user"), one(users, "min_per_user").alias("min_per_user"),
        one(items, "mean_per_item").alias("mean_per_item"), one(items, "min_per_item").alias("min_per_item"),
        "rating_mean", "rating_std", "pct_from_4",
        new_rows(known_users, "user_id").alias("new_user_rows"),
        new_rows(known_items, "item_id").alias("new_item_rows"))


def graph_summary(df: DataFrame) -> DataFrame:
    """Density, interactions per user and the period covered."""
    base = df.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"),
                  F.count(F.lit(1)).alias("n_edges"), F.min("date").alias("first_day"),
                  F.max("date").alias("last_day"))
    return base.select("*", (F.col("n_edges") / (F.col("n_users") * F.col("n_items"))).alias("density"),
                       (F.col("n_edges") / F.col("n_users")).alias("per_user"))


def most_active(df: DataFrame, key: str = "user_id", k: int = 10) -> DataFrame:
    """The ``k`` keys with most rows and their mean rating."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                round_even(F.avg("rating"), 1).alias("mean_stars"))
            .orderBy(F.col("n").desc(), key).limit(k))


def overlap_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys both sides share."""
    return (keys_of(left, key).join(keys_of(right, key), key, "left_semi")
            .agg(F.count(F.lit(1)).alias("n_common")))


def upload_profile(upload: DataFrame, known_users: DataFrame, known_items: DataFrame) -> DataFrame:
    """Rows, distinct users and items of a batch, and how many of them are new."""
    users, items = keys_of(upload, "user_id"), keys_of(upload, "item_id")
    n = lambda frame: frame.select(F.count(F.lit(1))).scalar()
    return upload.agg(F.count(F.lit(1)).alias("reviews")).select(
        "reviews", n(users).alias("users"),
        n(users.join(keys_of(known_users, "user_id"), "user_id", "left_anti")).alias("new_users"),
        n(items).alias("items"),
        n(items.join(keys_of(known_items, "item_id"), "item_id", "left_anti")).alias("new_items"))


def content_key(df: DataFrame, order: str, key: str, model: str, group: int = 4096) -> DataFrame:
    """Cache key of an ordered id list and a model name: one md5 row.

    Ids are digested in groups of ``group`` consecutive positions, the digests again in
    groups, and so on, so no task sees more than one group. ``order`` numbers the rows
    0, 1, 2, ... without gaps.
    """
    level = df.select(F.col(order).cast("long").alias("_i"), F.col(key).cast("string").alias("_t"))
    size = df.count()
    while True:
        level = (level.groupBy(F.floor(F.col("_i") / F.lit(group)).alias("_g"))
                 .agg(F.sort_array(F.collect_list(F.struct("_i", "_t"))).alias("_l"))
                 .select(F.col("_g").alias("_i"),
                         F.md5(F.concat_ws("", F.col("_l._t"))).alias("_t")))
        size = -(-size // group)
        if size <= 1:
            break
    return level.select(F.md5(F.concat(F.col("_t"), F.lit(model))).alias("cache_key"))
