"""Dense integer ids for users and items, and their extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import clean
from .ordering import with_row_index
from ..functions import vectors as V
from ..session import materialize


def dense_ids(df: DataFrame, key: str, idx: str) -> DataFrame:
    """Ids 0, 1, ... in ascending key order: the canonical encoding."""
    return with_row_index(df.select(key).distinct(), [key], idx)


def frequency_ids(df: DataFrame, key: str, idx: str) -> DataFrame:
    """Ids by falling row count, ties in ascending key order."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return with_row_index(counts, [F.col("n_rows").desc(), F.col(key).asc()], idx)


def count_rows(dim: DataFrame) -> Column:
    """Row count as a scalar subquery, for use inside other expressions."""
    return dim.select(F.count(F.lit(1))).scalar()


def extend_ids(dim: DataFrame, values: DataFrame, key: str, idx: str) -> DataFrame:
    """Known ids stay; unseen keys follow after the largest id, in ascending order."""
    unseen = clean.unknown_only(values.select(key).distinct(), dim, key)
    start = dim.select(F.coalesce(F.max(idx) + 1, F.lit(0))).scalar()
    added = dense_ids(unseen, key, idx)
    return dim.select(key, idx).unionByName(added.select(key, (F.col(idx) + start).alias(idx)))


def transform_ids(df: DataFrame, dim: DataFrame, key: str, idx: str,
                  unknown: str = "skip", proxy: int = 0) -> DataFrame:
    """Replace ``key`` by ``idx``; unknown keys are skipped, refused or mapped to ``proxy``."""
    lookup = dim.select(key, idx)
    if unknown == "skip":
        return df.join(lookup, key).drop(key)
    joined = df.join(lookup, key, "left")
    if unknown == "error":
        failed = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))
        return joined.withColumn(idx, F.coalesce(F.col(idx), failed.cast("long"))).drop(key)
    if unknown == "proxy":
        return joined.withColumn(idx, F.coalesce(F.col(idx), F.lit(proxy).cast("long"))).drop(key)
    raise ValueError(f"unknown={unknown!r}: use skip, error or proxy")


def lenient_encode(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Unknown users become user 0; rows of unknown items are dropped."""
    by_item = transform_ids(df, items, "item_id", "item_idx", "skip")
    return transform_ids(by_item, users, "user_id", "user_idx", "proxy")


def item_node(item_idx: Column | str, users: DataFrame) -> Column:
    """Item id in the shared node space, where items follow the users."""
    c = F.col(item_idx) if isinstance(item_idx, str) else item_idx
    return c + count_rows(users)


def preprocess(reviews: DataFrame, users: DataFrame, items: DataFrame,
               threshold: int | None = None,
               label: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known users and items only -> last review per pair -> dense ids.

    Returns ``(edges, user ids, item ids)``; edges carry local item ids. The pairs are
    written once, since the id tables and every later step read them. Items are looked up
    among the distinct ones of the pairs, and the pairs are filtered only if some are unknown.
    ``label`` may add columns to the written pairs (user_id, item_id, ...), whose keys are in the order of their
    ids; the edges keep them.
    """
    kept = clean.known_only(reviews, users, "user_id")
    if threshold is not None:
        kept = clean.drop_null_keys(clean.rating_filter(kept, threshold))
    newest = [F.col("date").desc_nulls_last(), F.col("review_id").desc()]
    pairs = materialize(
        clean.latest_row(kept, ["user_id", "item_id"], newest)
             .select("user_id", "item_id", "rating", "date", "review_id"),
        "pairs", codec="zstd",
    )
    met = materialize(clean.keys_of(pairs, "item_id"), "items")
    if not clean.unknown_only(met, items, "item_id").isEmpty():
        pairs = materialize(clean.known_only(pairs, items, "item_id"), "pairs", codec="zstd")
    user_ids = dense_ids(pairs, "user_id", "user_idx")
    item_ids = dense_ids(clean.known_only(met, items, "item_id"), "item_id", "item_idx")
    labelled = pairs if label is None else label(pairs)
    more = [c for c in labelled.columns if c not in pairs.columns]
    # (key, id) tables of a known size stay below the broadcast limit or are shuffled
    lookup = lambda ids: V.small_side(ids, ids.count(), 2)
    edges = (transform_ids(transform_ids(labelled, lookup(user_ids), "user_id", "user_idx"),
                           lookup(item_ids), "item_id", "item_idx")
             .select("user_idx", "item_idx", "rating", "date", "review_id", *more))
    return edges, user_ids, item_ids
