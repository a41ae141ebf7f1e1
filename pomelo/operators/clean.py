"""Filters and joins that turn raw tables into clean interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import terms, text


def domain_filter(businesses: DataFrame, words: tuple[str, ...] = terms.DOMAIN_WORDS) -> DataFrame:
    """Businesses whose category text names the domain."""
    return businesses.filter(F.col("categories").isNotNull() & text.contains_any("categories", words))


def whole_rating(rating: Column | str) -> Column:
    """Rating cut to its integer part; a missing one counts as 0."""
    c = F.col(rating) if isinstance(rating, str) else rating
    return F.floor(F.coalesce(c, F.lit(0)))


def rating_filter(df: DataFrame, threshold: float = 3, column: str = "rating") -> DataFrame:
    """Rows whose whole rating reaches ``threshold``.

    Against a whole number above 0 the plain column selects the same rows, and only that
    comparison is pushed down to the scan.
    """
    if threshold > 0 and float(threshold).is_integer():
        return df.filter(F.col(column) >= threshold)
    return df.filter(whole_rating(column) >= threshold)


def drop_null_keys(df: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id", "rating")) -> DataFrame:
    return df.na.drop(subset=list(keys))


def category_contains(df: DataFrame, needle: str, column: str = "categories") -> DataFrame:
    """Case-insensitive, literal substring match; null never matches."""
    return df.filter(F.lower(F.col(column)).contains(needle.lower()))


def is_medical(category: Column | str, include: tuple[str, ...] = terms.MEDICAL_FRAGMENTS,
               exclude: tuple[str, ...] = terms.NOT_MEDICAL) -> Column:
    """One category holds any fragment of ``include`` and is not listed in ``exclude``."""
    c = F.col(category) if isinstance(category, str) else category
    return ~F.lower(c).isin(*exclude) & text.contains_any(c, include)


def distinct_categories(df: DataFrame, column: str = "categories") -> DataFrame:
    """Every category named in the comma lists, once, in order."""
    return (df.select(F.explode(text.split_list(column)).alias("category"))
              .filter((F.col("category") != "") & (F.col("category") != "N/A"))
              .distinct().orderBy("category"))


def keys_of(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a long table, combined per map task before they are shuffled."""
    return df.select(key).distinct()


def known_only(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key exists in ``dim`` (one row per key); a semi join, so nothing is duplicated.

    The side is broadcast only below the session's broadcast threshold; beyond it AQE
    splits a frequent key over several tasks.
    """
    return df.join(dim.select(key), key, "left_semi")


def unknown_only(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.join(dim.select(key), key, "left_anti")


def join_and_clean(reviews: DataFrame, businesses: DataFrame, threshold: int = 3) -> DataFrame:
    """Reviews of the given businesses, rated at least ``threshold``, with complete keys."""
    kept = known_only(reviews, businesses, "item_id")
    return drop_null_keys(kept.filter(F.col("rating") >= threshold))


def referenced_by(dim: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Rows of ``dim`` that occur in ``df``."""
    return dim.join(keys_of(df, key), key, "left_semi")


def latest_row(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key: the first in ``newest_first``, which must be total per key.

    The filter sits directly on the window, so Spark keeps one row per key and map
    task before the shuffle; a key with a third of all rows stays harmless.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= 1).drop("_rank")
