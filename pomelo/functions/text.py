"""String, date and array expressions for catalogues and articles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def truncate(x: Column | str, length: int) -> Column:
    return F.substring(_c(x), 1, length)


def split_list(x: Column | str) -> Column:
    """Comma list -> array of trimmed entries."""
    return F.transform(F.split(_c(x), ","), lambda e: F.trim(e))


def first_entry(x: Column | str) -> Column:
    return F.trim(F.try_element_at(F.split(_c(x), ","), F.lit(1)))


def display_label(name: Column | str, categories: Column | str) -> Column:
    """'name  —  first category', or the bare name when there is no category."""
    first = first_entry(categories)
    return (F.when(first.isNotNull() & (first != "") & (first != "N/A"),
                   F.concat(_c(name), F.lit("  —  "), first))
            .otherwise(_c(name)))


def padded_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Date text with zero-padded month and day; missing parts default to 01."""
    month_text = F.coalesce(_c(month), F.lit("01"))
    day_text = F.coalesce(_c(day), F.lit("01"))
    pad = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    return F.concat(F.coalesce(_c(year), F.lit("")), F.lit("-"), pad(month_text),
                    F.lit("-"), pad(day_text))


def parse_day(x: Column | str) -> Column:
    """yyyy-MM-dd -> timestamp; empty or malformed text -> null."""
    return F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd"))


def parse_published(x: Column | str) -> Column:
    """Day or day-and-time text -> timestamp; anything else -> null."""
    return F.coalesce(parse_day(x), F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def has_text(x: Column | str) -> Column:
    return F.coalesce(_c(x) != "", F.lit(False))


def array_count(x: Column | str) -> Column:
    """Length of an array; a missing array counts as empty."""
    return F.coalesce(F.size(_c(x)), F.lit(0))


def contains_any(x: Column | str, words: tuple[str, ...]) -> Column:
    """Any of the words occurs in the lower-cased text."""
    lowered = F.lower(_c(x))
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word)
    return hit
