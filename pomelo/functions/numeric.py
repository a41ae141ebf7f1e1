"""Scalar formulas of scoring, metrics and reporting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: Column | str) -> Column:
    """Six decimals, half up; the same IEEE steps in every engine."""
    return F.floor(_c(x) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def round_even(x: Column | str, digits: int) -> Column:
    """Half-even rounding on the scaled double, as array libraries round."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(x) * scale) / scale + F.lit(0.0)


def settle(x: Column | str) -> Column:
    """Nine decimals: removes the noise that the order of a distributed sum leaves."""
    return F.floor(_c(x) * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def rating_from_score(x: Column | str) -> Column:
    """Map an unbounded score to the 1..5 rating scale."""
    return sigmoid(x) * F.lit(4.0) + F.lit(1.0)


def log_sigmoid(x: Column | str) -> Column:
    """log(sigmoid(x)) without overflow for large negative x."""
    c = _c(x)
    return F.least(c, F.lit(0.0)) - F.log1p(F.exp(-F.abs(c)))


def dcg_discount(rank: Column | str) -> Column:
    """Discount of a 1-based rank."""
    return F.lit(1.0) / F.log2(_c(rank) + F.lit(1))


def composite(ndcg: Column | str, precision: Column | str, recall: Column | str,
              weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    return (F.lit(weights[0]) * _c(ndcg) + F.lit(weights[1]) * _c(precision)
            + F.lit(weights[2]) * _c(recall))


# Quality grades and their upper NDCG bounds.
GRADE_ZERO = "NUL"
GRADE_BOUNDS = (
    (0.003, "TRES FAIBLE"),
    (0.006, "FAIBLE"),
    (0.008, "LIMITE"),
    (0.015, "ACCEPTABLE"),
)
GRADE_TOP = "BON"


def grade(ndcg: Column | str) -> Column:
    c = _c(ndcg)
    out = F.when(c == 0, F.lit(GRADE_ZERO))
    for bound, label in GRADE_BOUNDS:
        out = out.when(c < bound, F.lit(label))
    return out.otherwise(F.lit(GRADE_TOP))


def speedup(base: Column | str, other: Column | str) -> Column:
    """Two decimals; 0 when the other time is not positive."""
    o = _c(other)
    return F.when(o > 0, round_even(settle(F.try_divide(_c(base), o)), 2)).otherwise(F.lit(0.0))


def efficiency(speed: Column | str, workers: Column | str) -> Column:
    """Percent of linear speed-up, one decimal; 0 for a non-positive worker count."""
    w = _c(workers)
    return (F.when(w > 0, round_even(F.try_divide(_c(speed), w) * F.lit(100.0), 1))
            .otherwise(F.lit(0.0)))


def percent(value: Column | str) -> Column:
    return round_even(_c(value) * F.lit(100.0), 4)


def lift(value: Column | str, baseline: Column | str) -> Column:
    b = _c(baseline)
    return F.when(b > 1e-9, round_even(F.try_divide(_c(value), b), 3))


def normalized(value: Column | str, baseline: Column | str, ideal: Column | str) -> Column:
    """0 at the baseline, 100 at the ideal; null when the two coincide."""
    span = _c(ideal) - _c(baseline)
    return F.when(span > 1e-9,
                  round_even(F.try_divide(_c(value) - _c(baseline), span) * F.lit(100.0), 2))


def size_number(tag: Column | str) -> Column:
    """'10k' -> 10000, '2m' -> 2000000; anything else -> 0."""
    text = F.lower(_c(tag))
    text = F.regexp_replace(F.regexp_replace(text, "k", "000"), "m", "000000")
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def days_since(date: Column | str, as_of: Column, missing: int = 365) -> Column:
    return F.coalesce(F.datediff(as_of, _c(date)), F.lit(missing))


def temporal_weight(rating: Column | str, date: Column | str | None,
                    as_of: Column | None, decay_days: float = 365.0) -> Column:
    """Rating on a 0..1 scale, faded by age; a frame without dates uses rating / 5."""
    if date is None:
        return _c(rating) / F.lit(5.0)
    age = days_since(date, as_of).cast("double")
    return (_c(rating) - F.lit(1.0)) / F.lit(4.0) * F.exp(-age / F.lit(float(decay_days)))
