"""Document fingerprints: bottom-k sketches of shingle hashes, on DataFrame functions alone.

A sketch is the ``k`` smallest distinct hashes of a text's shingles, ascending. Sketches of parts
merge to the sketch of the union, and two of them estimate resemblance, containment and the
number of distinct shingles. Below ``k`` shingles the sketch is the whole set and the estimates
are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let

K = 128
SHINGLE_WORDS = 5
# Documents whose followers are found in one task; bounds the number of ranges, too.
RANGE_ROWS, MAX_RANGES = 2_048, 65_536
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_SPAN = 18446744073709551616.0  # hashes are 64 bits, compared as signed


def sketch(text: Column, k: int = K, width: int = SHINGLE_WORDS) -> Column:
    """Bottom-k sketch (array of long) of the shingles of ``width`` words.

    A text of fewer words is one shingle as a whole; null, empty and blank texts have no shingles
    and an empty sketch. Words are taken as they are written.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(ids: Column) -> Column:
        n = F.size(ids)
        return (F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))),
                                               lambda i: F.xxhash64(F.slice(ids, i, width))))
                .when(n > 0, F.array(F.xxhash64(ids)))
                .otherwise(F.array().cast("array<bigint>")))

    return F.slice(F.array_sort(F.array_distinct(let(hashes, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sets behind two sketches; 1 if both are empty."""
    def share(union: Column) -> Column:
        common = F.array_intersect(F.array_intersect(union, a), b)
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(common) / F.size(union))
    return let(merge(a, b, k), share).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    largest = F.element_at(a, k).cast("double") + F.lit(_SPAN / 2)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(_SPAN) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second has; 1 if the first is empty."""
    joint = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / distinct_shingles(a, k)))


def written(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(docs: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of the row next to it in descending order of ``key``; after the
    last row comes the first.

    Rows without a key come last; rows of equal key are ordered by ``columns``. The keys are cut
    into ranges at quantiles, found by a binary search in an array function, and every range gets
    a copy of the row that follows it, so that one shuffle by range serves the window.
    """
    spread = docs.agg(F.count(key).alias("n"), F.count(F.lit(1)).alias("rows"), F.max(key).alias("top")).first()
    ranges = max(1, min(MAX_RANGES, spread["rows"] // RANGE_ROWS))
    starts: list = []
    if ranges > 1 and spread["n"]:
        shares = [i / ranges for i in range(1, ranges)]
        found = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * ranges)).alias("q")).first()["q"]
        starts = sorted({x for x in found if x != spread["top"]}, reverse=True)
    last = len(starts)
    # number of range starts at or above the key: its range, counted from the top
    bounds = F.array(*[F.lit(x) for x in starts]).cast("array<bigint>")
    step, steps = 1, []
    while step <= last:
        steps.append(step)
        step *= 2

    def search(key_: Column) -> Column:
        if not steps:
            return F.lit(0)
        return F.aggregate(
            F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0),
            lambda at, s: F.when((at + s <= last) & (F.get(bounds, at + s - 1) >= key_), at + s).otherwise(at))

    where = F.when(F.col(key).isNull(), F.lit(last)).otherwise(search(F.col(key)))
    starts_range = F.coalesce((F.col("_range") > 0) & (F.get(bounds, F.col("_range") - 1) == F.col(key)), F.lit(False))
    first = F.col(key).eqNullSafe(F.lit(spread["top"]))
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("lap"), F.lit(True).alias("own"))
    before = F.struct((F.col("_range") - 1).alias("range"), F.lit(0).alias("lap"), F.lit(False).alias("own"))
    around = F.struct(F.lit(last).alias("range"), F.lit(1).alias("lap"), F.lit(False).alias("own"))
    places = F.when(first, F.array(own, around)).when(starts_range, F.array(own, before)).otherwise(F.array(own))
    placed = (docs.withColumn("_range", where).withColumn("_place", F.explode(places))
              .select(*docs.columns, "_place.range", "_place.lap", "_place.own"))
    order = Window.partitionBy("range").orderBy("lap", F.col(key).desc_nulls_last(), *[F.col(c) for c in columns])
    return (placed.select(*docs.columns, "own", *[F.lead(c).over(order).alias(prefix + c) for c in columns])
            .filter("own").drop("own"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points replaced by the
    first as many of the next document's text (all of it if it is shorter). Gives ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A null text counts as
    empty; two empty fingerprints have likeness 1, an empty and another one 0. A single document is
    its own next. Repeated rows follow each other; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"), k)), "doc_id", ["text", "sketch"])
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 2 as int))"),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
