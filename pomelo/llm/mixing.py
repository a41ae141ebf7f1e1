"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a budget of words. Whole passes over a source take what they can; for the rest,
documents are counted by exact length, and a bounded-knapsack dynamic program over these counts
finds how many of each length to take. Which documents of a length are taken is drawn by a seeded
hash. So the words taken hit a budget exactly wherever the lengths allow it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
SEED = 11
# Budget that is left to the dynamic program, in multiples of the largest length (at least SPAN
# words): proportional taking covers the budget down to there.
SPAN = 16_384
_BUCKET_BITS = 10


def size_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources in code point order, null last, have the weights in turn. A target stops at ``most``
    times the source's size, and what is over is shared again by weight until no target is above.
    That ends where ``min(most * size, level * weight)`` sums to all words, and the level follows
    from the sources in order of ``size / weight``, by running sums. Windows here run over one row
    per source.
    """
    # Spark compares strings by their UTF-8 bytes, which is code point order
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = (sizes.withColumn("turn", turn).withColumn("weight", weight)
            .withColumn("cap", (F.col("source_size") * most).cast("double")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    through, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (rows.withColumn("capped", F.coalesce(F.sum("cap").over(through), F.lit(0.0)))
            .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("all", F.sum("source_size").over(whole).cast("double"))
            .withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
            # the first source that its level does not fill gives the level of all from there on
            .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
                F.col("cap") / F.col("weight"), F.col("turn"), F.col("level").alias("level")))).over(whole)["level"]))
    return rows.select("source", "source_size", F.least(
        F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``.

    ``lengths`` are distinct and positive, ``counts`` how many documents have them. Each length first
    gets its share of the budget, rounded down; then lengths get one more, longest first, while the
    open budget stays above the span. For that rest a dynamic program over the sums 0..2*rest marks
    the step that first reaches each sum, by binary splitting of the counts left, and the reachable
    sum nearest to the rest is traced back. Its memory is bounded by the span and the longest length.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    span = max(span, 4 * int(lengths.max()))
    usable = max(0, budget - span)
    taken = np.array([int(c) * usable // total for c in counts], np.int64)
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    while rest > span:  # rounding leaves less than one document of each length
        before = rest
        for i in order:
            if taken[i] < counts[i] and rest - lengths[i] >= span // 2:
                taken[i] += 1
                rest -= int(lengths[i])
                if rest <= span:
                    break
        if rest == before:
            break
    limit = min(2 * rest, rest + int(lengths.max()))
    step_of = np.full(limit + 1, -1, np.int32)
    reach = np.zeros(limit + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for i in order:
        left, many = min(int(counts[i] - taken[i]), limit // int(lengths[i])), 1
        while left > 0 and not reach[rest]:
            many = min(many, left)
            shift = many * int(lengths[i])
            new = np.zeros_like(reach)
            new[shift:] = reach[:limit + 1 - shift]
            new &= ~reach
            step_of[new] = len(steps)
            steps.append((int(i), many))
            reach |= new
            left, many = left - many, many * 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, many = steps[step_of[at]]
        taken[i] += many
        at -= many * int(lengths[i])
    return taken


def draw_of(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """The seeded hash that documents of a length are drawn by; only rows of one id and text share it."""
    return F.xxhash64(doc_id, text, F.lit(seed))


def _budgeted(key, lengths: pd.DataFrame, most: int) -> pd.DataFrame:
    words, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
    passes = min(int(target // words), most) if words else 0
    extra = fit(lengths["size"].to_numpy(), lengths["n"].to_numpy(),
                round(target) - passes * words if passes < most else 0)
    return pd.DataFrame({"source": lengths["source"], "size": lengths["size"], "n": lengths["n"],
                         "passes": passes, "extra": extra})


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> tuple[DataFrame, DataFrame]:
    """Targets by source, and by source and length the passes and the largest hash that is drawn
    once more (``source, size, passes, last_draw, ties, of_ties``); from narrow rows ``source, size, draw``.

    ``of_ties`` of the ``ties`` rows that have that very hash are drawn; mostly it is one row.
    """
    by_length = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    budgets = materialize(targets(
        by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")
    # one row per length of a source: bounded by the longest document, however many there are
    planned = materialize(
        by_length.alias("l").filter("size > 0")
        .join(budgets.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")))
        .select("l.source", "l.size", "l.n", "b.source_size", "b.target").groupBy("source")
        .applyInPandas(lambda key, lengths: _budgeted(key, lengths, most),
                       "source string, size long, n long, passes long, extra long"), "plan")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))

    # Of a length the documents with the smallest hashes are drawn. Counts by the leading bits find
    # the bucket where the number is reached, and only that bucket is ordered.
    partly = planned.filter("extra > 0 AND extra < n")
    bucket = F.shiftright("draw", 64 - _BUCKET_BITS).cast("int")
    rows = rows.withColumn("bucket", bucket)
    upto = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (rows.alias("r").join(partly.alias("p"), same("r", "p")).select("r.source", "r.size", "r.bucket", "p.extra")
             .groupBy("source", "size", "bucket", "extra").agg(F.count(F.lit(1)).alias("here"))
             .withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
             .filter("before < extra AND extra <= before + here")
             .select("source", "size", "bucket", (F.col("extra") - F.col("before")).alias("wanted")))
    edges = materialize(edges, "edges")
    # rows of one hash count as one with their number, so a hot id does not pile up in the window
    here = (rows.alias("r").join(edges.alias("e"), same("r", "e") & (F.col("r.bucket") == F.col("e.bucket")))
            .groupBy("r.source", "r.size", "r.draw", "e.wanted").agg(F.count(F.lit(1)).alias("ties")))
    below = F.coalesce(F.sum("ties").over(Window.partitionBy("source", "size").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (here.withColumn("below", below).filter("below < wanted AND wanted <= below + ties")
            .select("source", "size", F.col("draw").alias("last_draw"), "ties", (F.col("wanted") - F.col("below")).alias("of_ties")))
    plan = (planned.alias("p").join(last.alias("t"), same("p", "t"), "left")
            .select("p.source", "p.size", "p.passes", F.when(F.col("p.extra") >= F.col("p.n"), F.lit(2**63 - 1))
                    .otherwise(F.col("t.last_draw")).alias("last_draw"), "t.ties", "t.of_ties"))
    return budgets, materialize(plan, "plan")


def with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source, size, draw``) and how often the mix takes each (``repeats``).

    Of repeated rows of which only some are drawn, the first in any order are: they are alike.
    """
    once_more = F.coalesce(F.col("r.draw") <= F.col("p.last_draw"), F.lit(False)).cast("long")
    joined = (rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
                                   & (F.col("r.size") == F.col("p.size")), "left"))
    repeats = F.coalesce(F.col("p.passes"), F.lit(0)) + once_more
    cut = F.coalesce((F.col("r.draw") == F.col("p.last_draw")) & (F.col("p.of_ties") < F.col("p.ties")), F.lit(False))
    if plan.filter("of_ties < ties").isEmpty():
        return joined.select("r.*", repeats.alias("repeats"))
    place = F.row_number().over(Window.partitionBy("source", "size", "draw").orderBy(F.lit(0)))
    alike = (joined.filter(cut).select("r.*", repeats.alias("repeats"), F.col("p.of_ties").alias("_of_ties"))
             .withColumn("repeats", F.col("repeats") - (place > F.col("_of_ties")).cast("long")).drop("_of_ties"))
    return joined.filter(~cut).select("r.*", repeats.alias("repeats")).unionByName(alike)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, repeats``.

    ``taken`` is ``size * repeats``: a row is taken by every whole pass over its source, and once more
    if it is drawn for what is left of the target. Null and empty texts have size 0 and take
    nothing. A null source is a source of its own, last in order. The draw is a hash of id, text and
    seed; of repeated rows as many are drawn as are wanted, so reruns agree. An empty table gives an
    empty result. Texts are read once; all else works on narrow rows.
    """
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                   size_of(F.col(text)).alias("size"), draw_of(F.col(doc_id), F.col(text), seed).alias("draw")), "sizes")
    budgets, plan = mix_plan(rows.select("source", "size", "draw"), weights, most)
    taken = with_repeats(rows, plan).alias("t")
    return (taken.join(budgets.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")))
            .select("t.doc_id", "t.size", "b.source_size", "b.target",
                    (F.col("t.size") * F.col("t.repeats")).alias("taken"), "t.repeats"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns."""
    keys = docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
                       draw_of(F.col(doc_id), F.col(text), seed).alias("draw"))
    _, plan = mix_plan(materialize(keys, "sizes"), weights, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
                       size_of(F.col(text)).alias("size"), draw_of(F.col(doc_id), F.col(text), seed).alias("draw"))
    return (with_repeats(rows, plan).filter("repeats > 0")
            .withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*"))
