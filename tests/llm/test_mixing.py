"""Budgets and mixing against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from helpers import WORD
from pomelo.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, draw string, p int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, -1, "x", 3) for i, t, s in rows], SCHEMA)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values())
    target, open_, left = {}, set(order), total
    while open_:
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if shares[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | shares
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_fit_is_nearest_on_small_cases():
    draw = random.Random(1)
    for _ in range(150):
        lengths = np.array(sorted(draw.sample(range(1, 40), draw.randint(1, 5))))
        counts = np.array([draw.randint(1, 3) for _ in lengths])
        budget = draw.randint(0, int((lengths * counts).sum()) + 5)
        taken = mixing.fit(lengths, counts, budget)
        assert ((0 <= taken) & (taken <= counts)).all()
        best = min(abs(sum(a * b for a, b in zip(c, lengths)) - budget)
                   for c in itertools.product(*[range(n + 1) for n in counts]))
        assert abs(int((taken * lengths).sum()) - budget) == best


def test_fit_hits_large_budgets():
    draw = np.random.default_rng(2)
    lengths = np.unique(draw.integers(1, 20_000, 3_000))
    counts = draw.integers(1, 400, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.001, 0.3, 0.77, 0.999):
        budget = int(total * share)
        taken = mixing.fit(lengths, counts, budget)
        assert ((0 <= taken) & (taken <= counts)).all()
        assert int((taken * lengths).sum()) == budget


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.choice([0, 1, 10, 500, 100_000]) + draw.randrange(9) for i in range(draw.randint(1, 9))}
    sizes[None] = 40
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)


def rows_of(seed, n=600):
    draw = random.Random(seed)
    sources = ["big"] * 6 + ["a", "b", "c", None, "Z", "é"]
    return [(i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(0, 60))), draw.choice(sources)) for i in range(n)]


def test_mix(spark):
    rows = rows_of(3) + [(9000, None, "a"), (9001, "", "only empty"), (9002, " \n", None)]
    got = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(got) == len(rows)
    sizes, taken, source = defaultdict(int), defaultdict(int), {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["size"] * r["repeats"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_hot_length(spark):
    """A third of all rows have one source and length; the number drawn of them is exact."""
    rows = [(i, "a b c d e f g", "hot") for i in range(3000)] + [(5000 + i, "x " * (1 + i % 50), "cold") for i in range(300)]
    got = mixing.mix(frame(spark, rows)).collect()
    hot = [r for r in got if r["doc_id"] < 5000]
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 7


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c", "s")] * 5 + [(None, "a b", "s"), (2, "a", None), (3, "x y z", "t")]
    assert mixing.mix(frame(spark, rows)).count() == len(rows)
    assert mixing.mix(frame(spark, [])).count() == 0


@pytest.mark.parametrize("key", [7, None])
def test_of_repeated_rows_as_many_are_drawn_as_wanted(spark, key):
    rows = [(key, "one two three four", "s")] * 400 + [(1000 + i, "one two three four", "t") for i in range(100)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    for source_size in (1600, 400):
        own = [r for r in got if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
        assert max(r["repeats"] for r in own) - min(r["repeats"] for r in own) <= 1
    assert mixing.mixed_documents(docs).count() == sum(r["repeats"] for r in got)


def test_columns_with_dots_stay(spark):
    from pyspark.sql import functions as F
    docs = frame(spark, rows_of(5, 40)).withColumn("a.b", F.lit(1)).withColumn("repeats", F.lit(2)).withColumn("row", F.lit(3))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.filter("`a.b` = 1 AND repeats = 2 AND row = 3").count() == mixed.count() > 0


def test_mixed_documents(spark):
    rows = rows_of(4, 200)
    docs = frame(spark, rows)
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r["doc_id"]] += 1
        assert r["text"] == rows[r["doc_id"]][1]
    assert {i: n for i, n in repeats.items() if n} == dict(counts)
