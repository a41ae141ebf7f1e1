"""Approximate neighbours against exact ones, and exact top-K that skips blocks it doesn't need."""

import numpy as np
import pytest

from conftest import SF, plan
from pomelo.operators import neighbours, scoring
from pomelo.plans.catalog import REGISTRY
from test_scoring import brute, table


def clustered(n, dim, seed=3):
    """Vectors around a few centres: what neighbours are looked for in."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    return centres[draw.integers(0, 12, n)] + 0.35 * draw.normal(size=(n, dim))


def test_recall_on_the_given_vectors(spark):
    row = REGISTRY["approximate_recall"].run(spark, SF).first()
    assert row["recall"] >= 0.95 and row["n_exact"] > 0


def test_recall_and_work_on_clusters(spark):
    x = clustered(900, 16)
    items = table(spark, "item", range(900), x)
    exact = scoring.nearest_items(items, 5)
    found = neighbours.approximate_neighbours(items, 5, 16, tables=8, bits=8, probes=8)
    assert neighbours.recall(found, exact, ["item", "neighbour"]).first()["recall"] >= 0.95
    assert found.filter("item = neighbour").count() == 0


@pytest.mark.parametrize("block", [7, 8192])
def test_blocks_cap_nothing(spark, block):
    """All vectors in one bucket: cut into blocks, the search is exact."""
    x = np.abs(clustered(120, 6)) + 5.0
    items = table(spark, "item", range(120), x)
    everything = dict(tables=1, bits=2, probes=4)
    found = neighbours.approximate_neighbours(items, 4, 6, block=block, **everything)
    view = lambda df: sorted(map(tuple, df.select("item", "neighbour", "rank").collect()))
    assert view(found) == view(scoring.nearest_items(items, 4))


def test_top_k_of_users(spark):
    draw = np.random.default_rng(5)
    items = clustered(600, 12) * draw.uniform(0.2, 3.0, (600, 1))
    users = table(spark, "user", range(40), clustered(40, 12, 9))
    items = table(spark, "item", range(600), items)
    exact, found = scoring.top_k_by_dot(users, items, 10), neighbours.approximate_top_k(users, items, 10, 12, tables=20)
    assert neighbours.recall(found, exact, ["user", "item"]).first()["recall"] >= 0.9
    both = found.join(exact.withColumnsRenamed({"score": "s"}), ["user", "item"])
    assert both.filter("abs(score - s) > 1e-6").count() == 0


def test_empty_and_few(spark):
    none = table(spark, "item", [], np.empty((0, 4)))
    assert neighbours.approximate_neighbours(none, 3, 4).count() == 0
    one = table(spark, "item", [1], np.ones((1, 4)))
    assert neighbours.approximate_neighbours(one, 3, 4).count() == 0


def long_tail(n, dim, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.geomspace(10, 0.01, n)[:, None]


@pytest.mark.parametrize("broadcast", [None, 0])
def test_short_items_are_not_multiplied(spark, monkeypatch, broadcast):
    if broadcast is not None:
        monkeypatch.setattr(scoring.V, "BROADCAST_BYTES", broadcast)
    x, y = long_tail(400, 5), np.random.default_rng(2).normal(size=(60, 5))
    users, items = table(spark, "user", range(60), y), table(spark, "item", range(400), x)
    seen = {(u, i) for u in range(60) for i in range(0, 30, 3)}
    pairs = spark.createDataFrame(sorted(seen), "user long, item long")
    got = {}
    for r in sorted(scoring.top_k_by_dot(users, items, 5, pairs, 16, 40).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["user"], []).append((r["item"], r["score"]))
    assert got == brute(range(60), y, range(400), x, 5, seen)


def test_blocks_that_are_skipped_are_counted(spark):
    x, y = long_tail(400, 5), np.random.default_rng(2).normal(size=(60, 5))
    users, items = table(spark, "user", range(60), y), table(spark, "item", range(400), x)
    blocks = scoring._ItemBlocks(items, 400, 40)
    assert blocks.count == 10 and blocks.longest == sorted(blocks.longest, reverse=True)
    sizes = {r["b"]: r["n"] for r in items.groupBy(blocks.where().alias("b")).count().withColumnRenamed("count", "n").collect()}
    assert sum(sizes.values()) == 400 and max(sizes.values()) <= 60 and set(sizes) == set(range(10))
    best = scoring.top_k_by_dot(users, items, 5)
    at = scoring._block("user", 4)
    cut = [r["cut"] for r in scoring.needed_blocks(best, users, at, blocks.longest, 5).collect()]
    assert len(cut) == 4 and max(cut) <= 6  # of 10
    few = scoring.needed_blocks(best.filter("rank < 5"), users, at, blocks.longest, 5)
    assert {r["cut"] for r in few.collect()} == {10}  # users without K scores need all


def test_equal_lengths_are_split_by_hash(spark):
    items = table(spark, "item", range(300), np.ones((300, 2)))
    blocks = scoring._ItemBlocks(items, 300, 50)
    assert blocks.count == 5
    assert items.select(blocks.where().alias("b")).distinct().count() == 5


def test_no_full_grid_and_no_cross_join(spark):
    items = table(spark, "item", range(300), long_tail(300, 4))
    text = plan(scoring.top_k_by_dot(items.withColumnRenamed("item", "user"), items, 5, None, 32, 32))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "cut" in text
    text = plan(neighbours.approximate_neighbours(items, 5, 4))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_vectors_are_not_sent_to_every_bucket(spark):
    """Queries and members meet in blocks; buckets are found where they meet."""
    items = table(spark, "item", range(300), clustered(300, 6))
    text = plan(neighbours.approximate_neighbours(items, 5, 6))
    assert "code" not in text and "BroadcastHashJoin [_ib" in text
