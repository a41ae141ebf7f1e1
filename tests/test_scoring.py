import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pomelo.operators import recommend, scoring


def table(spark, key, ids, mat):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, mat)],
                                 f"{key} long, v array<double>")


def brute(uids, users, iids, items, k, seen):
    scores = np.floor(users @ items.T * 1e6 + 0.5) / 1e6
    out = {}
    for a, u in enumerate(uids):
        rows = [(-scores[a, b], i) for b, i in enumerate(iids) if (u, i) not in seen]
        out[u] = [(i, -s) for s, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("blocks", [(2048, 8192), (16, 8)])
def test_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    uids, iids = list(range(100, 160)), list(range(0, 90, 2))
    users = rng.integers(-2, 3, (60, 4)).astype(float)  # small integers: many ties
    items = rng.integers(-2, 3, (45, 4)).astype(float)
    seen = {(u, i) for u in uids for i in iids if rng.random() < 0.1} | {(100, i) for i in iids[:-1]}
    pairs = spark.createDataFrame([*seen, (100, 0), (1, 1)], "user long, item long")
    got = scoring.top_k_by_dot(table(spark, "user", uids, users), table(spark, "item", iids, items), 7, pairs,
                               *blocks).collect()
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["user"], []).append((r["item"], r["score"]))
    assert mine == brute(uids, users, iids, items, 7, seen)
    assert len(mine[100]) == 1


def test_dense_history_shrinks_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SEEN_PAIRS", 50)
    users = table(spark, "user", range(200), np.ones((200, 1)))
    items = table(spark, "item", range(150), np.arange(150.0)[:, None])
    seen = spark.range(200 * 149).select((F.col("id") % 200).alias("user"), (F.col("id") / 200 + 1).cast("long").alias("item"))
    got = scoring.top_k_by_dot(users, items, 5, seen).collect()
    assert len(got) == 200 and {r["item"] for r in got} == {0}


def test_both_join_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    users = table(spark, "user", range(80), rng.normal(size=(80, 3)))
    items = table(spark, "item", range(70), rng.normal(size=(70, 3)))
    seen = spark.createDataFrame([(1, 2), (1, 3)], "user long, item long")
    view = lambda: sorted(map(tuple, scoring.top_k_by_dot(users, items, 4, seen, 16, 16).collect()))
    small = view()
    monkeypatch.setattr(scoring.V, "BROADCAST_BYTES", 0)
    assert view() == small


def test_more_items_wanted_than_exist(spark):
    users, items = table(spark, "user", [1], [[1.0]]), table(spark, "item", [5, 6], [[2.0], [3.0]])
    got = scoring.top_k_by_dot(users, items, 10).orderBy("rank").collect()
    assert [(r["item"], r["rank"]) for r in got] == [(6, 1), (5, 2)]


def test_score_rows_never_hold_all_pairs(spark):
    users = table(spark, "user", range(50), np.ones((50, 2)))
    items = table(spark, "item", range(40), np.ones((40, 2)))
    df = scoring.top_k_by_dot(users, items, 3, None, 8, 8)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_nearest_items_leave_out_themselves(spark):
    items = table(spark, "item", [0, 1, 2], [[1, 0], [2, 0.1], [0, 3]])
    got = {(r["item"], r["rank"]): r["neighbour"] for r in scoring.nearest_items(items, 1).collect()}
    assert got == {(0, 1): 1, (1, 1): 0, (2, 1): 1}


def test_cold_start_is_the_weighted_mean(spark):
    items = table(spark, "item", [0, 1, 2, 3], [[1, 0], [0, 1], [1, 1], [0.2, 0]])
    liked = spark.createDataFrame([(7, 0, 5.0), (7, 1, 1.0)], "user long, item long, rating double")
    assert recommend.profile_vectors(liked, items, 2).first()["v"] == pytest.approx([5 / 6, 1 / 6])
    plain = recommend.profile_vectors(liked.drop("rating"), items, 2).first()["v"]
    assert plain == pytest.approx([0.5, 0.5])
    got = recommend.recommend_cold(liked, items, 2, 5).orderBy("rank").collect()
    assert [r["item"] for r in got] == [2, 3]


def test_enrichment_defaults(spark):
    recs = spark.createDataFrame([(1, 0, 0.12345, 1), (1, 1, 0.5, 2), (1, 9, 0.1, 3)],
                                 "user long, item long, score double, rank int")
    ids = spark.createDataFrame([("b0", 0), ("b1", 1)], "item_id string, item_idx long")
    info = spark.createDataFrame([("b0", " Clinic ", "x" * 200), ("b0", "Zed", "y")],
                                 "item_id string, name string, categories string")
    rows = {r["rank"]: r for r in recommend.enrich(recs, ids, info).collect()}
    assert rows[1]["name"] == "Clinic" and len(rows[1]["categories"]) == 200
    assert {len(r["categories"]) for r in recommend.enrich(recs, ids, info, 120).collect()} == {120, 3}
    assert rows[1]["score"] == pytest.approx(0.1234)  # half to even
    assert (rows[2]["name"], rows[2]["categories"], rows[3]["business_id"]) == ("b1", "N/A", "item_9")


def test_comparison(spark):
    cols = "user long, item long, rank int"
    before = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], cols)
    after = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 13, 3)], cols)
    got = {r["item"]: (r["status"], r["rank_change"]) for r in recommend.compare(before, after).collect()}
    assert got == {10: ("down", -1), 11: ("up", 1), 12: ("dropped", None), 13: ("new", None)}


def test_user_blocks_are_not_sent_along_item_blocks(spark):
    """However many item blocks there are, a user's vector is dealt out once, before the blocks come to it."""
    from conftest import plan
    from pomelo.functions import vectors as V
    x = np.random.default_rng(6).normal(size=(200, 3))
    items = table(spark, "item", range(200), x / np.linalg.norm(x, axis=1, keepdims=True))  # no block can be skipped
    seen = spark.createDataFrame([(1, 2), (1, 3)], "user long, item long")
    text = plan(scoring.top_k_by_dot(items.withColumnRenamed("item", "user"), items, 3, seen, 50, 20))
    after = [line for line in text.splitlines() if "Exchange" in line and "_ib" in line and "Broadcast" not in line and "u_mat" in line]
    assert re.search(r"BroadcastHashJoin .*_ib", text) and not after
    # a length in a lambda is evaluated for every component
    unit = plan(items.select(V.unit("v").alias("v")))
    assert "/ sqrt" not in unit.lower() and "/ SQRT" not in unit


def test_single_precision_only_rules_out(spark, monkeypatch):
    """Scores that differ by less than single precision can tell are ranked as in double precision."""
    monkeypatch.setattr(scoring, "BOUND_COLUMNS", 16)
    draw = np.random.default_rng(4)
    x = 1000.0 + draw.normal(size=(300, 4)) * 1e-3
    y = draw.normal(size=(70, 4))
    got = {}
    rows = scoring.top_k_by_dot(table(spark, "user", range(70), y), table(spark, "item", range(300), x), 5).collect()
    for r in sorted(rows, key=lambda r: (r["user"], r["rank"])):
        got.setdefault(r["user"], []).append((r["item"], r["score"]))
    assert got == brute(range(70), y, range(300), x, 5, set())


def test_steps_yield_what_may_still_enter(spark, monkeypatch):
    """Many steps: lists equal brute force, ties included, and steps write far fewer rows than K per user each."""
    rng = np.random.default_rng(9)
    users, items = rng.integers(-3, 4, (150, 6)).astype(float), rng.integers(-3, 4, (900, 6)).astype(float)
    users[7] = 0.0
    seen = {(u, i) for u in range(150) for i in range(0, 900, 7) if rng.random() < 0.3}
    written, real = {}, scoring.materialize
    def kept(df, name, *a, **b):
        out = real(df, name, *a, **b)
        written.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(scoring, "materialize", kept)
    monkeypatch.setattr(scoring, "at_once", lambda block, dim: 1)
    monkeypatch.setattr(scoring._ItemBlocks, "__init__", _hashed_blocks)
    pairs = spark.createDataFrame(sorted(seen), "user long, item long")
    rows = scoring.top_k_by_dot(table(spark, "user", range(150), users), table(spark, "item", range(900), items), 5, pairs, 32, 60)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["user"], []).append((r["item"], r["score"]))
    assert got == brute(range(150), users, range(900), items, 5, seen)
    assert len(written["best"]) > 12 and sum(written["best"]) < 10 * 5 * 150 and written["users"] == [written["cut"][0]]


def _hashed_blocks(self, items, n_items, size):
    """Blocks of no order, none of which can be skipped."""
    self.count = -(-n_items // size)
    self.where, self.longest = lambda: scoring._block("item", self.count), [float("inf")] * self.count


def test_a_user_block_is_sent_once(spark):
    """However many item blocks come to a user block, one row has its vectors, also where its first item block is empty."""
    rng = np.random.default_rng(3)
    users = scoring._packed(table(spark, "user", range(40), rng.normal(size=(40, 3))), "user", "v", "_ub", scoring._block("user", 2), "u")
    items = scoring._packed(table(spark, "item", range(30), rng.normal(size=(30, 3))), "item", "v", "_ib", F.pmod("item", F.lit(3)) + 1, "i")
    users = users.withColumns({"_ibs": F.expr("sequence(0L, 3L)"), "s_users": F.lit(None).cast("array<long>"), "s_items": F.lit(None).cast("array<long>")})

    def rows(batches):
        for batch in batches:
            yield pd.DataFrame({"user": batch["ub"], "item": batch["u_mat"].notna().astype("int64"), "score": [0.0 if x is None else float(len(x)) for x in batch["i_ids"]]})

    got = scoring._met_blocks(users, items, None, 0, 3, rows).groupBy("user").agg(F.sum("item").alias("sent"), F.sum("score").alias("items")).collect()
    assert [(r["sent"], r["items"]) for r in got] == [(1, 30.0)] * 2
