import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pomelo.functions.hashing import xavier_matrix
from pomelo.operators import content, graph, training

EDGES = [(0, 3), (0, 4), (1, 3), (2, 4), (1, 5), (0, 5), (0, 3)]  # users 0-2, items 3-6


def make(spark, dim=4, n=7, seed=1):
    rng = np.random.default_rng(seed)
    mat = rng.normal(size=(n, dim))
    vectors = spark.createDataFrame([(i, mat[i].tolist()) for i in range(n)], "node long, v array<double>")
    links = spark.createDataFrame(EDGES, "src long, dst long")
    return mat, vectors, graph.both_directions(links)


def as_matrix(df, n):
    rows = {r["node"]: r["v"] for r in df.collect()}
    return np.array([rows[i] for i in range(n)])


def adjacency(n):
    a = np.zeros((n, n))
    for s, d in EDGES:
        a[d, s] += 1
        a[s, d] += 1
    return a


def test_directed_edges_and_threshold(spark):
    df = spark.createDataFrame([(0, 5, 5.0), (1, 6, 4.0)], "user_id long, item_id long, rating double")
    assert {(r["src"], r["dst"]) for r in graph.ui_edges(df).collect()} == {(0, 5), (1, 6)}
    df = spark.createDataFrame([(0, 3, 1.0), (1, 3, 3.9), (2, 3, 5.0), (4, 3, None)], "user_id long, item_id long, rating double")
    assert [r["src"] for r in graph.ui_edges(df, 4).collect()] == [2]


@pytest.mark.parametrize("layers", [1, 3])
@pytest.mark.parametrize("known_size", [None, 7])
def test_lightgcn_equals_matrix_form(spark, layers, known_size):
    mat, vectors, edges = make(spark)
    a = adjacency(7)
    deg = np.maximum(a.sum(1), 1)
    norm = a / np.sqrt(np.outer(deg, deg))
    x, total = mat, mat.copy()
    for _ in range(layers):
        x = norm @ x
        total += x
    got = as_matrix(graph.lightgcn(vectors, edges, 4, layers, n_nodes=known_size), 7)
    assert np.allclose(got, total / (layers + 1))


def test_sage_equals_matrix_form(spark):
    mat, vectors, edges = make(spark)
    layers = [{"neighbour": xavier_matrix(4, 4, f"n{i}"), "self": xavier_matrix(4, 4, f"s{i}"), "bias": [0.1, 0, -0.1, 0.2]}
              for i in range(2)]
    a = adjacency(7)
    mean = a / np.maximum(a.sum(1), 1)[:, None]
    x = mat
    for i, w in enumerate(layers):
        h = (mean @ x) @ np.array(w["neighbour"]).T + np.array(w["bias"]) + x @ np.array(w["self"]).T
        x = (np.maximum(h, 0) if i == 0 else h) + x
    assert np.allclose(as_matrix(graph.sage(vectors, edges, 4, layers), 7), x)


def test_gat_equals_matrix_form(spark):
    mat, vectors, edges = make(spark)
    layers = [{"heads": [{"matrix": xavier_matrix(4, 4, f"w{i}{h}"), "src": xavier_matrix(1, 4, f"a{i}{h}")[0],
                          "dst": xavier_matrix(1, 4, f"b{i}{h}")[0]} for h in range(2)], "bias": [0.1, 0.2, 0, 0]}
              for i in range(2)]
    a = adjacency(7) + np.eye(7)
    x = mat
    for i, w in enumerate(layers):
        outs = []
        for h in w["heads"]:
            z = x @ np.array(h["matrix"]).T
            e = (z @ np.array(h["src"]))[None, :] + (z @ np.array(h["dst"]))[:, None]
            e = np.where(e > 0, e, 0.2 * e)
            weight = a * np.exp(e)
            outs.append(weight / weight.sum(1)[:, None] @ z)
        out = np.mean(outs, axis=0) + np.array(w["bias"])
        x = (np.where(out > 0, out, np.expm1(out)) if i == 0 else out) + x
    assert np.allclose(as_matrix(graph.gat(vectors, edges, 4, layers), 7), x)


def test_softmax_sums_to_one_and_is_stable(spark):
    scores = spark.createDataFrame([(0, 1, 800.0), (2, 1, 801.0), (3, 4, -900.0)], "src long, dst long, e double")
    rows = graph.edge_softmax(scores).collect()
    assert sum(r["alpha"] for r in rows if r["dst"] == 1) == pytest.approx(1.0)
    assert [r["alpha"] for r in rows if r["dst"] == 4] == [1.0]


def test_temporal_weights(spark):
    df = spark.createDataFrame([(5, "2020-01-01"), (1, "2020-01-01"), (3, None)], "rating int, date string")
    from pomelo.functions.numeric import temporal_weight
    as_of = F.lit("2020-12-31").cast("date")
    got = [r["w"] for r in df.select(temporal_weight("rating", F.to_date("date"), as_of).alias("w")).collect()]
    assert got == pytest.approx([math.exp(-1), 0.0, 0.5 * math.exp(-1)])


def test_negatives_avoid_positives_unless_all_draws_hit(spark):
    pairs = spark.createDataFrame([(0, i) for i in range(5)] + [(1, 0)], "user_idx long, item_idx long")
    rows = graph.sample_negatives(pairs, pairs, 6, n_neg=20, rounds=5).collect()
    assert len(rows) == 6 * 20
    bad = [r for r in rows if r["user_idx"] == 1 and r["neg_idx"] == 0]
    assert not bad
    # user 0 likes 5 of 6 items: six draws miss the free one with (5/6)^6, a third of the time
    share = np.mean([r["neg_idx"] == 5 for r in rows if r["user_idx"] == 0])
    assert 0.45 < share < 0.85
    full = spark.createDataFrame([(0, 0), (0, 1)], "user_idx long, item_idx long")
    assert graph.sample_negatives(full, full, 2, n_neg=3).count() == 6


def test_neighbour_fan_out(spark):
    edges = spark.createDataFrame([(s, 0) for s in range(1, 40)] + [(100, s) for s in range(1, 40)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    rows = graph.sample_neighbours(edges, seeds, (15, 10)).collect()
    first = {r["src"] for r in rows if r["hop"] == 0}
    assert len(first) == 15 and {r["dst"] for r in rows if r["hop"] == 1} == first


def test_warm_start_replaces_items_only(spark):
    _, vectors, _ = make(spark)
    new = spark.createDataFrame([(3, [9.0] * 4)], "node long, v array<double>")
    before = {r["node"]: r["v"] for r in vectors.collect()}
    after = {r["node"]: r["v"] for r in graph.warm_start(vectors, new).collect()}
    assert after.pop(3) == [9.0] * 4 and before.pop(3) and after == before


# ---------------------------------------------------------------- training

TRIPLES = [(0, 0, 3), (0, 0, 2), (1, 0, 1), (2, 1, 0), (1, 2, 3)]


def numpy_loss(mat, n_users, reg):
    total = 0.0
    for u, i, j in TRIPLES:
        a, b, c = mat[u], mat[n_users + i], mat[n_users + j]
        total += math.log1p(math.exp(-(a @ b - a @ c))) + reg * (a @ a + b @ b + c @ c)
    return total / len(TRIPLES)


def test_gradient_equals_finite_differences(spark):
    mat, vectors, _ = make(spark)
    triples = spark.createDataFrame(TRIPLES, "user_idx long, item_idx long, neg_idx long")
    assert training.bpr_loss(triples, vectors, 3, 4, 0.01).first()["loss"] == pytest.approx(numpy_loss(mat, 3, 0.01))
    for size in (None, 7):
        got = {r["node"]: r["g"] for r in training.bpr_gradient(triples, vectors, 3, 4, 0.01, size).collect()}
        for node in range(7):
            for d in range(4):
                up, down = mat.copy(), mat.copy()
                up[node, d] += 1e-6
                down[node, d] -= 1e-6
                slope = (numpy_loss(up, 3, 0.01) - numpy_loss(down, 3, 0.01)) / 2e-6
                assert got.get(node, [0.0] * 4)[d] / len(TRIPLES) == pytest.approx(slope, abs=1e-7)


def test_training_lowers_the_loss(spark):
    _, vectors, _ = make(spark)
    pairs = spark.createDataFrame(sorted({(s, d - 3) for s, d in EDGES}), "user_idx long, item_idx long")
    links = pairs.select(F.col("user_idx").alias("src"), (F.col("item_idx") + 3).alias("dst"))
    trained, losses = training.train_bpr(vectors, pairs, links, 3, 4, 4, epochs=4, lr=0.3, warmup=1, n_neg=4)
    assert losses[-1] < losses[0] and trained.count() == 7


def test_learning_rates(spark):
    rates = [r["lr"] for r in training.lr_schedule(spark, 0.005, 200, 10).orderBy("epoch").collect()]
    assert rates[0] == pytest.approx(0.0005) and rates[9] == rates[10] == pytest.approx(0.005)
    assert rates[105] == pytest.approx(0.005 * 0.01 + 0.005 * 0.99 / 2, rel=1e-2)
    assert all(a >= b for a, b in zip(rates[10:], rates[11:]))


def test_early_stopping_folds_in_order(spark):
    scores = [0.1, 0.2, 0.2 + 5e-6, 0.19, 0.3, 0.1, 0.1, 0.1, 0.9]
    log = spark.createDataFrame([("a", i + 1, s) for i, s in enumerate(scores)] + [("b", 1, 0.5)],
                                "run string, epoch long, score double").repartition(4)
    rows = {r["run"]: (r["best_score"], r["best_epoch"], r["stop_epoch"]) for r in training.early_stopping(log, 3).collect()}
    assert rows == {"a": (0.3, 5, 8), "b": (0.5, 1, None)}


def test_text_vectors_group_equal_categories(spark):
    df = spark.createDataFrame([(0, "Dentists, Health"), (1, "health dentists"), (2, "Yoga"), (3, None)],
                               "item long, categories string")
    v = {r["item"]: np.array(r["v"]) for r in content.hashed_text_vectors(df, "categories", 64).collect()}
    assert np.allclose(v[0], v[1]) and not np.allclose(v[0], v[2]) and not v[3].any()
    encoded = content.model_vectors(df, "categories", lambda: (lambda texts: [[len(t), 1.0] for t in texts]))
    assert {r["item"]: r["v"] for r in encoded.collect()}[2] == [4.0, 1.0]


@pytest.fixture
def large_vectors(monkeypatch):
    """Vectors of any size count as too large to broadcast, and sums as too many for one task."""
    monkeypatch.setattr(graph.V, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(graph, "SUM_BYTES", 32)


@pytest.mark.parametrize("layers", [0, 1, 3])
def test_lightgcn_sent_to_ranges_equals_matrix_form(spark, large_vectors, layers):
    mat, vectors, edges = make(spark)
    a = adjacency(7)
    deg = np.maximum(a.sum(1), 1)
    norm = a / np.sqrt(np.outer(deg, deg))
    x, total = mat, mat.copy()
    for _ in range(layers):
        x = norm @ x
        total += x
    assert np.allclose(as_matrix(graph.lightgcn(vectors, edges, 4, layers, n_nodes=7), 7), total / (layers + 1))


def test_a_large_vector_is_sent_once_to_a_range_of_nodes(spark, monkeypatch):
    """Rows shuffled are pairs of a source and a range, not edges; a sum needs no second shuffle."""
    monkeypatch.setattr(graph.V, "BROADCAST_BYTES", 0)
    pairs = [(s, 50 + (s + i) % 50) for s in range(50) for i in range(40)] + [(3, None), (None, 60), (3, 99), (200, 60)]
    edges = spark.createDataFrame([(s, d, 0.5) for s, d in pairs], "src long, dst long, w double")
    vectors = spark.range(100).select(F.col("id").alias("node"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v"))
    for weight in (None, "w"):
        for how in (F.sum, F.avg):
            one = graph.sum_messages(edges, vectors, 2, how=how, weight=weight)
            many = graph.sum_messages(edges, vectors, 2, how=how, weight=weight, n_nodes=100)
            assert {(r["node"], *r["m"]) for r in one.collect()} == {(r["node"], *r["m"]) for r in many.collect()}
    many.collect()
    final = many._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    top = final[:final.index("shufflepartitionidpassthrough")]
    assert "Exchange hashpartitioning" not in top
    assert "collect_list" in final


def test_gat_with_large_vectors_equals_small(spark, monkeypatch):
    _, vectors, edges = make(spark)
    heads = [{"matrix": xavier_matrix(4, 4, f"m{i}"), "src": xavier_matrix(1, 4, f"a{i}")[0], "dst": xavier_matrix(1, 4, f"b{i}")[0]} for i in range(3)]
    layers = [{"heads": heads, "bias": [0.1, 0.0, -0.1, 0.2]}] * 2
    small = as_matrix(graph.gat(vectors, edges, 4, layers, n_nodes=7), 7)
    monkeypatch.setattr(graph.V, "BROADCAST_BYTES", 0)
    asked = []
    real = graph.meet_vectors
    monkeypatch.setattr(graph, "meet_vectors", lambda *a, **k: asked.append(1) or real(*a, **k))
    assert np.allclose(as_matrix(graph.gat(vectors, edges, 4, layers, n_nodes=7), 7), small)
    assert len(asked) == 2  # one meeting per layer, not one per head


def test_profiles_by_ranges_of_users_equal_those_by_ratings(spark, monkeypatch):
    from pomelo.operators import recommend
    liked = spark.createDataFrame([(0, 1, 5.0), (0, 2, 3.0), (0, 2, 3.0), (4, 0, 1.0), (9, 2, None), (None, 1, 2.0), (7, None, 2.0), (6, 1, 0.0), (3, 8, 1.0)],
                                  "user long, item long, rating double")
    items = spark.createDataFrame([(i, [i + 0.5, -1.0 * i]) for i in range(3)], "item long, v array<double>")
    plain = recommend.profile_vectors(liked, items, 2).collect()
    monkeypatch.setattr(graph.V, "BROADCAST_BYTES", 0)
    sent = recommend.profile_vectors(liked, items, 2, 10)
    assert "shufflepartitionidpassthrough" in sent._jdf.queryExecution().executedPlan().toString()
    assert {(r["user"], *r["v"]) for r in sent.collect()} == {(r["user"], *r["v"]) for r in plain} and len(plain) == 3


def test_triples_meet_vectors_in_ranges(spark, monkeypatch):
    """Beyond the broadcast limit scores are the same, and no vector is shuffled along triples."""
    from conftest import plan
    from pomelo.functions import vectors as V
    from pomelo.operators import training
    n_users, n_items = 60, 50
    vectors = spark.range(n_users + n_items).select(F.col("id").alias("node"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(3)]).alias("v"))
    pairs = spark.range(400).select((F.col("id") % n_users).alias("user_idx"), F.pmod(F.xxhash64("id"), F.lit(n_items)).alias("item_idx")).distinct()
    triples = graph.sample_negatives(pairs, pairs, n_items)
    view = lambda df: sorted((r[0], r[1], r[2], round(r[3], 9), round(r[4], 9)) for r in df.select("user_idx", "item_idx", "neg_idx", "gap", "size").collect())
    few = view(training.score_triples(triples, vectors, n_users, 3, n_users + n_items))
    ends = pairs.select(F.col("user_idx").alias("user_id"), (F.col("item_idx") + n_users).alias("item_id"))
    plain = sorted((r["user_id"], r["item_id"], round(r["score"], 9)) for r in graph.pair_scores(ends, vectors).collect())
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    many = training.score_triples(triples, vectors, n_users, 3, n_users + n_items)
    assert "[neg_idx" not in "".join(x for x in plan(many).splitlines() if "MergeJoin" in x)
    assert view(many) == few and len(few) > 3000
    met = graph.pair_scores(ends, vectors, n_users, n_items, 3)
    assert "ShuffledHashJoin" in plan(met)
    assert sorted((r["user_id"], r["item_id"], round(r["score"], 9)) for r in met.collect()) == plain


def test_negatives_are_tested_where_they_are_drawn(spark, monkeypatch):
    from conftest import plan
    pairs = spark.range(900).select((F.col("id") % 30).alias("user_idx"), (F.floor(F.col("id") / 30) * 2).alias("item_idx"))
    view = lambda df: sorted(map(tuple, df.select("user_idx", "item_idx", "slot", "neg_idx").collect()))
    local = graph.sample_negatives(pairs, pairs, 61)
    text = plan(local)
    assert "slot" not in "".join(x for x in text.splitlines() if "Exchange" in x) and "draws" not in text
    monkeypatch.setattr(graph, "CARRIED", 29)  # all users go through the join
    joined = graph.sample_negatives(pairs, pairs, 61)
    assert view(local) == view(joined) and local.count() == 9000


def test_als_frees_its_shuffles_on_the_way(spark):
    """A checkpoint is written within few iterations, after which shuffle files of the iterations before it go."""
    import glob
    import random
    from urllib.parse import urlparse
    rng = random.Random(5)
    pairs = spark.createDataFrame([(rng.randrange(40), rng.randrange(30), 5) for _ in range(300)], "user_idx long, item_idx long, rating int")
    sets = lambda: set(glob.glob(f"{urlparse(spark.sparkContext.getCheckpointDir() or '/none').path}/rdd-*"))
    before = sets()
    assert training.train_als(pairs, 40, rank=4, iterations=3).count() == len({r[0] for r in pairs.collect()}) + len({r[1] for r in pairs.collect()})
    assert sets() - before


def test_computed_vectors_are_not_taken_for_small_ones(spark, monkeypatch):
    """Spark takes an array that is computed for one number, so vectors known to be large would be broadcast by their estimate."""
    from conftest import plan
    monkeypatch.setattr(graph.V, "BROADCAST_BYTES", 0)
    edges = spark.range(200).select(F.col("id").alias("src"), F.pmod(F.col("id") * 7, F.lit(200)).alias("dst"))
    vectors = graph.initial_vectors(spark.range(200).withColumnRenamed("id", "node"), 8, 200)
    sums = graph.sum_messages(edges, vectors, 8, n_nodes=200)
    assert "Broadcast" not in plan(sums)
    got, start = ({r[0]: r[1] for r in df.collect()} for df in (sums, vectors))
    assert all(got[i * 7 % 200] == pytest.approx(start[i]) for i in range(200))
