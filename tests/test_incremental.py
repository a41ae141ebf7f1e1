import pytest
from pyspark.sql import functions as F

from pomelo.operators import graph, incremental as I, stats
from pomelo.streaming import batches


def ids(spark, key, idx, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{key} string, {idx} long")


def test_vectors_move_with_the_new_users(spark):
    old = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(18)], "node long, v array<double>")
    out = {r["node"]: r["v"] for r in I.extend_vectors(old, 10, 5, 8, 3, 2).collect()}
    assert sorted(out) == list(range(26))
    assert out[3] == [3.0, 0.0] and out[15] == [10.0, 0.0] and out[22] == [17.0, 0.0]
    assert all(abs(x) <= (6 / 28) ** 0.5 for n in (10, 14, 23, 25) for x in out[n])
    same = I.extend_vectors(old, 10, 0, 8, 0, 2)
    assert same.exceptAll(old).count() == 0 and same.count() == 18


def test_newest_rating_wins(spark):
    cols = "user_idx long, item_idx long, rating double"
    old = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], cols)
    new = spark.createDataFrame([(0, 1, 5.0, 1), (0, 1, 4.0, 2), (1, 0, 3.0, 0)], cols + ", seq long")
    got = {(r[0], r[1]): r[2] for r in I.rebuild_interactions(old, new).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 4.0, (1, 0): 3.0}
    assert I.rebuild_interactions(old, new, new_only=True).count() == 2


def test_replay_sizes_and_capacity(spark):
    assert I.replay_size(70) == 30 and I.replay_size(0) == 0 and I.replay_size(10, 0.5) == 10
    cols = "seq long, user_idx long, item_idx long, rating double"
    empty = spark.createDataFrame([], cols)
    batch = spark.createDataFrame([(i, i, float(i)) for i in range(8)], "user_idx long, item_idx long, rating double")
    first = I.append_replay(empty, batch, ["user_idx"], capacity=5)
    assert sorted(r["seq"] for r in first.collect()) == [3, 4, 5, 6, 7]
    second = I.append_replay(first, batch.limit(0), ["user_idx"], capacity=5)
    assert second.count() == 5
    third = I.append_replay(first, batch.filter("user_idx < 2"), ["user_idx"], capacity=5)
    assert sorted((r["seq"], r["user_idx"]) for r in third.collect()) == [(5, 5), (6, 6), (7, 7), (8, 0), (9, 1)]
    assert I.sample_replay(first, 3).count() == 3 and I.sample_replay(first, 99).count() == 5


def test_kept_rows_grow_with_the_input(spark):
    cols = "user_idx long, item_idx long, rating double"
    empty = spark.createDataFrame([], "seq long, user_idx long, item_idx long, rating double")
    rows = lambda n: spark.range(n).selectExpr("id % 300 AS user_idx", "id AS item_idx", "4.0D AS rating")
    sizes = []
    for n in (12_000, 24_000):
        buffer = I.append_replay(empty, rows(n), ["item_idx"])
        sizes.append((buffer.count(), I.first_buffer(rows(n), ["item_idx"]).count(),
                      I.mix_replay(rows(n), buffer, n).filter("origin = 'replay'").count()))
    assert sizes == [(12_000, 12_000, 5_142), (24_000, 24_000, 10_285)]
    some = I.first_buffer(rows(12_000), ["date"], 3_000)
    users = {r["user_idx"] for r in some.collect()}
    assert some.count() == 3_000 and len(users) > 290  # a fair sample, not the largest ids


def test_versions_keep_recent_and_best(spark):
    m = spark.createDataFrame([(v, s) for v, s in enumerate([0.1, 0.9, 0.2, 0.9, 0.3, 0.4])], "version long, val_score double")
    assert {r["version"]: r["reason"] for r in I.retained_versions(m).collect()} == {
        1: "best", 3: "recent", 4: "recent", 5: "recent"}


def test_whole_round_and_reload(spark, tmp_path):
    users, items = ids(spark, "user_id", "user_idx", "ab"), ids(spark, "item_id", "item_idx", "xyz")
    vectors = graph.initial_vectors(spark.range(5).withColumnRenamed("id", "node"), 4, 5)
    past = spark.createDataFrame([(0, 0, 5.0), (1, 2, 2.0)], "user_idx long, item_idx long, rating double")
    empty = spark.createDataFrame([], "seq long, user_idx long, item_idx long, rating double")
    state = I.ModelState(users, items, vectors, past, empty)
    batch = spark.createDataFrame([("a", "x", 1, 0), ("c", "w", 4, 1), ("b", "x", 3, 2)],
                                  "user_id string, item_id string, rating int, n int")
    new, mix = I.run_incremental(state, batch, 4, ["n"])
    assert new.version == 1 and new.users.count() == 3 and new.items.count() == 4
    assert {r["item_id"]: r["item_idx"] for r in new.items.collect()}["w"] == 3
    assert {(r[0], r[1]): r[2] for r in new.interactions.collect()} == {(0, 0): 1.0, (1, 2): 2.0, (2, 3): 4.0, (1, 0): 3.0}
    assert new.vectors.count() == 7
    old_rows = {r["node"]: r["v"] for r in vectors.collect()}
    rows = {r["node"]: r["v"] for r in new.vectors.collect()}
    assert rows[0] == old_rows[0] and rows[3] == old_rows[2]
    assert mix.filter("origin = 'new'").count() == 3 and mix.filter("origin = 'replay'").count() == 1
    assert new.replay.count() == 2 + 3  # the rows of the first version stay in the buffer
    folder = new.save(str(tmp_path))
    back = I.ModelState.load(spark, folder, 1)
    assert back.replay.count() == 5 and back.users.exceptAll(new.users).count() == 0


def test_repeated_stream_batch_gives_the_same_tables(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([("b", "x", 5), ("a", "y", 3)], "user_id string, item_id string, rating int")
    two = spark.createDataFrame([("c", "x", 5), ("a", "w", 3)], "user_id string, item_id string, rating int")
    batches.process_batch(one, 0, root)
    batches.process_batch(two, 1, root)
    users = batches.id_logs(spark, root)[0]
    first = sorted(map(tuple, users.table().collect()))
    batches.process_batch(two, 1, root)
    assert sorted(map(tuple, users.table().collect())) == first == [("a", 0), ("b", 1), ("c", 2)]
    assert spark.read.parquet(f"{root}/encoded").count() == 4


def test_content_key_depends_on_order_and_model(spark):
    df = spark.range(50).select(F.col("id").alias("i"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    key = lambda d, m="m", g=8: stats.content_key(d, "i", "k", m, g).first()[0]
    assert key(df) == key(df.repartition(3))
    swapped = df.withColumn("i", F.when(F.col("i") == 0, 1).when(F.col("i") == 1, 0).otherwise(F.col("i")))
    assert len({key(df), key(swapped), key(df, "other"), key(df.filter("i < 49"))}) == 4


def test_median_over_counts(spark):
    df = spark.createDataFrame([(u,) for u, n in ((1, 1), (2, 4), (3, 6), (4, 9)) for _ in range(n)], "u long")
    row = stats.per_key_spread(df, "u").first()
    assert (row["min_n"], row["median_n"], row["max_n"]) == (1, 5.0, 9)


def test_incremental_unknown_ids_are_detected(spark):
    batch = spark.createDataFrame([("a",), ("q",), ("q",)], "user_id string")
    assert [r[0] for r in I.detect_new(batch, ids(spark, "user_id", "user_idx", "ab"), "user_id").collect()] == ["q"]
    assert pytest.approx(I.replay_size(100, 0.0)) == 0


def test_history_and_batch_are_joined_once(spark):
    """Both are read from one table that is written once, and hold the rows of the joins."""
    from conftest import SF, plan
    from pomelo.plans import domain as D

    rows = D.with_late(spark, SF)
    for part, mine in ((D.history(spark, SF), "NOT late"), (D.batch(spark, SF), "late")):
        assert "lineitem.parquet" not in plan(part)
        wanted = rows.filter(mine).drop("late")
        assert part.columns == wanted.columns and part.count() == wanted.count() > 0
        assert part.exceptAll(wanted).isEmpty()
