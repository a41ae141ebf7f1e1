import random

from pyspark.sql import functions as F

from conftest import plan
from pomelo.operators import encode, ordering, split, subset


def skewed(spark, n=30_000, seed=3):
    """A third of all rows on one day, the rest over few days."""
    rng = random.Random(seed)
    rows = [(i, 5 if rng.random() < 0.34 else rng.randrange(40)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, d int").withColumn(
        "date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).repartition(6)
    return df, sorted(rows, key=lambda r: (r[1], r[0]))


def test_row_index_equals_sorted_position(spark):
    df, rows = skewed(spark)
    out = ordering.with_row_index(df.select("d", "id"), ["d", "id"]).collect()
    got = [(r["id"], r["d"]) for r in sorted(out, key=lambda r: r["row_idx"])]
    assert got == rows
    assert sorted(r["row_idx"] for r in out) == list(range(len(rows)))


def test_row_index_spreads_a_hot_value(spark):
    df, _ = skewed(spark)
    ranged = df.repartitionByRange(8, "d", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranged.collect()) < 0.34 * 30_000


def test_cutoffs_inside_a_hot_bucket(spark, monkeypatch):
    df, rows = skewed(spark)
    wanted = [1, 7_000, 15_000, 29_999, 30_000]
    for limit in (10, 10_000_000):  # through the row index, and through the sort-limit
        monkeypatch.setattr(ordering, "SORT_LIMIT_ROWS", limit)
        cuts = ordering.order_cutoffs(df, ["d", "id"], F.col("d"), lambda n: wanted)
        assert [(c["id"], c["d"]) for c in cuts] == [rows[p - 1] for p in wanted]


def test_temporal_split_has_exact_sizes_and_order(spark):
    df, rows = skewed(spark)
    out = split.temporal_split(df, ["id"])
    assert "SinglePartition" not in plan(out)
    got = {r["id"]: r["split"] for r in out.collect()}
    n = len(rows)
    expected = ["train"] * int(n * 0.7) + ["val"] * (int(n * (0.7 + 0.15)) - int(n * 0.7))
    expected += ["test"] * (n - len(expected))
    assert [got[i] for i, _ in rows] == expected


def test_split_puts_missing_dates_last(spark):
    df = spark.createDataFrame([(1, None), (2, "2020-01-02"), (3, "2020-01-01"), (4, "2020-01-03")],
                               "id long, date string").withColumn("date", F.to_date("date"))
    got = {r["id"]: r["split"] for r in split.temporal_split(df, ["id"]).collect()}
    assert got == {3: "train", 2: "train", 4: "val", 1: "test"}


def test_random_split_sizes_and_repeatability(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in split.random_split(df, ["k"]).collect()}
    b = {r["k"]: r["split"] for r in split.random_split(df.repartition(3), ["k"]).collect()}
    assert a == b
    sizes = {s: list(a.values()).count(s) for s in ("train", "val", "test")}
    assert sizes == {"train": 700, "val": 150, "test": 151}
    assert split.random_split(df, ["k"], seed=2).exceptAll(split.random_split(df, ["k"])).count() > 0


def test_sampling_large_n_equals_sort(spark, monkeypatch):
    df = spark.range(5_000).withColumnRenamed("id", "k")
    small = {r["k"] for r in split.sample_rows(df, ["k"], 1_234).collect()}
    monkeypatch.setattr(ordering, "SORT_LIMIT_ROWS", 10)
    large = {r["k"] for r in split.sample_rows(df, ["k"], 1_234).collect()}
    assert small == large and len(small) == 1_234
    assert split.sample_rows(df, ["k"], 9_999).count() == 5_000
    assert split.sample_rows(df, ["k"], 0).count() == 0


def test_validation_size():
    assert [split.validation_size(n) for n in (3, 100, 1_000, 10_000)] == [0, 20, 200, 2_000]
    assert [split.validation_size(n, low=10, high=500) for n in (3, 100, 1_000, 10_000)] == [10, 20, 200, 500]


def test_stratified_sample_keeps_one_per_user(spark):
    rows = [(f"r{i}", i % 50, f"2020-01-{1 + i % 28:02d}") for i in range(2_000)]
    df = spark.createDataFrame(rows, "review_id string, user_id long, date string")
    out = subset.stratified_sample(df, 300).collect()
    assert len(out) == 300 and len({r["user_id"] for r in out}) == 50
    assert {r["user_id"] for r in subset.stratified_sample(df, 20).collect()} == set(range(20))


def test_newest_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "seq")
    assert sorted(r["seq"] for r in subset.newest_rows(df, "seq", 7).collect()) == list(range(93, 100))


def test_encoder_keeps_known_ids(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    dim = encode.dense_ids(names("carol", "alice", "bob", "alice"), "name", "idx")
    ids = lambda d: {r["name"]: r["idx"] for r in d.collect()}
    assert ids(dim) == {"alice": 0, "bob": 1, "carol": 2}
    grown = encode.extend_ids(dim, names("dave", "alice"), "name", "idx")
    assert ids(grown) == {"alice": 0, "bob": 1, "carol": 2, "dave": 3}
    again = encode.extend_ids(grown, names("zoe", "abe", "zoe"), "name", "idx")
    assert ids(again)["abe"] == 4 and ids(again)["zoe"] == 5
    assert ids(encode.extend_ids(grown, names("bob"), "name", "idx")) == ids(grown)


def test_unknown_keys(spark):
    import pytest
    dim = spark.createDataFrame([("a", 0), ("b", 1)], "k string, i long")
    df = spark.createDataFrame([("b", 1.0), ("x", 2.0)], "k string, v double")
    assert [r["i"] for r in encode.transform_ids(df, dim, "k", "i").collect()] == [1]
    proxied = {r["v"]: r["i"] for r in encode.transform_ids(df, dim, "k", "i", "proxy").collect()}
    assert proxied == {1.0: 1, 2.0: 0}
    with pytest.raises(Exception, match="unknown k: x"):
        encode.transform_ids(df, dim, "k", "i", "error").collect()


def test_frequency_ids_break_ties_by_key(spark):
    df = spark.createDataFrame([(x,) for x in "ccbbad"], "k string")
    assert {r["k"]: r["i"] for r in encode.frequency_ids(df, "k", "i").collect()} == {"b": 0, "c": 1, "a": 2, "d": 3}


def test_stored_keys_are_not_written_again(spark, monkeypatch):
    df, rows = skewed(spark)
    written = []
    real = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, name, *a, **b: written.append(name) or real(df, name, *a, **b))
    wanted = [1, 7_000, 15_000, 30_000]
    cuts = ordering.order_cutoffs(df, ["d", "id"], F.col("d"), lambda n: wanted, stored=True)
    assert [(c["id"], c["d"]) for c in cuts] == [rows[p - 1] for p in wanted]
    assert "keys" not in written


def test_pairs_split_by_key_are_those_split_by_id(spark, monkeypatch):
    rng = random.Random(4)
    reviews = spark.createDataFrame(
        [(f"r{i}", rng.randrange(-20, 40) * 7, rng.randrange(30), rng.randrange(1, 6)) for i in range(3000)],
        "review_id string, user_id long, item_id long, rating int").withColumn(
        "date", F.date_add(F.lit("2020-01-01").cast("date"), (F.xxhash64("review_id") % 50).cast("int")))
    # some users are unknown, and the items from 25 on; user -140 has met no other items
    reviews = reviews.filter("user_id <> -140 OR item_id >= 25")
    users, items = spark.range(-300, 200).withColumnRenamed("id", "user_id"), spark.range(25).withColumnRenamed("id", "item_id")
    by_key = lambda pairs: split.temporal_split(pairs, ["user_id", "item_id"], stored=True)
    for limit in (0, encode.V.BROADCAST_BYTES):
        monkeypatch.setattr(encode.V, "BROADCAST_BYTES", limit)
        got, user_ids, item_ids = encode.preprocess(reviews, users, items, 3, by_key)
        edges, _, _ = encode.preprocess(reviews, users, items, 3)
        old = split.temporal_split(edges, ["user_idx", "item_idx"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.collect()))
        kept = reviews.filter("rating >= 3 AND user_id < 200 AND item_id < 25")
        for ids, key, idx in ((user_ids, "user_id", "user_idx"), (item_ids, "item_id", "item_idx")):
            assert [tuple(r) for r in ids.orderBy(idx).select(key, idx).collect()] == [
                (r[0], n) for n, r in enumerate(kept.select(key).distinct().orderBy(key).collect())]
        assert got.count() == kept.select("user_id", "item_id").distinct().count()
