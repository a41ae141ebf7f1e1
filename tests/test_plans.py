"""The plans are the ones meant: no single-task steps over data, pruned scans, bounded groups."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF, plan
from pomelo.operators import clean, encode, evaluate, graph
from pomelo.plans import domain as D
from pomelo.plans.catalog import REGISTRY


def test_semi_joins_and_pruned_scans(spark):
    df = clean.join_and_clean(D.reviews(spark, SF), clean.domain_filter(D.businesses(spark, SF), ("economy",)))
    text = plan(df.select("review_id", "user_id"))
    assert "LeftSemi" in text and "PushedFilters" in text
    part = next(line for line in text.splitlines() if "part.parquet" in line)
    assert "p_retailprice" not in part.split("ReadSchema")[1]
    assert "l_tax" not in text


@pytest.mark.parametrize("build", [
    lambda s: clean.latest_row(D.reviews(s, SF), ["user_id", "item_id"], [F.col("date").desc(), F.col("review_id").desc()]),
    lambda s: graph.sample_neighbours(D.prepared(s, SF).graph(), D.prepared(s, SF).user_ids.select(F.col("user_idx").alias("node")), (5,)),
])
def test_group_limits_run_before_the_shuffle(spark, build):
    assert re.search(r"WindowGroupLimit .*Partial", plan(build(spark)))


def test_no_query_uses_a_cross_join(spark):
    for name in ("known_user_top_k", "popularity_baseline", "random_baseline", "nearest_items", "score_evaluation",
                 "split_parts", "rating_distribution", "trial_ranking", "cold_start_top_k"):
        text = plan(REGISTRY[name].run(spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_metrics_group_hits_with_partial_sums(spark):
    p = D.prepared(spark, SF)
    ranked = p.part("test").select("user", "item", F.lit(1).alias("rank"))
    assert "partial_sum" in plan(evaluate.user_metrics(ranked, p.part("test")))


def hot(spark, n=60_000):
    """Edges of which a third leave one node and a third enter another."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("src"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 700).alias("dst"))


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_partitions(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    old = {k: spark.conf.get(k, None) if k == "spark.sql.adaptive.autoBroadcastJoinThreshold" else spark.conf.get(k)
           for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_source_is_split_over_tasks(spark, small_partitions):
    vectors = spark.range(700).select(F.col("id").alias("node"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"))
    out = graph.sum_messages(hot(spark).repartition(8), vectors, 2)
    assert "skew=true" in executed(out)
    total = out.agg(F.sum(F.col("m")[1])).first()[0]
    assert total == 60_000


def test_hot_user_is_split_when_ids_are_joined(spark, small_partitions):
    edges = hot(spark).repartition(8).select(F.col("src").alias("user_id"), "dst")
    dim = encode.dense_ids(edges, "user_id", "user_idx")
    out = encode.transform_ids(edges, dim, "user_id", "user_idx")
    assert "skew=true" in executed(out) and out.count() == 60_000


def test_softmax_over_a_hot_destination_needs_no_window(spark):
    scored = hot(spark).withColumn("e", F.col("src") * 0.001)
    text = plan(graph.edge_softmax(scored))
    assert "Window" not in text and "partial_max" in text and "partial_sum" in text


def test_filters_reach_the_scan(spark, tmp_path):
    D.reviews(spark, SF).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert "GreaterThanOrEqual(rating,3)" in plan(clean.rating_filter(stored, 3))
    text = plan(D.prepared(spark, SF).part("test"))
    assert "PartitionFilters: [isnotnull(split" in text


def test_whole_ratings_by_either_comparison(spark):
    df = spark.createDataFrame([(None,), (0.5,), (2.9,), (3.0,), (4.2,)], "rating double")
    for threshold in (0, 1, 3, 2.5):
        slow = df.filter(clean.whole_rating("rating") >= threshold)
        assert clean.rating_filter(df, threshold).exceptAll(slow).count() == 0
        assert clean.rating_filter(df, threshold).count() == slow.count()


def test_a_large_csv_is_read_by_several_tasks(spark, tmp_path):
    from pomelo.sources import reviews as review_files
    path = str(tmp_path / "c")
    spark.range(200_000).selectExpr("id AS review_id", "id AS user_id", "id AS business_id", "'3.0' AS stars", "'2020-01-01' AS date") \
        .coalesce(1).write.option("header", "true").csv(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = review_files.read_reviews(spark, path)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 200_000
        assert review_files.read_reviews(spark, path, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_given_degrees_are_used(spark):
    edges = graph.both_directions(hot(spark, 600).filter("src != dst").distinct())
    vectors = spark.range(700).select(F.col("id").alias("node"), F.array(F.col("id") * 0.1, F.lit(1.0)).alias("v"))
    degree = graph.degrees(edges).withColumn("degree", F.lit(1))
    own = {r["node"]: r["v"] for r in graph.lightgcn(vectors, edges, 2).collect()}
    other = {r["node"]: r["v"] for r in graph.lightgcn(vectors, edges, 2, degree=degree).collect()}
    assert own != other
