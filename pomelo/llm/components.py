"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import TemporaryTables, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return (joined.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(least.select(F.col("m").alias("a"), "b"))
            .distinct())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges`` (a, b); the component is its
    smallest node. Nodes may be of any type with an order; loops and repeated edges do no harm.

    Both steps are equi-joins of the edges with one row per node, so Spark can split a hub that holds
    a large part of the edges. Each round is written to the shared folder; the rounds end when one
    changes nothing, which takes about the logarithm of the longest path.
    """
    edges = (edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
             .distinct())

    def mark(df: DataFrame):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        return row["n"], row["h"]

    with TemporaryTables(edges.sparkSession) as tables:
        edges = materialize(edges, "edges")
        before = mark(edges)
        for _ in range(max_rounds):
            if not before[0]:
                break
            edges = materialize(_small_star(_large_star(edges)), "edges")
            after = mark(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        tables.keep(edges)
    return (edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))


def joined_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more ``links`` (a, b), from the ``known`` ones (node, component).

    The links are drawn between known components first, so only what is new is worked through.
    """
    def end(side: str) -> DataFrame:
        return known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))

    drawn = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(
        "a", "b", F.coalesce("a_part", "a").alias("a_part"), F.coalesce("b_part", "b").alias("b_part"))
    merged = connected_components(drawn.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")))
    old = known.join(merged.select(F.col("node").alias("component"), F.col("component").alias("larger")), "component", "left")
    old = old.select("node", F.coalesce("larger", "component").alias("component"))
    # nodes that no component held before are their own part
    return old.unionByName(merged.join(known.select("node"), "node", "left_anti"))
