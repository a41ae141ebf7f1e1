"""Sketches of batches merge to those of their union, within their bounds."""

import pytest
from pyspark.sql import functions as F

from pomelo.operators import sketches


def rows(spark, start, stop):
    return spark.range(start, stop).select((F.col("id") % 7000).alias("k"), F.concat(F.lit("s"), F.col("id") % 40).alias("s"), (F.col("id") % 1000).alias("x"))


def read(sketch):
    return {(r["measure"], r["column"], r["at"]): r["estimate"] for r in sketches.estimates(sketch).collect()}


def test_merged_batches_equal_one_pass(spark):
    parts = [rows(spark, a, a + 10_000) for a in range(0, 40_000, 10_000)]
    one = read(sketches.batch_sketch(rows(spark, 0, 40_000), ["k", "s"], ["x"]))
    kept = sketches.batch_sketch(parts[0], ["k", "s"], ["x"])
    for p in parts[1:]:
        kept = kept.unionByName(sketches.batch_sketch(p, ["k", "s"], ["x"]))
    many = read(sketches.merged(kept))
    assert many[("rows", None, None)] == one[("rows", None, None)] == 40_000
    assert many[("distinct", "k", None)] == one[("distinct", "k", None)] == pytest.approx(7000, rel=0.05)
    assert many[("distinct", "s", None)] == pytest.approx(40, abs=1)
    for q in (0.25, 0.5, 0.75):
        ranks = sketches.rank_range(rows(spark, 0, 40_000), "x", many[("quantile", "x", q)]).first()
        assert ranks["below"] - 0.02 <= q <= ranks["upto"] + 0.02


def test_nulls_and_empty_batches(spark):
    none = rows(spark, 0, 0)
    found = read(sketches.merged(sketches.batch_sketch(none, ["k"], ["x"]).unionByName(sketches.batch_sketch(rows(spark, 0, 10), ["k"], ["x"]))))
    assert found[("rows", None, None)] == 10 and found[("distinct", "k", None)] == 10
    assert read(sketches.batch_sketch(none, ["k"], ["x"]))[("rows", None, None)] == 0
