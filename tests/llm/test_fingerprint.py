"""Fingerprints against brute force, and their plan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helpers import documents
from pomelo.llm import fingerprint as fp


def brute_edited(rows):
    """(id, edited text) in descending order of id; rows without an id last."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(t) // 2
        out.append((i, t[:len(t) - half] + following[:half]))
    return out


def rows_of(n, seed=1):
    draw = random.Random(seed)
    ids = draw.sample(range(10 * n), n)
    words = ["éa", "b", "cc", "😀d", "e　f"]
    return [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))) for i in ids]


@pytest.mark.parametrize("per_range", [4, 100_000])
def test_edited_texts(spark, monkeypatch, per_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", per_range)
    rows = rows_of(150) + [(-1, None), (-2, ""), (None, "tail of all")]
    got = fp.fingerprints(documents(spark, rows).repartition(6)).collect()
    want = {i: t for i, t in brute_edited(rows)}
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(text[r["doc_id"]] or "")
        assert r["edited_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


@pytest.mark.parametrize("per_range", [2, 100_000])
def test_repeated_ids(spark, monkeypatch, per_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", per_range)
    rows = [(i // 3, f"text number {i} of some") for i in range(30)] + [(4, "same"), (4, "same")]
    got = sorted(r["edited_sha256"] for r in fp.fingerprints(documents(spark, rows)).collect())
    assert got == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in brute_edited(rows))


def test_single_empty_and_idless(spark):
    one = fp.fingerprints(documents(spark, [(1, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert fp.fingerprints(documents(spark, [])).count() == 0
    rows = [(None, "x y"), (None, None)]
    assert fp.fingerprints(documents(spark, rows)).count() == 2


def test_sketch_estimates(spark):
    a, b = [f"w{i}" for i in range(900)], [f"w{i}" for i in range(450, 1350)]
    small = "one two three four five six seven"
    df = spark.createDataFrame([(" ".join(a), " ".join(b), small, small + " eight")], "a string, b string, c string, d string")
    s = {c: fp.sketch(F.col(c)) for c in "abcd"}
    row = df.select(fp.resemblance(s["a"], s["b"]).alias("j"), fp.containment(s["a"], s["b"]).alias("in_b"),
                    fp.distinct_shingles(s["a"]).alias("n"), fp.resemblance(s["c"], s["d"]).alias("exact"),
                    fp.containment(s["c"], s["d"]).alias("whole"), fp.distinct_shingles(s["c"]).alias("three"),
                    (fp.merge(s["a"], s["b"]) == fp.sketch(F.concat_ws(" ", F.lit(" ".join(f"w{i}" for i in range(1350)))))).alias("merged"),
                    F.size(s["a"]).alias("k")).first()
    assert row["j"] == pytest.approx(446 / 1346, abs=0.13) and row["in_b"] == pytest.approx(446 / 896, abs=0.15)
    assert row["n"] == pytest.approx(896, rel=0.3) and row["k"] == fp.K
    assert row["exact"] == 3 / 4 and row["whole"] == 1.0 and row["three"] == 3
    assert row["merged"]


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "a b c d e f"), (2, "a  b\nc d e f"), (3, ""), (4, None), (5, "short one"), (6, "short one")]
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(documents(spark, rows)).collect()}
    assert got[1] == got[2] and got[3] == got[4] == "" and got[5] == got[6] != got[1]
    assert len(got[5]) == 16 and len(got[1]) == 32


def test_plan_has_no_python(spark):
    plan = fp.fingerprints(documents(spark, rows_of(20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
