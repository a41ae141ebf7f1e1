"""Line dedup against a plain loop, its plan, and odd tables."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import documents, lower_ascii
from pomelo.llm import line_dedup as ld

WHITE = " \t\n\x0b\f\r"


def brute(rows, least=10):
    """Multiset of (doc_id, n_lines, n_dropped, digest)."""
    key = lambda line: lower_ascii(line.strip(WHITE))
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least and (k not in first or rank(i) < rank(first[k])):
                first[k] = i
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())


LINES = ["", "short", "A line that is long enough", "a LINE that is long enough  ", "\t another line, much the same\x0b", "Ünï line with accents",
         "ünï line with accents", "ÜNï LINE with accents", "ten chars!", "nine char", "\x85 not white space, that one", "\r", "license MIT, all rights"]


def rows_of(n, seed=1):
    draw = random.Random(seed)
    return [(i, "\n".join(draw.choice(LINES + [f"own line of {i} number {k}" for k in range(4)]) for _ in range(draw.randint(0, 9)))) for i in draw.sample(range(5 * n), n)]


def test_against_a_plain_loop(spark):
    rows = rows_of(400)
    assert result(ld.line_digests(documents(spark, rows).repartition(7))) == brute(rows)


def test_odd_rows(spark):
    line = "the very same line in all of them"
    rows = [(None, line), (None, "and one more line without an id"), (5, line), (5, line), (5, line + "\nother text, same id here"), (7, None), (8, ""),
            (9, line + "\n" + line), (3, "and one more line without an id\n" + line), (4, "\n" * 5), (10, "x" * 200_000 + "\n" + "x" * 200_000), (11, "x" * 200_000)]
    assert result(ld.line_digests(documents(spark, rows))) == brute(rows)
    assert ld.line_digests(documents(spark, [])).count() == 0


def test_long_documents_and_bitmaps(spark):
    shared = [f"a shared line with number {i}" for i in range(1000)]
    rows = [(1, "\n".join(shared[::7])), (2, "\n".join(shared + ["its own last line, long"])), (3, "\n".join(["short"] * 300 + shared[500:]))]
    docs = documents(spark, rows)
    assert result(ld.line_digests(docs)) == brute(rows)
    maps = {r["doc_id"]: r for r in ld.keep_bitmaps(docs).collect()}
    assert set(maps) == {2, 3}
    assert [w["word"] for w in maps[3]["keep"]] == list(range(300 // 64, 800 // 64 + 1))  # words that keep all are left out
    assert maps[2]["n_dropped"] == len(shared[::7]) and maps[3]["n_dropped"] == 500


@pytest.mark.parametrize("least", [1, 10, 40])
def test_other_least_lengths(spark, least):
    rows = rows_of(60, 3)
    assert result(ld.line_digests(documents(spark, rows), least_chars=least)) == brute(rows, least)


def test_hot_lines_are_spread(spark, monkeypatch):
    rows = [(i, f"one line that all of them share\nown line of document {i}") for i in range(3000)]
    docs = documents(spark, rows)
    assert ld._hot(ld.line_hashes(docs, "doc_id", "text", 10)).count() == 1
    assert result(ld.line_digests(docs)) == brute(rows)
    monkeypatch.setattr(ld, "HOT_SHARE", 2.0)  # none is hot
    assert result(ld.line_digests(docs)) == brute(rows)


def test_texts_and_columns_stay(spark):
    docs = documents(spark, [(1, "a line of some length\nb"), (2, "A line of some length\nc")])
    docs = docs.withColumn("a.b", F.lit("dot")).withColumn("_doc", F.lit(1)).withColumn("keep", F.lit(2)).withColumn("n_lines", F.lit(3)).withColumn("text_hash", F.lit(4))
    done = ld.dedup_lines(docs)
    got = {r["doc_id"]: r for r in done.collect()}
    assert set(done.columns) == set(docs.columns) | {"n_dropped"}
    assert got[1]["text"] == "a line of some length\nb" and got[2]["text"] == "c"
    assert got[2]["a.b"] == "dot" and got[2]["keep"] == 2 and got[2]["n_lines"] == 2 and got[2]["n_dropped"] == 1


def test_plan_has_no_python_and_one_shuffle_of_hashes(spark):
    docs = documents(spark, rows_of(20))
    text = ld.keep_bitmaps(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "Cartesian"))
    assert text.count("rangepartitioning(_h1") == 1 and "hashpartitioning(_h1" not in text.split("BroadcastExchange")[0]
