"""Commit log, keyed index and id log: conflicts, repeats, order of batches, and what a batch costs."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from pomelo.sources.commits import CommitLog, Conflict, to_fold
from pomelo.operators.versions import VersionLog
from pomelo.streaming import index
from pomelo.streaming.ids import IdLog

DOCS = "index_name string, doc_id string, kafka_ts timestamp, offset long, partition int, title string"


def versions(spark, rows):
    """(doc, offset) rows; the title tells the version."""
    df = spark.createDataFrame([(f"m{d % 2}", f"d{d}", o, d % 4, f"{d}@{o}") for d, o in rows], "index_name string, doc_id string, offset long, partition int, title string")
    return df.withColumn("kafka_ts", F.timestamp_seconds(F.col("offset"))).select("index_name", "doc_id", "kafka_ts", "offset", "partition", "title")


def titles(df):
    return sorted(r["title"] for r in df.collect())


def newest(rows):
    best = {}
    for d, o in rows:
        best[d] = max(o, best.get(d, -1))
    return sorted(f"{d}@{o}" for d, o in best.items())


def test_one_of_two_writers_wins(spark, tmp_path):
    logs = [CommitLog(spark, str(tmp_path)) for _ in range(4)]
    assert logs[0].latest() == -1
    won, lost = [], []

    def write(k):
        try:
            logs[k].commit(0, {"by": k})
            won.append(k)
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3 and logs[0].read(0) == {"by": won[0]}
    logs[0].commit(1, {"by": 9})
    logs[0].forget(1)
    assert logs[0].numbers() == [1] and [f for f in os.listdir(tmp_path / "_commits") if not f.startswith(".")] == ["000000000001.json"]


def test_parts_of_one_size_are_folded():
    assert to_fold([("a", 1), ("b", 2), ("c", 100)], 3) == []
    assert to_fold([("a", 1), ("b", 2), ("c", 2), ("d", 100)], 3) == [("a", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("seed", range(3))
def test_batches_in_any_order_and_repeated(spark, tmp_path, seed):
    """The newer version may be in the earlier batch."""
    draw = random.Random(seed)
    rows = [(draw.randint(0, 20), o) for o in range(120)]
    batches = [rows[i:i + 20] for i in range(0, 120, 20)]
    draw.shuffle(batches)
    path = str(tmp_path / "index")
    for number, part in enumerate(batches):
        index.write_batch(versions(spark, part), number, path, buckets=2, most_parts=2)
        if number == 3:
            index.write_batch(versions(spark, part), number, path, buckets=2, most_parts=2)  # repeated
            index.write_batch(versions(spark, part), number, path, "another", buckets=2, most_parts=2)  # and by another writer
    assert titles(index.read_index(spark, path)) == newest(rows)


def test_newer_version_in_the_earlier_batch(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_batch(versions(spark, [(1, 50), (2, 51)]), 0, path)
    index.write_batch(versions(spark, [(1, 10), (3, 11)]), 1, path)
    assert titles(index.read_index(spark, path)) == ["1@50", "2@51", "3@11"]


def test_reading_costs_the_same_after_many_batches(spark, tmp_path):
    path, rows = str(tmp_path / "index"), []
    for number in range(12):
        part = [(d, 100 * number + d) for d in range(6)]
        rows += part
        index.write_batch(versions(spark, part), number, path, buckets=1, most_parts=3)
    state = CommitLog(spark, path).read(CommitLog(spark, path).latest())
    assert max(len(v) for v in state["live"].values()) <= 3 and titles(index.read_index(spark, path)) == newest(rows)
    old = index.read_index(spark, path, version=9)
    assert titles(old) == newest(rows[:60])
    index.vacuum(spark, path, keep=1)
    assert titles(index.read_index(spark, path)) == newest(rows)
    live = {p for v in state["live"].values() for p, _ in v}
    assert {f.removeprefix("part=") for f in os.listdir(f"{path}/data")} == live


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_batch(versions(spark, [(d, d) for d in range(200)]), 0, path, buckets=8, most_parts=2)
    before = CommitLog(spark, path).read(0)["live"]
    index.write_batch(versions(spark, [(4, 500)]), 1, path)
    after = CommitLog(spark, path).read(1)["live"]
    assert sum(before[k] != after[k] for k in before) == 1


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_batch(versions(spark, [(1, 1)]).limit(0), 0, path)
    assert index.read_index(spark, path).count() == 0
    index.write_batch(versions(spark, [(1, 1)]), 1, path)
    assert titles(index.read_index(spark, path)) == ["1@1"]


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_ids_of_batches(spark, tmp_path):
    log = IdLog(spark, str(tmp_path / "ids"), "k", "i", buckets=4, most_parts=2)
    draw, seen = random.Random(7), {}
    for number in range(9):
        values = [f"key{draw.randint(0, 60)}" for _ in range(12)]
        for v in sorted(set(values)):
            seen.setdefault(v, len(seen))
        log.extend(keys(spark, [*values, None]), number)
        if number % 3 == 0:
            log.extend(keys(spark, values + ["never seen"]), number)  # a repeated batch is the same; what it holds doesn't matter
        assert log.size() == len(seen)
    assert dict(map(tuple, log.table().collect())) == seen
    some = list(seen)[:3]
    got = dict(map(tuple, log.of(keys(spark, some)).collect()))
    assert all(got[v] == seen[v] for v in some)
    log.vacuum(1)
    assert dict(map(tuple, log.table().collect())) == seen


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_a_small_batch_writes_little_whatever_the_table(spark, tmp_path):
    written = []
    for n in (200, 20_000):
        log = IdLog(spark, str(tmp_path / f"ids{n}"), "k", "i", buckets=8)
        log.extend(keys(spark, [f"old{i}" for i in range(n)]), 0)
        before = size_of(log.path)
        log.extend(keys(spark, [f"new{i}" for i in range(10)] + ["old1"]), 1)
        written.append(size_of(log.path) - before)
        assert log.size() == n + 10
    assert written[0] == pytest.approx(written[1], rel=0.1)


def test_two_writers_of_ids(spark, tmp_path, monkeypatch):
    """A writer that loses looks again, so no key gets two ids and no id two keys."""
    path = str(tmp_path / "ids")
    one, two = IdLog(spark, path, "k", "i"), IdLog(spark, path, "k", "i")
    commit = one._log.commit

    def late(number, content):
        monkeypatch.setattr(one._log, "commit", commit)
        two.extend(keys(spark, ["b", "c"]), 0, "two")
        commit(number, content)

    monkeypatch.setattr(one._log, "commit", late)
    one.extend(keys(spark, ["a", "b"]), 0, "one")
    assert sorted(map(tuple, one.table().collect())) == [("a", 2), ("b", 0), ("c", 1)]
    assert json.loads(json.dumps(one._log.read(1)["batches"])) == {"one": 0, "two": 0}


def model(path, *versions):
    for v in versions:
        os.makedirs(f"{path}/v{v}", exist_ok=True)
        with open(f"{path}/v{v}/table", "w") as file:
            file.write(str(v))


def test_one_writer_of_a_version_wins(spark, tmp_path):
    out = str(tmp_path)
    model(out, 1, 2)
    VersionLog(spark, out).record(1, 0.5, 2)
    VersionLog(spark, out).record(2, 0.6, 2)
    with pytest.raises(Conflict):
        VersionLog(spark, out).record(2, 0.9, 2)
    assert {tuple(r) for r in VersionLog(spark, out).table().collect()} == {(1, 0.5), (2, 0.6)}


def test_a_reader_survives_retention(spark, tmp_path):
    out = str(tmp_path)
    model(out, 1, 2, 3, 4, 9)
    log = VersionLog(spark, out, keep_commits=2)
    log.record(1, 0.5, 1)
    commit, kept = log.pin()
    assert kept == [1]
    log.record(2, 0.6, 1)  # keeps 2 only, but the commit before names 1
    assert os.path.exists(f"{out}/v1/table") and log.pin() == (commit + 1, [2])
    log.record(3, 0.7, 1)
    assert not os.path.exists(f"{out}/v1") and os.path.exists(f"{out}/v2/table")
    log.record(4, 0.1, 1)  # the newest and the best
    assert log.pin()[1] == [3, 4]
    assert os.path.exists(f"{out}/v9/table")  # of a writer that has not recorded it yet
    log.record(1, 0.2, 1, restart=True)
    assert {r["version"] for r in log.table().collect()} == {1}
