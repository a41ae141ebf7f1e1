"""Toxicity and quality: held-out accuracy, pairs of terms, bounds and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from helpers import documents
from pomelo.llm import labelled, quality, toxicity

LARGER = "/root/testdata/sf0.1"


def judged(spark, run, column, folder=LARGER):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return run(docs, docs, labels).join(labels, "doc_id").filter(f"held_out AND {column} IS NOT NULL").select(
        "score", "predicted", F.col(column).alias("y")).toPandas()


def test_toxicity_on_the_held_out_fold(spark):
    rows = judged(spark, toxicity.toxicity, "toxic")
    toxic, clean = rows[rows.y == 1], rows[rows.y == 0]
    assert (toxic.predicted == 1).mean() > 0.8 and (clean.predicted == 1).mean() < 0.01
    assert rows.score.between(0, 1).all()


def test_quality_on_the_held_out_fold(spark):
    rows = judged(spark, quality.quality, "quality")
    good, poor = rows[rows.y == 1], rows[rows.y == 0]
    assert (good.predicted == 1).mean() > 0.99 and (poor.predicted == 0).mean() > 0.8


def test_factorization_learns_a_pair():
    """Neither an insult nor a group alone is toxic here; both together are."""
    draw = random.Random(1)
    rows, labels = [], []
    for _ in range(4000):
        words = [f"w{draw.randrange(400)}" for _ in range(30)]
        insult, group = draw.random() < 0.4, draw.random() < 0.4
        words += ["vilest"] * insult + ["zorblings"] * group
        rows.append(" ".join(words))
        labels.append(int(insult and group))
    model = toxicity.fit([toxicity.terms(t).tobytes() for t in rows[:3000]], labels[:3000])
    p = toxicity.score(model, rows[3000:]) >= 0.5
    y = np.array(labels[3000:]) == 1
    assert (p == y).mean() > 0.98
    alone, both = toxicity.score(model, ["w1 vilest w2"])[0], toxicity.score(model, ["w1 vilest zorblings w2"])[0]
    assert both > 0.7 > 0.5 > alone


def test_scores_do_not_depend_on_batches():
    texts = [f"w{i} " * (i % 7) for i in range(50)] + [""]
    model = toxicity.fit([toxicity.terms(f"bad{i % 3} w{i}" if i % 2 else f"w{i} x").tobytes() for i in range(60)], [i % 2 for i in range(60)])
    one = np.concatenate([toxicity.score(model, [t]) for t in texts])
    assert toxicity.score(model, texts) == pytest.approx(one, abs=1e-12)


def test_pooling_in_stretches(monkeypatch):
    ids = quality.units(" ".join(f"w{i % 50}" for i in range(1000)))
    vectors = quality.word_vectors([ids])
    whole = quality.pooled(ids, vectors)
    monkeypatch.setattr(quality, "STRETCH", 7)
    assert quality.pooled(ids, vectors) == pytest.approx(whole, abs=1e-5)


def test_the_fold_and_labels_stay_apart(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)] + [(5, None), (None, 1), (6, 1), (6, 0)], "doc_id long, toxic int")
    rows = labelled.training_ids(labels, "toxic", {1: 10**6, 0: 10**6}).collect()
    want = {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    assert {r["y"] for r in rows if r["doc_id"] == 6} <= {1}
    few = labelled.training_ids(labels, "toxic", {1: 40, 0: 60})
    assert 40 <= few.count() <= 160


@pytest.mark.parametrize("run,score", [(toxicity.toxicity, 0.0), (quality.quality, 1.0)])
def test_without_labels_and_with_odd_rows(spark, run, score):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 50_000), (4, "!!! ### |")]
    docs = documents(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = run(docs, docs, none).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {score}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    got = run(docs, docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert run(docs.limit(0), docs, labels).count() == 0


def test_filters_keep_whole_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("score", F.lit("own")).withColumn("row", F.lit(1))
    for keep, judge, wanted in ((toxicity.clean, toxicity.toxicity, 0), (quality.good, quality.quality, 1)):
        kept = keep(docs, docs, labels)
        assert kept.columns == docs.columns
        want = {r["doc_id"] for r in judge(docs, docs, labels).filter(f"predicted = {wanted}").collect()}
        assert {r["doc_id"] for r in kept.collect()} == want


def naive_toxicity(packed, text):
    """Bias, weights and the sum over all pairs of terms, one by one."""
    import math
    bias, hashes, w, v = toxicity._model(packed)
    place = {int(h): i for i, h in enumerate(hashes)}
    words = set(toxicity._WORD.findall(text.lower()))
    hashed = {toxicity.xxhash.xxh32_intdigest(t, toxicity.SEED) for x in words for t in [x, *(x[:n] + "*" for n in toxicity.PREFIXES if len(x) > n)]}
    at = [place[h] for h in hashed if h in place]
    z = bias + sum(float(w[i]) for i in at)
    for k, i in enumerate(at):
        for j in at[:k]:
            z += sum(float(x) * float(y) for x, y in zip(v[i], v[j]))
    return 1 / (1 + math.exp(-z))


def naive_quality(packed, text):
    """Pooling token by token and the network unit by unit."""
    import math
    center, scale, (w1, b1, w2, b2), temperature, vectors = quality._model(packed)
    ids = quality.units(text).tolist()
    d, index = vectors.shape[1], quality._index_vectors()
    x = np.zeros(3 * d + quality.EXTRA)
    if ids:
        own = [vectors[i // quality.SHAPES] for i in ids]
        known = [bool(o.any()) for o in own]
        own = [(o if k else vectors[quality.BUCKETS + i % quality.SHAPES]).astype(float) for o, k, i in zip(own, known, ids)]
        for c in range(d):
            column = [o[c] for o in own]
            mean = sum(column) / len(ids)
            x[c], x[d + c] = mean, math.sqrt(max(0.0, sum(y * y for y in column) / len(ids) - mean * mean))
            x[2 * d + c] = sum(p * q for p, q in zip(column[1:], column)) / len(ids)
        words = [i // quality.SHAPES for i in ids]
        same = sum(p == q for p, q in zip(words[1:], words)) / (len(ids) - 1) if len(ids) > 1 else 0.0
        length = math.sqrt(sum((sum(float(index[k][c]) for k in words) / len(ids)) ** 2 for c in range(d)) / quality.NONZEROS)
        x[3 * d:] = sum(known) / len(ids), same, length
    x = np.clip((x - center) / scale, -8, 8)
    hidden = [max(0.0, float(b1[k]) + sum(float(a) * float(b) for a, b in zip(x, w1[:, k]))) for k in range(len(b1))]
    return 1 / (1 + math.exp(-(sum(h * float(a) for h, a in zip(hidden, w2)) + float(b2[0])) / temperature))


@pytest.mark.parametrize("run,learn,naive,column,tolerance", [
    (toxicity.toxicity, toxicity.learn, naive_toxicity, "toxic", 1e-5), (quality.quality, quality.learn, naive_quality, "quality", 1e-4)])
def test_scores_equal_a_naive_computation(spark, run, learn, naive, column, tolerance):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    packed = learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in run(docs, docs, labels).collect()}
    short = [r for r in docs.collect() if len(r["text"] or "") < 4_000][:100]
    assert packed is not None and len(short) > 50
    for r in short:
        assert got[r["doc_id"]] == pytest.approx(naive(packed, r["text"] or ""), abs=tolerance)
