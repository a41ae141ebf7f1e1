"""Near duplicates and components against brute force."""

import itertools
import random

import pytest

from helpers import components, documents, shingles
from pomelo.llm import minhash
from pomelo.llm.components import connected_components


def edited(words, n, draw):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    rows, number = [], itertools.count()
    for _ in range(40):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(3, 200))]
        rows.append((next(number), " ".join(words)))
        for _ in range(draw.randint(0, 5)):
            rows.append((next(number), " ".join(edited(words, draw.randint(0, 1 + len(words) // 25), draw))))
    family = [f"f{draw.randrange(500)}" for _ in range(120)]
    for _ in range(60):  # one large group of near copies, as chains
        rows.append((next(number), " ".join(family)))
        family = edited(family, 1, draw)
    shared = [f"s{i}" for i in range(60)]
    for _ in range(30):  # many documents share a passage and are no copies
        rows.append((next(number), " ".join(shared + [f"u{draw.randrange(10**6)}" for _ in range(60)])))
    rows += [(next(number), "Same TEXT here"), (next(number), "same text  here"), (next(number), "sAME text\there\n"),
             (next(number), ""), (next(number), None), (next(number), " \n "), (next(number), "ÄPFEL und x"), (next(number), "äpfel und x")]
    draw.shuffle(rows)
    return rows


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2)
             if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    return dict(sets), components([i for i, _ in rows], links)


def test_against_brute_force(spark, corpus):
    sets, found = brute(corpus)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, corpus).repartition(5)).collect()}
    assert len(got) == len(corpus)
    for i, s in sets.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), found[i], found[i] == i)


def test_without_near_copies(spark, corpus):
    _, found = brute(corpus)
    kept = minhash.without_near_copies(documents(spark, corpus))
    assert kept.columns == documents(spark, corpus).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in found if found[i] == i)


def test_edge_cases(spark):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"),
            (7, None), (7, None), (None, None), (9, "x " * 60_000)]
    got = sorted(map(tuple, minhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (7, 0, 7, True), (7, 0, 7, True),
                          (None, 0, None, True), (9, 1, 9, True)], key=str)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert minhash.without_near_copies(documents(spark, rows)).count() == 3 + 1


def test_links_across_components_of_a_bucket(spark):
    """b is like a and like c, which are not alike; c is hub of nothing else."""
    base = [f"w{i}" for i in range(100)]
    draw = random.Random(8)
    rows, words = [], base
    for i in range(12):
        rows.append((i, " ".join(words)))
        words = edited(words, 2, draw)
    _, found = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == found


def test_words_split_at_ascii_space_only():
    assert len(minhash.shingle_set("a b c")) == 1
    assert (minhash.shingle_set("A B c") == minhash.shingle_set("a b\vC")).all()
    assert (minhash.shingle_set("Ä b c") != minhash.shingle_set("ä b c")).any()


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(130)]                # a long path
    links += [(2000, 2001 + i) for i in range(400)] + [(7, 7)]        # a hub, a loop
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for p in links if p[0] != p[1] for n in p}
    assert got == components(nodes, [p for p in links if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [30, 60])
def test_links_at_lower_percentages(spark, percent):
    """Pairs just above the percentage: sets of 100 shingles that share a run of them."""
    rows, shared = [], -(-200 * percent // (100 + percent))
    for i in range(40):
        common = [f"c{i}_{k}" for k in range(shared + 4)]
        rows += [(2 * i + side, " ".join(common + [f"s{i}_{side}_{k}" for k in range(100 - shared)])) for side in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows), percent=percent).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
    assert all(100 * len(shingles(a[1]) & shingles(b[1])) >= percent * len(shingles(a[1]) | shingles(b[1]))
               for a, b in zip(rows[::2], rows[1::2]))


def test_limits_at_75_percent_and_percentages_that_are_too_low(spark):
    assert (minhash.band_rows(75), minhash.least_agreeing(128, 75), minhash.least_agreeing(1024, 75)) == (4, 72, 702)
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            minhash.near_duplicates(documents(spark, [(1, "a")]), percent=percent)
