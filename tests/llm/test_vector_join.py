"""The vector join against brute force."""

import itertools

import numpy as np
import pytest

from helpers import components
from pomelo.llm import vector_join

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, cell int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "u", 1, 2)
                                  for i, v, y in rows], SCHEMA)


def brute(rows, cosine=0.93):
    usable = {}
    for k, (i, v, y) in enumerate(rows):
        if y is not None and v and all(x is not None for x in v):
            x = np.array(v, np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                usable[k] = (x / np.sqrt((x * x).sum()), y)
    links = [(a, b) for a, b in itertools.combinations(usable, 2)
             if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] >= cosine]
    names = [i for i, _, _ in rows]
    found = components(range(len(rows)), links)
    smallest = {}
    for k, c in found.items():
        smallest[c] = min(smallest.get(c, names[k]), names[k])
    out = []
    for k, i in enumerate(names):
        n = sum(k in pair for pair in links)
        out.append((i, n, smallest[found[k]], smallest[found[k]] == i))
    return sorted(out)


def rows_of(n=400, dim=12, seed=1):
    draw = np.random.default_rng(seed)
    rows, centers = [], draw.normal(size=(12, dim))
    for i in range(n):
        kind = i % 4
        base = centers[draw.integers(12)] if kind else draw.normal(size=dim)
        rows.append((i, (base + draw.normal(scale=0.02 + 0.15 * draw.random(), size=dim)).tolist(), int(draw.integers(3))))
    near = draw.normal(size=dim)  # a third of all rows: one group of near copies
    rows += [(n + i, (near + draw.normal(scale=0.03, size=dim)).tolist(), 1) for i in range(n // 2)]
    rows += [(5000 + i, [1.0] * dim, 2) for i in range(30)]  # exact copies
    return rows


@pytest.mark.parametrize("cell_rows,block_rows", [(40, 16), (100_000, 100_000)])
def test_against_brute_force(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(vector_join, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vector_join, "BLOCK_ROWS", block_rows)
    rows = rows_of()
    got = sorted(map(tuple, vector_join.near_vectors(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0], 1), (2, [1, 0], 1), (2, [1, 0], 1), (3, [2, 0.1], 1), (4, [1, 0], 2), (5, [1, 0], None),
            (6, None, 1), (7, [], 1), (8, [0, 0], 1), (9, [nan, 1], 1), (10, [inf, 1], 1), (11, [None, 1], 1),
            (12, [1, 0, 0], 1), (13, [-1, 0], 1), (14, [1e-30, 0], 1), (15, [1e30, 0], 1)]
    assert sorted(map(tuple, vector_join.near_vectors(frame(spark, rows)).collect())) == brute(rows)
    assert vector_join.near_vectors(frame(spark, [])).count() == 0
    nameless = vector_join.near_vectors(frame(spark, [(None, [1, 0], 1), (3, [1, 0], 1)])).collect()
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in nameless) == [(1, 3, False), (1, 3, True)]


def test_every_neighbour_is_in_the_home_cell(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "CELL_ROWS", 30)
    units = vector_join._units(frame(spark, rows_of(seed=2)), "vec_id", "embedding", "label").filter("class_id IS NOT NULL")
    classes = units.selectExpr("class_id", "1L AS n", "label", "dim", "unit").dropDuplicates(["class_id"])
    cells = vector_join._cells(classes, 0.93).collect()
    homes = {bytes(r["class_id"]): (r["label"], r["cell"]) for r in cells if r["home"]}
    members = {(r["label"], r["cell"], bytes(r["class_id"])) for r in cells}
    units = {bytes(r["class_id"]): (r["label"], np.frombuffer(r["unit"])) for r in cells}
    assert len(homes) == len(units) and len({c for c in homes.values()}) > 3
    for a, b in itertools.permutations(units, 2):
        if units[a][0] == units[b][0] and units[a][1] @ units[b][1] >= 0.93:
            assert (*homes[a], b) in members


def test_small_groups_have_pivots(spark):
    rows = rows_of(n=200, seed=3)
    units = vector_join._units(frame(spark, rows), "vec_id", "embedding", "label").filter("class_id IS NOT NULL")
    classes = units.selectExpr("class_id", "1L AS n", "label", "dim", "unit").dropDuplicates(["class_id"])
    assert {len(p) > 1 for p in vector_join._pivots(classes).values()} == {True}
    assert len(vector_join._pivots(classes)) == 3
    assert sorted(map(tuple, vector_join.near_vectors(frame(spark, rows)).collect())) == brute(rows)
