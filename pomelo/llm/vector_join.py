"""Near duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least ``c`` is a distance of at most ``eps = sqrt(2 - 2 c)``. Pivots,
a bounded sample of the vectors, cut each group of comparable vectors into cells: a vector's home is
the cell of its nearest pivot p. By the triangle inequality every neighbour of a vector at home with
pivot q has ``d(x, q) - d(x, p) <= 2 eps``, so a copy of x goes to each such cell and cells are joined
independently: rows at home against all rows of the cell. A large cell is cut into blocks, and a task
multiplies two blocks; only counts and a spanning forest of the links leave it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import bound_batches
from .components import connected_components

COSINE = 0.93
CELL_ROWS = 2_048
# Smaller groups have the square root of their rows as pivots, but not more than FEW_PIVOTS, since a
# vector may be copied to each; groups of fewer rows than LEAST_ROWS are one cell.
LEAST_ROWS, FEW_PIVOTS = 16, 8
MAX_PIVOTS = 512  # of all groups together: bounds what is broadcast
BLOCK_ROWS = 2_048
SEED = 5
_MARGIN = 1e-9  # added to distances, against rounding


def _unit(values) -> np.ndarray | None:
    """The unit vector in double precision, or None if the vector can't be compared."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x /= np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _units(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, dim, class_id, unit``; the class stands for rows of equal label and vector,
    and is null for vectors that link with nothing."""
    bound_batches(vectors.sparkSession)
    kinds = [vectors.schema[c].dataType.simpleString() for c in (vec_id, label)]

    def run(batches):
        for batch in batches:
            dims, ids, units = [], [], []
            for key, values in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist()):
                x = None if key is None else _unit(values)
                if x is None:
                    dims.append(0), ids.append(None), units.append(None)
                else:
                    raw = repr(key).encode() + b"|" + np.array(values, np.float64).tobytes()
                    dims.append(len(x))
                    ids.append(hashlib.blake2b(raw, digest_size=16).digest())
                    units.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()),
                 pa.array(ids, pa.binary()), pa.array(units, pa.binary())],
                names=["vec_id", "label", "dim", "class_id", "unit"])

    return (vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
            .mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, dim int, class_id binary, unit binary"))


def _pivots(classes: DataFrame) -> dict:
    """Pivot matrices by (label, dim), for groups of several cells; drawn by a hash of the class.

    About one pivot for ``CELL_ROWS`` classes, or in smaller groups as many as the square root of their
    classes up to ``FEW_PIVOTS``; at most about ``MAX_PIVOTS`` in all, of which large groups get theirs
    first. They decide how the work is cut, never what is found.
    """
    groups = (classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_ROWS)
              .withColumn("large", F.when(F.col("n") > CELL_ROWS, F.col("n") / CELL_ROWS).otherwise(0.0))
              .withColumn("more", F.greatest(F.least(F.sqrt("n"), F.lit(float(FEW_PIVOTS))) - F.col("large"), F.lit(0.0))))
    total = groups.agg(F.sum("large").alias("large"), F.sum("more").alias("more")).first()
    if total["large"] is None:
        return {}
    large = min(1.0, MAX_PIVOTS / max(total["large"], 1e-9))
    more = min(1.0, (MAX_PIVOTS - large * total["large"]) / max(total["more"], 1e-9))
    shares = groups.select("label", "dim", ((F.col("large") * large + F.col("more") * more) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64("class_id", F.lit(SEED)), F.lit(2**40)) / float(2**40)
    rows = (classes.join(shares, ["label", "dim"]).filter(draw < F.col("share"))
            .select("label", "dim", "class_id", "unit").orderBy("class_id").limit(2 * MAX_PIVOTS).collect())
    found: dict = {}
    for row in rows:
        found.setdefault((row["label"], row["dim"]), []).append(np.frombuffer(row["unit"], np.float64))
    return {key: np.array(units) for key, units in found.items()}


def _cells(classes: DataFrame, cosine: float) -> DataFrame:
    """``label, dim, cell, home, class_id, n, unit``: each class at home once, and a copy in every
    cell that may hold a neighbour of it."""
    spark = classes.sparkSession
    pivots = spark.sparkContext.broadcast(_pivots(classes))
    reach = 2 * float(np.sqrt(2 - 2 * cosine)) + _MARGIN
    schema = f"label {classes.schema['label'].dataType.simpleString()}, dim int, cell int, home boolean, class_id binary, n long, unit binary"

    def run(batches):
        for batch in batches:
            at, cells, homes = [], [], []
            keys = zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), batch.column("unit"))
            for i, (key, dim, unit) in enumerate(keys):
                around = pivots.value.get((key, dim))
                if around is None:
                    at.append(i), cells.append(0), homes.append(True)
                    continue
                gap = around - np.frombuffer(unit.as_py(), np.float64)
                distance = np.sqrt((gap * gap).sum(axis=1))
                home = int(distance.argmin())
                for cell in np.flatnonzero(distance - distance[home] <= reach):
                    at.append(i), cells.append(int(cell)), homes.append(int(cell) == home)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("label"), rows.column("dim"), pa.array(cells, pa.int32()), pa.array(homes, pa.bool_()),
                 rows.column("class_id"), rows.column("n"), rows.column("unit")],
                names=["label", "dim", "cell", "home", "class_id", "n", "unit"])

    return classes.select("label", "dim", "class_id", "n", "unit").mapInArrow(run, schema)


def _forest(linked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Components of a bipartite graph given as a boolean matrix, as (rows, columns); those with a
    single row and column are left out."""
    out = []
    todo = linked.sum(axis=1) > 1
    while True:
        start = np.flatnonzero(todo)
        if not len(start):
            return out
        rows = np.zeros(linked.shape[0], bool)
        columns = np.zeros(linked.shape[1], bool)
        frontier = np.array([start[0]])
        while len(frontier):
            rows[frontier] = True
            reached = linked[frontier].any(axis=0) & ~columns
            columns |= reached
            frontier = np.flatnonzero(linked[:, reached].any(axis=1) & ~rows)
        todo &= ~rows
        out.append((np.flatnonzero(rows), np.flatnonzero(columns)))


def _joined(cells: DataFrame, cosine: float) -> DataFrame:
    """Rows (class_id, n, other): ``n`` rows linked with a class at home and no ``other``, or an edge
    of a spanning forest."""
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.sum(F.col("home").cast("long")) / BLOCK_ROWS).alias("home_blocks"),
                                    F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")).filter("home_blocks > 0")
    rows = cells.join(sizes, key).withColumn("h", F.xxhash64("class_id"))
    every = F.col("home_blocks") - 1
    as_home = (rows.filter("home").withColumn("x", F.pmod("h", "home_blocks"))
               .withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    as_member = (rows.withColumn("y", F.pmod("h", "blocks"))
                 .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), every))))
    columns = [*key, "x", "y", "class_id", "n", "unit"]
    grid = as_home.select(*columns, F.lit(True).alias("at_home")).unionByName(
        as_member.select(*columns, F.lit(False).alias("at_home")))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        home, other = part[part["at_home"]], part[~part["at_home"]]
        empty = pd.DataFrame({"class_id": [], "n": [], "other": []}, dtype=object)
        if home.empty or other.empty:
            return empty
        a, b = (np.frombuffer(b"".join(p["unit"]), np.float64).reshape(len(p), -1) for p in (home, other))
        linked = a @ b.T >= cosine
        ids, others = home["class_id"].to_numpy(object), other["class_id"].to_numpy(object)
        place = {c: i for i, c in enumerate(others)}
        counted = linked.copy()
        itself = np.array([place.get(c, -1) for c in ids])
        known = np.flatnonzero(itself >= 0)
        counted[known, itself[known]] = False
        linked[known, itself[known]] = True
        n = counted @ other["n"].to_numpy(np.int64)
        some = n > 0
        out = [pd.DataFrame({"class_id": ids[some], "n": n[some], "other": None})]
        linked[~some] = False
        for p, q in _forest(linked | counted) if some.any() else []:
            members = sorted({*ids[p], *others[q]})
            out.append(pd.DataFrame({"class_id": members[0], "n": 0, "other": members[1:]}))
        # a row at home with one link, not to itself
        single = np.flatnonzero(some & (linked.sum(axis=1) == 1))
        if len(single):
            out.append(pd.DataFrame({"class_id": ids[single], "n": 0, "other": others[linked[single].argmax(axis=1)]}))
        return pd.concat(out, ignore_index=True)

    return grid.groupBy(*key, "x", "y").applyInPandas(join, "class_id binary, n long, other binary")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their labels are equal and not null, they have as many components, and their
    cosine in double precision is at least ``cosine``. Vectors that are null, empty, zero or hold
    null or non-finite components, and vectors without a label, link with nothing and are their own
    component. Equal vectors are joined as one class, so thousands of copies cost one row; they count
    as links of each other, and so do repeated rows. ``component_id`` is the smallest id reachable; a
    row without an id links as any other but gives no name. An empty table gives an empty result.
    """
    rows = materialize(_units(vectors, vec_id, embedding, label), "units")
    usable = rows.filter("class_id IS NOT NULL")
    classes = materialize(usable.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("unit").alias("unit")), "classes")
    found = materialize(_joined(materialize(_cells(classes, cosine), "cells"), cosine), "links")
    counts = found.filter("other IS NULL").groupBy("class_id").agg(F.sum("n").alias("others"))
    edges = found.filter("other IS NOT NULL").select(F.col("class_id").alias("a"), F.col("other").alias("b"))
    component = connected_components(edges).withColumnRenamed("node", "class_id")
    named = classes.select("class_id", "n", "first_id").join(component, "class_id", "left").join(counts, "class_id", "left")
    names = (named.filter("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("smallest")))
    own = named.join(names, "component", "left").select(
        "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("smallest", "first_id").alias("component_id"))
    linked = usable.select("vec_id", "class_id").join(own, "class_id").select("vec_id", "n_links", "component_id")
    alone = rows.filter("class_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                   F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
