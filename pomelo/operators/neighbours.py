"""Approximate nearest neighbours by seeded hyperplanes, with exact scores.

An index is a number of tables; in each, the signs of a vector's dot products with a few hyperplanes
name its bucket. A query looks into its own bucket and into those that it is nearest to: the ones that
differ in the signs of its smallest products. Only vectors are sent: queries and members are cut into blocks, a block of queries stays
in one task, and blocks of members come to it. There both find their buckets, so no vector travels once per
bucket, and only pairs that share a probed bucket are looked at. None is capped, and only the best of a query become rows.
Scores are exact; only members that share no probed bucket can be missed.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V
from ..functions.hashing import xavier_matrix
from ..session import materialize
from .scoring import SCORE_CELLS, _Best, _block, _met_blocks, _packed, _score_blocks, _sorted_matrix, at_once

TABLES, BITS, PROBES, MOST_FLIPS = 12, 8, 32, 2
BLOCK = 8_192


def masks(bits: int, most: int = MOST_FLIPS) -> list[tuple[int, list[int]]]:
    """Sets of up to ``most`` signs that a probe may turn, as a number and as positions."""
    return [(sum(1 << i for i in chosen), list(chosen)) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def _products(rows: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    return (rows @ planes.T).reshape(len(rows), tables, bits)


def _codes(products: np.ndarray) -> np.ndarray:
    """Bucket number in each table."""
    return ((products > 0) << np.arange(products.shape[2])).sum(axis=2)


def _probed(products: np.ndarray, probes: int) -> np.ndarray:
    """Bucket numbers that a query looks into: its own and those that cost least, the sum of the sizes of
    the products whose signs are turned; ties go to the smaller set."""
    each = sorted(masks(products.shape[2]))
    size = np.abs(products)
    cost = np.stack([size[:, :, at].sum(axis=2) for _, at in each], axis=2)
    cheapest = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    return _codes(products)[:, :, None] ^ np.array([mask for mask, _ in each])[cheapest]


class _BestProbed(_Best):
    """Best K members so far among those that share a probed bucket with a query."""

    def __init__(self, row, k: int, planes: np.ndarray, tables: int, bits: int, probes: int, itself: bool) -> None:
        super().__init__(row, k)
        self.planes, self.shape, self.itself = planes, (tables, bits), itself
        probed = _probed(_products(self.users, planes, tables, bits), probes)
        self.looks = np.zeros((tables, len(self.users), 1 << bits), dtype=bool)
        for t in range(tables):
            self.looks[t][np.arange(len(self.users))[:, None], probed[:, t]] = True

    def add(self, row) -> None:
        ids, rows = _sorted_matrix(row.i_ids, row.i_mat)
        same = np.concatenate(([False], ids[1:] == ids[:-1])) if len(ids) else np.empty(0, dtype=bool)
        own = np.empty(0, dtype=np.int64) if self.itself else ids[~np.isin(ids, ids[same])]
        while len(ids):
            # members of one number take turns, so that a pair is met once at a time
            now = np.concatenate(([True], ids[1:] != ids[:-1]))
            self._meet(ids[now], rows[now], own)
            ids, rows = ids[~now], rows[~now]

    def _meet(self, ids: np.ndarray, items: np.ndarray, own: np.ndarray) -> None:
        codes = _codes(_products(items, self.planes, *self.shape))
        longest = float(np.sqrt((items ** 2).sum(axis=1)).max(initial=0.0))
        narrow, step = items.astype(np.float32).T, max(1, 2 * SCORE_CELLS // len(ids))
        found = [(self.rows, self.items, self.values)]
        for lo in range(0, len(self.user_ids), step):
            hi = min(lo + step, len(self.user_ids))
            met = self.looks[0][lo:hi].take(codes[:, 0], axis=1)
            for t in range(1, self.shape[0]):
                met |= self.looks[t][lo:hi].take(codes[:, t], axis=1)
            if len(own):
                at = np.searchsorted(ids, self.user_ids[lo:hi]).clip(max=len(ids) - 1)
                mine = (ids[at] == self.user_ids[lo:hi]) & np.isin(self.user_ids[lo:hi], own)
                met[np.flatnonzero(mine), at[mine]] = False
            r, c = self._candidates(narrow, lo, hi, longest, np.nonzero(~met))
            found.append((r, ids[c], np.floor(np.einsum("ij,ij->i", self.users[r], items[c]) * 1e6 + 0.5) / 1e6))
        rows, members, values = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-values, members, rows))
        rows, members, values = rows[order], members[order], values[order]
        first = np.concatenate(([True], (rows[1:] != rows[:-1]) | (members[1:] != members[:-1]))) if len(rows) else np.empty(0, dtype=bool)
        self._keep([(rows[first], members[first], values[first])])


def search(queries: DataFrame, members: DataFrame, k: int, dim: int, itself: bool = True, tables: int = TABLES, bits: int = BITS,
           probes: int = PROBES, seed: int | str = 42, block: int = BLOCK) -> DataFrame:
    """The best ``k`` of ``members`` (item, v) found for each of ``queries`` (user, v): ``user, item, score, rank``.

    Both should have vectors of length one. ``itself=False`` leaves out the member with the query's own id.
    """
    planes = np.asarray(xavier_matrix(tables * bits, dim, seed))
    n_queries, n_members = queries.count(), members.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    ib = max(1, math.ceil(n_members / block))
    ub = max(1, math.ceil(n_queries / block), min(2 * cores, math.ceil(n_queries / 64)))
    none = F.lit(None).cast("array<long>")
    left = _packed(queries.filter(F.col("v").isNotNull()), "user", "v", "_ub", _block("user", ub), "u").withColumns({"s_users": none, "s_items": none})
    right = _packed(members.filter(F.col("v").isNotNull()), "item", "v", "_ib", _block("item", ib), "i")
    width = at_once(min(block, n_members), dim)
    kernel = _score_blocks(k, partial(_BestProbed, planes=planes, tables=tables, bits=bits, probes=probes, itself=itself))
    if ib > width:
        left = materialize(left, "queries")
    best = None
    for low in range(0, ib, width):
        high = min(low + width, ib) - 1
        # blocks as an expression of a column: a join on constants would be a nested loop
        zero = F.pmod("_ub", F.lit(1).cast("long"))
        found = _met_blocks(left.withColumn("_ibs", F.transform(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")), lambda i: i + zero)),
                            right, ub, low, high, kernel)
        found = materialize(found, "best") if ib > width else found
        best = found if best is None else best.unionByName(found)
    once = best.groupBy("user", "item").agg(F.max("score").alias("score"))  # rows of one number
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.col("score").desc(), "item"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def approximate_neighbours(items: DataFrame, k: int, dim: int, **index) -> DataFrame:
    """Nearly the ``k`` most cosine-similar other items of every item: ``item, neighbour, score, rank``."""
    unit = materialize(V.dealt(items.select("item", "v"), "item").select("item", V.unit("v").alias("v")), "unit")
    found = search(unit.withColumnRenamed("item", "user"), unit, k, dim, itself=False, **index)
    return found.select(F.col("user").alias("item"), F.col("item").alias("neighbour"), "score", "rank")


def approximate_top_k(users: DataFrame, items: DataFrame, k: int, dim: int, **index) -> DataFrame:
    """Nearly the best ``k`` items of every user by dot product: ``user, item, score, rank``.

    Items get one more component that brings all of them to the length of the longest, users a zero,
    so the largest products are the smallest angles. Scores are those of the vectors as given.
    """
    longest = items.select(F.coalesce(F.max(V.dot("v", "v")), F.lit(0.0)).alias("n")).first()["n"]
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(longest) - V.dot("v", "v")))
    wide_items = items.select("item", F.concat("v", F.array(rest)).alias("v"))
    wide_users = users.select("user", F.concat("v", F.array(F.lit(0.0))).alias("v"))
    return search(wide_users, wide_items, k, dim + 1, **index)


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """One row: share of the exact rows that were found, and how many there are."""
    hit = found.select(*keys, F.lit(1).alias("_hit"))
    return exact.select(*keys).join(hit, keys, "left").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("n_exact"))
