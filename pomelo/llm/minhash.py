"""Near duplicates by MinHash: universal hash minima, banding, verification, components.

1. Each text becomes its set of distinct shingles, as 64-bit hashes, in a Python worker; what leaves
   it is the set's size, a 128-bit digest of the set, the minima of ``MINIMA`` universal hash
   functions and a hash of each band. Texts with equal sets are one class from here on.
2. Classes that share a band are candidates. With a similarity of s, a pair shares no band of r rows
   with probability ``(1 - s**r) ** (MINIMA / r)``: 5.4e-6 at 0.75, where r is 4. Lower percentages
   have bands of 2 rows or 1, so that it is never more than 1e-5.
3. In every bucket, each class proposes the classes of other components that agree most with its
   signature, and each class's best proposals are compared on their full sets. The components of the
   links found are joined, and the next round proposes more, until the last one proposes all that is
   left: pairs that share a bucket, agree enough in their signatures, lie in different components and
   have not been compared. So no candidate is lost, yet a bucket of thousands of near copies, which
   the first rounds connect, never costs its square in pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import bound_batches
from .components import joined_components
from .worker_caches import Generations, kept_by, start

MINIMA = 128
MOST_MISSED = 1e-5      # pairs at the wanted similarity that share no band, at most
SHINGLE_WORDS = 5
SEED = 20240607
# Candidates are told by how many minima agree (their lowest bytes, that is): of the 128 that the
# bands are made of in the first round, and then of SHARPER others. Fewer than the mean at the wanted
# similarity less this many deviations come up about once in a million; at 0.75 the means are 96 and
# 768, the deviations 4.9 and 13.9, and the least 72 and 702.
SHARPER = 1_024
DEVIATIONS = 4.76
# Proposals of a class in each round; the last has no limit.
PROPOSALS = (1, 4, None)
# Rows of a bucket that meet in one task; larger buckets are cut into blocks, and all pairs of blocks met.
BLOCK_ROWS = 4_096
_CHUNK = 1_024

# Odd multipliers and addends of the multiply-add functions on 64-bit words; the high half of the
# result counts.
_RANDOM = np.random.Generator(np.random.PCG64(SEED))
_MULTIPLY = _RANDOM.integers(0, 2**64, MINIMA + SHARPER, dtype=np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 2**64, MINIMA + SHARPER, dtype=np.uint64)
_OF_BANDS, _OTHERS = slice(0, MINIMA), slice(MINIMA, MINIMA + SHARPER)
_WORD_FACTORS = _RANDOM.integers(0, 2**64, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

_WORDS = Generations(xxhash.xxh64_intdigest)
kept_by("minhash", _WORDS.clear)


def band_rows(percent: int) -> int:
    """Minima of a band: as many of 4, 2 and 1 as leave a pair at ``percent`` almost surely in a band."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100, not {percent}")
    for rows in (4, 2, 1):
        if (1 - (percent / 100) ** rows) ** (MINIMA // rows) <= MOST_MISSED:
            return rows
    raise ValueError(f"{MINIMA} minima can't find pairs at {percent} percent")


def least_agreeing(minima: int, percent: int) -> int:
    """Of so many minima, those that agree at least in a pair at ``percent``; from 75 on as many as there,
    since few misses are not normally distributed."""
    s = min(percent, 75) / 100
    return max(0, int(minima * s - DEVIATIONS * (minima * s * (1 - s)) ** 0.5))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. A text of
    fewer words is one shingle as a whole; one without words has none.
    """
    start("minhash")
    # bytes.lower() and bytes.split() know ASCII only, which is what is asked for
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        whole = b"\x20".join(words)
        return np.array([xxhash.xxh64_intdigest(whole, seed=len(words))], np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(ids) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += _mixed(ids[k:k + n] * _WORD_FACTORS[k])
    return np.unique(_mixed(out))


def minima(shingles: np.ndarray, functions: slice = _OF_BANDS) -> np.ndarray:
    """The minima of universal hash functions over a set, as 32-bit numbers."""
    multiply, add = _MULTIPLY[functions, None], _ADD[functions, None]
    least = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _CHUNK):  # memory is bounded for very long texts, too
        part = shingles[start:start + _CHUNK]
        np.minimum(least, (multiply * part[None, :] + add).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64) * _MIX
    for k in range(rows):
        out = _mixed((out ^ bands[:, k]) * _MULTIPLY[k])
    return out.view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, percent: int = 75) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id, signature, bands`` of every row; the last two are null
    for an empty set. The signature is the lowest byte of each minimum."""
    bound_batches(docs.sparkSession)
    kind, width = docs.schema[doc_id].dataType.simpleString(), band_rows(percent)

    def run(batches):
        for batch in batches:
            sizes, ids, signs, bands = [], [], [], []
            for value in batch.column("text"):
                shingles = shingle_set(value.as_py())
                sizes.append(len(shingles))
                ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                if len(shingles):
                    signature = minima(shingles)
                    signs.append(signature.astype(np.uint8).tobytes())
                    bands.append(_band_hashes(signature, width))
                else:
                    signs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "signature", "bands"])

    return (docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_id binary, signature binary, bands array<long>"))


def _best(found: list, band: int, x: tuple, y: tuple, limit: int | None, percent: int) -> None:
    """Add to ``found`` the proposals (a, b, agreeing) of the rows ``x`` among the rows ``y``, each given
    as (ids, signatures, sizes, components, bands). Of the buckets that two rows share only the first
    proposes them."""
    ids, signs, sizes, parts, bands = x
    other_ids, other_signs, other_sizes, other_parts, other_bands = y
    least = least_agreeing(signs.shape[1], percent)
    step = max(1, 2**22 // (len(other_ids) * signs.shape[1]))
    for at in range(0, len(ids), step):  # bounds the comparisons held at once
        rows = slice(at, at + step)
        fit = (100 * np.minimum(sizes[rows, None], other_sizes[None]) >= percent * np.maximum(sizes[rows, None], other_sizes[None]))
        fit &= parts[rows, None] != other_parts[None]
        if not fit.any():
            continue
        agreeing = (signs[rows, None] == other_signs[None]).sum(axis=2, dtype=np.int16)
        agreeing[~fit | (agreeing < least)] = -1
        i, j = np.nonzero(agreeing >= 0)
        for some in range(0, len(i), 65_536):
            a, b = i[some:some + 65_536], j[some:some + 65_536]
            shared = (bands[at + a] == other_bands[b]).argmax(axis=1)
            later = bands[at + a, shared] != band
            agreeing[a[later], b[later]] = -1
        if limit is None or limit >= len(other_ids):
            i, j = np.nonzero(agreeing >= 0)
        else:
            j = np.argsort(-agreeing, axis=1, kind="stable")[:, :limit].ravel()
            i = np.repeat(np.arange(agreeing.shape[0]), limit)
            some = agreeing[i, j] >= 0
            i, j = i[some], j[some]
        found.append((ids[at + i], other_ids[j], agreeing[i, j]))


def _proposals(members: DataFrame, limit: int | None, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a before b, that classes of a bucket propose across components.

    ``members`` has ``band, set_id, signature, n, bands, component``. Rows of a bucket stand one behind the
    other, so a task reads its buckets as a stream. Those of a bucket's largest component propose
    nothing: each pair across components has another end.
    """
    spread = members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                         F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")).filter("x < y")
    rows = members.join(spread.select("band", "blocks"), "band").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks"))
    grid = (rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block",
                    "set_id", "signature", "n", F.xxhash64("component").alias("part"), "bands"))
    keys = ["band", "x", "y"]

    def run(batches):
        def columns(batch):
            return (np.stack([batch.column(c).to_numpy() for c in keys], axis=1), batch.column("block").to_numpy(),
                    np.frombuffer(b"".join(batch.column("set_id").to_pylist()), "V16"),
                    np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1),
                    batch.column("n").to_numpy(), batch.column("part").to_numpy(),
                    batch.column("bands").flatten().to_numpy().reshape(-1, MINIMA // band_rows(percent)))

        def propose(key, block, ids, signs, sizes, parts, bands, found):
            if len(ids) < 2:
                return
            names, counts = np.unique(parts, return_counts=True)
            if len(names) < 2:
                return
            active = (parts != names[counts.argmax()]) | (counts.max() == 1)
            low, high = block == key[1], block == key[2]
            side = lambda at: (ids[at], signs[at], sizes[at], parts[at], bands[at])
            for x, y in ((low, high),) if key[1] == key[2] else ((low, high), (high, low)):
                if (x & active).any() and y.any():
                    _best(found, key[0], side(x & active), side(y), limit, percent)

        def emit(found):
            a, b, n = (np.concatenate(c) for c in zip(*found))
            return pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary()),
                 pa.array(n.astype(np.int32))], names=["a", "b", "agreeing"])

        held, found = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = columns(batch)
            held = part if held is None else tuple(np.concatenate(c) for c in zip(held, part))
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1)) + 1
            start = 0
            for end in ends:  # the last bucket may go on in the next batch
                propose(held[0][start], *(c[start:end] for c in held[1:]), found)
                start = end
            held = tuple(c[start:] for c in held)
            if found:
                yield emit(found)
                found = []
        if held is not None:
            propose(held[0][0], *held[1:], found)
            if found:
                yield emit(found)

    proposed = grid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary, agreeing int")
    if limit is not None:
        # buckets propose each on their own: of all that a class proposes the best stay
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("agreeing").desc(), "b"))
        best = proposed.groupBy("a", "b").agg(F.max("agreeing").alias("agreeing"))
        proposed = best.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes whose full sets have ``100 * intersection >= percent * union``."""
    # the hub is joined last: its pairs then come one behind the other, and Spark can split them
    both = (pairs.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("ta")), "a"))

    def run(batches):
        last: dict[str, tuple] = {"a": (None, None), "b": (None, None)}

        def of(side, key, value):
            if last[side][0] != key:
                last[side] = key, shingle_set(value.as_py())
            return last[side][1]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                                    batch.column("ta"), batch.column("tb")):
                x, y = of("a", a, ta), of("b", b, tb)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _class_texts(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set_id, text`` of one text for each wanted class (column ``set_id``).

    Rows are found by the class's smallest id and then told apart by their set, since ids may repeat.
    """
    bound_batches(docs.sparkSession)
    ids = classes.join(wanted, "set_id", "left_semi").select(F.col("first_id").alias("key")).distinct()
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    named, unnamed = rows.join(ids, "key", "left_semi"), rows.filter("key IS NULL")

    def run(batches):
        for batch in batches:
            found = [hashlib.blake2b(shingle_set(x.as_py()).tobytes(), digest_size=16).digest()
                     for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("text")],
                                             names=["set_id", "text"])

    texts = (named.select("text").unionByName(unnamed.select("text"))
             .mapInArrow(run, "set_id binary, text string").join(wanted, "set_id", "left_semi"))
    return texts.groupBy("set_id").agg(F.min("text").alias("text"))


def _sharper(texts: DataFrame) -> DataFrame:
    """``set_id, signature`` with more minima than the bands have, and independent of them."""
    def run(batches):
        for batch in batches:
            signs = [minima(shingle_set(x.as_py()), _OTHERS).astype(np.uint8).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(signs, pa.binary())], names=["set_id", "signature"])

    return texts.select("set_id", "text").mapInArrow(run, "set_id binary, signature binary")


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, group, component_id`` of every row; the group is null for an
    empty set."""
    rows = materialize(signatures(docs, doc_id, text, percent), "signatures")
    full = rows.filter("n_shingles > 0")
    classes = materialize(
        full.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"),
                                   F.first("signature").alias("signature"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("set_id", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    members = materialize(buckets.join(shared, "band", "left_semi")
                          .join(classes.select("set_id", "signature", "n", "bands"), "set_id"), "buckets")
    component = classes.select(F.col("set_id").alias("node"), F.col("set_id").alias("component")).limit(0)
    compared = texts = None
    for limit in PROPOSALS:
        placed = members.join(component.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
            "component", F.coalesce("component", "set_id"))
        pairs = _proposals(placed, limit, percent)
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "proposals")
        if texts is None:
            # who proposes nothing now never will, so later rounds need no other classes
            nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "nodes")
            texts = materialize(_class_texts(docs, doc_id, text, classes, nodes), "texts")
            members = materialize(members.drop("signature").join(_sharper(texts), "set_id"), "buckets")
        elif pairs.isEmpty():
            continue
        found = materialize(_confirmed(pairs, texts, percent), "links")
        compared = pairs if compared is None else compared.unionByName(pairs)
        if not found.isEmpty():
            component = materialize(joined_components(component, found), "components")

    placed = classes.select("set_id", "first_id").join(component.withColumnRenamed("node", "set_id"), "set_id")
    names = placed.groupBy("component").agg(F.min("first_id").alias("smallest"))
    named = placed.join(names, "component").select("set_id", "component", "smallest")
    own = classes.select("set_id", "first_id").join(named, "set_id", "left").select(
        "set_id", F.coalesce("component", "set_id").alias("group"), F.coalesce("smallest", "first_id").alias("component_id"))
    empty = rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("binary").alias("group"),
                                                 F.col("doc_id").alias("component_id"))
    linked = full.select("doc_id", "text_hash", "n_shingles", "set_id").join(own, "set_id").drop("set_id")
    return linked.unionByName(empty)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when their shingle sets have ``100 * intersection >= percent * union``, and
    ``component_id`` is the smallest id reachable by links, the row's own included. A row is kept if
    its id is that. Null and empty texts and texts of white space have an empty set and link with
    nothing, not even with each other: each is its own component. Rows with equal sets are linked,
    so repeated rows share a component; those with the same id are all kept. A row without an id
    links as any other, never gives its component a name, and is not kept unless nothing in its
    component has an id. An empty table gives an empty result; other columns are not read. Percentages
    too low for ``MINIMA`` minima, below 9, are an error.
    """
    return _grouped(docs, doc_id, text, percent).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Rows of ``docs``, with their own columns, of one document of each group of near duplicates:
    that with the smallest id, or if none has one, with any.

    Null and empty texts are groups of their own. Of rows that repeat id and text, one stays.
    """
    rows = materialize(_grouped(docs, doc_id, text, percent).withColumn("pick", F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")), "groups")
    picked = (rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("pick").alias("pick")).select("pick")
              .unionByName(rows.filter("group IS NULL").select("pick").distinct()))
    copies = rows.groupBy("pick").agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(picked.join(copies, "pick").select(
        F.col("pick.doc_id").alias("_id"), F.col("pick.text_hash").alias("_hash"), "n"), "kept")
    # the hash of a null text is the seed, here as there
    same = F.col(f"_row.{doc_id}").eqNullSafe(F.col("_id")) & (F.xxhash64(f"_row.{text}") == F.col("_hash"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    once = whole.join(kept.filter("n = 1"), same, "left_semi").select("_row.*")
    if kept.filter("n > 1").isEmpty():
        return once
    repeated = whole.join(kept.filter("n > 1"), same, "left_semi").select("_row.*")
    return once.unionByName(repeated.dropDuplicates([doc_id, text]))
