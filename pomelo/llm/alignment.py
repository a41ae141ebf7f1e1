"""Alignment of two tokenizers: groups of tokens with common borders, and corpus-wide counts of linked ids.

Tokens of both tokenizers (A and B) are laid over the same bytes. Where tokens of both end, a group
ends. A group of one A and one B token holds the same bytes twice, so its B id follows from its A id:
these are counted in a vector as long as A's vocabulary, by a precomputed map from A ids to B ids.
Only links of the other groups are merged as pairs, as packed blocks dealt out by B id.

What a row of the result needs of the corpus is then looked up in tables that are broadcast: the
vector, the largest count of each B id, and the most frequent pairs up to a fixed number. Links of
pairs beyond that number meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path, materialize
from . import worker_caches
from .common import bound_batches
from .tokens import encoder, entry_bytes

# Tokens that are aligned at once, pairs that a task holds, and parts that pairs are dealt out to.
ALIGNED_TOKENS, HELD_PAIRS, PAIR_PARTS = 400_000, 1_000_000, 256
# Most pairs in the broadcast table: 64 MB.
SHARED_PAIRS = 4_000_000
_SPACE = "▁"


class _Bytes:
    """The bytes of each id of a vocabulary, laid out so that those of many ids are joined at once."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = entries
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self._starts, self._flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        upto = np.cumsum(n)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self._starts[ids] - upto + n, n)
        return self._flat[at].tobytes()


class Pair:
    """Both tokenizers in one worker: ids of texts, bytes and lengths of ids, and A's map to same-bytes B ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        self._a, self._b = encoder(path_a, "alignment", plain=True), sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        entries = entry_bytes(vocabulary)
        b = self._b
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self._bytes_a = _Bytes(entries)
        self._bytes_b = _Bytes([bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i)
                                else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)])
        plain = [not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i)) for i in range(len(pieces))]
        same = {}
        for i, held in enumerate(self._bytes_b.entries):
            if held and (plain[i] or held not in same):  # a piece rather than a byte
                same[held] = i
        self.same = np.array([same.get(held, -1) if held else -1 for held in entries], np.int64)
        self.length_a, self.length_b = self._bytes_a.lengths, self._bytes_b.lengths
        self.n_a, self.n_b = len(entries), len(pieces)
        self._written: list[str] = []

    def ids_a(self, text: str) -> np.ndarray:
        return np.frombuffer(self._a.ids(text), "<u4")

    def ids_b(self, text: str) -> np.ndarray:
        return np.array(self._b.encode(text, num_threads=1), np.uint32)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, or none if the text is missing or empty or the bytes of either differ from it."""
        none = np.empty(0, np.uint32)
        if not text:
            return none, none
        whole = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self.ids_a(" " + text), self.ids_b(text)
        if self._bytes_a.joined(a) != whole or self._bytes_b.joined(b) != whole:
            return none, none
        return a, b

    def written(self) -> list[str]:
        """How each id is written in a list of groups, within a side and at its end: A ids, then B ids."""
        if not self._written:
            self._written = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for i in range(n) for end in ends]
        return self._written


_PAIRS: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(path_a: str, path_b: str) -> Pair:
    """Both tokenizers of this worker process."""
    worker_caches.start("alignment")
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
        worker_caches.kept_by("alignment", _PAIRS.clear)
    return _PAIRS[path_a, path_b]


class Aligned:
    """Documents' tokens laid over the same bytes, one document behind the other.

    A link is a stretch between neighbouring borders of any token: exactly one A and one B token overlap there.
    """

    def __init__(self, pair: Pair, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> None:
        self._pair = pair
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        end_a, end_b = np.cumsum(pair.length_a[self.a]), np.cumsum(pair.length_b[self.b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
        self._last_a, self._last_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.zeros(len(ends), np.bool_), np.zeros(len(ends), np.bool_)
        in_a[self._last_a], in_b[self._last_b] = True, True
        self._border = in_a & in_b
        self.link_a, self.link_b = self.a[np.cumsum(in_a) - in_a], self.b[np.cumsum(in_b) - in_b]
        after_border = np.r_[True, self._border[:-1]] if len(ends) else self._border
        #: links of groups of one A token and the B token that it maps to
        self.regular = self._border & after_border & (pair.same[self.link_a] == self.link_b)
        self._group = np.cumsum(self._border) - self._border
        # each document's last A token ends where its last link does
        self._upto_a = np.cumsum(self.n_a)
        self._upto_link = np.r_[-1, self._last_a][self._upto_a] + 1

    def by_document(self, of_link: np.ndarray) -> np.ndarray:
        """Sums of a number of each link over the documents."""
        return np.diff(np.r_[0, np.cumsum(of_link)][np.r_[0, self._upto_link]])

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(np.r_[0, self._upto_link])

    @property
    def n_groups(self) -> np.ndarray:
        return self.by_document(self._border.astype(np.int64))

    def pairs(self) -> np.ndarray:
        """One number for the ids of each link."""
        return self.link_a * self._pair.n_b + self.link_b

    def groups(self) -> list[str]:
        """The groups of each document: ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
        n_groups = int(self._border.sum())
        group_a, group_b = self._group[self._last_a], self._group[self._last_b]
        of_a, of_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        at_a = np.arange(len(self.a)) + (np.cumsum(of_b) - of_b)[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(of_a)[group_b]
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[at_a] = 2 * self.a + self._border[self._last_a]
        code[at_b] = 2 * (self._pair.n_a + self.b) + self._border[self._last_b]
        upto = np.r_[0, np.cumsum(self.n_a + self.n_b)]
        table = self._pair.written()
        return ["".join(map(table.__getitem__, code[s:e].tolist()))[:-1] for s, e in zip(upto[:-1], upto[1:])]


def encoded(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's token ids by both tokenizers, as packed numbers, written once: ``row, doc_id, a, b``.

    Ids of vocabularies of at most 65,536 entries take two bytes. Rows whose text is missing, empty or not
    given back by both tokenizers have no ids.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        pair = tokenizer_pair(path_a, path_b)
        for batch in batches:
            sides = [], []
            for value in batch.column("text"):
                for side, ids, n in zip(sides, pair.encode(value.as_py()), (pair.n_a, pair.n_b)):
                    side.append(ids.astype("<u2" if n <= 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array(s, pa.binary()) for s in sides]],
                                             names=["row", "doc_id", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done = rows.mapInArrow(run, f"row long, doc_id {kind}, a binary, b binary")
    path = fresh_path(spark, "encoded")
    done.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def _aligned(batches, pair: Pair):
    """Yield (batch columns, Aligned) for stretches of rows of a bounded number of tokens, or one row."""
    kinds = ["<u2" if n <= 1 << 16 else "<u4" for n in (pair.n_a, pair.n_b)]
    for batch in batches:
        sides = [[np.frombuffer(x, kind) for x in batch.column(c).to_pylist()] for c, kind in zip("ab", kinds)]
        at = held = 0
        for i, ids in enumerate(sides[0]):
            held += len(ids)
            if held >= ALIGNED_TOKENS or i == batch.num_rows - 1:
                yield batch.slice(at, i + 1 - at), Aligned(pair, sides[0][at:i + 1], sides[1][at:i + 1])
                at, held = i + 1, 0


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    key, n = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class LinkCounts:
    """How many links of the corpus hold each pair of ids: a table of pairs in blocks, and for regular groups a
    vector over A's ids. Rows of ``blocks``: ``part, keys, counts``, all pairs of a B id in one part."""

    def __init__(self, tokens: DataFrame, path_a: str, path_b: str) -> None:
        self._paths = path_a, path_b
        pair = tokenizer_pair(path_a, path_b)
        self._n_b = n_b = pair.n_b

        def count(batches):
            pair = tokenizer_pair(path_a, path_b)
            regular, keys, counts, held = np.zeros(pair.n_a, np.int64), [], [], 0

            def blocks():
                key, n = _merged(keys, counts)
                part = key % n_b % PAIR_PARTS
                order = np.argsort(part, kind="stable")
                key, n, part = key[order], n[order], part[order]
                edges = np.searchsorted(part, np.arange(PAIR_PARTS + 1))
                some = np.flatnonzero(edges[1:] > edges[:-1])
                return pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), *[pa.array([x[edges[p]:edges[p + 1]].astype("<i8").tobytes() for p in some], pa.binary()) for x in (key, n)]],
                    names=["part", "keys", "counts"])

            for _, aligned in _aligned(batches, pair):
                regular += np.bincount(aligned.link_a[aligned.regular], minlength=len(regular))
                key, n = np.unique(aligned.pairs()[~aligned.regular], return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held >= HELD_PAIRS:
                    merged = _merged(keys, counts)
                    keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                    if held >= HELD_PAIRS // 2:
                        yield blocks()
                        keys, counts, held = [], [], 0
            if held:
                yield blocks()
            # the vector in slices, below the parts of pairs
            slices = np.array_split(regular, PAIR_PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(-PAIR_PARTS, 0), pa.int32()), pa.array([b""] * PAIR_PARTS, pa.binary()),
                                              pa.array([s.astype("<i8").tobytes() for s in slices], pa.binary())], names=["part", "keys", "counts"])

        def merge(batches):
            part, keys, counts, vector, held = None, [], [], 0, 0

            def done():
                key, n = (np.empty(0, np.int64), vector) if part < 0 else _merged(keys, counts)
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([key.astype("<i8").tobytes()], pa.binary()),
                                                   pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["part", "keys", "counts"])

            for batch in batches:
                for p, key, n in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts"))):
                    if p != part:
                        if part is not None:
                            yield done()
                        part, keys, counts, vector, held = p, [], [], 0, 0
                    if p < 0:
                        vector = vector + np.frombuffer(n, "<i8")
                        continue
                    keys.append(np.frombuffer(key, "<i8"))
                    counts.append(np.frombuffer(n, "<i8"))
                    held += len(keys[-1])
                    if held >= HELD_PAIRS:
                        merged = _merged(keys, counts)
                        keys, counts, held = [merged[0]], [merged[1]], 0
            if part is not None:
                yield done()

        schema = "part int, keys binary, counts binary"
        self.blocks = materialize(tokens.select("a", "b").mapInArrow(count, schema).repartition("part").sortWithinPartitions("part")
                                  .mapInArrow(merge, schema), "links")
        self._sum_up(pair)

    def _sum_up(self, pair: Pair) -> None:
        """Numbers bounded by the vocabularies: counts of the pairs of the map, the largest count of each B id,
        and how many other pairs have counts of so many bits."""
        same, n_b = pair.same, self._n_b

        def figures(batches):
            for batch in batches:
                rows = {"kind": [], "key": [], "n": []}
                for key, n in zip(*([np.frombuffer(x, "<i8") for x in batch.column(c).to_pylist()] for c in ("keys", "counts"))):
                    mapped = same[key // n_b] == key % n_b
                    b, most = key[~mapped] % n_b, n[~mapped]
                    order = np.lexsort((most, b))
                    last = order[np.r_[b[order][1:] != b[order][:-1], True]] if len(b) else order
                    bits = np.bincount(np.floor(np.log2(most)).astype(np.int64)) if len(most) else np.empty(0, np.int64)
                    for kind, k, v in ((0, key[mapped], n[mapped]), (1, b[last], most[last]), (2, np.arange(len(bits)), bits)):
                        rows["kind"] += [kind] * len(k)
                        rows["key"] += k.tolist()
                        rows["n"] += v.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(rows["kind"], pa.int32()), pa.array(rows["key"], pa.int64()), pa.array(rows["n"], pa.int64())], names=["kind", "key", "n"])

        vector = np.zeros(pair.n_a, np.int64)
        slices = np.array_split(np.arange(pair.n_a), PAIR_PARTS)
        for row in self.blocks.filter("part < 0").select("part", "counts").collect():
            vector[slices[row["part"] + PAIR_PARTS]] += np.frombuffer(row["counts"], "<i8")
        found = (self.blocks.filter("part >= 0").select("keys", "counts").mapInArrow(figures, "kind int, key long, n long")
                 .groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow())  # at most an entry for each id
        kind, key, n = (found.column(c).to_numpy() for c in ("kind", "key", "n"))
        vector[key[kind == 0] // n_b] += n[kind == 0]
        best = np.zeros(n_b, np.int64)
        best[key[kind == 1]] = n[kind == 1]
        there = same >= 0
        np.maximum.at(best, same[there], vector[there])
        self.vector, self.best = vector, best
        self._bits = {int(k): int(v) for k, v in zip(key[kind == 2], n[kind == 2])}

    def table(self) -> DataFrame:
        """All pairs: ``a_id, b_id, links``."""
        blocks, vector, n_b, paths = self.blocks, self.vector, self._n_b, self._paths
        spark = blocks.sparkSession
        shared = spark.sparkContext.broadcast(vector)

        def spread(batches):
            same = tokenizer_pair(*paths).same
            for batch in batches:
                for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts"))):
                    if part == -PAIR_PARTS:
                        a = np.flatnonzero(shared.value)
                        b, n = same[a], shared.value[a]
                    elif part < 0:
                        continue
                    else:
                        key, n = np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")
                        a, b = key // n_b, key % n_b
                        other = same[a] != b
                        a, b, n = a[other], b[other], n[other]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], names=["a_id", "b_id", "links"])

        return blocks.mapInArrow(spread, "a_id int, b_id int, links long")

    def frequent(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The least count in the shared table, its pairs and their counts; a power of two chosen so that at
        most SHARED_PAIRS pairs have it. Pairs of the map are in the vector."""
        least, total = 64, 0
        while least > 0 and total + self._bits.get(least - 1, 0) <= SHARED_PAIRS:
            least -= 1
            total += self._bits.get(least, 0)
        same, n_b, lowest = tokenizer_pair(*self._paths).same, self._n_b, 1 << least if least < 63 else 2**63 - 1

        def pick(batches):
            for batch in batches:
                out = [], []
                for key, n in zip(*([np.frombuffer(x, "<i8") for x in batch.column(c).to_pylist()] for c in ("keys", "counts"))):
                    taken = (n >= lowest) & (same[key // n_b] != key % n_b)
                    out[0].append(key[taken].tobytes())
                    out[1].append(n[taken].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["keys", "counts"])

        keys, counts = [], []
        for row in self.blocks.filter("part >= 0").select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").toLocalIterator():
            keys.append(np.frombuffer(row["keys"], "<i8"))
            counts.append(np.frombuffer(row["counts"], "<i8"))
        return (lowest, *_merged(keys, counts))

    @property
    def n_pairs(self) -> int:
        """Number of different pairs besides those of the map."""
        return sum(self._bits.values())


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups_sha256``,
    or the ``groups`` themselves (``a1,a2|b1;a3|b2,b3``) without ``digest``.

    A is a byte-level BPE that reads a space and the text, B a sentencepiece BPE that adds the space itself;
    special strings are plain text for both. Texts that are null, empty or not given back byte for byte have
    zeros and an empty last column. A link is an overlapping pair of an A and a B token; its count is the number
    of links of the corpus with the same two ids. ``n_best`` counts links whose count is the highest of their B
    id, ``count_sum`` adds counts up. Repeated rows count each time; an empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    tokens = encoded(docs, path_a, path_b, doc_id, text)
    counts = LinkCounts(tokens, path_a, path_b)
    lowest, keys, numbers = counts.frequent()
    shared = spark.sparkContext.broadcast((keys, numbers, counts.vector, counts.best))  # bounded by SHARED_PAIRS and the vocabularies

    def run(batches):
        pair = tokenizer_pair(path_a, path_b)
        keys, numbers, vector, best = shared.value
        for batch, aligned in _aligned(batches, pair):
            n = vector[aligned.link_a]
            other = np.flatnonzero(pair.same[aligned.link_a] != aligned.link_b)
            key = aligned.pairs()[other]
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), np.bool_)
            n[other] = np.where(known, numbers[at], 0) if len(keys) else 0
            groups = aligned.groups()
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            missed = other[~known]
            of_row = np.searchsorted(aligned._upto_link, missed, side="right")
            edges = np.searchsorted(of_row, np.arange(batch.num_rows + 1))
            rare = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(key[~known], pa.int64()))
            columns = [aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links, aligned.by_document((n > 0) & (n == best[aligned.link_b])), aligned.by_document(n)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(groups, pa.string()), rare],
                                             names=["row", "doc_id", *_COLUMNS, "groups", "rare"])

    schema = f"row long, doc_id {kind}, {', '.join(f'{c} long' for c in _COLUMNS)}, groups string, rare array<long>"
    done = tokens.mapInArrow(run, schema)
    if len(keys) < counts.n_pairs:
        done = _with_rare(done, counts, lowest)
    last = "groups_sha256" if digest else "groups"
    return done.select("doc_id", *_COLUMNS, F.col("groups").alias(last))


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _with_rare(done: DataFrame, counts: LinkCounts, lowest: int) -> DataFrame:
    """Add what links of pairs outside the shared table contribute. Each such pair has fewer than ``lowest`` links,
    so no key of the join is hot."""
    done = materialize(done, "aligned")
    n_b = counts._n_b
    best = done.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(counts.best)], "b_id int, most long")  # a row per B id
    table = (counts.table().filter(F.col("links") < lowest).join(F.broadcast(best), "b_id")
             .select((F.col("a_id").cast("long") * n_b + F.col("b_id")).alias("key"), "links", (F.col("links") == F.col("most")).cast("long").alias("is_best")))
    links = (done.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("m")).join(table, "key")
             .groupBy("row").agg(F.sum(F.col("m") * F.col("links")).alias("more"), F.sum(F.col("m") * F.col("is_best")).alias("more_best")))
    return (done.join(links, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0))))
