"""Packing documents into sequences of bounded length by Karmarkar-Karp differencing.

A document's full stretches of ``size`` tokens are sequences of their own. What is left at its end
is gathered into groups, and each group is dealt into windows by multiway differencing: partial
partitions with the largest imbalance are merged with their loads opposed, until one partition is
left. Its windows are near equal, and because a group holds just less than a whole number of
windows, near full. If the fullest window exceeds the capacity, the group is dealt again into one
window more.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches
from .tokens import encoder

# Windows of a group, the tokens that a group stays below their whole number, and the length that
# every fourth rest is cut to: small parts are merged last and even out what the large ones leave.
GROUP_WINDOWS = 96
GROUP_SLACK = 96
SMALL_PART = 48
_NUMBER_BITS = 40


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Deal items into ``k`` subsets of near equal sum; gives the items' positions by subset.

    A partial partition is its non-empty subsets as (sum, node), largest first; the subsets it lacks
    are empty. A node is an item or a pair of nodes, so a merge moves no lists of items.
    """
    if k == 1:
        return [list(range(len(lengths)))] if lengths else []
    nodes: list[tuple[int, int] | None] = [None] * len(lengths)
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - k
        if overlap > 0:
            # the largest subsets of one meet the smallest of the other
            merged = a[:len(a) - overlap] + b[:len(b) - overlap]
            for (x, p), (y, q) in zip(a[len(a) - overlap:], reversed(b[len(b) - overlap:])):
                nodes.append((p, q))
                merged.append((x + y, len(nodes) - 1))
        else:
            merged = a + b
        merged.sort(key=lambda s: -s[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    out = []
    for _, root in (heap[0][2] if heap else []):
        items, stack = [], [root]
        while stack:
            node = stack.pop()
            if nodes[node] is None:
                items.append(node)
            else:
                stack.extend(nodes[node])
        out.append(sorted(items))
    return out


def windows(lengths: list[int], size: int) -> list[list[int]]:
    """The fewest near equal windows by differencing that all hold at most ``size``."""
    k = max(1, -(-sum(lengths) // size))
    while True:
        dealt = difference(lengths, k)
        if max((sum(lengths[i] for i in w) for w in dealt), default=0) <= size:
            return dealt
        k += 1


class _Packer:
    """Packs the documents of one task; rows are gathered as columns."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.sequence = size, first
        self.rows: list[tuple] = []
        self.rest: list[tuple] = []
        self.waiting = 0
        self.documents = 0

    def add(self, doc_id, ids: bytes) -> None:
        total, view, size = len(ids) // 4, memoryview(ids), self.size
        start = 0
        while total - start >= size:
            self.rows.append((doc_id, start, size, zlib.crc32(view[4 * start:4 * (start + size)]), total, self.sequence, 0))
            self.sequence += 1
            start += size
        self.documents += 1
        step = min(SMALL_PART, size) if self.documents % 4 == 0 else size
        while start < total:
            room = GROUP_WINDOWS * size - min(GROUP_SLACK, size // 2) - self.waiting
            length = min(step, total - start, room)
            self.rest.append((doc_id, start, length, zlib.crc32(view[4 * start:4 * (start + length)]), total))
            self.waiting += length
            start += length
            if length == room:
                self.deal()

    def deal(self) -> None:
        for window in windows([r[2] for r in self.rest], self.size):
            offset = 0
            for i in window:
                self.rows.append((*self.rest[i], self.sequence, offset))
                offset += self.rest[i][2]
            self.sequence += 1
        self.rest, self.waiting = [], 0


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
         size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and then ``end_id``; a missing or empty text is ``end_id`` alone.
    Every id lies in exactly one piece, and a sequence holds at most ``size``. Documents are packed
    where they are read, without a shuffle; a task numbers its sequences from its partition's own
    range. Memory is bounded by one group of windows, one Arrow batch and one text. Repeated rows
    are packed each on its own; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[doc_id].dataType
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = (f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")

    def run(batches):
        enc = encoder(path, "packing")
        end = np.array([end_id], "<u4").tobytes()
        packer = _Packer(size, TaskContext.get().partitionId() << _NUMBER_BITS)
        id_type = None

        def flush():
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(key, enc.ids(value.as_py()) + end)
                if len(packer.rows) >= 65_536:
                    yield flush()
        packer.deal()
        if packer.rows:
            yield flush()

    return narrow.mapInArrow(run, schema)
