"""What Python workers keep between tasks, bounded in bytes.

A worker lives as long as its executor and serves one operator after the other. Caches count the bytes
that they hold, and an operator that starts in a worker drops what others have left there.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable

import pyarrow as pa

# Bytes of one generation of a cache, and of a dictionary's entry besides key and value.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 96
LONGEST_CACHED = 32

_KEPT: dict[str, list[Callable[[], None]]] = {}
_IN_USE: list[str] = []


def kept_by(operator: str, forget: Callable[[], None]) -> None:
    """``forget`` drops something that ``operator`` keeps in this worker."""
    _KEPT.setdefault(operator, []).append(forget)


def start(operator: str) -> None:
    """To be called where a task of ``operator`` begins: drops what other operators have left."""
    if _IN_USE == [operator]:
        return
    for other, forgets in _KEPT.items():
        if other != operator:
            for forget in forgets:
                forget()
    _IN_USE[:] = [operator]
    gc.collect()
    pa.default_memory_pool().release_unused()


class Generations(dict):
    """A cache of bounded size: when full, its entries become the old generation and the one before goes."""

    def __init__(self, compute, limit: int = CACHE_BYTES) -> None:
        super().__init__()
        self._compute, self._limit, self._old, self._held = compute, limit, {}, 0

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
            if len(key) > LONGEST_CACHED:
                return value
        size = sys.getsizeof(key) + sys.getsizeof(value) + ENTRY_BYTES
        if self._held + size > self._limit:
            self._old = dict(self)
            super().clear()
            self._held = 0
        self._held += size
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self._old, self._held = {}, 0
