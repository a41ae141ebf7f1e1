"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words and their beginnings. The machine adds a weight for
each term and, for each pair of terms, the product of two short vectors, so that terms that are
harmless alone can count together. The machine holds the terms whose share of toxic documents differs
from that of the others by several standard errors; the rest would add up to noise in long texts.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from . import labelled
from .worker_caches import Generations, kept_by, start

BITS = 32
# Terms of the machine: at most, documents that one is in at least, and standard errors between its
# shares of the two classes.
MOST_TERMS, LEAST_DOCUMENTS, STANDARD_ERRORS = 1 << 16, 3, 5.0
FACTORS = 6
PREFIXES = (3, 4, 5, 6)
# Labelled rows that are learnt from, by class, at most.
MOST_ROWS = {1: 6_000, 0: 9_000}
THRESHOLD = 0.7
EPOCHS, BATCH, RATE = 12, 32, 0.1
# Summed gradient below which a weight is zero, ridge of the weights, shrinkage of vectors at each use.
SHRINK, RIDGE, SHRINK_FACTORS = 0.5, 0.1, 0.01
SEED = 3

_WORD = re.compile(r"[^\W_]+")


def _hashes(word: str) -> bytes:
    terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return struct.pack(f"={len(terms)}I", *(xxhash.xxh32_intdigest(t, SEED) for t in terms))


_TERMS = Generations(_hashes)
kept_by("toxicity", _TERMS.clear)


def terms(text: str) -> np.ndarray:
    """Sorted distinct hashed terms of a whole text."""
    start("toxicity")
    packed = b"".join(map(_TERMS.__getitem__, set(_WORD.findall(text.lower()))))
    return np.unique(np.frombuffer(packed, np.uint32))


def _known(hashes: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of hashes as sets of positions in the sorted ``hashes``, without those that it lacks."""
    out = []
    for s in sets:
        at = np.searchsorted(hashes, s)
        at[at == len(hashes)] = 0
        out.append(at[hashes[at] == s] if len(hashes) else at[:0])
    return out


def _sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows; 0 for empty ones."""
    out = np.zeros((len(starts), *values.shape[1:]), np.float64)
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def _margins(weights: np.ndarray, factors: np.ndarray, bias: float, sets: list[np.ndarray]):
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    ids = np.concatenate(sets) if len(sets) else np.empty(0, np.int64)
    v = factors[ids]
    total = _sums(v, starts, lengths)
    pairs = 0.5 * ((total * total).sum(axis=1) - _sums((v * v).sum(axis=1), starts, lengths))
    return bias + _sums(weights[ids], starts, lengths) + pairs, ids, v, total, lengths


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(packed: list[bytes], labels: list[int]) -> bytes:
    """Learn on the logistic loss; gives the packed model.

    Weights follow the regularized leader: one is zero until the gradients of its term, summed over
    all its documents, pass ``SHRINK``. Vectors follow AdaGrad, and shrink as a whole to zero at each
    use.
    """
    sets = [np.frombuffer(p, np.uint32) for p in packed]
    y = np.array(labels, np.float64)
    random = np.random.default_rng(SEED)
    hashes, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    positive = np.bincount(place, np.repeat(y, [len(s) for s in sets]), len(hashes))
    del place
    share, ones = seen / len(y), y.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / (len(y) - ones)))
    apart = np.abs(positive / ones - (seen - positive) / (len(y) - ones)) / error
    kept = (seen >= LEAST_DOCUMENTS) & (apart >= STANDARD_ERRORS)
    if kept.sum() > MOST_TERMS:
        kept &= apart >= np.partition(apart, -MOST_TERMS)[-MOST_TERMS]
    hashes, size = hashes[kept], int(kept.sum())
    sets = _known(hashes, sets)
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    v, gv = random.normal(0, 0.01, (size, FACTORS)), np.ones(size)
    bias, gb = float(np.log(y.mean() / (1 - y.mean()))), 1.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # each class weighs the same
    for _ in range(EPOCHS):
        order = random.permutation(len(sets))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            margin, ids, vectors, total, lengths = _margins(w, v, bias, [sets[i] for i in rows])
            g = (_sigmoid(margin) - y[rows]) * weight[rows]
            gb += g.sum() ** 2
            bias -= RATE * g.sum() / np.sqrt(gb)
            if not len(ids):
                continue
            each = np.repeat(g, lengths)
            used, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, each, len(used))
            root = np.sqrt(n[used] + dw * dw)
            z[used] += dw - (root - np.sqrt(n[used])) / RATE * w[used]
            n[used] += dw * dw
            w[used] = -np.sign(z[used]) * np.maximum(np.abs(z[used]) - SHRINK, 0) / ((1 + root) / RATE + RIDGE)
            live = v[used].any(axis=1)
            if live.any():
                slope = each[:, None] * (np.repeat(total, lengths, axis=0) - vectors)
                dv = np.stack([np.bincount(place, slope[:, f], len(used)) for f in range(FACTORS)], axis=1)[live]
                at_live = used[live]
                gv[at_live] += (dv * dv).sum(axis=1)
                rate = (RATE / np.sqrt(gv[at_live]))[:, None]
                step = v[at_live] - rate * dv
                norm = np.sqrt((step * step).sum(axis=1, keepdims=True))
                v[at_live] = step * np.maximum(1 - rate * SHRINK_FACTORS / np.maximum(norm, 1e-12), 0)
    some = (w != 0) | v.any(axis=1)
    return b"".join([struct.pack("<dq", bias, int(some.sum())), hashes[some].tobytes(),
                     w[some].astype(np.float32).tobytes(), v[some].astype(np.float32).tobytes()])


@functools.lru_cache(maxsize=2)
def _model(packed: bytes) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    bias, n = struct.unpack_from("<dq", packed)
    hashes = np.frombuffer(packed, np.uint32, n, 16)
    w = np.frombuffer(packed, np.float32, n, 16 + 4 * n)
    return bias, hashes, w, np.frombuffer(packed, np.float32, n * FACTORS, 16 + 8 * n).reshape(n, FACTORS)


kept_by("toxicity", _model.cache_clear)


def score(packed: bytes, texts: list[str]) -> np.ndarray:
    """Probabilities of the toxic class; texts are taken in stretches of bounded size."""
    bias, hashes, w, v = _model(packed)
    out, sets, held = [], [], 0
    for text in texts:
        sets.append(terms(text))
        held += len(sets[-1])
        if held >= 200_000:
            out.append(_margins(w, v, bias, _known(hashes, sets))[0])
            sets, held = [], 0
    if sets:
        out.append(_margins(w, v, bias, _known(hashes, sets))[0])
    return _sigmoid(np.concatenate(out)) if out else np.empty(0)


def learn(training: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> bytes | None:
    """A machine from at most ``MOST_ROWS`` rows of ``training`` that ``labels`` marks, none of the
    held-out fold; None without labels of both classes."""
    return labelled.train(training, labels, label, MOST_ROWS, lambda t: terms(t).tobytes(), fit, doc_id, text)


def toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null and empty texts get the score of no terms; without labels of both classes every score is 0.
    Repeated rows get equal scores; an empty table gives an empty result. Other columns are never read.
    """
    return labelled.apply(docs, learn(training, labels, label, doc_id, text), score, THRESHOLD, doc_id, text)


def clean(docs: DataFrame, training: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> DataFrame:
    """Rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    return labelled.passing(docs, learn(training, labels, label, doc_id, text), score, THRESHOLD, 0, text)
