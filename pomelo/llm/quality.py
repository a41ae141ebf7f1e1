"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives each unit (a word, or the shape of a token) a sparse random index vector, and as
its word vector the sum of the index vectors that it meets within ``WINDOW`` tokens, over the labelled
sample. A text is the mean and the spread of its tokens' vectors and the mean product of vectors that
stand side by side; and, of the index vectors, how far neighbours agree and how long the mean is, which
tell repetition of words the sample has never seen. A network of two layers in numpy turns that into a margin,
and a temperature fitted on labelled rows that it has not seen makes it a probability.
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

BUCKETS = 1 << 15
SHAPES = 64
DIMENSION, NONZEROS, WINDOW = 48, 4, 2
LEAST_TOKENS = 4          # a word that the sample holds less often has its shape's vector
MOST_ROWS = {0: 3_000, 1: 5_000}   # labelled rows that are learnt from, by class, at most
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 64, 3e-3, 1e-4
THRESHOLD = 0.5
EXTRA = 3                 # numbers of a text besides the pooled vectors
STRETCH = 4_096           # tokens of a text that are in memory as vectors at once
SEED = 9

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _shape(token: str) -> int:
    """Number of a token's shape: its letters' case and length, or its first sign and their number."""
    n = min(len(token), 12)
    if token.isdigit():
        return 0
    if token[0].isalnum() or token[0] == "_":
        case = 1 if token.islower() else 2 if token.isupper() and n > 1 else 3 if token[0].isupper() else 4
        return 4 * (1 + (n > 2) + (n > 5) + (n > 9)) + case - 1
    return 32 + 8 * min(n - 1, 3) + ord(token[0]) % 8


def _unit(token: str) -> int:
    """A token's word bucket and shape as one number."""
    return (xxhash.xxh32_intdigest(token.lower(), SEED) % BUCKETS) * SHAPES + _shape(token)


_UNITS = Generations(_unit)
kept_by("quality", _UNITS.clear)


def units(text: str) -> np.ndarray:
    """The units of a whole text's tokens, in order."""
    start("quality")
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(_UNITS.__getitem__, tokens), np.int32, len(tokens))


@functools.lru_cache(maxsize=1)
def _index_vectors() -> np.ndarray:
    """A sparse row of +1 and -1 for each word bucket, and then for each shape."""
    random = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + SHAPES, DIMENSION), np.float32)
    for k in range(NONZEROS):
        at = random.integers(0, DIMENSION, len(out))
        out[np.arange(len(out)), at] += random.choice(np.array([-1, 1], np.float32), len(out))
    return out


def word_vectors(sets: list[np.ndarray]) -> np.ndarray:
    """Word vector of each bucket and shape, of length one; a rare bucket's row is zero."""
    index = _index_vectors()
    vectors = np.zeros_like(index, np.float64)
    counts = np.zeros(len(index), np.int64)
    for ids in sets:
        if not len(ids):
            continue
        rows, shapes = ids // SHAPES, BUCKETS + ids % SHAPES
        own = index[rows] + index[shapes]
        around = np.zeros_like(own)
        for k in range(1, WINDOW + 1):
            around[k:] += own[:-k]
            around[:-k] += own[k:]
        for which in (rows, shapes):
            order = np.argsort(which, kind="stable")
            keys, starts = np.unique(which[order], return_index=True)
            vectors[keys] += np.add.reduceat(around[order], starts, axis=0)
            counts += np.bincount(which, minlength=len(index))
    vectors[:BUCKETS][counts[:BUCKETS] < LEAST_TOKENS] = 0
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (vectors / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and mean neighbour product of a text's token vectors, the share of tokens that have a
    word vector, the agreement of neighbours' index vectors and the length of their mean; zeros for a
    text without tokens. Long texts are taken in stretches."""
    d = vectors.shape[1]
    total, squares, products = np.zeros(d), np.zeros(d), np.zeros(d)
    if not len(ids):
        return np.zeros(3 * d + EXTRA)
    words = ids // SHAPES
    # equal words have equal index vectors, and those of different words are near orthogonal
    agreement = float((words[1:] == words[:-1]).mean()) if len(ids) > 1 else 0.0
    used, counts = np.unique(words, return_counts=True)
    center = (_index_vectors()[used] * counts[:, None]).sum(axis=0) / len(ids)
    known, last = 0, None
    for at in range(0, len(ids), STRETCH):
        part = ids[at:at + STRETCH]
        x = vectors[part // SHAPES]
        missing = ~x.any(axis=1)
        known += len(part) - int(missing.sum())
        x[missing] = vectors[BUCKETS + part[missing] % SHAPES]
        total += x.sum(axis=0)
        squares += np.einsum("ij,ij->j", x, x)
        products += np.einsum("ij,ij->j", x[1:], x[:-1])
        if last is not None:
            products += x[0] * last
        last = x[-1]
    n = len(ids)
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), products / n,
                           [known / n, agreement, np.sqrt((center * center).sum() / NONZEROS)]])


def _network(x: np.ndarray, layers) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2


def _learn(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the logistic loss, classes weighing the same."""
    random = np.random.default_rng(SEED)
    layers = [random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    t = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            hidden, margin = _network(x[rows], layers)
            g = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[rows]) * weight[rows] / len(rows)
            back = np.outer(g, layers[2]) * (hidden > 0)
            t += 1
            for i, grad in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ g, np.array([g.sum()]))):
                grad = grad + DECAY * layers[i]
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                layers[i] = layers[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def _temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss, over a grid from 1/8 to 8."""
    if len(set(y.tolist())) < 2:
        return 1.0
    grid = 2.0 ** np.linspace(-3, 3, 49)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * margin / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(packed: list[bytes], labels: list[int]) -> bytes:
    """Word vectors, network and temperature from the labelled sample; gives the packed model.

    A fifth of the rows is left out of a first network and sets the temperature; the final network
    learns from all.
    """
    sets, y = [np.frombuffer(p, np.int32) for p in packed], np.array(labels, np.float64)
    vectors = word_vectors(sets).astype(np.float16).astype(np.float32)
    x = np.array([pooled(s, vectors) for s in sets])
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - center) / scale, -8, 8)
    aside = np.arange(len(y)) % 5 == 4
    temperature = 1.0
    if len(set(y[~aside].tolist())) == 2 and aside.any():
        temperature = _temperature(_network(x[aside], _learn(x[~aside], y[~aside]))[1], y[aside])
    layers = _learn(x, y)
    rest = np.concatenate([center, scale, *[p.ravel() for p in layers], [temperature]])
    return struct.pack("<q", len(rest)) + rest.astype(np.float64).tobytes() + vectors.astype(np.float16).tobytes()


@functools.lru_cache(maxsize=2)
def _model(packed: bytes):
    n = struct.unpack_from("<q", packed)[0]
    rest = np.frombuffer(packed, np.float64, n, 8)
    vectors = np.frombuffer(packed, np.float16, (BUCKETS + SHAPES) * DIMENSION, 8 + 8 * n)
    size, at, parts = 3 * DIMENSION + EXTRA, 0, []
    for shape in ((size,), (size,), (size, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)):
        k = int(np.prod(shape))
        parts.append(rest[at:at + k].reshape(shape))
        at += k
    return parts[0], parts[1], parts[2:], float(rest[at]), vectors.astype(np.float32).reshape(-1, DIMENSION)


kept_by("quality", _model.cache_clear)
kept_by("quality", _index_vectors.cache_clear)


def score(packed: bytes, texts: list[str]) -> np.ndarray:
    """Probabilities that texts are of good quality."""
    center, scale, layers, temperature, vectors = _model(packed)
    if not texts:
        return np.empty(0)
    x = np.array([pooled(units(t), vectors) for t in texts])
    margin = _network(np.clip((x - center) / scale, -8, 8), layers)[1] / temperature
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def learn(training: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> bytes | None:
    """A model from at most ``MOST_ROWS`` rows of ``training`` that ``labels`` marks, none of the
    held-out fold; None without labels of both classes."""
    return labelled.train(training, labels, label, MOST_ROWS, lambda t: units(t).tobytes(), fit, doc_id, text)


def quality(docs: DataFrame, training: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
            label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null and empty texts get the score of a text without tokens; without labels of both classes every
    score is 1, so that nothing is rejected unjudged. Repeated rows get equal scores; an empty table
    gives an empty result. Other columns are never read.
    """
    return labelled.apply(docs, learn(training, labels, label, doc_id, text), score, THRESHOLD, doc_id, text, 1.0)


def good(docs: DataFrame, training: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
         label: str = "quality") -> DataFrame:
    """Rows of ``docs`` that are predicted to be of good quality, with all their columns."""
    return labelled.passing(docs, learn(training, labels, label, doc_id, text), score, THRESHOLD, 1, text, 1.0)
