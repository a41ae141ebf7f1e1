"""Alignment of two tokenizers against the libraries and a plain loop."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from helpers import documents
from pomelo.llm import alignment as al
from pomelo.llm import worker_caches
from pomelo.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None
    return tokens


def brute(rows, tokens):
    docs, count = [], Counter()
    for i, text in rows:
        found = tokens(text) if text else None
        if not found:
            docs.append((i, [], "", 0, 0))
            continue
        ids_a, bytes_a, ids_b, bytes_b = found
        spans = lambda parts: list(zip(np.cumsum([0, *map(len, parts[:-1])]).tolist(), np.cumsum(list(map(len, parts))).tolist()))
        span_a, span_b = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for (s, e), x in zip(span_a, ids_a) for (t, f), y in zip(span_b, ids_b) if s < f and t < e]
        both = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, low = [], 0
        for end in both:
            inside = lambda spans, ids: ",".join(str(x) for (s, e), x in zip(spans, ids) if low < e <= end)  # noqa: E731,B023
            groups.append(inside(span_a, ids_a) + "|" + inside(span_b, ids_b))
            low = end
        count.update(links)
        docs.append((i, links, ";".join(groups), len(ids_a), len(ids_b)))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((i, n_a, n_b, g.count(";") + bool(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), g) for i, links, g, n_a, n_b in docs), count


PARTS = [" ", " ", " ", "  ", "\n", "\t", "a", "Be", "<|endoftext|>", "<s>", "12", "é", "!!", "'s", "\x85", "\xa0", "　", "²", "\r\n", "😀", "漢字", "word", "Ünï",
         "tokenization", " of", " the", " language", "<0x41>", "\x00", "▁"]


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS if draw.random() < 0.9 else PARTS[:-1]) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def result(df, last="groups"):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last).collect())


def rows_of(n, seed):
    return [*enumerate(texts(n, seed)), (1000, None), (1001, ""), (1002, "twice the same"), (1002, "twice the same"), (None, "without an id"), (1003, " "), (1004, "tail  "),
            (1005, "  head"), (1006, "▁"), (1007, "no sign "), (1008, "long unspaced" * 300)]


def test_ids_equal_the_libraries(libraries):
    pair = al.Pair(A, B)
    for text in texts(20_000, 2):
        found = libraries(text) if text else None
        a, b = pair.encode(text)
        assert a.tolist() == (found[0] if found else []) and b.tolist() == (found[2] if found else []), repr(text)
    assert 50256 not in pair.encode("<|endoftext|>")[0]


def test_against_a_plain_loop(spark, libraries):
    rows = rows_of(250, 3)
    want, count = brute(rows, libraries)
    docs = documents(spark, rows).repartition(4)
    assert result(al.align(docs, A, B, digest=False)) == want
    digests = Counter({(*k[:-1], hashlib.sha256(k[-1].encode()).hexdigest() if k[-1] else ""): n for k, n in want.items()})
    assert result(al.align(docs, A, B), "groups_sha256") == digests
    table = al.LinkCounts(al.encoded(docs, A, B), A, B).table()
    assert {(r["a_id"], r["b_id"]): r["links"] for r in table.collect()} == dict(count) and table.count() == len(count)


@pytest.mark.parametrize("shared,held,tokens", [(0, 10, 1), (60, 50, 40), (400, 10**6, 10**6)])
def test_bounds_change_no_result(spark, libraries, monkeypatch, shared, held, tokens):
    monkeypatch.setattr(al, "SHARED_PAIRS", shared)
    monkeypatch.setattr(al, "HELD_PAIRS", held)
    monkeypatch.setattr(al, "ALIGNED_TOKENS", tokens)
    rows = rows_of(120, 4)
    assert result(al.align(documents(spark, rows), A, B, digest=False)) == brute(rows, libraries)[0]


def test_empty_tables(spark):
    assert al.align(documents(spark, []), A, B).count() == 0
    assert result(al.align(documents(spark, [(1, None), (2, "")]), A, B), "groups_sha256") == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_caches_are_dropped_when_another_operator_starts():
    dropped = []
    worker_caches.kept_by("first of the test", lambda: dropped.append(1))
    worker_caches.start("first of the test")
    worker_caches.start("first of the test")
    assert not dropped
    worker_caches.start("second of the test")
    assert dropped == [1]


def test_bounded_in_bytes():
    cache = worker_caches.Generations(lambda x: b"x" * 100, 10_000)
    for k in range(1000):
        assert len(cache[f"w{k}"]) == 100
        assert cache._held <= 10_000 and len(cache) < 50
    assert cache["y" * 100] and "y" * 100 not in cache
    cache.clear()
    assert not cache and not cache._old
