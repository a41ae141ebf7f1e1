"""Token ids, counts and packing against the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import documents
from pomelo.llm import packing, token_counts, tokens
from pomelo.llm.queries import tokenizer_path

PARTS = [" ", "  ", "\n", "\t", "a", "Be", "<|endoftext|>", "12", "é", "!!", "'s", "\x1c", "\x85", "\xa0", "　",
         "़", "²", "|", "\r\n", "😀", "​", "漢", "ՙ", "՘", "್", "֋", "\x00", "word", "Ünï"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_ids_equal_the_library(library):
    enc = tokens.Encoder(tokenizer_path())
    for text in texts(20_000):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_are_whole(name):
    enc = tokens.Encoder(tokenizer_path(name))
    assert not enc.cut
    text = "Hello  World\nagain"
    assert enc.length(text) == len(enc.ids(text)) // 4 > 0


def test_counts(spark, library):
    rows = [(1, "A small text."), (2, None), (3, ""), (3, ""), (None, "no id"), (4, "<|endoftext|> in a text"),
            (5, "long " * 40_000), *[(100 + i, t) for i, t in enumerate(texts(300, 2))]]
    df = token_counts.count_tokens(documents(spark, rows), tokenizer_path())
    got = Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert got == want
    assert token_counts.count_tokens(documents(spark, []), tokenizer_path()).count() == 0
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_frequent_table_only_speeds_up(spark, monkeypatch):
    docs = documents(spark, list(enumerate(texts(200, 3))))
    full = sorted(map(tuple, token_counts.count_tokens(docs, tokenizer_path()).collect()))
    monkeypatch.setattr(token_counts, "FREQUENT_PIECES", 0)
    assert sorted(map(tuple, token_counts.count_tokens(docs, tokenizer_path()).collect())) == full


def test_difference_deals_each_item_once():
    draw = random.Random(4)
    for _ in range(100):
        lengths = [draw.randint(1, 1000) for _ in range(draw.randint(0, 60))]
        k = draw.randint(1, 12)
        dealt = packing.difference(lengths, k)
        assert len(dealt) <= k
        assert sorted(i for w in dealt for i in w) == list(range(len(lengths)))


def test_difference_is_near_even():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    draw = random.Random(5)
    lengths = [draw.randint(1, 300) for _ in range(800)]
    sums = [sum(lengths[i] for i in w) for w in packing.difference(lengths, 100)]
    assert max(sums) - min(sums) <= 25


def test_windows_rise_until_all_fit():
    assert len(packing.windows([600, 600, 600], 1024)) == 3  # 1800 tokens would go into two
    assert packing.windows([], 1024) == []


def check_packing(rows, got, library, size=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert 1 <= r["length"] <= size
    copies = Counter(i for i, _ in rows)
    for i, t in dict(rows).items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert sum(r["length"] for r in by_doc[i]) == copies[i] * len(ids) // 4
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]) if copies[i] == 1 else []:
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            at += r["length"]
            assert zlib.crc32(ids[4 * r["start"]:4 * at]) == r["ids_crc32"]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return by_sequence


def test_pack(spark, library):
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice(["the", "quick", "brünn", "x1"]) for _ in range(draw.randint(0, 900)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 30_000), (1003, "twice"), (1003, "twice")]
    got = packing.pack(documents(spark, rows).repartition(3), tokenizer_path()).collect()
    sequences = check_packing(rows, got, library)
    used = sum(r["length"] for r in got)
    assert used / (1024 * len(sequences)) > 0.95
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0


def test_frequent_pieces_of_all_texts_are_found(spark, monkeypatch):
    rows = [(i, f"x early{i % 7}") for i in range(2500)] + [(5000 + i, "x later later") for i in range(2500)] + [(9000, "x " + "long " * 8000)]
    joined, counts = token_counts.frequent_table(documents(spark, rows).coalesce(1), tokenizer_path())
    assert joined.split(" ")[:2] == ["long", "later"] and len(counts) == len(joined.split(" "))
    monkeypatch.setattr(token_counts, "COUNTED_PIECES", 8)
    seen = Counter({f"p{i}": 1 for i in range(12)} | {"often": 50, "more": 40})
    token_counts._bounded(seen)
    assert set(seen) == {"often", "more"}


def test_sample_is_of_bounded_size_and_from_all_rows(spark):
    docs = documents(spark, [(i, "text") for i in range(20_000)])
    some = [r["doc_id"] for r in token_counts.sampled(docs, documents=500).collect()]
    assert 350 < len(some) < 650 and min(some) < 1000 and max(some) > 19_000
    assert token_counts.sampled(docs, documents=20_000).count() == 20_000


def test_rank_table_agrees_on_all_characters_that_it_is_used_for(library):
    enc = tokens.Encoder(tokenizer_path())
    assert enc._fast is not None
    characters = [c for c in map(chr, range(0x110000)) if tokens.SAME_CLASSES.fullmatch(c)]
    assert len(characters) > 30_000
    for at in range(0, len(characters), 500):
        some = [f"x{c}y {c}1{c}{c} {c}\n{c}'s" for c in characters[at:at + 500]]
        for text, want in zip(some, library.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(enc.ids(text), "<u4").tolist() == want.ids, repr(text)
            assert enc.length(text) == len(want.ids)


def test_other_vocabularies_have_no_ranks():
    assert tokens.by_rank({"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}) is None
