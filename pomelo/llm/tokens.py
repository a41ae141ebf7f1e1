"""Token ids of whole texts, computed in Python workers from cached pieces.

A byte-level BPE tokenizer never merges across its pre-tokens, and a pre-token starts wherever a
space is followed by a character that is no white space. So a text can be cut at such places, and
the ids of the parts put one behind the other are the ids of the text. Parts repeat, and their ids
are looked up instead of computed. Tokenizers of another kind encode each text as a whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import regex

from . import worker_caches
from .worker_caches import Generations

# Two white space characters in a row: the place where cutting at spaces alone would be wrong.
_RUN = re.compile(r"\s\s")
# The general cut: words with the space before them, and runs of white space as the tokenizer sees them.
_CUTS = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
# The pre-tokens of a byte-level tokenizer, as its published pattern has them, and the characters
# whose Unicode classes are the same in the regex module and in the tokenizer library.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ONE_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
SAME_CLASSES = re.compile(r"[\0-\u052f\u3000-\u9fff\uac00-\ud7a3]*")


def byte_alphabet() -> dict[int, int]:
    """The character a byte-level model writes for each byte: itself if it is printable, else one
    from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


def entry_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; none for entries that are not written in its alphabet."""
    back = {chr(c): b for b, c in byte_alphabet().items()}
    entries = [b""] * (1 + max(vocabulary.values(), default=0))
    for token, i in vocabulary.items():
        entries[i] = bytes(back[c] for c in token) if all(c in back for c in token) else b""
    return entries


def by_rank(model: dict):
    """A byte-level BPE as a table of ranks for a faster library; None if its ids are not in the order of its merges."""
    vocabulary = model["vocab"]
    entries = entry_bytes(vocabulary)
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = [i for i, held in enumerate(entries) if len(held) == 1]
    if len(single) != 256 or not merged or merged != sorted(set(merged)) or max(single) > merged[0]:
        return None
    import tiktoken
    return tiktoken.Encoding("by rank", pat_str=PRE_TOKENS.pattern, mergeable_ranks={entries[i]: i for i in [*single, *merged]}, special_tokens={})


class Encoder:
    """One tokenizer file in one worker. ``ids(text)`` gives the ids as packed unsigned 32-bit
    little-endian numbers. Special strings in a text are tokens of their own, as is the library's
    default, or with ``plain`` ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        self.path = path
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole, self.cut = lambda text: model.encode(text, num_threads=1), False
        else:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            tokenizer.encode_special_tokens = plain
            self._whole = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            self._model, self._alphabet = tokenizer.model, byte_alphabet()
            with open(path, encoding="utf-8") as file:
                description = json.load(file)
            before = description.get("pre_tokenizer") or {}
            added = description.get("added_tokens") or []
            self.cut = (description.get("normalizer") is None and before.get("type") == "ByteLevel"
                        and before.get("use_regex", True) and not before.get("add_prefix_space")
                        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
                                    for t in added))
            if plain:
                added = [t for t in added if not t["special"]]
            self._special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
            self._parts = (re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")
                           if added else None)
            self._fast = by_rank(description["model"]) if self.cut else None
        self._tokens = Generations(self._pre_token)
        self.after_space = Generations(lambda piece: self._piece(" " + piece))
        self.at_start = Generations(self._piece)

    def _pack(self, text: str) -> bytes:
        return np.array(self._whole(text), "<u4").tobytes()

    def _pre_token(self, token: str) -> bytes:
        written = token.encode().decode("latin-1").translate(self._alphabet)
        return array("I", [t.id for t in self._model.tokenize(written)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if _ONE_WORD.fullmatch(piece):
            return self._tokens[piece]
        if SAME_CLASSES.fullmatch(piece) is None:
            return self._pack(piece)
        return b"".join(map(self._tokens.__getitem__, PRE_TOKENS.findall(piece)))

    def pieces(self, text: str):
        """Yield (starts with a space that is left out, pieces) for consecutive parts of ``text``."""
        if _RUN.search(text):
            yield False, _CUTS.findall(text)
            return
        first = True
        for line in text.split("\n"):
            if not first:
                yield False, ("\n",)
            first = False
            head, *rest = line.split(" ")
            if head:
                yield False, (head,)
            yield True, rest

    def segments(self, text: str):
        """Yield (text, is special) around the special strings."""
        if self._parts is None or not self._parts.search(text):
            yield text, False
            return
        for k, part in enumerate(self._parts.split(text)):
            if part:
                yield part, k % 2 == 1

    def ids(self, text: str) -> bytes:
        if not self.cut:
            return self._pack(text)
        out = []
        for part, special in self.segments(text):
            if special:
                out.append(self._special[part])
                continue
            if self._fast is not None and SAME_CLASSES.fullmatch(part):
                out.append(self._fast.encode_to_numpy(part, disallowed_special=()).astype("<u4").tobytes())
                continue
            for spaced, pieces in self.pieces(part):
                out.extend(map((self.after_space if spaced else self.at_start).__getitem__, pieces))
        return b"".join(out)

    def length(self, text: str) -> int:
        """Number of tokens of a piece, or of a whole text if the tokenizer's texts can't be cut."""
        if not self.cut:
            return len(self._whole(text))
        if self._fast is not None and SAME_CLASSES.fullmatch(text):
            return len(self._fast.encode_ordinary(text))
        return len(self._piece(text)) // 4


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, operator: str, plain: bool = False) -> Encoder:
    """The encoder of this worker process, kept from task to task of an operator."""
    worker_caches.start(operator)
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
        worker_caches.kept_by(operator, _ENCODERS.clear)
    return _ENCODERS[path, plain]
