"""Texts to token ids for tokenizers of the word-end BPE kind (word_bpe_49k.json).

A text is cut at white space into pieces, a piece into the pretokens of the tokenizer's pattern, and a
pretoken is encoded on its own. That gives what the tokenizers library gives for the whole text, since
neither its normalizer nor its pattern looks across white space, and lets each distinct piece be encoded
once: ``Encoder`` keeps a bounded table of the pieces it has seen.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cached_property
from itertools import islice

import numpy as np
import regex

#: White space of the tokenizer's pattern: Unicode White_Space. Python's split() adds \x1c-\x1f.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_CUT = re.compile(f"[{_SPACE}]+")
_EXTRA = re.compile("[\x1c-\x1f]")
#: A comma or stop between a letter and white space; a space before it leaves the pretokens as they are.
_MARK = re.compile(r"[,.](?<=[^\W\d_][,.])(?=\s)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def as_letters(pretoken: str) -> str:
    return pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)


class LibraryModel:
    """Encodes pretokens by the tokenizers library's own BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __call__(self, pretokens: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(as_letters(x))] for x in pretokens]


class _Pieces(dict):
    """Numbers pieces in the order in which they first appear."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """encode(texts) -> (ids, ends). The table of pieces starts anew beyond ``limit`` pieces."""

    def __init__(self, path: str, model=None, limit: int = 400_000):
        self.path, self.limit = path, limit
        self.model = model or LibraryModel(path)
        self._clear()

    def _clear(self) -> None:
        self.pieces, self.known = _Pieces(), 0
        self.flat, self.start = array("I"), array("q", [0])

    @cached_property
    def special(self) -> dict[str, int]:
        with open(self.path, encoding="utf-8") as f:
            return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}

    @cached_property
    def special_cut(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def _cut(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = _MARK.sub(r" \g<0>", text.lower())
        return [x for x in _CUT.split(text) if x] if _EXTRA.search(text) else text.split()

    def cut(self, text: str) -> list[str]:
        if "<|" not in text or not self.special:
            return self._cut(text)
        out: list[str] = []
        for i, part in enumerate(self.special_cut.split(text)):
            out += [" " + part] if i % 2 else self._cut(part)  # a piece has no space, so this names the token
        return out

    def _learn(self) -> None:
        new = list(islice(reversed(self.pieces), len(self.pieces) - self.known))[::-1]
        parts = [[x] if x[0] == " " else _PRETOKEN.findall(x) for x in new]
        distinct = list(dict.fromkeys(y for x in parts for y in x if y[0] != " "))
        of = dict(zip(distinct, self.model(distinct), strict=True))
        for x in parts:
            for y in x:
                self.flat.extend([self.special[y[1:]]] if y[0] == " " else of[y])
            self.start.append(len(self.flat))
        self.known = len(self.pieces)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > self.limit:
            self._clear()
        number, found = self.pieces.__getitem__, []
        for t in texts:
            pieces = self.cut(t)
            found.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if len(self.pieces) > self.known:
            self._learn()
        ends = np.cumsum([len(x) for x in found], dtype=np.int64)
        return np.concatenate(found) if found else np.zeros(0, np.int64), ends

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        numbers, ends = self._numbers(texts)
        start = np.frombuffer(self.start, np.int64)
        total = np.concatenate([[0], np.cumsum(np.diff(start)[numbers])]).astype(np.int64)
        return np.diff(total[np.concatenate([[0], ends]).astype(np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (uint32), and where each text's ids end."""
        numbers, ends = self._numbers(texts)
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.uint32)
        begin, size = start[numbers], np.diff(start)[numbers]
        total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        ids = flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        return ids, total[ends]


_KEPT: dict = {}


def shared_encoder(path: str, kind: str = "library") -> Encoder:
    """One encoder for each Python worker, so that its tasks share the table of pieces."""
    if (kind, path) not in _KEPT:
        if kind == "library":
            _KEPT[kind, path] = Encoder(path)
        else:
            from veilspark.llm.bpe import NumpyBpe

            _KEPT[kind, path] = Encoder(path, NumpyBpe.from_file(path))
    return _KEPT[kind, path]


def groups(texts: list[str], most: int = 4_000_000):
    """Runs (low, high) of texts of about ``most`` characters in all, at least one text each."""
    low = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield low, i
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)
