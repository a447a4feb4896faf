"""Operator 12, byte-level BPE encoding and decoding, by corpus-level merge replay.

The distinct words (matches of the tokenizer's pattern) of many documents lie in one flat array of symbols. An inverted index
leads from the token that a pair makes to the positions of that pair in words. The lowest rank in the index is taken, merged at
all of its positions, and only the pairs of the touched neighbours enter the index anew; so each merge of the ranks is
applied once for the whole corpus of words, not once for each text.

1. ``lexicon``: Spark counts the words of the whole corpus; those that make up over 1 / LEXICON of it are replayed, each once.
   So they are fewer than LEXICON, of at most LONGEST bytes, and safe to broadcast at any size of input.
2. A task replays all words of its documents that the lexicon lacks in an index of its own, share by share of the documents:
   SHARE characters, so its memory is bounded. Every word gets its ids by a replay, wherever that is.
3. A text is cut at single blanks between other characters, where the pattern always cuts; each distinct piece is matched
   against the pattern once for a share.

As the library does: a word that is a token is that token; else the lowest rank goes first, of equal ones the leftmost; pairs
are known by the bytes they make. Where a merge may make a pair of lower rank than its own, its positions in a word are
taken one at a time.

Defined results: a null or empty text has no ids and decodes to nothing; a null doc_id is smallest; each row that repeats
a doc_id gets its own text's result; ties do not arise; very long texts are whole; an empty table gives an empty one;
extra columns are not read. Lone surrogates cannot stand in Spark's strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.base import doc_id, keyed, record, stash
from veilspark.llm.wordtok import _SPACE

#: A word of the lexicon is over 1 / LEXICON of all words; bytes of the longest of them; characters of a share; pieces that a task
#: remembers between shares.
LEXICON, LONGEST, SHARE, REMEMBERED = 1 << 18, 64, 16_000_000, 600_000
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def matcher(pattern: str):
    """The pattern with its white space spelt out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


class Ranks:
    """A file of ranks: tokens, and the pairs of tokens that make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = dict(zip(self.rank.values(), self.rank, strict=True))
        self.width = max(self.token) + 1
        pairs = [(self.rank[t[:i]] * self.width + self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        pairs.sort()
        self.keys, self.made = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.letters = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        two = {t: r for t, r in self.rank.items() if len(t) == 2}
        self.of_bytes = np.full(1 << 16, -1, np.int32)  # what two bytes make
        self.of_bytes[[t[0] << 8 | t[1] for t in two]] = list(two.values())
        self.back = np.zeros(self.width, bool)  # whether a pair with this token makes one of lower rank
        for side in (self.keys // self.width, self.keys % self.width):
            self.back[side[self.made < side]] = True

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair makes, or -1."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list = [[self.rank[w]] if w in self.rank else None for w in words]
        rest = [i for i, w in enumerate(out) if w is None and words[i]]
        if not rest:
            return [x or [] for x in out]
        sizes = np.array([len(words[i]) for i in rest], np.int64)
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        data = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
        symbol = np.append(self.letters[data], np.int32(0))
        if (symbol < 0).any():
            raise ValueError("the ranks lack a byte")
        word = np.append(np.repeat(np.arange(len(rest), dtype=np.int32), sizes), np.int32(len(rest)))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # n stands for none
        after[ends - 1] = after[n] = n
        before[ends - sizes] = before[n] = n
        makes = np.full(n + 1, -1, np.int32)  # what the pair at each position makes now; -1 also where the symbol is gone
        inner = np.flatnonzero(after[:n] < n).astype(np.int32)
        makes[inner] = self.of_bytes[(data[inner].astype(np.int32) << 8) | data[inner + 1]]
        alive, merged = np.ones(n + 1, bool), np.zeros(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = makes[at]
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(waiting, r)

        enter(inner)
        while waiting:
            r = heapq.heappop(waiting)
            parts = index.pop(r)
            at = np.sort(parts[0] if len(parts) == 1 else np.concatenate(parts))
            at = at[(makes[at] == r) & np.concatenate([[True], at[1:] != at[:-1]])]
            if not len(at):
                continue
            if self.back[r]:
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(waiting, r)
                at = at[first]
            elif len(at) > 1:  # of pairs in a row, each shares a symbol with the next: every other one
                new = np.concatenate([[True], after[at[:-1]] != at[1:]])
                if not new.all():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            gone = after[at]
            then = after[gone]
            symbol[at], makes[gone], alive[gone] = r, -1, False
            after[at], before[then] = then, at
            before[n] = n
            left = before[at]
            merged[at] = True
            touched = np.concatenate([at, left[(left < n) & ~merged[left]]])
            merged[at] = False
            right = after[touched]
            makes[touched] = np.where(right < n, self.of_pairs(symbol[touched], symbol[right]), -1)
            enter(touched)
            makes[n] = -1
        alive = alive[:n]
        ids, cut = symbol[:n][alive].tolist(), np.concatenate([[0], np.cumsum(np.bincount(word[:n][alive], minlength=len(rest)))]).tolist()
        for i, a, b in zip(rest, cut, cut[1:], strict=False):
            out[i] = ids[a:b]
        return [x or [] for x in out]


_RANKS: dict[str, Ranks] = {}


def shared_ranks(path: str) -> Ranks:
    """One table for each Python worker."""
    if path not in _RANKS:
        _RANKS[path] = Ranks(path)
    return _RANKS[path]


class _Numbers(dict):
    def __missing__(self, piece) -> int:
        self[piece] = n = len(self)
        return n


def _cut(text: str) -> list[str]:
    """The text at single blanks between other characters."""
    if text[:1] == " " or text[-1:] == " " or any(c in text and (c + " " in text or " " + c in text) for c in _WHITE):
        return _BLANK.split(text)
    return text.split(" ")


class Share:
    """Pieces and words of a share of the documents. ``numbers`` takes texts in, ``learn`` encodes what is new."""

    def __init__(self, ranks: Ranks, pattern: str, lexicon: dict[str, list[int]] | None = None):
        self.ranks, self.match, self.lexicon = ranks, matcher(pattern).findall, lexicon or {}
        self.letters = pattern == default_pattern()  # there letters, with or without a blank before them, are one word
        self.clear()

    def clear(self) -> None:
        self.pieces = _Numbers()
        self.flat, self.start = array("I"), array("q", [0])
        self.shown: list[bytes] = []
        self.decoded: list[bytes] = []

    def numbers(self, text: str) -> np.ndarray:
        parts: list = _cut(text)
        parts[0] = (parts[0],)  # the only one without a blank before it
        return np.fromiter(map(self.pieces.__getitem__, parts), np.int32, len(parts))

    def words(self, first: int = 0):
        """The words of each piece from the first given on."""
        for x in itertools.islice(self.pieces, first, None):
            x = x[0] if isinstance(x, tuple) else " " + x
            yield [x] if self.letters and x.removeprefix(" ").isalpha() else self.match(x)

    def learn(self) -> None:
        new = list(self.words(len(self.shown)))
        missing = list(dict.fromkeys(w for x in new for w in x if w not in self.lexicon))
        coded = dict(zip(missing, self.ranks.replay([w.encode() for w in missing]), strict=True))
        token = self.ranks.token
        for x in new:
            ids = [i for w in x for i in (coded.get(w) or self.lexicon[w])]
            self.flat.extend(ids)
            self.start.append(len(self.flat))
            self.shown.append(b"%d " * len(ids) % tuple(ids))
            self.decoded.append(b"".join([token[i] for i in ids]))


_SHARES: dict[tuple, Share] = {}


def _shares(batches, share: Share):
    """(keys, numbers of each text's pieces) for shares of the documents, once all their pieces are learnt."""
    keys, numbers, size = [], [], 0
    for batch in batches:
        for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
            keys.append(k)
            numbers.append(share.numbers(text))
            size += len(text)
            if size >= SHARE or len(share.pieces) - len(share.shown) > REMEMBERED:
                share.learn()
                yield keys, numbers
                keys, numbers, size = [], [], 0
                if len(share.pieces) > REMEMBERED:
                    share.clear()
    if keys:
        share.learn()
        yield keys, numbers
    if len(share.pieces) > REMEMBERED:
        share.clear()


def lexicon(docs: DataFrame, path: str | None = None, pattern: str | None = None, most: int = LEXICON) -> DataFrame:
    """(word, ids array<int>) of the words that are over 1 / most of all words of all texts. Counts are exact."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def counted(batches):
        share, of = Share(shared_ranks(path), pattern), pa.schema([("word", pa.string()), ("n", pa.int64())])

        def told(counts):
            n: dict[str, int] = {}
            for words, times in zip(share.words(), counts.tolist(), strict=True):
                for w in words:
                    n[w] = n.get(w, 0) + times
            yield record(of, list(n), list(n.values()))
            share.clear()

        counts, size = np.zeros(0, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                got = share.numbers(text)
                if len(counts) < len(share.pieces):
                    counts = np.append(counts, np.zeros(len(share.pieces) + 100_000 - len(counts), np.int64))
                np.add.at(counts, got, 1)
                size += len(text)
                if size >= SHARE or len(share.pieces) > REMEMBERED:
                    yield from told(counts[: len(share.pieces)])
                    counts, size = np.zeros(0, np.int64), 0
        yield from told(counts[: len(share.pieces)])

    def replayed(batches):
        ranks, of = shared_ranks(path), pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield record(of, words, ranks.replay([w.encode() for w in words]))

    counts = stash(keyed(docs).select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where((F.col("n") * most > total) & (F.octet_length("word") <= LONGEST)).select("word")
    return top.mapInArrow(replayed, "word string, ids array<int>")


_CODED = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGEST = pa.schema([("k", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _mapped(docs: DataFrame, path: str | None, pattern: str | None, schema: str, row) -> DataFrame:
    path, pattern = path or default_path(), pattern or default_pattern()
    known = docs.sparkSession.sparkContext.broadcast({w: list(ids) for w, ids in lexicon(docs, path, pattern).collect()})
    name = (path, pattern, uuid.uuid4().hex)

    def rows(batches):
        if name not in _SHARES:  # the tasks of a worker share what they have learnt
            _SHARES.clear()
            _SHARES[name] = Share(shared_ranks(path), pattern, known.value)
        share = _SHARES[name]
        for keys, numbers in _shares(batches, share):
            for low in range(0, len(keys), 1000):
                yield row(share, keys[low : low + 1000], numbers[low : low + 1000])

    return keyed(docs).mapInArrow(rows, schema)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of whole texts."""

    def row(share, keys, numbers):
        start, flat = np.frombuffer(share.start, np.int64), np.frombuffer(share.flat, np.uint32)
        ids = [np.concatenate([flat[:0], *(flat[start[p] : start[p + 1]] for p in x.tolist())]).astype(np.int32) for x in numbers]
        return record(_CODED, keys, ids, [b"".join([share.ranks.token[i] for i in x.tolist()]).decode("utf-8", "replace") for x in ids])

    return _mapped(docs, path, pattern, "k long, ids array<int>, decoded string", row).select(doc_id(), "ids", "decoded")


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of decimal ids joined by blanks, and of the decoded bytes."""

    def row(share, keys, numbers):
        lists = [x.tolist() for x in numbers]
        counts = np.diff(np.frombuffer(share.start, np.int64))
        shown = [hashlib.sha256(b"".join(map(share.shown.__getitem__, x))[:-1]).hexdigest() for x in lists]
        return record(_DIGEST, keys, [int(counts[x].sum()) for x in numbers], shown, [hashlib.sha256(b"".join(map(share.decoded.__getitem__, x))).hexdigest() for x in lists])

    return _mapped(docs, path, pattern, "k long, n_tokens long, ids_sha256 string, decoded_sha256 string", row).select(doc_id(), "n_tokens", "ids_sha256", "decoded_sha256")
