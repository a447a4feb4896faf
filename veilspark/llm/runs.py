"""Operator 13, periodic run detection, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and length of at least max(LEAST, TIMES * q) that no
neighbouring word extends keeping period q. Texts are independent, so the operator is narrow; a batch of texts is worked on
at once, as one array of word numbers with a separator of its own after each piece.

1. A run's words all lie in strings of GRAM words that occur twice in their text, since a run repeats at least
   LEAST * (TIMES - 1) / TIMES words. Only such words go on; this is a necessary condition, not a choice.
2. Prefix doubling gives the suffix array and, on its way, the dictionary of basic factors: for each power of two B the
   rank of the string of B words at each place. Equal ranks are equal strings.
3. A dyadic block is a string of B words at a multiple of B. A run of period q, B <= q < 2 * B, holds a block that occurs
   again q words on. So each block asks for its occurrences that start in the window from B to 2 * B words on: range
   successors, inside the block's interval of the suffix array, by a wavelet matrix over that array. They form an
   arithmetic progression. One or two give a candidate period each. From three on the block has the progression's
   difference d as a period; then a run can only match the ends of the block's stretch of period d with those of
   the progression's, which gives two candidates however long the progression. Periods below the least block are
   read off the basic factors of the next few places.
4. Each candidate is extended to both sides over basic factors, longest first; of one stretch the least period counts.

Defined results: a null text is empty; a text without words has no runs; a null doc_id is smallest and, having no
decimal, keeps its words in ``digest_documents``; rows that repeat a doc_id each get their own text's result; extra columns
are not read. Very long texts are whole: beside its words, a repeated word of a text takes about 8 * log2(n) bytes for n
repeated words in the batch, and a long text is a batch of its own. Nothing is collected, shuffled or broadcast.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.base import NO_ID, doc_id, keyed, record
from veilspark.llm.wordtok import groups

#: Least length of a run in words, and in periods.
LEAST, TIMES = 24, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Factors:
    """Suffix array, basic factors and wavelet matrix of an array of numbers whose last one is unique."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        order = np.argsort(x, kind="stable")
        rank = self._ranked(x[order], order)
        self.n, self.rank, self.ends = n, [rank], []
        while True:
            k, half = len(self.rank) - 1, 1 << (len(self.rank) - 1)
            at = np.arange(0, n - half + 1, half)  # the blocks of this size and their intervals of the suffix array
            counts = np.bincount(rank, minlength=n)
            self.ends.append(rank[at] + counts[rank[at]])
            if counts.max(initial=0) <= 1 or half >= n:
                break
            key = rank.astype(np.int64) * (n + 1)
            key[: n - half] += rank[half:] + 1
            order = np.argsort(key)
            rank = self._ranked(key[order], order)
            self.rank.append(rank)
        self.order = order
        self._wavelet()

    @staticmethod
    def _ranked(values: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Of each place, the number of places with smaller values."""
        new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        rank = np.empty(len(values), np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
        return rank

    def _wavelet(self) -> None:
        self.zeros, values = [], self.order.astype(np.int32)
        for bit in range(int(self.n).bit_length() - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Places under bound among the suffixes low to high."""
        found, bits = np.zeros(len(low), np.int64), len(self.zeros)
        for i, before in enumerate(self.zeros):
            one = (bound >> (bits - 1 - i)) & 1 == 1
            a, b = before[low], before[high]
            found += np.where(one, b - a, 0)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth place, ascending from 0, among the suffixes low to high."""
        found = np.zeros(len(low), np.int64)
        for before in self.zeros:
            a, b = before[low], before[high]
            one = nth >= b - a
            nth = np.where(one, nth - (b - a), nth)
            found = found * 2 + one
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return found

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words from the places x and y on."""
        got = np.zeros(len(x), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            rank, last = self.rank[k], self.n - 1
            same = (rank[np.minimum(x + got, last)] == rank[np.minimum(y + got, last)]) & (y + got + (1 << k) <= self.n) & (x + got + (1 << k) <= self.n)
            got += same << np.int64(k)
        return got

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words before the places x and y, x < y."""
        got = np.zeros(len(x), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            rank, back = self.rank[k], got + (1 << k)
            got += ((x >= back) & (rank[np.maximum(x - back, 0)] == rank[np.maximum(y - back, 0)])) << np.int64(k)
        return got

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch of this period around the words at and at + period."""
        return at - self.behind(at, at + period), at + period + self.ahead(at, at + period)


def _candidates(text: Factors, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods, one of each run at least."""
    first = max(least // 3, 1).bit_length() - 1
    places, periods = [], []

    def add(at, period):
        places.append(at)
        periods.append(period)

    for k in range(min(first, len(text.rank) - 1), len(text.rank)):
        size = 1 << k
        at = np.arange(0, text.n - size + 1, size)
        if k <= first:
            for q in range(1, size if k == first else max(least // 3, 1) + 1):
                near = at[at + q < text.n]
                add(near := near[text.rank[k][near] == text.rank[k][near + q]], np.full(len(near), q))
        low, high = text.rank[k][at].astype(np.int64), text.ends[k].astype(np.int64)
        often = high - low > 1
        at, low, high = at[often], low[often], high[often]
        skip, stop = text.below(low, high, np.minimum(at + size, text.n)), text.below(low, high, np.minimum(at + 2 * size, text.n))
        there = stop > skip
        at, low, high, skip, many = at[there], low[there], high[there], skip[there], (stop - skip)[there]
        one = text.nth(low, high, skip)
        add(at, one - at)
        more = many > 1
        at, one, many = at[more], one[more], many[more]
        two = text.nth(low[more], high[more], skip[more] + 1)
        pair = many == 2
        add(at[pair], (two - at)[pair])
        at, one, step = at[~pair], one[~pair], (two - one)[~pair]
        here, there = text.stretch(at, step), text.stretch(one, step)
        for a, b in zip(here, there, strict=True):
            fits = (b - a >= size) & (b - a < 2 * size) & (at + b - a < text.n)
            add(at[fits], (b - a)[fits])
    return np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(periods) if periods else np.zeros(0, np.int64)


def find(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text, given as word numbers, its runs as rows (start, length, period), by start, then period."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by blocks")
    gram = 1 << (max(least // 3, 1).bit_length() - 1)
    sizes = np.array([len(x) for x in texts], np.int64)
    words = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    held = np.zeros(len(words) + 1, np.int64)
    if len(words) >= gram:
        hashed, width = words.astype(np.uint64) * _MIX, 1
        hashed ^= hashed >> np.uint64(29)
        while width < gram:  # 64-bit hashes of strings of gram words; equal strings have equal ones, which is all that counts here
            hashed = (hashed[:-width] * np.uint64(0xBF58476D1CE4E5B9)) ^ (hashed[width:] * _MIX + np.uint64(width))
            hashed ^= hashed >> np.uint64(31)
            width *= 2
        hashed = hashed ^ (of[: len(hashed)].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        inside = np.flatnonzero(of[: len(hashed)] == of[gram - 1 :])
        hashed = hashed[inside]
        order = np.argsort(hashed)
        same = hashed[order][1:] == hashed[order][:-1]
        again = inside[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(inside) else inside
        np.add.at(held, again, 1)
        np.add.at(held, again + gram, -1)
    kept = np.flatnonzero(np.cumsum(held[:-1]) > 0)
    none = np.zeros((0, 3), np.int64)
    if not len(kept):
        return [none] * len(texts)
    # Pieces of neighbouring kept words of one text, each with a separator behind it.
    apart = np.concatenate([(np.diff(kept) > 1) | (np.diff(of[kept]) > 0), [True]])
    place = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(apart)[:-1]])
    x = np.full(len(kept) + int(apart.sum()), -1, np.int64)
    x[place] = words[kept]
    x[x < 0] = words.max() + 1 + np.arange(int(apart.sum()))
    origin = np.zeros(len(x), np.int64)
    origin[place] = kept
    text = Factors(x)
    at, period = _candidates(text, least)
    at, period = np.unique(np.stack([at, period]), axis=1) if len(at) else (at, period)
    start, end = text.stretch(at, period)
    good = end - start >= np.maximum(least, times * period)
    found = np.stack([start, end, period], axis=1)[good]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # the same stretch also has the multiples of its period
        found = found[np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)])]
    origin, begins = origin[found[:, 0]], np.concatenate([[0], np.cumsum(sizes)])
    text_of = of[origin]
    runs = np.stack([origin - begins[text_of], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    order = np.lexsort((runs[:, 2], runs[:, 0], text_of))
    runs, cut = runs[order], np.searchsorted(text_of[order], np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def left_over(n: int, runs: np.ndarray) -> np.ndarray:
    """Of n words, whether each stays: one in a run after the run's first period does not."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def best(runs: np.ndarray) -> tuple:
    """(start, length, period, exponent_milli) of the run with most periods; ties: least start, then least period."""
    top = None
    for s, n, q in runs.tolist():
        if top is None or n * top[2] > top[1] * q:
            top = (s, n, q)
    return (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])


def rebuilt(k: int, n: int) -> np.ndarray | None:
    """Which word each of the n words of document k becomes in the digest, or None where all stay."""
    h = zlib.crc32(str(k).encode())
    if k == NO_ID or h % 10 or not n:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < start, i, start + (i - start) % period)


def _found(batches, change, least: int, times: int):
    """(ids, words of each text, its runs) for groups of texts."""
    for batch in batches:
        ks, texts = batch.column("k"), batch.column("text").to_pylist()
        for low, high in groups(texts):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts[low:high]]
            if change:
                for i, k in enumerate(ks.slice(low, high - low).to_pylist()):
                    turned = change(k, len(words[i]))
                    if turned is not None:
                        words[i] = [words[i][j] for j in turned.tolist()]
            number = _Numbers().__getitem__
            yield ks.slice(low, high - low), words, find([np.fromiter(map(number, w), np.int64, len(w)) for w in words], least, times)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    return b" ".join(np.array(words, object)[left_over(len(words), runs)].tolist()) if len(runs) else b" ".join(words)


_RUNS = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
_DIGEST = pa.schema([("k", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start,length,period>>, collapsed string) of whole texts, as they are: all runs by
    start, then period, and the words that stay once each run keeps its first period only."""

    def rows(batches):
        for k, words, runs in _found(batches, None, least, times):
            shown = [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs]
            yield record(_RUNS, k, [len(w) for w in words], shown, [_collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)])

    return keyed(docs).mapInArrow(rows, "k long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").select(doc_id(), "n_words", "runs", "collapsed")


def digest_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), after one document in ten has
    been made periodic from some word on (``rebuilt``)."""

    def rows(batches):
        for k, words, runs in _found(batches, rebuilt, LEAST, TIMES):
            top = list(zip(*(best(r) for r in runs), strict=True)) or [()] * 4
            lines = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r.tolist()).encode()).hexdigest() for r in runs]
            yield record(_DIGEST, k, [len(r) for r in runs], *top, lines, [hashlib.sha256(_collapsed(w, r)).hexdigest() for w, r in zip(words, runs, strict=True)])

    return keyed(docs).mapInArrow(rows, "k long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string").select(doc_id(), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
