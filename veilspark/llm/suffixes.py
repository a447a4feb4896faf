"""Operator 3, suffix-array dedup: a logarithmic family of sparse suffix arrays.

Only suffixes at anchors are kept: in each window of ``length`` bytes, the leftmost anchor of least hash. Windows with the
same bytes have the same anchor, so every repeated window lies in the *spans* of equal anchors (a span is all windows
around one position that share its anchor), and one suffix stands for some forty bytes. A suffix carries the bytes of its
span: those from the anchor on, by which it is ordered, then those before it, backwards.

1. Each batch of documents becomes a suffix array, cut into buckets of anchors. In its bucket it enters a family of
   levels: levels of like size are merged geometrically, and a merge meets equal spans; of these the earliest stays and
   the others are repeats as a whole.
2. A scan over neighbours in the merged order finds the longer matches of spans that differ: runs that share the bytes
   from the anchor on, and of these those that share the bytes before it.
3. Each document drops the bytes that its repeated windows cover.

Batches find their own repeats before the shuffle, so a passage that a third of all documents share reaches its bucket once
for each batch. An anchor with more than HOT different spans (a line that many documents have, each in its own context) leaves
its bucket: its windows are dealt out by their hashes and meet there. Bytes decide all matches but those, which 64-bit
hashes decide. The levels can be kept and met by a later batch (``index_batch``).
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import hashing
from veilspark.llm.base import doc_id, keyed, packed, partitions, record, shared_ids, stash, text_hash, told_apart, unpacked, utf8

#: Bytes of a repeated string, of an anchor.
LENGTH, ANCHOR = 100, 20
#: Bytes hashed at once; bytes of text whose spans form a batch; bytes of text for a bucket; different spans of an anchor in a bucket.
PIECE, BATCH, BUCKET, HOT = 1 << 19, 16_000_000, 64_000_000, 200_000
_LOW = np.uint64((1 << 24) - 1)
_REPEAT, _HOT, _LEVEL = range(3)
_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_BLOB_DDL = "bucket int, kind int, blob binary"
_MARK = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("lo", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
_MARK_DDL = "k long, h long, lo array<long>, n array<long>"


def spans_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Spans of the documents data[bounds[i]:bounds[i + 1]]: document, first window, windows, bytes before the anchor."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    least = (hashing.all_spans(hashing.prefix(data), anchor) & ~_LOW) | np.arange(n - anchor + 1, dtype=np.uint64)
    width, reach = length - anchor + 1, 1
    while reach * 2 <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    inside = np.ones(n - length + 1, bool)
    for b in bounds[1:-1].tolist():
        inside[max(0, b - length + 1) : b] = False
    window = np.flatnonzero(inside)
    at = (least[window] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(window) != 1)])) if len(window) else window
    lo, hi = window[first], window[np.append(first[1:], len(window)) - 1] if len(window) else window
    doc = np.searchsorted(bounds, lo, side="right") - 1
    return doc, lo - bounds[doc], hi - lo + 1, at[first] - lo


def byte_rows(data: np.ndarray, start: np.ndarray, n: np.ndarray, before: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """A row of bytes for each span that begins at start in data: from the anchor on, then backwards before it; zeros fill up."""
    back, q = length - anchor, start + before
    wide = np.concatenate([np.zeros(back, np.uint8), data, np.zeros(length, np.uint8)])
    out = np.zeros((len(start), -(-(length + back) // 8) * 8), np.uint8)
    right, left = np.arange(length), np.arange(back)
    out[:, :length] = np.where(right < (n + length - 1 - before)[:, None], wide[(q + back)[:, None] + right], 0)
    out[:, length : length + back] = np.where(left < before[:, None], wide[(q + back - 1)[:, None] - left], 0)
    return out


def in_order(columns) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by columns, the first of them foremost, and whether each row in that order differs from the one before."""
    columns = iter(columns)
    column = next(columns)
    order = np.argsort(column, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = column[order[1:]] != column[order[:-1]]
    for column in columns:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True)) if len(new) else order
        if not len(tied):
            break
        group, rows = np.cumsum(new)[tied], order[tied]
        inner = np.lexsort((column[rows], group))
        order[tied] = rows = rows[inner]
        differs = np.ones(len(tied), bool)
        differs[1:] = (column[rows[1:]] != column[rows[:-1]]) | (group[1:] != group[:-1])
        new[tied] = differs
    return order, new


class Level:
    """Suffixes in the order of their bytes: ``text`` has a row for each, ``before`` and ``n`` say how much of it counts; k, h and lo
    are the document and first window, ``old`` is 1 for those that an index held before."""

    NAMES = ("text", "before", "n", "k", "h", "lo", "old")

    def __init__(self, *columns: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, ordered: bool = False):
        self.length, self.anchor = length, anchor
        for name, column in zip(self.NAMES, columns, strict=True):
            setattr(self, name, column)
        self.same = None  # rows whose span is that of the row before
        if not ordered:
            words = np.ascontiguousarray(self.text).view(">u8")
            order, _ = in_order([*(words[:, i] for i in range(words.shape[1])), self.before, self.n, 1 - self.old, self.k, self.h, self.lo])
            self._take(order)
        words = np.ascontiguousarray(self.text).view(np.uint64)
        self.same = np.zeros(len(self), bool)
        self.same[1:] = (words[1:] == words[:-1]).all(1) & (self.before[1:] == self.before[:-1]) & (self.n[1:] == self.n[:-1])

    def __len__(self) -> int:
        return len(self.k)

    def _take(self, rows: np.ndarray) -> None:
        for name in self.NAMES:
            setattr(self, name, getattr(self, name)[rows])

    def only(self, rows: np.ndarray) -> Level:
        """The level of some rows, given in order."""
        return Level(*(getattr(self, name)[rows] for name in self.NAMES), length=self.length, anchor=self.anchor, ordered=True)

    def marks(self, rows: np.ndarray) -> list[np.ndarray]:
        """(k, lo, n, h) of rows that no index held before."""
        rows = rows[self.old[rows] == 0]
        return [x[rows] for x in (self.k, self.lo, self.n, self.h)]

    def repeats(self) -> list[np.ndarray]:
        """Takes out all but the earliest of equal spans; their marks. A row that repeats a document goes without one."""
        itself = np.zeros(len(self), bool)
        itself[1:] = self.same[1:] & (self.k[1:] == self.k[:-1]) & (self.h[1:] == self.h[:-1]) & (self.lo[1:] == self.lo[:-1])
        out = self.marks(np.flatnonzero(self.same & ~itself))
        self._take(np.flatnonzero(~self.same))
        self.same = np.zeros(len(self), bool)
        return out

    def anchors(self) -> np.ndarray:
        """Whether a row's anchor is another than that of the row before."""
        new = np.ones(len(self), bool)
        new[1:] = (self.text[1:, : self.anchor] != self.text[:-1, : self.anchor]).any(1)
        return new

    def names(self) -> np.ndarray:
        """Hashes of the anchors."""
        out = np.zeros(len(self), np.uint64)
        for i in range(self.anchor):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.text[:, i].astype(np.uint64) + np.uint64(1)
        return hashing.mix(out)

    def long_matches(self) -> list[np.ndarray]:
        """Marks of the windows that spans with equal anchors share though they differ; the earliest has none.

        Windows that begin ``a`` bytes before the anchor are equal if length - a bytes from the anchor on are, which makes a
        run of neighbours in this order, and a bytes before it."""
        new = self.anchors()
        rows = np.flatnonzero(~new | ~np.append(new[1:], True)) if len(new) else np.zeros(0, np.int64)
        # no run is longer than what a row shares with a neighbour
        shared = np.zeros(len(rows) + 1, np.int64)
        for low in range(0, len(rows) - 1, 1 << 16):
            a, b = self.text[rows[low : low + (1 << 16)], : self.length], self.text[rows[low + 1 : low + 1 + (1 << 16)], : self.length]
            differs = a[: len(b)] != b
            shared[low + 1 : low + 1 + len(b)] = np.where(differs.any(1), differs.argmax(1), self.length)
        most = np.maximum(shared[:-1], shared[1:])
        q = self.lo + self.before
        place = np.empty(len(rows), np.int64)
        place[np.lexsort((q[rows], self.h[rows], self.k[rows], 1 - self.old[rows]))] = np.arange(len(rows))
        found: list[list[np.ndarray]] = []
        for a in range(self.length - self.anchor + 1 if len(rows) else 0):
            right = self.length - a
            fits = (most >= right) & (self.before[rows] >= a) & (self.n[rows] + self.length - 1 - self.before[rows] >= right)
            own, rank = rows[fits], place[fits]
            if len(own) < 2:
                continue
            run = np.ones(len(own), bool)
            run[1:] = (self.text[own[1:], :right] != self.text[own[:-1], :right]).any(1)
            both = np.flatnonzero(~run | ~np.append(run[1:], True))
            own, rank, run = own[both], rank[both], np.cumsum(run)[both]
            if not len(own):
                continue
            left = np.zeros((len(own), -(-max(a, 1) // 8) * 8), np.uint8)
            left[:, :a] = self.text[own, self.length : self.length + a]
            words = left.view(np.uint64)
            order, differs = in_order([run, *(words[:, i] for i in range(words.shape[1]))])
            group = np.cumsum(differs)
            by_rank = np.lexsort((rank[order], group))
            order, group = order[by_rank], group[by_rank]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            head = own[order[np.repeat(first, np.diff(np.append(first, len(order))))]]
            later = own[order]
            other = (self.k[later] != self.k[head]) | (self.h[later] != self.h[head]) | (q[later] != q[head])
            later = later[other & (self.old[later] == 0)]
            found.append([self.k[later], q[later] - a, np.ones(len(later), np.int64), self.h[later]])
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4

    @staticmethod
    def _counting(before: np.ndarray, n: np.ndarray, length: int, anchor: int) -> np.ndarray:
        """Which bytes count of rows as they stand in the text: those before the anchor, then the others."""
        at, back = np.arange(length + length - anchor), length - anchor
        return (at >= back - before[:, None]) & (at < back + (n + length - 1 - before)[:, None])

    def blob(self) -> bytes:
        """The level as bytes: of each row only what counts, as it stands in the text."""
        back = self.length - self.anchor
        body = np.concatenate([self.text[:, self.length : self.length + back][:, ::-1], self.text[:, : self.length]], 1)
        body = zstandard.ZstdCompressor(level=5).compress(body[self._counting(self.before, self.n, self.length, self.anchor)].tobytes())
        rest = hashing.pack(self.before.astype("<u2"), self.n.astype("<u2"), self.k, self.h, self.lo, self.old.astype("<u1"))
        return struct.pack("<QHH", len(body), self.length, self.anchor) + body + rest

    @classmethod
    def from_blob(cls, blob: bytes) -> Level:
        size, length, anchor = struct.unpack_from("<QHH", blob)
        before, n, k, h, lo, old = hashing.unpack(blob[12 + size :])
        before, n, back = before.astype(np.int64), n.astype(np.int64), length - anchor
        body = np.zeros((len(k), length + back), np.uint8)
        body[cls._counting(before, n, length, anchor)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[12 : 12 + size]), np.uint8)
        text = np.zeros((len(k), -(-(length + back) // 8) * 8), np.uint8)
        text[:, :length], text[:, length : length + back] = body[:, back:], body[:, :back][:, ::-1]
        return cls(text, before, n, k, h, lo, old.astype(np.int64), length=length, anchor=anchor, ordered=True)

    def merged(self, other: Level) -> Level:
        return Level(*(np.concatenate([getattr(self, x), getattr(other, x)]) for x in self.NAMES), length=self.length, anchor=self.anchor)


class Family:
    """Levels of which each is over twice as large as the next; ``add`` gives the marks of the repeats that merging met."""

    def __init__(self, levels: list[Level] | None = None, hot: int | None = HOT):
        self.levels, self.most, self.hot, self.gone = list(levels or []), hot, np.zeros(0, np.uint64), []

    def add(self, level: Level):
        if len(self.hot):
            away = np.isin(level.names(), self.hot)
            self.gone.append(level.marks(np.flatnonzero(away)))
            level = level.only(np.flatnonzero(~away))
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            yield self._merge()

    def _merge(self) -> list[np.ndarray]:
        a, b = self.levels.pop(), self.levels.pop()
        both = b.merged(a)
        out = both.repeats()
        if self.most is not None and len(both):
            first = np.flatnonzero(both.anchors())
            size = np.diff(np.append(first, len(both)))
            if (size > self.most).any():
                # rows of such anchors in other levels follow when these are merged
                self.hot = np.union1d(self.hot, both.names()[first[size > self.most]])
        self.levels.append(self._cool(both))
        return out

    def _cool(self, level: Level) -> Level:
        if not len(self.hot):
            return level
        away = np.isin(level.names(), self.hot)
        if not away.any():
            return level
        self.gone.append(level.marks(np.flatnonzero(away)))
        return level.only(np.flatnonzero(~away))

    def close(self):
        """One level of all, without hot anchors."""
        while len(self.levels) > 1:
            yield self._merge()
        if self.levels:
            self.levels[0] = self._cool(self.levels[0])


def _sent(found: list[np.ndarray], kind: int, buckets: int) -> list[tuple]:
    """Rows of blobs of (k, lo, n, h), each for a bucket of documents."""
    k, h = found[0], found[3]
    to = hashing.bucket(hashing.mix(k.astype(np.uint64) ^ h.astype(np.uint64)), buckets)
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    columns = [x[order] for x in (k, found[1], found[2].astype("<i4"), h)]
    return [(b, kind, hashing.pack(*(x[cut[b] : cut[b + 1]] for x in columns))) for b in np.flatnonzero(np.diff(cut)).tolist()]


def _joined(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def _records(rows: list[tuple]):
    for low in range(0, len(rows), 64):
        yield record(_BLOB, *zip(*rows[low : low + 64], strict=True))


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first row, bounds, first byte of the row): documents in runs of about PIECE bytes; a longer one in parts that overlap."""
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + PIECE, side="right")) - 1
        if high > low:
            yield low, offsets[low : high + 1], 0
            low = high
        else:
            start, end = int(offsets[low]), int(offsets[low + 1])
            for at in range(start, max(end - length + 1, start + 1), PIECE):
                yield low, np.array([at, min(at + PIECE + length - 1, end)]), at - start
            low += 1


def _anchored(length: int, anchor: int, buckets: int):
    """Blobs of batches: suffix arrays for buckets of anchors, and the repeats that a batch has found itself."""

    def flush(held):
        level = Level(*(np.concatenate(x) for x in zip(*held, strict=True)), length=length, anchor=anchor)
        found = level.repeats()
        to = hashing.bucket(level.names(), buckets)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        yield from _records(_sent(found, _REPEAT, buckets))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            yield from _records([(b, _LEVEL, level.only(order[cut[b] : cut[b + 1]]).blob())])

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, hashes = (np.asarray(batch.column(c)) for c in ("k", "h"))
            for row, bounds, base in _pieces(data, offsets, length):
                part = data[bounds[0] : bounds[-1]]
                doc, lo, n, before = spans_of(part, bounds - bounds[0], length, anchor)
                text = byte_rows(part, lo + (bounds - bounds[0])[doc], n, before, length, anchor)
                held.append([text, before, n, ids[row + doc], hashes[row + doc], lo + base, np.zeros(len(lo), np.int64)])
                size += len(part)
                if size >= BATCH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return rows


def _family(buckets: int, keep: bool):
    """Blobs of a bucket of anchors, those of an index first, to marks for buckets of documents: repeats, and spans of hot anchors.
    With ``keep`` also the levels, for a later batch; then no anchor is hot."""

    def rows(batches):
        found, stored, family = [], [], None
        for batch in batches:
            for to, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
                if kind == _REPEAT:
                    yield from _records([(to, _REPEAT, blob)])
                elif kind > _LEVEL:
                    stored.append((kind, Level.from_blob(blob)))
                else:
                    if family is None:
                        family, bucket = Family([x for _, x in sorted(stored, key=lambda x: x[0])], None if keep else HOT), to
                    found += family.add(Level.from_blob(blob))
                    if sum(len(x[0]) for x in found) > 4_000_000:
                        yield from _records(_sent(_joined(found), _REPEAT, buckets))
                        found = []
        if family is None:
            for kind, level in stored:  # a bucket that the batch did not touch
                yield from _records([(int(hashing.bucket(level.names()[:1], buckets)[0]), kind, level.blob())])
            return
        if keep:
            kept = list(family.levels)
        found += family.close()
        for level in family.levels:
            found.append(level.long_matches())
        yield from _records(_sent(_joined(found), _REPEAT, buckets) + (_sent(_joined(family.gone), _HOT, buckets) if family.gone else []))
        if keep:
            for i, level in enumerate(kept):
                level.old = np.ones(len(level), np.int64)
                yield from _records([(bucket, _LEVEL + 1 + i, level.blob())])

    return rows


def _gathered(batches):
    """Marks of a bucket of documents: a row for each document, its windows as runs."""
    parts = [hashing.unpack(blob) for batch in batches for blob in batch.column("blob").to_pylist()]
    if not parts:
        return
    k, lo, n, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((lo, h, k))
    k, h, lo, end = k[order], h[order], lo[order], lo[order] + n[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
    # runs: a new one starts where the document changes or a window starts beyond all before it
    base = np.cumsum(np.concatenate([[0], np.maximum.reduceat(end, first)[:-1] + 1]))
    shift = np.repeat(base, np.diff(np.append(first, len(k))))
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], lo[1:] + shift[1:] > reach[:-1]])
    run = np.flatnonzero(new)
    stop = reach[np.append(run[1:], len(k)) - 1] - shift[run]
    rk, rh, rlo, rn = k[run], h[run], lo[run], stop - lo[run]
    first = np.flatnonzero(np.concatenate([[True], (rk[1:] != rk[:-1]) | (rh[1:] != rh[:-1])]))
    at = np.append(first, len(rk))
    for low in range(0, len(first), 4096):
        a, b = at[low], at[min(low + 4096, len(first))]
        offsets = pa.array((at[low : low + 4097] - a).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(rk[first[low : low + 4096]]), pa.array(rh[first[low : low + 4096]]), pa.ListArray.from_arrays(offsets, pa.array(rlo[a:b])), pa.ListArray.from_arrays(offsets, pa.array(rn[a:b]))], schema=_MARK)


def _windows(length: int, buckets: int):
    """Every window of the listed spans of each document: hash and place, for buckets of hashes."""

    def flush(held):
        key, k, lo, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((lo, h, k, key))
        cut = np.searchsorted(hashing.bucket(key[order], buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            part = order[cut[b] : cut[b + 1]]
            yield from _records([(b, _HOT, hashing.pack(hashing.deltas(key[part]), k[part], lo[part], h[part]))])

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, (k, h, los, ns) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "h", "lo", "n")), strict=True)):
                lo, n = np.array(los, np.int64), np.array(ns, np.int64)
                start = np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
                sums = hashing.prefix(data[offsets[i] : offsets[i + 1]])
                start = start[start + length < len(sums)]
                held.append([hashing.span(sums, start, start + length), np.full(len(start), k, np.int64), start, np.full(len(start), h, np.int64)])
                size += len(start)
                if size >= 2_000_000:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return rows


def _later(buckets: int):
    """Marks of all but the earliest of equal windows of a bucket of hashes."""

    def rows(batches):
        parts = [hashing.unpack(blob) for batch in batches for blob in batch.column("blob").to_pylist()]
        if parts:
            key, k, lo, h = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, *_ in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            order = np.lexsort((lo, h, k, key))
            key, k, lo, h = key[order], k[order], lo[order], h[order]
            later = np.concatenate([[False], key[1:] == key[:-1]])
            later[1:] &= ~((k[1:] == k[:-1]) & (lo[1:] == lo[:-1]) & (h[1:] == h[:-1]))
            yield from _records(_sent([k[later], lo[later], np.ones(int(later.sum()), np.int64), h[later]], _REPEAT, buckets))

    return rows


def _marks(docs: DataFrame, length: int, anchor: int, index: DataFrame | None, keep: bool, shared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(texts by k and h, marks by document, table of blobs, buckets)."""
    texts = told_apart(keyed(docs, text_hash()), shared)
    n = index.agg(F.max("buckets")).first()[0] if index is not None else None
    if n is None:  # no index, or one without a row
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(partitions(docs.sparkSession), -(-size // BUCKET))
    blobs = texts.mapInArrow(_anchored(length, anchor, n), _BLOB_DDL)
    if index is not None:
        blobs = blobs.unionByName(index.select("bucket", "kind", "blob"))
    # levels of an index come first: their kinds are higher
    dealt = blobs.repartitionById(n, "bucket").sortWithinPartitions(F.desc("kind"))
    made = stash(dealt.mapInArrow(_family(n, keep), _BLOB_DDL))
    by_id = texts.repartition(n, "k", "h")
    gather = lambda df: df.repartitionById(n, "bucket").mapInArrow(_gathered, _MARK_DDL)
    found, hot = (made.where(F.col("kind") == kind) for kind in (_REPEAT, _HOT))
    if hot.limit(1).count():
        listed = by_id.join(gather(hot), ["k", "h"]).select("k", "h", "text", "lo", "n")
        found = found.unionByName(listed.mapInArrow(_windows(length, n), _BLOB_DDL).repartitionById(n, "bucket").mapInArrow(_later(n), _BLOB_DDL))
    return by_id, gather(found), made, n


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, marks): documents by k and h, and for each of them with repeats lists lo, n: n windows from byte lo on are repeated.
    shared is what ``shared_ids`` gives, where that is known."""
    return _marks(docs, length, anchor, None, False, shared_ids(docs) if shared is None else shared)[:2]


def index_batch(docs: DataFrame, index: DataFrame | None = None, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(found, index): (doc_id, lo, n) of a new batch's repeats as lists, null where it has none, and the index with the batch in it.

    index is what the call for the batch before gave, or None: a table (bucket, kind, blob, buckets) of the levels in every bucket,
    to be written and read as any other. All that it holds counts as earlier than the batch, whatever the ids. Batches and indexes
    may be empty."""
    texts, marks, made, n = _marks(docs, length, anchor, index, True, shared_ids(docs))
    found = texts.join(marks, ["k", "h"], "left").select(doc_id(), "lo", "n")
    return found, made.where(F.col("kind") > _LEVEL).select("bucket", "kind", "blob", F.lit(n).alias("buckets"))


_DIGEST = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_runs(size: int, lo, n, length: int) -> np.ndarray:
    """Maximal runs (start, end) of the bytes that repeated windows cover."""
    if not lo:
        return np.zeros((0, 2), np.int64)
    lo, n = np.array(lo, np.int64), np.array(n, np.int64)
    end = lo + n - 1 + length
    lo, end = lo[end <= size], end[end <= size]
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > end[:-1]])) if len(lo) else lo
    return np.stack([lo[first], end[np.append(first[1:], len(lo)) - 1]], 1) if len(lo) else np.zeros((0, 2), np.int64)


def _kept(data: np.ndarray, runs: np.ndarray) -> bytes:
    cut = np.concatenate([[0], runs.reshape(-1), [len(data)]]).tolist()
    return b"".join(data[a:b].tobytes() for a, b in zip(cut[::2], cut[1::2], strict=True))


def digest_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document after every byte is gone that a string of
    ``length`` bytes covers which also starts earlier. A null or empty text has 0 bytes. Documents of
    one doc_id, or of none, with different texts are ordered by the hashes of these."""
    texts, marks = repeated_windows(docs, length)

    def rows(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for i, (k, lo, n) in enumerate(zip(batch.column("k").to_pylist(), batch.column("lo").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                runs = removed_runs(len(own), lo, n, length)
                out.append((k, len(own), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(_kept(own, runs)).hexdigest()))
            yield record(_DIGEST, *(zip(*out, strict=True) if out else [[]] * len(_DIGEST)))

    joined = texts.join(marks, ["k", "h"], "left").select("k", "text", "lo", "n")
    return joined.mapInArrow(rows, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with every repeated byte of text gone; a character goes only if all its bytes do. Rows and columns stay, null texts
    too. Rows that repeat a document lose what it loses; documents of one doc_id are ordered by the hashes of their texts."""
    shared = shared_ids(docs)
    _, marks = repeated_windows(docs, length, shared=shared)

    def rows(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for i, (lo, n) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                own = data[offsets[i] : offsets[i + 1]]
                runs = removed_runs(len(own), lo, n, length)
                inner = lambda at, own=own: at < len(own) and own[at] & 0xC0 == 0x80
                for run in runs:
                    while inner(run[0]):
                        run[0] += 1
                    while inner(run[1]):
                        run[1] -= 1
                out.append(_kept(own, runs[runs[:, 0] < runs[:, 1]]).decode())
            out = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pc.if_else(batch.column("none"), pa.scalar(None, pa.string()), out)], names=["row", "text"])

    kept = packed(docs, F.col("text").isNull().alias("none")).withColumn("text", F.coalesce("text", F.lit("")))
    kept = told_apart(kept, shared).repartition(partitions(docs.sparkSession), "k", "h")
    joined = kept.join(marks, ["k", "h"], "left").select("row", "none", "text", "lo", "n")
    return unpacked(joined.mapInArrow(rows, T.StructType([joined.schema["row"], T.StructField("text", T.StringType())])), docs.columns)
