"""Operator 5, media columns: ISO media containers.

``write_container`` stores a payload losslessly as fixed-size samples of an ISO base media file;
``read_container`` walks the nested boxes, decodes the sample tables and gives codec, duration and the
byte ranges of samples and keyframes. It reads box headers and tables only, never the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.base import doc_id, keyed, record, small_batches

#: Bytes in a sample, samples in a chunk, samples from one keyframe to the next, samples in a second.
UNIT, CHUNK, KEYFRAME, TIMESCALE = 64, 16, 8, 1000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b"\0")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes, codec: bytes = b"raw ") -> bytes:
    """An ISO media file whose one track has the payload, a multiple of UNIT bytes, as 8-bit samples."""
    n = len(payload) // UNIT
    chunks = -(-n // CHUNK)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    mdat = struct.pack(">I4s", len(payload) + 8, b"mdat") if len(payload) + 8 < 2**32 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    first = len(head) + len(mdat)
    full, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK)] if full else []) + ([(full + 1, rest)] if rest else [])
    entry = _box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16 & 0xFFFFFFFF))
    keys = np.arange(1, n + 1, KEYFRAME, dtype=">u4")
    places = first + np.arange(chunks, dtype=np.int64) * CHUNK * UNIT
    wide = bool(len(places)) and int(places[-1]) >= 2**32
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s12s", 0, b"soun", b""), b"\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3), media)
    movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((head, mdat, payload, _box(b"moov", movie, track)))


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of samples
    sizes: np.ndarray
    keyframes: np.ndarray  # numbers of samples, from 0

    @property
    def ranges(self) -> np.ndarray:
        """Byte ranges (start, end) of the samples from each keyframe to the next, where these lie together."""
        start = self.offsets[self.keyframes]
        last = np.append(self.keyframes[1:], len(self.sizes)) - 1
        return np.stack([start, self.offsets[last] + self.sizes[last]], 1)


def walk(data, low: int = 0, high: int | None = None, path: tuple = ()):
    """(path, start, end) of the body of each box, outer boxes first. A box that overruns its parent ends the walk."""
    high = len(data) if high is None else high
    while low + 8 <= high:
        size, kind = struct.unpack_from(">I4s", data, low)
        body = low + 8
        if size == 1:
            if body + 8 > high:
                return
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        end = high if size == 0 else low + size
        if end > high or end < body:
            return
        yield (*path, kind), body, end
        if kind in _NESTED:
            yield from walk(data, body, end, (*path, kind))
        low = end


def _numbers(data, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def read_container(data: bytes) -> list[Track]:
    """The tracks of an ISO media file; none for bytes that are not one."""
    tracks: list[dict[bytes, int]] = []
    for path, body, _ in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], body)
    out = []
    for t in tracks:
        if not {b"mdhd", b"stsd", b"stsz", b"stsc"} <= t.keys() or not {b"stco", b"co64"} & t.keys():
            continue
        at = t[b"mdhd"]
        scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        codec = data[t[b"stsd"] + 12 : t[b"stsd"] + 16].decode("latin-1")
        fixed, n = struct.unpack_from(">II", data, t[b"stsz"] + 4)
        sizes = np.full(n, fixed, np.int64) if fixed else _numbers(data, t[b"stsz"] + 12, n)
        wide = b"co64" in t
        at = t[b"co64" if wide else b"stco"]
        places = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u8" if wide else ">u4")
        runs = _numbers(data, t[b"stsc"] + 8, 3 * struct.unpack_from(">I", data, t[b"stsc"] + 4)[0]).reshape(-1, 3)
        in_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(places) + 1)))
        chunk = np.repeat(np.arange(len(places)), in_chunk)[:n]
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(in_chunk) - in_chunk
        offsets = places[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
        keys = _numbers(data, t[b"stss"] + 8, struct.unpack_from(">I", data, t[b"stss"] + 4)[0]) - 1 if b"stss" in t else np.arange(n)
        out.append(Track(codec, scale, duration, offsets, sizes, keys))
    return out


def stored_bytes(data: bytes, track: Track) -> bytes:
    """The samples of a track, one after another; byte ranges that touch are cut out at once."""
    end = track.offsets + track.sizes
    cut = np.flatnonzero(np.append(True, track.offsets[1:] != end[:-1])) if len(end) else np.zeros(0, np.int64)
    stop = end[np.append(cut[1:], len(end)) - 1] if len(end) else cut
    return b"".join(data[a:b] for a, b in zip(track.offsets[cut].tolist(), stop.tolist(), strict=True))


def feature(track: Track) -> str:
    """codec:duration in seconds:samples:keyframes:first range-last range."""
    ranges = track.ranges
    ends = "-".join(f"{a}+{b - a}" for a, b in (ranges[[0, -1]] if len(ranges) else []))
    return f"{track.codec.strip()}:{track.duration / track.timescale:.3f}:{len(track.sizes)}:{len(track.keyframes)}:{ends}"


def media_columns(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows of ``media`` and, for each one's first track, codec, duration_s and keyframes array<struct<start,end>>; null
    for a null or for bytes that are not an ISO media file. Columns of these names are replaced."""
    small_batches(media.sparkSession)

    def described(batches):
        for batch in batches:
            rows = []
            for data in batch.column("data").to_pylist():
                try:
                    track = next(iter(read_container(data or b"")), None)
                except (struct.error, ValueError, IndexError):
                    track = None
                rows.append(None if track is None else {"codec": track.codec, "duration_s": track.duration / max(track.timescale, 1), "keyframes": [{"start": a, "end": b} for a, b in track.ranges.tolist()]})
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "m": pa.array(rows, pa.struct([("codec", pa.string()), ("duration_s", pa.float64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))})

    kept = media.select(*[c for c in media.columns if c not in ("codec", "duration_s", "keyframes")])
    packed = kept.select(F.struct("*").alias("row"), F.col(column).alias("data"))
    return packed.mapInArrow(described, f"row struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in kept.schema)}>, m struct<codec:string,duration_s:double,keyframes:array<struct<start:bigint,end:bigint>>>").select("row.*", "m.*")


_OUT = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded to a multiple of UNIT zero bytes, as an ISO media file. A null text is empty."""

    def rows(batches):
        for batch in batches:
            raw = [x.encode() for x in batch.column("text").to_pylist()]
            yield record(pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]), batch.column("k"), [len(x) for x in raw], [write_container(padded(x)) for x in raw])

    return keyed(docs).mapInArrow(rows, "k long, n_bytes long, media binary").select(doc_id(), "n_bytes", "media")


def digest_documents(docs: DataFrame) -> DataFrame:
    """Stores each text as store_documents does, reads the stored bytes back and describes both.

    Each row is described by its own text: rows that repeat a doc_id, or have none, each get theirs; ties do not arise. A null
    text is empty and padded to one unit; a very long one is whole, alone in its task's memory. No rows give no rows."""

    def rows(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                media = write_container(padded(raw))
                track = read_container(media)[0]
                back = stored_bytes(media, track)
                out.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
            yield record(_OUT, *(zip(*out, strict=True) if out else [[]] * len(_OUT)))

    return keyed(docs).mapInArrow(rows, "k long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").select(doc_id(), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
