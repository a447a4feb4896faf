"""Hashes of byte ranges in numpy, and compact blobs of integer columns for the shuffle."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x. Works in place on its copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the odd base modulo 2**64 and of its inverse, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_POWERS = _Powers()


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over bytes, for ``span``."""
    _POWERS.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POWERS.up[: len(data)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end; they depend on these bytes alone."""
    return mix((sums[end] - sums[start]) * _POWERS.down[start])


def all_spans(sums: np.ndarray, size: int) -> np.ndarray:
    """span of every run of ``size`` bytes."""
    n = len(sums) - size
    return mix((sums[size:] - sums[:n]) * _POWERS.down[:n])


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each hash, ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as byte planes under zstandard; ascending ones as differences do best."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(n, -1).T).tobytes() for c in columns)
    kinds = "".join(c.dtype.str[1:] for c in columns).encode()
    return struct.pack("<IH", n, len(kinds)) + kinds + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    n, size = struct.unpack_from("<IH", blob)
    kinds = blob[6 : 6 + size].decode()
    data, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[6 + size :]), np.uint8), 0, []
    for i in range(0, len(kinds), 2):
        width = int(kinds[i + 1])
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(f"<{kinds[i : i + 2]}").reshape(n))
        at += n * width
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))
