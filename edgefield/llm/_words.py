"""Words of UTF-8 texts as 64-bit hashes, whole Arrow batches at a time in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial over the bytes, modulo 2**64, mixed at the
end. Documents are told apart by their row in the batch; nothing crosses from one to the next.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20260101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
PLAIN = np.ones(256, bool)  # another set of separators: all of ASCII but letters and digits
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Words(NamedTuple):
    start: np.ndarray  # in data
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # of the rows' bytes in data

    def first_of_row(self) -> np.ndarray:
        """The index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        a = np.full(n + 1, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    data, offsets = raw(texts)
    size = len(data)
    found = []
    lo = 0
    while lo < size:
        hi = min(lo + SLICE, size)
        while hi < size and not space[data[hi]]:  # a slice ends between words: at a space, or where a row begins
            ahead = np.flatnonzero(space[data[hi : hi + 65536]])
            stop = hi + int(ahead[0]) if len(ahead) else min(hi + 65536, size)
            row = int(offsets[np.searchsorted(offsets, hi)])
            if row <= stop:
                hi = row
                break
            hi = stop
        b = data[lo:hi]
        if lower:
            b = _LOWER[b]
        n = hi - lo
        inside = ~space[b]
        first = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi)] - lo
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        start[first] = inside[first]
        end[first - 1] = inside[first - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        up, down = _powers(max(SLICE * 2, 1 << int(n - 1).bit_length() if n > 1 else 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[:n], out=sums[1:])
        found.append((s + lo, e + lo, mixed((sums[e] - sums[s]) * down[s])))
        lo = hi
    s, e, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Words(s, e, h, np.searchsorted(offsets, s, "right") - 1, data, offsets)


def runs(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k consecutive words, and whether they lie in one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mixed(out + np.uint64(k)), rows[:n] == rows[k - 1 :]
