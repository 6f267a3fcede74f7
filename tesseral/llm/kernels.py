"""Vectorised numpy kernels over Arrow string columns.

Every kernel takes a flat UTF-8 byte buffer with row offsets, so one call serves a whole Arrow batch. Long inputs are
handled in segments, which keeps the working set at a few tens of MB whatever the length of a text.

Hashes are polynomials modulo 2**64 taken from prefix sums (an odd base has an inverse, so any slice's hash is two
gathers), followed by a 64-bit finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
WORD_BASE = U(0xC2B2AE3D27D4EB4F | 1)
SEGMENT = 1 << 20
#: Bytes of text that one kernel call works on, unless a single row is longer.
CHUNK_BYTES = 2 << 20


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % 2**64
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class Powers:
    """Growing tables of powers of a base and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = int(base), _inverse(int(base))
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 4096)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BASE), Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Runs of rows (first, last, data, offsets) with at most limit bytes each, or one row."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, by default [^\\x20\\x09-\\x0D]+, and where each row's words begin (one entry more)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.empty(n + 1, bool)
    inside[0], inside[1:] = False, ~space[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # of each row; rows without bytes mark the next row's first byte, which is right too
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first[:-1]))
    after = np.append(~inside[1:], True)[1:] | first[1:]
    after[-1] = True
    ends = np.flatnonzero(inside[1:] & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices, which are ascending and do not overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = BYTE_POWERS.get(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum((data[a:b].astype(U) + U(1)) * up[:-1], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0x632BE59BD9B4E019)
        i = j
    return mix(out)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries (len - n + 1 of them, across rows too)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    if n <= 4:
        out = np.zeros(m, U)
        for k in range(n):
            out = out * WORD_BASE + hashes[k : k + m]
        return mix(out)
    out = np.empty(m, U)
    for i in range(0, m, SEGMENT):
        j = min(m, i + SEGMENT)
        up, down = WORD_POWERS.get(j - i + n)
        sums = np.zeros(j - i + n, U)
        np.cumsum(hashes[i : j + n - 1] * up[:-1], out=sums[1:])
        out[i:j] = (sums[n : n + j - i] - sums[: j - i]) * down[: j - i]
    return mix(out)


def byte_ngram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive bytes (len - n + 1 of them, across rows too)."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.empty(m, U)
    for i in range(0, m, SEGMENT):
        j = min(m, i + SEGMENT)
        up, down = BYTE_POWERS.get(j - i + n)
        sums = np.zeros(j - i + n, U)
        np.cumsum((data[i : j + n - 1].astype(U) + U(1)) * up[:-1], out=sums[1:])
        out[i:j] = (sums[n : n + j - i] - sums[: j - i]) * down[: j - i]
    return mix(out)


def valid_starts(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over the positions 0 .. total - n: whether n entries from there lie in one row."""
    m = max(0, total - n + 1)
    out = np.zeros(m + 1, np.int32)
    lo, hi = bounds[:-1], bounds[1:] - n + 1
    ok = hi > lo
    np.add.at(out, lo[ok], 1)
    np.add.at(out, np.minimum(hi[ok], m), -1)
    return np.cumsum(out)[:m] > 0


def row_of(bounds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each position, given where the rows begin (rows may be empty)."""
    return np.searchsorted(bounds, positions, "right") - 1


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w entries."""
    out, size = values, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def covered(starts: np.ndarray, lengths: np.ndarray, total: int) -> np.ndarray:
    """Mask of total entries: which lie in one of the spans."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:total] > 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
