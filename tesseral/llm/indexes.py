"""Text indexes over small integer alphabets: suffix order, wavelet matrix with FM-index, run-length index."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling; the end of the text is below every symbol.

    The first order is that of as many symbols as fit into 62 bits; then only suffixes that share a rank are sorted again.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    least = int(text.min())
    bits = (int(text.max()) - least + 1).bit_length()
    size = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(size):
        key <<= bits
        key[: max(0, n - i)] |= text[i:] - (least - 1)
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)  # where a group of suffixes that are equal so far begins
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        at = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(at):
            return order
        own = order[at]
        after = np.where(own + size < n, rank[np.minimum(own + size, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        by = np.argsort(key)
        own, key = own[by], key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        order[at], head[at] = own, new
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        size *= 2


class WaveletMatrix:
    """Rank over a sequence, in bit-packed levels with a count for every 64 bits."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        now = values
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position at of the sequence goes on the path of the symbol; differences of two are ranks."""
        for level in range(self.levels):
            ones = self.ones(level, at)
            at = np.where((symbols >> (self.levels - 1 - level)) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over the wavelet matrix of the Burrows-Wheeler transform; symbols are 0 .. sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.suffixes = suffix_array(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(text[self.suffixes - 1], sigma)
        every = np.arange(sigma)
        self.shift = self.first[:-1] - self.tree.descend(every, np.zeros(sigma, np.int64))

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end, how many symbols before it (at most so many) also occur elsewhere, and the rows of those most symbols.

        The text is the indexed one, so an interval of one row is the place itself. Rows are empty where the statistic is
        below most.
        """
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64)
        matched = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(1, most + 1):
            symbols = text[ends[live] - step]
            both = self.tree.descend(np.concatenate([symbols, symbols]), np.concatenate([lo[live], hi[live]])) + np.concatenate([self.shift[symbols]] * 2)
            new_lo, new_hi = both[: len(live)], both[len(live) :]
            good = new_hi - new_lo > 1
            live = live[good]
            lo[live], hi[live] = new_lo[good], new_hi[good]
            matched[live] = step
            if not len(live):
                break
        short = matched < most
        lo[short] = hi[short] = 0
        return matched, lo, hi

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least place among each row interval, none of which is empty."""
        edges = np.stack([lo, hi], 1).reshape(-1)
        return np.minimum.reduceat(np.append(self.suffixes, len(self.suffixes)), edges)[::2] if len(lo) else lo


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform with the suffixes at run ends.

    From those samples alone, the suffix before and after any suffix in the order follows: places between two samples
    keep their distance to the neighbour of the sample at or before them.
    """

    def __init__(self, text: np.ndarray):
        suffixes = suffix_array(text)
        bwt = text[suffixes - 1]
        new = np.ones(len(text), bool)
        new[1:] = bwt[1:] != bwt[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text)) - 1
        self.heads, self.lengths = bwt[first], np.diff(np.append(first, len(text)))
        starts, ends = suffixes[first], suffixes[last]
        self.size = len(text)
        self.before = self._sorted(starts[1:], ends[:-1])
        self.after = self._sorted(ends[:-1], starts[1:])

    @staticmethod
    def _sorted(samples: np.ndarray, neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(samples)
        return samples[order], neighbours[order]

    def neighbour(self, places: np.ndarray, side: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The place next to each place in suffix order; -1 where there is none."""
        samples, neighbours = side
        if not len(samples):
            return np.full(len(places), -1)
        at = np.searchsorted(samples, places, "right") - 1
        out = neighbours[np.maximum(at, 0)] + places - samples[np.maximum(at, 0)]
        return np.where((at >= 0) & (out < self.size), out, -1)
