"""Elias-Fano sequences: monotone integers in about 2 + log2(universe / n) bits each.

The low bits of each value are packed; the high bits are a bit vector with a one for each
value after as many zeros as its high part says. Directories of ones and of zeros before each
64-bit word answer selects. All queries take arrays, and all parts may be memory-mapped.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 16  # values that are encoded at once; a multiple of 8, so that a slice's low bits end with a byte
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
_SELECT = np.array([[([j for j in range(8) if i >> j & 1] + [0] * 8)[r] for r in range(8)] for i in range(256)], dtype=np.int64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sequence of ascending values, fewer than 2**32 of them, below ``universe``."""
    n = len(values)
    low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    bits = np.zeros(-(-((universe >> low) + n + 2) // 64) * 64, dtype=np.uint8)
    packed = np.zeros((-(-n * low // 64) + 2) * 8, dtype=np.uint8)
    for at in range(0, n, SLICE):
        part = values[at : at + SLICE].astype("<u8")
        bits[(part >> np.uint64(low)).astype(np.int64) + np.arange(at, at + len(part))] = 1
        lows = np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, count=low, bitorder="little").ravel(), bitorder="little")
        packed[at * low // 8 :][: len(lows)] = lows
    words = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))])
    zeros = 64 * np.arange(len(ones)) - ones
    return {"high": words, "ones": ones.astype("<u4"), "zeros": zeros.astype("<u4"), "low": packed.view("<u8"), "shape": np.array([n, low], dtype="<i8")}


class EliasFano:
    """Queries over the arrays of ``encode``."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.high, self.low = arrays["high"], arrays["low"]
        self.n, self.width = map(int, arrays["shape"])
        self.ones, self.zeros = arrays["ones"], arrays["zeros"]

    def _select(self, before: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of the one (or zero) with each rank."""
        word = np.searchsorted(before, rank.astype(before.dtype), side="right") - 1  # of one type, or all of ``before`` is copied
        left = rank - before[word]
        bits = self.high[word]
        if flip:
            bits = ~bits
        place, byte = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        todo = np.ones(len(rank), dtype=bool)
        for k in range(8):
            here = (bits >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)
            count = _POP[here]
            hit = todo & (left < count)
            byte = np.where(hit, here, byte)
            place = np.where(hit, 8 * k, place)
            todo &= ~hit
            left = np.where(todo, left - count, left)
        return 64 * word + place + _SELECT[byte, left]

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), dtype=np.int64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        upper = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> shift | upper) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the places ``at``."""
        return (self._select(self.ones, at, False) - at << self.width) | self.lows(at)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is not below each ``x``, and whether it equals ``x``.

        ``x`` must lie below the universe.
        """
        high, want = x >> self.width, x & ((1 << self.width) - 1)
        end = self._select(self.zeros, high, True) - high
        start = np.zeros(len(x), dtype=np.int64)
        later = np.flatnonzero(high > 0)
        start[later] = self._select(self.zeros, high[later] - 1, True) - (high[later] - 1)
        lo, hi = start, end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        same = lo < end
        at = np.flatnonzero(same)
        same[at] = self.lows(lo[at]) == want[at]
        return lo, same
