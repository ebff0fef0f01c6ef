"""Elias-Fano coded monotone sequences in numpy, laid out so that they can be memory-mapped.

n values below a universe u take about 2 + log2(u / n) bits each: low bits packed, high bits as a
unary bitmap with running counts of its zeros and ones. Searches are vectorised over queries.
"""

from __future__ import annotations

import numpy as np

PACK = 1 << 17
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A one in every byte; the pairs, fours and bytes of a word.
EACH, TWO, FOUR, EIGHT, TOP = (np.uint64(x) for x in (0x0101010101010101, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x8080808080808080))
#: Where the r-th one of a byte b stands, at r * 256 + b.
IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.int64)


def select(w: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Where in each 64-bit word its ``rest``-th one stands: running byte counts, then a table of bytes."""
    s = w - (w >> np.uint64(1) & TWO)
    s = (s & FOUR) + (s >> np.uint64(2) & FOUR)
    sums = (s + (s >> np.uint64(4)) & EIGHT) * EACH
    place = np.minimum(np.bitwise_count((rest * EACH | TOP) - sums & TOP).astype(np.uint64) << np.uint64(3), np.uint64(56))
    rank = rest - ((sums << np.uint64(8)) >> place & np.uint64(255))
    return place.astype(np.int64) + IN_BYTE[((rank & np.uint64(7)) << np.uint64(8) | (w >> place & np.uint64(255))).astype(np.int64)]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width``-bit integers one after another, with eight spare bytes at the end."""
    if not width:
        return np.zeros(8, np.uint8)
    parts = []
    for k in range(0, len(values), PACK):  # PACK * width is a multiple of 8 bits
        v = values[k : k + PACK].astype(np.uint64)
        bits = np.empty((len(v), width), np.uint8)
        for b in range(width):
            bits[:, b] = v >> np.uint64(b) & np.uint64(1)
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def unpack(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.int64)
    window = np.ndarray((len(packed) - 7,), "<u8", buffer=packed, strides=(1,))
    bit = at * width
    return (window[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.int64)


def encode(values: np.ndarray, universe: int, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and meta of a non-decreasing sequence of values below ``universe``."""
    n = len(values)
    width = max(0, int(universe // max(n, 1)).bit_length() - 1) if n else 0
    places = (values >> width) + np.arange(n)
    size = n + (int(universe) >> width) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[places] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    zeros = 64 - np.bitwise_count(high).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(zeros)[:-1]])
    ones = 64 * np.arange(len(before)) - before
    kind = np.uint32 if size < 1 << 32 else np.int64
    return {f"{name}.low": pack(values & ((1 << width) - 1), width), f"{name}.high": high, f"{name}.zeros": before.astype(kind), f"{name}.ones": ones.astype(kind)}, {"n": n, "width": width}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], meta: dict, name: str):
        self.low, self.high, self.zeros, self.ones = (np.asarray(arrays[f"{name}.{x}"]) for x in ("low", "high", "zeros", "ones"))
        self.n, self.width = meta["n"], meta["width"]

    @staticmethod
    def _pair(bits: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the k-th and the next one of a bitmap (zero, if ``flip``) stand."""
        word = np.searchsorted(before, k.astype(before.dtype), side="right") - 1
        w = ~bits[word] if flip else bits[word]
        at = select(w, (k - before[word].astype(np.int64)).astype(np.uint64))
        after = w & ((ALL << at.astype(np.uint64)) << np.uint64(1))
        first, then = word * 64 + at, word * 64 + np.bitwise_count((after & (~after + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(after == 0)  # the next one stands in a later word
        if len(far):
            word = np.searchsorted(before, (k[far] + 1).astype(before.dtype), side="right") - 1
            w = ~bits[word] if flip else bits[word]
            then[far] = word * 64 + select(w, (k[far] + 1 - before[word].astype(np.int64)).astype(np.uint64))
        return first, then

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th and the next values: a range, where the sequence holds pointers."""
        one, two = self._pair(self.high, self.ones, i, False)
        return (one - i) << self.width | unpack(self.low, self.width, i), (two - i - 1) << self.width | unpack(self.low, self.width, i + 1)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of each value in the sequence, within [begin, stop) if given; -1 where it is absent: a successor search."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        top = x >> self.width
        lower = np.maximum(top - 1, 0)
        one, two = self._pair(self.high, self.zeros, lower, True)
        lo, end = np.where(top > 0, one - lower, 0), np.where(top > 0, two, one) - top
        if begin is not None:
            lo, end = np.maximum(lo, begin), np.minimum(end, stop)
        want, hi = x & ((1 << self.width) - 1), end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = unpack(self.low, self.width, mid) < want[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        out = np.full(len(x), -1, np.int64)
        held = np.flatnonzero(lo < end)
        held = held[unpack(self.low, self.width, lo[held]) == want[held]]
        out[held] = lo[held]
        return out

    def all(self) -> np.ndarray:
        """The whole sequence, decoded."""
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        at = np.arange(self.n)
        return ((np.flatnonzero(bits)[: self.n] - at) << self.width) + unpack(self.low, self.width, at)
