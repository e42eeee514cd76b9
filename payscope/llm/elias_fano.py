"""Elias-Fano sequences over flat buffers, with vectorised access and search.

``n`` ascending numbers below a universe are kept as ``low`` bits each plus a bit vector of their high parts in unary: about
2 + log2(universe / n) bits a number.  The arrays are read straight from the buffer, which may be a memory map.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 8  # words of 64 bits for each directory entry


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    place = np.zeros(len(word), dtype=np.int64)
    k = k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = k >= count
        k = k - count * up
        word = np.where(up, word >> np.uint64(width), word)
        place += width * up
    return place


class EliasFano:
    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.ones = n, low, lower, upper, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * (64 * _BLOCK) - ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values``: ascending, unsigned 64-bit, below ``universe``."""
        n = len(values)
        low = min(56, max(0, (int(universe) // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(low)).astype(np.int64)
        bits = int(universe >> low) + n + 1
        words = -(-bits // 64)
        words += -words % _BLOCK
        flags = np.zeros(words * 64, dtype=np.uint8)
        flags[high + np.arange(n)] = 1
        upper = np.packbits(flags, bitorder="little").view("<u8")
        lower = np.zeros(n * low // 8 + 17, dtype=np.uint8)
        step = 8 * 8192  # a multiple of 8 numbers ends on a byte
        for at in range(0, n if low else 0, step):
            part = values[at: at + step]
            packed = np.packbits(((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            lower[at * low // 8: at * low // 8 + len(packed)] = packed
        counts = np.bitwise_count(upper).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
        return cls(n, low, lower, upper, np.r_[0, np.cumsum(counts)[:-1]])

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        block = np.searchsorted(directory, k, side="right") - 1
        rest, word = k - directory[block], block * _BLOCK
        get = lambda w: ~self.upper[w] if flip else self.upper[w]
        for _ in range(_BLOCK - 1):
            count = np.bitwise_count(get(word)).astype(np.int64)
            on = rest >= count
            rest = rest - count * on
            word = word + on
        return word * 64 + _select_in_word(get(word), rest)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.low
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        out = np.zeros(len(i), dtype=np.uint64)
        for k in range(8):
            out |= self.lower[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (out >> shift) & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, dtype=np.int64)
        if not self.n:
            return np.zeros(len(i), dtype=np.uint64)
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._lows(i)

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Place of each ``x`` in [begin, end), or -1: the successor of x among the numbers of its high part."""
        x = np.asarray(x, dtype=np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, dtype=np.int64)
        high = (x >> np.uint64(self.low)).astype(np.int64)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - high + 1, 0)
        last = self._select(high, self.zeros, True) - high
        lo, hi = np.maximum(first, begin), np.minimum(last, self.n if end is None else end)
        stop, low = hi.copy(), x & np.uint64((1 << self.low) - 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self._lows(np.minimum(mid, self.n - 1)) < low)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        safe = np.clip(lo, 0, self.n - 1)
        return np.where((lo < stop) & (self._lows(safe) == low), lo, -1)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low], dtype="<i8"), self.lower, self.upper, self.ones.astype("<i8")]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])


# -- files of arrays --------------------------------------------------------------------------------------------

_KINDS = ["<i8", "<u8", "|u1", "<u2", "<u4"]


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """One buffer: count, (kind, length) of each array, then the arrays, each at a multiple of 8 bytes."""
    head = [len(arrays)]
    for a in arrays:
        head += [_KINDS.index(a.dtype.newbyteorder("<").str), len(a)]
    out = [np.array(head, dtype="<i8").tobytes()]
    for a in arrays:
        raw = a.tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)


def unpack_arrays(buffer) -> list[np.ndarray]:
    """The arrays of ``pack_arrays`` as views of the buffer."""
    n = int(np.frombuffer(buffer, "<i8", 1)[0])
    head = np.frombuffer(buffer, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 * (1 + 2 * n)
    for kind, length in head.tolist():
        a = np.frombuffer(buffer, _KINDS[kind], length, at)
        out.append(a)
        at += a.nbytes + -a.nbytes % 8
    return out
