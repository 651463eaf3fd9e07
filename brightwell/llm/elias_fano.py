"""Elias-Fano sequences over flat arrays, queried in batches, in memory or mapped from a file."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_NEAR = 8  # elements of a range that are searched without the high bits' help


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """width low bits of each value, one after another, in 64-bit words (with one word to spare)."""
    out = np.zeros(len(values) * width // 64 + 2, _U)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U)
        values = values & _U((1 << width) - 1)
        np.bitwise_or.at(out, word, values << shift)
        over = shift + _U(width) > _U(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


_L8, _H8 = _U(0x0101010101010101), _U(0x8080808080808080)
#: Position of the k-th one of each byte, at 256 * k + byte.
_IN_BYTE = np.array([[[i for i in range(8) if b >> i & 1][k] if k < b.bit_count() else 0 for b in range(256)] for k in range(8)], np.int64).ravel()


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one in each 64-bit word: sums of its bytes side by side, then a table."""
    s = word - ((word >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _L8  # byte i: ones of bytes 0 to i
    k = k.astype(_U)
    full = ((k * _L8 | _H8) - s) & _H8  # bytes that end before the k-th one
    place = ((full >> _U(7)) * _L8 >> _U(56)) << _U(3)
    left = k - ((s << _U(8)) >> place & _U(0xFF))
    return (place + _IN_BYTE[(left << _U(8) | (word >> place) & _U(0xFF)).astype(np.int64)].astype(_U)).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit integers in about 2 + log2(universe / n) bits each."""

    #: name and kind of the arrays, in the order in which they are stored; ones: how many come before each word of high
    PARTS = (("low", _U), ("high", _U), ("ones", np.int64))

    def __init__(self, n: int, width: int, low, high, ones):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = (np.arange(len(ones)) << 6) - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values, _U), len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        buckets = (top >> width) + 1
        at = (values >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((n + buckets + 63) // 64 * 64 + 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
        return cls(n, width, _packed(values, width), high, ones)

    def _find(self, rank: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Bit positions of the rank-th ones (flip 0) or zeros (flip all); before: how many come before each word."""
        word = np.searchsorted(before, rank, side="right") - 1
        held, left = self.high[word] ^ flip, rank - before[word]
        return (word << 6) + _select(held, left)

    def following(self, at: np.ndarray) -> np.ndarray:
        """Bit positions of the next ones after those at bit positions at."""
        word = at >> 6
        held = self.high[word] & (~_U(1) << (at & 63).astype(_U))
        todo = np.flatnonzero(held == 0)
        while len(todo):
            word[todo] += 1
            held[todo] = self.high[word[todo]]
            todo = todo[held[todo] == 0]
        low = held & (~held + _U(1))
        return (word << 6) + np.bitwise_count(low - _U(1))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(_U)
        first = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | rest) & _U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        i = np.asarray(i, np.int64)
        return ((self._find(i, self.ones, _U(0)) - i).astype(_U) << _U(self.width)) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions i and i + 1."""
        i = np.asarray(i, np.int64)
        at = self._find(i, self.ones, _U(0))
        return tuple(((p - k).astype(_U) << _U(self.width)) | self._low(k) for p, k in ((at, i), (self.following(at), i + 1)))

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value: the first position whose element is not below it, and whether they are equal.

        Exact for values up to the largest element; beyond it the position is n.
        """
        values = np.asarray(values, _U)
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        bucket = values >> _U(self.width)
        top = int(self.access(np.array([self.n - 1]))[0]) >> self.width
        beyond = bucket > _U(top)
        bucket = np.minimum(bucket, _U(top)).astype(np.int64)
        lo = np.zeros(len(values), np.int64)
        later = bucket > 0
        lo[later] = self._find(bucket[later] - 1, self.zeros, ~_U(0)) - (bucket[later] - 1)
        end = np.full(len(values), self.n, np.int64)
        inner = bucket < top
        end[inner] = self._find(bucket[inner], self.zeros, ~_U(0)) - bucket[inner]
        low, hi = values & _U((1 << self.width) - 1), end.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        lo[beyond] = self.n
        inside = (lo < end) & ~beyond
        equal = np.zeros(len(values), bool)
        equal[inside] = self._low(lo[inside]) == low[inside]
        return lo, equal

    def search(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor of each value among the positions [lo, hi) only, and whether they are equal."""
        values, lo, hi = np.asarray(values, _U), lo.astype(np.int64), hi.astype(np.int64)
        end = hi.copy()
        far = np.flatnonzero(hi - lo > _NEAR)
        if len(far):  # long ranges: first to the elements with the same high bits
            top = int(self.access(np.array([self.n - 1]))[0]) >> self.width
            bucket = np.minimum(values[far] >> _U(self.width), _U(top)).astype(np.int64)
            after = np.full(len(far), self.n, np.int64)
            inner = bucket < top
            after[inner] = self._find(bucket[inner], self.zeros, ~_U(0)) - bucket[inner]
            before = np.zeros(len(far), np.int64)
            later = bucket > 0
            before[later] = self._find(bucket[later] - 1, self.zeros, ~_U(0)) - (bucket[later] - 1)
            lo[far], hi[far] = np.clip(before, lo[far], hi[far]), np.clip(after, lo[far], hi[far])
        equal = np.zeros(len(values), bool)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            here = self.access(mid)
            less, same = here < values[todo], here == values[todo]
            lo[todo] = np.where(same, mid, np.where(less, mid + 1, lo[todo]))
            hi[todo] = np.where(less, hi[todo], mid)
            equal[todo[same]] = True
            todo = todo[lo[todo] < hi[todo]]
        return np.minimum(lo, end), equal

    def dump(self) -> list[np.ndarray]:
        """Arrays that restore reads: a head of 64-bit integers, then the parts."""
        parts = [np.ascontiguousarray(getattr(self, k)) for k, _ in self.PARTS]
        return [np.array([self.n, self.width, *map(len, parts)], _U), *parts]

    @classmethod
    def restore(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """From byte at of a mapped or held array of bytes; also where it ends."""
        head = data[at : at + 8 * 5].view(_U)
        n, width, *sizes = (int(x) for x in head)
        at += 40
        parts = []
        for (_, kind), size in zip(cls.PARTS, sizes, strict=True):
            end = at + size * np.dtype(kind).itemsize
            parts.append(data[at:end].view(kind))
            at = -(-end // 8) * 8
        return cls(n, width, *parts), at


def stored(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each filled up to 8 bytes."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)
