"""Elias-Fano coded sets of sorted 64-bit hashes, in numpy.

A set of n sorted numbers below 2^u is cut into u - l high bits, written in unary (number i sets the bit
high_i + i), and l low bits each, packed end to end, with l = floor(log2(2^u / n)). That takes about
2 + l bits a number. Probes find the first number with their high bits by selecting a zero in the unary
bits and walk the few numbers that share them; everything works on arrays of probes at once.
"""

from __future__ import annotations

import numpy as np

#: Bytes of unary bits between two entries of the directory of zeros.
BLOCK = 32
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th zero in a byte, lowest bit first; 8 where there is none.
_ZERO_AT = np.array([([b for b in range(8) if not i >> b & 1] + [8] * 9)[:9] for i in range(256)], np.uint8)


class EliasFano:
    """A frozen sorted set of distinct unsigned numbers below 2^universe (at most 64)."""

    def __init__(self, numbers: np.ndarray, universe: int = 64):
        n = len(numbers)
        numbers = numbers.astype(np.uint64)
        self.n, self.universe = n, universe
        self.low = max(0, min(56, universe - max(1, int(n).bit_length())))
        high = (numbers >> np.uint64(self.low)).astype(np.int64)
        top = (1 << (universe - self.low)) if universe - self.low < 40 else int(high[-1]) + 2
        size = -(-(n + top + 1) // (8 * BLOCK)) * BLOCK
        bits = np.zeros(size * 8, np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = np.packbits(bits, bitorder="little")
        zeros = (8 - _ONES[self.high]).reshape(-1, BLOCK).sum(1)
        self.zeros = np.concatenate([[0], np.cumsum(zeros, dtype=np.int64)])
        self.packed = self._pack(numbers)

    def _pack(self, numbers: np.ndarray) -> np.ndarray:
        l = self.low
        if not l or not self.n:
            return np.zeros(16, np.uint8)
        out = np.zeros((self.n * l + 7) // 8 + 16, np.uint8)
        for first in range(0, self.n, 1 << 16):  # whole bytes: 65,536 l is a multiple of 8
            part = numbers[first : first + (1 << 16)]
            bits = ((part[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            out[first * l // 8 : first * l // 8 + len(packed)] = packed
        return out

    def nbytes(self) -> int:
        return self.high.nbytes + self.zeros.nbytes + self.packed.nbytes

    def to_bytes(self) -> bytes:
        """The count in 8 bytes, first byte highest, then universe, low bits, length of the unary bits, the bits and the low bits; the directory is made again on reading."""
        head = self.n.to_bytes(8, "big") + bytes([self.universe, self.low]) + len(self.high).to_bytes(8, "big")
        return head + self.high.tobytes() + self.packed.tobytes()

    @staticmethod
    def of_bytes(data: bytes) -> EliasFano:
        own = EliasFano.__new__(EliasFano)
        own.n, own.universe, own.low, size = int.from_bytes(data[:8], "big"), data[8], data[9], int.from_bytes(data[10:18], "big")
        own.high = np.frombuffer(data, np.uint8, size, 18).copy()
        own.packed = np.frombuffer(data, np.uint8, -1, 18 + size).copy()
        zeros = (8 - _ONES[own.high]).reshape(-1, BLOCK).sum(1)
        own.zeros = np.concatenate([[0], np.cumsum(zeros, dtype=np.int64)])
        return own

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        words = np.lib.stride_tricks.as_strided(self.packed[:8].view("<u8"), shape=(len(self.packed) - 7,), strides=(1,))
        got = words[bit >> 3] >> (bit & 7).astype(np.uint64)  # low is 56 at most, so 8 bytes hold it at any shift
        return got & np.uint64((1 << self.low) - 1)

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th zeros (from 0) in the unary bits."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        rest = k - self.zeros[block]
        rows = self.high.reshape(-1, BLOCK)[block]
        ahead = np.cumsum(8 - _ONES[rows], axis=1, dtype=np.int64)
        at = (ahead <= rest[:, None]).sum(1)
        before = np.where(at > 0, ahead[np.arange(len(k)), np.maximum(at - 1, 0)], 0)
        return block * (BLOCK * 8) + at * 8 + _ZERO_AT[rows[np.arange(len(k)), at], rest - before]

    def successor(self, probes: np.ndarray) -> np.ndarray:
        """For each probe the index of the first number that isn't smaller; n where there is none."""
        probes = probes.astype(np.uint64)
        if not self.n:
            return np.zeros(len(probes), np.int64)
        hi = (probes >> np.uint64(self.low)).astype(np.int64)
        hi = np.minimum(hi, self.zeros[-1] - 2)
        start = np.where(hi > 0, self.select_zero(np.maximum(hi - 1, 0)) - (hi - 1), 0)
        end = self.select_zero(hi) - hi
        want = probes & np.uint64((1 << self.low) - 1) if self.low else np.zeros(len(probes), np.uint64)
        over = (probes >> np.uint64(self.low)).astype(np.int64) > hi
        at = np.where(over, self.n, start)
        live = np.flatnonzero(~over & (at < end))
        while len(live):
            live = live[self.lows(at[live]) < want[live]]
            at[live] += 1
            live = live[at[live] < end[live]]
        return at

    def contains(self, probes: np.ndarray) -> np.ndarray:
        at = self.successor(probes)
        inside = at < self.n
        got = np.zeros(len(probes), bool)
        if inside.any():
            got[inside] = self.values(at[inside]) == probes[inside].astype(np.uint64)
        return got

    def values(self, i: np.ndarray | None = None) -> np.ndarray:
        """The numbers at the indices i, or all."""
        if i is None:
            ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
            high, i = ones - np.arange(self.n), np.arange(self.n)
        else:
            high = self.select_one(i) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self.lows(i)

    def select_one(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th ones (from 0) in the unary bits."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * (BLOCK * 8) - self.zeros
        block = np.searchsorted(ones, k, side="right") - 1
        rest = k - ones[block]
        rows = self.high.reshape(-1, BLOCK)[block]
        ahead = np.cumsum(_ONES[rows], axis=1, dtype=np.int64)
        at = (ahead <= rest[:, None]).sum(1)
        before = np.where(at > 0, ahead[np.arange(len(k)), np.maximum(at - 1, 0)], 0)
        return block * (BLOCK * 8) + at * 8 + _ZERO_AT[255 - rows[np.arange(len(k)), at], rest - before]


class Seen:
    """A growing set: Elias-Fano runs of falling size; a new batch is merged with the runs no larger than it.

    So each number is merged again only a logarithmic number of times, and a probe looks into that many runs.
    """

    def __init__(self, universe: int = 64):
        self.runs: list[EliasFano] = []
        self.universe = universe

    def __len__(self) -> int:
        return sum(r.n for r in self.runs)

    def nbytes(self) -> int:
        return sum(r.nbytes() for r in self.runs)

    def contains(self, probes: np.ndarray) -> np.ndarray:
        got = np.zeros(len(probes), bool)
        left = np.arange(len(probes))
        for run in self.runs:
            hit = run.contains(probes[left])
            got[left[hit]] = True
            left = left[~hit]
            if not len(left):
                break
        return got

    def add(self, numbers: np.ndarray) -> None:
        """Adds sorted distinct numbers that aren't in the set yet."""
        if not len(numbers):
            return
        numbers = numbers.astype(np.uint64)
        while self.runs and self.runs[-1].n <= 2 * len(numbers):
            both = np.concatenate([self.runs.pop().values(), numbers])
            both.sort(kind="stable")  # merges two sorted pieces
            numbers = both
        self.runs.append(EliasFano(numbers, self.universe))
