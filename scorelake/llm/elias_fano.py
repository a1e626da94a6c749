"""Non-decreasing numbers in near-minimal space, with access by place.

Each number is cut in two. Its low bits are stored as they are; its high bits as the distance to the number before,
in unary: number i sets bit (high + i) of a bit string. With n numbers below u the low part takes log2(u / n) bits
each and the bit string at most three, whatever their size. The place of every 256th set bit is kept in 32 bits, so that the i-th
number is found from one stretch of the bit string and its own low bits, without reading the rest.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

SAMPLE = 256
# Count, bytes of the bit string, low bits, least number.
HEAD = "<QQQq"
#: Numbers whose low bits are packed in one step; a multiple of eight, so that steps end on whole bytes.
STEP = 1 << 13


def _packed_low(low: np.ndarray, bits: int) -> bytes:
    places = np.arange(bits, dtype=np.uint64)
    parts = []
    for at in range(0, len(low), STEP):
        part = (low[at:at + STEP, None] >> places) & np.uint64(1)
        parts.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(parts)


def pack(values: np.ndarray) -> bytes:
    """Bytes of non-decreasing 64-bit numbers, signed or not."""
    signed = np.asarray(values).astype(np.int64)
    n = len(signed)
    if not n:
        return struct.pack(HEAD, 0, 0, 0, 0)
    if (signed[1:] < signed[:-1]).any():
        raise ValueError("the numbers must not fall")
    base = int(signed[0])
    above = signed.view(np.uint64) - signed.view(np.uint64)[:1]  # up to 2^64 - 1, modulo 2^64
    bits = max((int(above[-1]) // n).bit_length() - 1, 0)
    set_bits = (above >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    if set_bits[-1] >= 1 << 32:
        raise ValueError("too many numbers for samples of 32 bits")
    high = np.zeros((int(set_bits[-1]) // 8 + 1) * 8, np.uint8)
    high[set_bits] = 1
    high = np.packbits(high, bitorder="little").tobytes()
    low = _packed_low(above & np.uint64((1 << bits) - 1), bits)
    return struct.pack(HEAD, n, len(high), bits, base) + set_bits[::SAMPLE].astype("<u4").tobytes() + high + low


class EliasFano:
    """Packed numbers, read through ``read(offset, size)`` from offset ``at`` on."""

    def __init__(self, read: Callable[[int, int], bytes], at: int = 0):
        self.read = read
        self.n, self.high_bytes, self.bits, self.base = struct.unpack(HEAD, read(at, struct.calcsize(HEAD)))
        self.samples_at = at + struct.calcsize(HEAD)
        self.high_at = self.samples_at + 4 * (-(-self.n // SAMPLE))
        self.low_at = self.high_at + self.high_bytes
        self.end = self.low_at + (self.n * self.bits + 7) // 8

    def __len__(self) -> int:
        return self.n

    def _numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        above = (high.astype(np.uint64) << np.uint64(self.bits)) | low
        return (above + np.array([self.base], np.int64).view(np.uint64)).view(np.int64)

    def _ones(self, first: int, last: int) -> np.ndarray:
        """Places of the set bits in some bytes of the bit string."""
        data = np.frombuffer(self.read(self.high_at + first, last - first), np.uint8)
        return np.flatnonzero(np.unpackbits(data, bitorder="little")) + 8 * first

    def _low(self, first: int, last: int) -> np.ndarray:
        """Low bits of the numbers from ``first``, a multiple of eight, up to ``last``."""
        if not self.bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.bits // 8, (last * self.bits + 7) // 8
        bits = np.unpackbits(np.frombuffer(self.read(self.low_at + a, b - a), np.uint8), bitorder="little")
        bits = bits[:(last - first) * self.bits].reshape(-1, self.bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))

    def all(self) -> np.ndarray:
        """Every number, as signed 64 bits."""
        if not self.n:
            return np.empty(0, np.int64)
        low = np.concatenate([self._low(a, min(a + STEP, self.n)) for a in range(0, self.n, STEP)])
        return self._numbers(self._ones(0, self.high_bytes) - np.arange(self.n), low)

    def select(self, places: np.ndarray) -> np.ndarray:
        """The numbers at some places, in any order; only the blocks they lie in are read."""
        places = np.asarray(places, np.int64)
        if len(places) and not 0 <= places.min() <= places.max() < self.n:
            raise IndexError("place beyond the numbers")
        out = np.empty(len(places), np.int64)
        for block in np.unique(places // SAMPLE).tolist():
            known = np.frombuffer(self.read(self.samples_at + 4 * block, 8 if (block + 1) * SAMPLE < self.n else 4), "<u4")
            last = int(known[1]) // 8 + 1 if len(known) > 1 else self.high_bytes
            ones = self._ones(int(known[0]) // 8, last)
            ones = ones[ones >= known[0]][:SAMPLE]
            first = block * SAMPLE
            hit = np.flatnonzero(places // SAMPLE == block)
            inside = places[hit] - first
            low = self._low(first, min(first + SAMPLE, self.n))
            out[hit] = self._numbers(ones[inside] - places[hit], low[inside])
        return out
