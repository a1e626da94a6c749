"""Words, lines and hashes of whole texts as numpy arrays, read straight from the bytes of an Arrow column.

A word is a run of bytes other than space and the controls 9 to 13. These separators are single bytes that
never occur inside another character of UTF-8, so words are found without decoding. Texts are worked on in
slices of a quarter of a megabyte (one text at least), which bounds the memory of a task by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers of one seed."""
    first = np.array([seed], np.uint64) * _C
    return mix((np.arange(1, n + 1, dtype=np.uint64) * _A) ^ mix(first))


#: Numbers of a seed kept for the next call, 1 MB; those for a longer text are let go with it.
KEPT_NUMBERS = 1 << 17
_TABLES: dict[int, np.ndarray] = {}


def multipliers(n: int, seed: int) -> np.ndarray:
    """At least ``n`` of a seed's numbers."""
    held = _TABLES.get(seed)
    if held is None or len(held) < n:
        held = draws(max(4096, 2 * n if 2 * n <= KEPT_NUMBERS else n), seed)
        if len(held) <= KEPT_NUMBERS:
            _TABLES[seed] = held
    return held


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order."""
    return mix(a * _A + b)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbours, by doubling; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, level, size = None, 0, h, 1
    while True:
        if k & size:
            part = level[done:done + n]
            out = part if out is None else joined(out, part)
            done += size
        if 2 * size > k:
            return out
        level = joined(level[:-size], level[size:])
        size *= 2


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins and ends; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of texts."""
    data, offsets = text_bytes(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def gaps(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


_BASES = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
#: Powers kept for the next call, 2 MB of each kind; those for a longer text are let go with it.
KEPT_POWERS = SLICE_BYTES
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, factor: int) -> np.ndarray:
    """At least ``n`` powers of an odd number, modulo 2^64."""
    held = _POWERS.get(factor)
    if held is None or len(held) < n:
        size = max(SLICE_BYTES, n)
        held = np.ones(1 << (size - 1).bit_length(), np.uint64)
        done = 1
        while done < len(held):
            held[done:2 * done] = held[:done] * np.array([pow(factor, done, 1 << 64)], np.uint64)
            done *= 2
        if len(held) <= KEPT_POWERS:
            _POWERS[factor] = held
    return held


def _inverse(base: int) -> int:
    return pow(_BASES[base], -1, 1 << 64)


def byte_sums(data: np.ndarray, base: int = 0) -> np.ndarray:
    """Running sums of bytes times powers, from which the hash of any run of bytes follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _powers(len(data), _BASES[base])[:len(data)], dtype=np.uint64, out=total[1:])
    return total


def run_hashes(total: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of the bytes of each run, wherever it stands."""
    inverse = _powers(len(total), _inverse(base))
    return mix((total[stop] - total[start]) * inverse[start] ^ ((stop - start).astype(np.uint64) * _A))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs may be empty."""
    kind = np.uint64 if values.dtype == np.uint64 else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, dtype=kind, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Words:
    """The words of a slice of texts: ``start`` and ``stop`` in bytes, ``bounds`` of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = gaps(data)
        self.solid = ~gap
        first, last = self.solid.copy(), self.solid.copy()
        if len(data):
            first[1:] &= gap[:-1]
            last[:-1] &= gap[1:]
            full = offsets[:-1] < offsets[1:]
            at = offsets[:-1][full]
            first[at] = self.solid[at]
            at = offsets[1:][full] - 1
            last[at] = self.solid[at]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self, lower: bool = False, base: int = 0) -> np.ndarray:
        return run_hashes(byte_sums(lower_ascii(self.data) if lower else self.data, base), self.start, self.stop, base)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sequence_keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits, as two numbers, of each text's sequence of words."""
        place = np.arange(len(h)) - np.repeat(self.bounds[:-1], self.counts)
        n = int(self.counts.max()) if len(self.counts) else 0
        out = []
        for seed in (2, 3):
            total = sums(h * (multipliers(n, seed)[place] | np.uint64(1)), self.bounds)
            out.append(mix(total ^ (self.counts.astype(np.uint64) * _A)))
        return out[0], out[1]

    def window_mask(self, k: int) -> np.ndarray:
        """Which runs of ``k`` words, by their first, lie within one text."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.empty(0, bool)
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.start))
        return left[:n] >= k


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
