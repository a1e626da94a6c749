"""Poisson weights of many rows and rounds as matrices, number by number those of :mod:`scorelake.functions.draws`."""

from __future__ import annotations

import math

import numpy as np

#: Weights worked out at a time; they stay in the processor's cache.
BLOCK = 1 << 18
#: Rows whose totals are multiplied at a time.
ROWS = 256

# Fixed values, those of ``draws``: multiplier, step from one stream to the next, and the largest weight.
MULTIPLIER = np.uint32(0x45D9F3B)
STREAM_STEP = 40503
LONGEST = 12


#: The least draw of each weight above 0; the last weights are rarer than one draw in 2^32.
LIMITS = np.array([x for x in np.ceil(np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(LONGEST)]) * 2.0 ** 32) if x < 2.0 ** 32], np.uint32)
#: Weights compared for all draws; higher ones are looked up for the few draws that reach them.
COMMON = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= MULTIPLIER
    x ^= x >> np.uint32(16)
    return x


def draws(state: np.ndarray, first: int, last: int) -> np.ndarray:
    """Draws of the streams ``first`` to ``last`` - 1 (down) of rows with these states (across)."""
    streams = ((np.arange(first, last, dtype=np.uint64) * np.uint64(STREAM_STEP)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return _mixed(streams[:, None] + state.astype(np.uint32)[None, :])


def weights(state: np.ndarray, first: int, last: int) -> np.ndarray:
    """Weights in rounds ``first`` to ``last`` - 1 (down) of rows with these states (across)."""
    drawn = draws(state, first, last)
    out = (drawn >= LIMITS[0]).view(np.uint8)
    for limit in LIMITS[1:COMMON]:
        out += (drawn >= limit).view(np.uint8)
    high = np.flatnonzero(out.ravel() == COMMON)
    out.ravel()[high] = np.searchsorted(LIMITS, drawn.ravel()[high], side="right")
    return out


def add_resampled(sums: np.ndarray, state: np.ndarray, values: np.ndarray) -> None:
    """Add to ``sums`` (round, column) the weighted sums of ``values`` (row, column) in every round."""
    rounds = len(sums)
    for low in range(0, len(state), ROWS):
        own, held = state[low:low + ROWS], values[low:low + ROWS]
        step = max(1, BLOCK // len(own))
        for first in range(0, rounds, step):
            last = min(first + step, rounds)
            sums[first:last] += weights(own, first, last).astype(np.float64) @ held


def add_picked(sums: np.ndarray, pool: np.ndarray, state: int) -> None:
    """Add to every round of ``sums`` the row of ``pool`` that a draw of this state and round picks."""
    rounds = len(sums)
    for first in range(0, rounds, BLOCK):
        last = min(first + BLOCK, rounds)
        drawn = draws(np.array([state], np.uint32), first, last)[:, 0].astype(np.uint64)
        sums[first:last] += pool[((drawn * np.uint64(len(pool))) >> np.uint64(32)).astype(np.intp)]
