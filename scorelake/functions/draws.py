"""Repeatable pseudo-random draws from a row's key.

The value depends on the key, the stream and the seed only, never on partitioning, so a job that is
retried or re-planned draws the same numbers. Plain integer arithmetic keeps it inside generated code
and lets any SQL engine repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: seed used by every shuffle and split unless another is given.
SEED = 1024

_MASK = 0xFFFFFFFF
_MULTIPLIER = 0x45D9F3B
_STREAM_STEP = 40503
SPAN = 1 << 32


def _mix(x: Column) -> Column:
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * _MULTIPLIER).bitwiseAND(_MASK)
    return F.shiftright(x, 16).bitwiseXOR(x)


def key_state(key: Column, seed: int = SEED) -> Column:
    """What all draws of a whole-number key start from; a missing key counts as 0. Worth keeping as a
    column when a row draws often."""
    # Never null, so that a join or filter on a draw adds no test that would work it out once more.
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    folded = key.bitwiseXOR(F.shiftright(key, 32)).bitwiseAND(_MASK)
    return _mix(folded.bitwiseXOR(F.lit(seed).cast("bigint")))


def draw_from(state: Column, stream: Column | int = 0) -> Column:
    """A whole number in [0, 2^32); ``stream`` tells draws of one key apart."""
    zero = F.lit(0).cast("bigint")
    stream = F.lit(stream).cast("bigint") if isinstance(stream, int) else F.coalesce(stream.cast("bigint"), zero)
    return _mix((F.coalesce(state, zero) + stream * _STREAM_STEP).bitwiseAND(_MASK))


def draw(key: Column, stream: Column | int = 0, seed: int = SEED) -> Column:
    return draw_from(key_state(key, seed), stream)


def uniform_from(state: Column, stream: Column | int = 0) -> Column:
    """A number in [0, 1)."""
    return draw_from(state, stream) / float(SPAN)


def uniform_int(state: Column, low: int, high: Column, stream: Column | int) -> Column:
    """A whole number from low to high, both included."""
    return low + F.floor(uniform_from(state, stream) * (high - low + 1))


def poisson_one(u: Column, longest: int = 12) -> Column:
    """Turn a uniform number into a Poisson(1) count by its cumulative distribution."""
    import math

    total, steps = 0.0, []
    for k in range(longest):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(total)
    count = F.lit(longest)
    for k in range(longest - 1, -1, -1):
        count = F.when(u < steps[k], F.lit(k)).otherwise(count)
    return count
