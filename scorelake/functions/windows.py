"""Token windows for rolling likelihoods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.binding import bound


def rolling_windows(tokens: Column, prefix: Column, longest: int, context: int = 1) -> Column:
    """Windows of (input, predicted) tokens that predict every token once.

    The first window predicts as many tokens as fit, from the prefix; later ones predict
    ``longest - context + 1`` tokens with the context before them.
    """
    if not 1 <= context <= longest:
        raise ValueError("context must be between 1 and the longest window")
    return bound(tokens, lambda t: _windows(t, prefix, longest, longest - context + 1))


def _windows(tokens: Column, prefix: Column, longest: int, stride: int) -> Column:
    n = F.size(tokens)
    head = F.least(n, F.lit(longest))
    first = F.struct(
        F.concat(F.array(prefix), F.slice(tokens, F.lit(1), F.greatest(head - 1, F.lit(0)))).alias("input"),
        F.slice(tokens, F.lit(1), head).alias("predicted"),
    )
    more = F.ceil((n - longest) / F.lit(float(stride))).cast("int")

    def later(i: Column) -> Column:
        done = F.lit(longest) + i * stride
        size = F.least(n - done, F.lit(stride))
        end = done + size
        return F.struct(
            F.slice(tokens, end - longest, F.lit(longest)).alias("input"),
            F.slice(tokens, end - size + 1, size).alias("predicted"),
        )

    rest = F.when(more > 0, F.transform(F.sequence(F.lit(0), F.greatest(more, F.lit(1)) - 1), later))
    windows = F.concat(F.array(first), F.coalesce(rest, F.slice(F.array(first), 1, 0)))
    return F.when(n > 0, windows).otherwise(F.slice(F.array(first), 1, 0))


def disjoint_input(window: Column) -> Column:
    """Input of a window without what it predicts."""
    given, predicted = window["input"], window["predicted"]
    return F.slice(given, F.lit(1), F.greatest(F.size(given) - F.size(predicted) + 1, F.lit(0)))
