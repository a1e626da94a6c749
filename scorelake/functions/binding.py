"""Naming an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` mentions it.

    Inside array functions Spark evaluates expressions as they stand, so a long expression mentioned
    many times, or captured by a lambda, would be worked out each time.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
