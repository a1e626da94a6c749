"""Ranges of near-equal bytes by sampled splitters, and shards made of them.

Records are ordered by (key, tie). A sample drawn with chances in proportion to size gives the splitters at its
quantiles; as a sampled record carries its tie, a key that holds a third of all rows is cut by ties like any other
stretch. The exact sizes of the ranges are then counted, and a range of more than twice its share is cut again by
a denser sample of its own. The sample is picked by a hash of the record, so the same records give the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.storage import fresh, stored

#: Bytes a range should hold, within bounds of their number.
RANGE_BYTES = 64 << 20
MIN_RANGES, MAX_RANGES = 256, 1 << 15
SAMPLES_OF_RANGE = 32
ROUNDS = 4
LOWEST = -(1 << 63)

Splitters = tuple[np.ndarray, np.ndarray]


def ranges_of(splitters: Splitters, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The number of splitters at or below each (key, tie)."""
    keys, ties = splitters
    twice = np.unique(keys)
    out = np.searchsorted(keys, k, side="left")
    at = np.searchsorted(twice, k)
    hit = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == k) if len(twice) else np.empty(0, np.int64)
    for value in np.unique(k[hit]):
        rows = hit[k[hit] == value]
        low, high = np.searchsorted(keys, value, side="left"), np.searchsorted(keys, value, side="right")
        out[rows] = low + np.searchsorted(ties[low:high], t[rows], side="right")
    return out


def range_of(splitters: Splitters) -> Callable[[Column, Column], Column]:
    """Column function: the number of splitters at or below (key, tie); nulls stand below all numbers."""

    @F.pandas_udf("long")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(ranges_of(splitters, key.to_numpy(np.int64), tie.to_numpy(np.int64)))

    return lambda key, tie: place(_number(key), _number(tie))


def _number(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(LOWEST))


def _quantiles(key: np.ndarray, tie: np.ndarray, weight: np.ndarray, n: int) -> set[tuple[int, int]]:
    """Splitters that cut a weighted sample into ``n`` parts. A record of more than a share takes a part, and the others share
    the rest."""
    if not len(key) or n < 2:
        return set()
    order = np.lexsort((tie, key))
    weight = weight[order].astype(float)
    for _ in range(8):
        weight = np.minimum(weight, weight.sum() / n)
    total = np.cumsum(weight)
    at = order[np.minimum(np.searchsorted(total, total[-1] * np.arange(1, n) / n), len(order) - 1)]
    return set(zip(key[at].tolist(), tie[at].tolist()))


def splitters_of(rows: DataFrame, key: str, tie: str, size: str, least: int = MIN_RANGES) -> tuple[Splitters, int]:
    """Splitters of a table of (key, tie, size) into ``least`` ranges or more, and its bytes.

    ``rows`` is read once per round: give a stored table. Sizes are at least 1; a null one counts as 1. Both the sample and the counts brought to the driver are
    bounded by ``MAX_RANGES``, whatever the table."""
    rows = rows.select(_number(F.col(key)).alias("key"), _number(F.col(tie)).alias("tie"),
                       F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(1)), F.lit(1)).alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    ranges = int(min(max(total // RANGE_BYTES, least), MAX_RANGES))
    if not total:
        return (np.empty(0, np.int64), np.empty(0, np.int64)), 0
    share = total / ranges
    step = share / SAMPLES_OF_RANGE
    draw = F.pmod(F.xxhash64("key", "tie", F.lit(5)), F.lit(1 << 32)) / float(1 << 32)
    weight = F.greatest(F.col("size"), F.lit(step)).alias("weight")

    def drawn(table: DataFrame, density: float, *more: str) -> tuple[np.ndarray, ...]:
        sample = table.where(draw < F.col("size") * density / step).select("key", "tie", weight, *more).toArrow()
        return tuple(sample.column(c).to_numpy() for c in sample.column_names)

    found = _quantiles(*drawn(rows, 1.0), ranges)
    density = 1.0
    for _ in range(ROUNDS):
        splitters = _arrays(found)
        placed = rows.withColumn("range", range_of(splitters)(F.col("key"), F.col("tie")))
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min(F.struct("key", "tie")).alias("low"),
                                            F.max(F.struct("key", "tie")).alias("high"))
        over = sizes.where((F.col("bytes") > 2 * share) & (F.col("low") < F.col("high"))).select("range", "bytes").collect()
        if not over:
            break
        density *= SAMPLES_OF_RANGE
        keys, ties, weights, place = drawn(placed.where(F.col("range").isin([r.range for r in over])), density, "range")
        before = len(found)
        for r in over:
            own = place == r.range
            found |= _quantiles(keys[own], ties[own], weights[own], int(np.ceil(r.bytes / share)))
        if len(found) == before:
            break
    return _arrays(found), total


def _arrays(found: set) -> Splitters:
    pairs = sorted(found)
    return np.array([k for k, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64)


def sharded(rows: DataFrame, key: str, tie: str, size: str, shards: int) -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot (place in the shard, gapless from 0).

    Shards are runs of the order by (key, tie) whose sums of ``size`` differ by no more than about a record. A record
    belongs to the shard in which the middle of its bytes falls, so equal keys stay in one shard, or in
    neighbours where a border cuts them. Nulls stand below all numbers; rows alike in key and tie take slots in
    any order. An empty table gives an empty result. No task sorts more than one range. A column named like one of the
    two new ones comes back with a ``_`` behind its name. ``rows`` is read several times: give a stored table.
    """
    for name in [c for c in rows.columns if c.lower() in ("shard", "slot")]:
        other = fresh(rows, name)
        rows = rows.withColumnRenamed(name, other)
        key, tie, size = (other if c == name else c for c in (key, tie, size))
    splitters, total = splitters_of(rows, key, tie, size)
    part, before, above, bytes_, place, start = (fresh(rows, n) for n in ("range_no", "bytes_before", "rows_above", "size_of", "place_no", "shard_start"))
    placed = rows.withColumn(part, range_of(splitters)(F.col(key), F.col(tie)))
    placed = placed.withColumn(bytes_, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(1)), F.lit(1)))
    sizes = placed.groupBy(part).agg(F.sum(bytes_).alias("b"), F.count("*").alias("n")).collect()
    offsets, b, n = [], 0, 0
    for r in sorted(sizes, key=lambda r: r[part]):
        offsets.append((r[part], b, n))
        b, n = b + r.b, n + r.n
    spark = rows.sparkSession
    # One row for each range, of which there are at most a few times MAX_RANGES.
    starts = F.broadcast(spark.createDataFrame(offsets, f"`{part}` long, `{before}` long, `{above}` long"))
    in_order = Window.partitionBy(part).orderBy(_number(F.col(key)), _number(F.col(tie)))
    out = placed.join(starts, part).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (F.col(above) + F.row_number().over(in_order) - 1).alias(place),
        F.least(F.lit(shards - 1), F.floor(shards * (
            F.col(before) + F.sum(bytes_).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
            - F.col(bytes_) / 2) / max(total, 1))).cast("int").alias("shard"))
    out = stored(out, "shards")
    firsts = out.groupBy("shard").agg(F.min(place).alias(start))
    joined = out.join(F.broadcast(firsts), "shard")  # as many rows as shards
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", (F.col(place) - F.col(start)).alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write a sharded table as one folder per shard, each in the order of its slots, in files of bounded size."""
    blocks = F.floor(F.col("slot") / 100_000)
    (placed.repartition(F.col("shard"), blocks).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
