"""Near-duplicate vectors by random hyperplanes: every vector of a bucket meets every other.

In a pass every vector gets the signs of its projections on random directions as one number. Two kinds of pass use it.

Gathering passes sort the table by 64 signs and fold tight groups: going down the order, a vector within ``BALL`` of one
of the last few heads joins that head's ball. ``BALL`` is half the angle of the limit, so any two members of a ball are
linked without being compared, and members equal to their head are represented by it.

Bucket passes deal everything else, heads and members alike, into buckets by the first signs. All pairs of a bucket
are compared, however many the bucket holds: it is cut into blocks, and a cell holds two of them. A pair
counts in the first pass that has it in one bucket, so links are counted without being listed. A ball that fills more
than a block of a bucket does not meet itself there.

The number of signs follows from the number of vectors, that of passes from the signs: two vectors share a bucket
with a chance that depends on their angle alone, and a pair at the limit does in some pass with a chance of ``RECALL``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.components import components
from scorelake.llm.storage import removed, stored

#: Vectors a bucket holds on the average, at most, of a table spread evenly.
BUCKET = 512
RECALL = 0.9995
GATHERINGS = 4
HEADS_LOOKED_AT = 16
PASSES_AT_ONCE = 8
#: Vectors of a block, and of one of a bucket that would have more than MANY_BLOCKS of them.
BLOCK = 512
LARGE_BLOCK = 1024
MANY_BLOCKS = 8
SEED = 101

UNITS = "row long, vec_id long, dim int, unit binary"
ITEMS = "row long, dim int, head long, weight long, unit binary, buckets array<int>"
CELL = ["pass", "dim", "bucket", "side", "other"]


def _units(batches):
    """Unit vectors in double precision; null for vectors that link with nothing."""
    for batch in batches:
        rows, ids, vectors = batch.columns
        dims, units = [], []
        for v in vectors.to_pylist():
            x = None if not v or None in v else np.array(v, float)
            if x is not None and np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                units.append((x / np.sqrt((x * x).sum())).tobytes())
                dims.append(len(v))
            else:
                units.append(None)
                dims.append(None)
        yield pa.RecordBatch.from_arrays([rows, ids, pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                                         ["row", "vec_id", "dim", "unit"])


def planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng((SEED, number, dim)).standard_normal((dim, 64))


def signs(x: np.ndarray, number: int) -> np.ndarray:
    """Signs of 64 projections of each row, the first as the highest bit."""
    bits = np.packbits(x @ planes(number, x.shape[1]) > 0, axis=1)
    return bits.view(">u8").ravel().astype(np.uint64).view(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), dim)


def _keyed(numbers: list[int]):
    """Every vector once for each pass, with its key there."""
    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(3), int(dim))
                for number in numbers:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), number, np.int32)), pa.array(signs(x, number)), *part.columns],
                        ["pass", "key", "row", "dim", "mark", "unit"])
    return run


def _sorted(heads: DataFrame, numbers: list[int]) -> DataFrame:
    """``heads`` (row, dim, mark, unit) in the order of each pass, over ranges."""
    keyed = heads.mapInArrow(_keyed(numbers), "pass int, key long, row long, dim int, mark double, unit binary")
    order = ["pass", "dim", "key", "row"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "dim", "row", "mark", "unit")


def _gathered(least: float):
    """(row, head, equal) of vectors that join a ball; ``mark`` is positive for heads that have members already."""
    def run(batches):
        where, heads, units, raw = None, [], [], []
        for batch in batches:
            out = []
            for number, dim, row, mark, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if where != (number, dim):
                    where, heads, units, raw = (number, dim), [], [], []
                x = np.frombuffer(unit)
                if units and mark == 0:
                    if unit in raw:
                        out.append((row, heads[raw.index(unit)], True))
                        continue
                    cosine = np.stack(units) @ x
                    best = int(cosine.argmax())
                    if cosine[best] >= least:
                        out.append((row, heads[best], False))
                        continue
                heads, units, raw = ([*held[1 - HEADS_LOOKED_AT:], new] for held, new in ((heads, row), (units, x), (raw, unit)))
            r, h, e = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(h, pa.int64()), pa.array(e, pa.bool_())],
                                             ["row", "head", "equal"])
    return run


def _bucketed(numbers: list[int], bits: int):
    """Every vector with its bucket, the first ``bits`` signs, in each pass."""
    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(4), int(dim))
                keys = np.zeros((len(x), len(numbers)), np.int32)
                for i, number in enumerate(numbers if bits else []):
                    keys[:, i] = signs(x, number).view(np.uint64) >> np.uint64(64 - bits)
                edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(numbers))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(edges, pa.array(keys.ravel()))],
                                                 [c.split()[0] for c in ITEMS.split(", ")])
    return run


def _in_cells(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Vectors of a bucket dealt over cells of two blocks, or of one with itself: every pair of the bucket meets in one
    cell, except for the pairs of its main ball.

    The main ball fills the blocks 0, 1, ... and the rest the blocks -1, -2, ...; a cell (side, other) holds a block of
    the rest and one other block of either kind.
    """
    in_main = F.coalesce(F.col("head") == F.col("main"), F.lit(False))
    spots = F.when(in_main, F.col("main_spots")).otherwise(F.col("rest_spots"))
    dealt = entries.join(sizes, ["pass", "dim", "bucket"])
    dealt = dealt.withColumn("place", F.pmod(F.xxhash64("row", "pass"), spots).cast("int"))
    rest = F.sequence(F.lit(0), F.col("rest_spots") - 1)
    with_main = F.when(F.col("main_spots") > 0, F.sequence(F.lit(0), F.col("main_spots") - 1)).otherwise(F.array().cast("array<int>"))
    cells = F.when(in_main, F.transform(rest, lambda t: F.struct((-1 - t).alias("side"), F.col("place").alias("other")))).otherwise(
        F.concat(F.transform(with_main, lambda m: F.struct((-1 - F.col("place")).alias("side"), m.alias("other"))),
                 F.transform(rest, lambda t: F.struct((-1 - F.least("place", t)).alias("side"), (-1 - F.greatest("place", t)).alias("other")))))
    spot = F.when(in_main, F.col("place")).otherwise(-1 - F.col("place")).alias("spot")
    out = dealt.select("pass", "dim", "bucket", spot, "row", "head", "weight", "unit", "buckets", F.explode(cells).alias("cell"))
    out = out.select("pass", "dim", "bucket", "cell.side", "cell.other", "spot", "row", "head", "weight", "unit", "buckets")
    return out.repartition(*CELL).sortWithinPartitions(*CELL)


def _sizes(entries: DataFrame) -> DataFrame:
    """(pass, dim, bucket, main, main_spots, rest_spots) of every bucket with two vectors to compare; ``main`` is the
    ball with most members there where it fills more than a block."""
    def spots(n):
        return F.ceil(n / F.when(n > BLOCK * MANY_BLOCKS, LARGE_BLOCK).otherwise(BLOCK)).cast("int")

    balls = entries.groupBy("pass", "dim", "bucket", "head").agg(F.count("*").alias("n"))
    found = balls.groupBy("pass", "dim", "bucket").agg(F.max(F.struct("n", "head")).alias("most"), F.sum("n").alias("n"))
    large = F.col("most.n") > BLOCK
    n_main = F.when(large, F.col("most.n")).otherwise(0)
    found = found.where("n > 1").select("pass", "dim", "bucket", F.when(large, F.col("most.head")).alias("main"),
                                        spots(n_main).alias("main_spots"), spots(F.col("n") - n_main).alias("rest_spots"))
    return found.where("rest_spots > 0")


def _whole_cells(batches):
    """Tables of the rows of one cell each, from rows sorted by cell."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        columns = [c.to_numpy() for c in batch.columns[:len(CELL)]]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()]
        for low, high in zip(cut, cut[1:]):
            yield batch.slice(low, high - low)
        held = batch.slice(cut[-1])
    if held is not None:
        yield held


def _least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one reachable over the links i - j."""
    label = np.arange(n)
    while True:
        low, least = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _linked_in_cells(limit: float):
    """(row, n, head, other) of every vector with a link to another ball in a cell: the rows linked that no earlier
    pass had in one bucket with it, its head and one that links lead to."""
    def run(batches):
        for cell in _whole_cells(batches):
            number, dim, _, side, other = (cell.column(i)[0].as_py() for i in range(len(CELL)))
            spot, row, head, weight = (cell.column(i).to_numpy() for i in range(5, 9))
            x = _matrix(cell.column(9), dim)
            buckets = cell.column(10).flatten().to_numpy().reshape(len(x), -1)
            a, b = np.flatnonzero(spot == side), np.flatnonzero(spot == other)
            hit = (x[a] @ x[b].T >= limit) & (head[a][:, None] != head[b][None, :])
            i, j = np.nonzero(np.triu(hit, 1) if side == other else hit)
            i, j = a[i], b[j]
            least = _least_reached(len(x), i, j)
            touched = np.zeros(len(x), bool)
            touched[i] = touched[j] = True
            for earlier in range(number):
                new = buckets[i, earlier] != buckets[j, earlier]
                i, j = i[new], j[new]
            n = np.zeros(len(x), np.int64)
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            yield pa.RecordBatch.from_arrays([pa.array(c[touched]) for c in (row, n, head, head[least])], ["row", "n", "head", "other"])
    return run


def bits_for(n: int) -> int:
    """Signs that name a bucket among ``n`` vectors; none where one bucket holds them all."""
    return min(31, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))))


def passes_for(bits: int, angle: float) -> int:
    """Passes after which a pair at ``angle`` has shared a bucket of ``bits`` signs with a chance of ``RECALL``."""
    together = (1 - angle / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - together))) if together < 1 else 1


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.9) -> DataFrame:
    """row, vec_id, n_links, component_id, kept for every row.

    Two vectors of equal length link when the cosine, in double precision, is at least ``limit``. ``n_links`` counts
    the other rows linked, ``component_id`` is the least id reachable, ``kept`` marks one row of each component: its
    least id, the first such row when an id repeats. Null and zero vectors, and those with a null or non-finite
    component, link with nothing; equal vectors link. A null id counts as larger than all others. ``row`` is
    the row's place (``monotonically_increasing_id``). Other columns are not looked at. Links found are exact; a
    pair at the limit itself is missed with a chance of 1 - ``RECALL``, a nearer one more seldom, however many vectors
    stand around it; up to ``BUCKET`` vectors none is missed. A large group that folds into no ball costs the square of its size.
    """
    angle = math.acos(limit)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    units = stored(rows.mapInArrow(_units, UNITS), "units")
    usable = units.where("unit is not null")

    # Balls: row -> head; heads are rows that joined none.
    least = math.cos(angle / 2 - 1e-6)
    joined_parts = []
    heads = usable.select("row", "dim", F.lit(0.0).alias("mark"), "unit")
    for number in range(GATHERINGS):
        joins = stored(_sorted(heads, [number]).mapInArrow(_gathered(least), "row long, head long, equal boolean"), "joins")
        joined_parts.append(joins)
        full = joins.select(F.col("head").alias("row"), F.lit(1.0).alias("more")).distinct()
        rest = heads.join(joins.select("row"), "row", "left_anti").join(full, "row", "left")
        heads = stored(rest.select("row", "dim", F.greatest("mark", F.coalesce("more", F.lit(0.0))).alias("mark"), "unit"), "heads")
    joins = joined_parts[0]
    for more in joined_parts[1:]:
        joins = joins.union(more)
    balls = joins.groupBy(F.col("head").alias("row")).agg(
        (F.count("*") + 1).alias("size"), (F.count_if("equal") + 1).alias("weight"))
    balls = stored(balls, "balls", narrow=True)

    # What is compared: heads, for themselves and all members equal to them, and every other member.
    items = usable.join(joins.where("not equal").select("row", "head"), "row").select("row", "dim", "head", F.lit(1).cast("long").alias("weight"), "unit")
    items = items.union(heads.join(balls, "row", "left").select("row", "dim", F.col("row").alias("head"), F.coalesce("weight", F.lit(1)), "unit"))
    bits = bits_for(usable.count() - joins.where("equal").count())
    total = passes_for(bits, angle)
    items = stored(items.mapInArrow(_bucketed(list(range(GATHERINGS, GATHERINGS + total)), bits), ITEMS), "items")
    parts = []
    for first in range(0, total, PASSES_AT_ONCE):
        turn = F.array(*[F.struct(F.lit(p).alias("pass"), F.col("buckets")[p].alias("bucket"))
                         for p in range(first, min(first + PASSES_AT_ONCE, total))])
        sizes = stored(_sizes(items.select("dim", "head", F.inline(turn))), "bucket-sizes", narrow=True)
        cells = _in_cells(items.select("*", F.inline(turn)), sizes)
        linked = cells.mapInArrow(_linked_in_cells(limit), "row long, n long, head long, other long")
        linked = stored(linked.groupBy("row", "head").agg(F.sum("n").alias("n"), F.collect_set("other").alias("others")), "linked")
        removed(sizes)
        parts.append(linked)
    linked = parts[0]
    for more in parts[1:]:
        linked = linked.union(more)
    by_row = linked.groupBy("row").agg(F.sum("n").alias("near"))
    roots = components(linked.select(F.col("head").alias("a"), F.explode("others").alias("b")))

    placed = units.select("row", "vec_id").join(joins, "row", "left").select(
        "row", "vec_id", F.coalesce("head", "row").alias("head"), F.when(F.col("equal"), F.col("head")).otherwise(F.col("row")).alias("item"))
    placed = placed.join(balls.select(F.col("row").alias("head"), "size"), "head", "left").join(
        by_row.withColumnRenamed("row", "item"), "item", "left").join(roots.withColumnRenamed("node", "head"), "head", "left")
    n = F.coalesce("size", F.lit(1)) - 1 + F.coalesce("near", F.lit(0))
    placed = stored(placed.select("row", "vec_id", n.cast("long").alias("n_links"), F.coalesce("root", "head").alias("root")), "placed", narrow=True)
    removed(units, heads, balls, items, *joined_parts, *parts)
    head = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")).alias("first")
    firsts = placed.groupBy("root").agg(head)
    return placed.join(firsts, "root").select("row", "vec_id", "n_links", F.col("first.vec_id").alias("component_id"),
                                              (F.col("row") == F.col("first.row")).alias("kept"))
