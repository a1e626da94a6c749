"""Near-duplicate texts by HyperMinHash registers.

Every text is the set of its distinct shingles. A register keeps the least hash value of a bucket of
shingles in 16 bits: the count of leading zeros (6) and the ten bits that follow (Yu and Weber 2017). Four
registers form a band; texts that agree in a band are candidates; candidates whose Jaccard similarity, as
estimated from equal registers less the expected collisions, is within five standard deviations of the
limit are confirmed on their full sets.

Sets of up to 80 shingles use 128 hash rounds of one bucket, sets of at least 64 use 8 rounds of 16 buckets
picked by the leading bits, so that a bucket is seldom empty. Two sets of similarity 0.8 lie both within the
first or both within the second range. With 32 bands of 4 registers such a pair is missed with probability
(1 - 0.8^4)^32 = 5e-8; an estimate below the margin is as rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm.beside import Beside
from scorelake.llm.components import components
from scorelake.llm.storage import removed, settled, stored

REGISTERS, BAND = 128, 4
BANDS = REGISTERS // BAND
MANTISSA = 10
SMALL, LARGE = 80, 64
BUCKET_BITS = 4
ROUNDS = REGISTERS >> BUCKET_BITS
EMPTY = 0xFFFF
#: A block of a bucket holds about so many texts, or fewer whose sets are large.
CELL_ROWS, CELL_SHINGLES = 256, 1 << 16

SIGNATURES = "row long, doc_id long, k1 long, k2 long, n_shingles long, small binary, large binary"


def shingle_sets(words: A.Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; fewer words form one shingle."""
    h = words.hashes(lower=True)
    windows = A.window_hashes(h, size)
    for low, high in zip(words.bounds[:-1], words.bounds[1:]):
        if high - low >= size:
            yield np.unique(windows[low:high - size + 1])
        elif high > low:
            yield A.window_hashes(h[low:high], int(high - low))
        else:
            yield np.empty(0, np.uint64)


def registers(least: np.ndarray, bits: int) -> np.ndarray:
    """Leading zeros and mantissa of the ``bits`` low bits of the least hash values."""
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(bits - exponent, 0, 62)
    part = np.where(least > 0, ((mantissa - 0.5) * (2 << MANTISSA)).astype(np.int64), 0)
    return ((zeros << MANTISSA) | np.clip(part, 0, (1 << MANTISSA) - 1)).astype("<u2")


_SMALL_SEEDS = A.draws(REGISTERS, 11)[:, None]
_LARGE_SEEDS = A.draws(ROUNDS, 12)[:, None]


def small_sketch(shingles: np.ndarray) -> bytes:
    least = A.mix(shingles[None, :] ^ _SMALL_SEEDS).min(axis=1) >> np.uint64(BUCKET_BITS)
    return registers(least, 64 - BUCKET_BITS).tobytes()


def large_sketch(shingles: np.ndarray) -> bytes:
    """Registers in an order that gives a band one register of each of four rounds."""
    drawn = np.sort(A.mix(shingles[None, :] ^ _LARGE_SEEDS), axis=1)
    bucket = (drawn >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(bucket.shape, bool)
    first[:, 1:] = bucket[:, 1:] != bucket[:, :-1]
    row, col = np.nonzero(first)
    out = np.full((ROUNDS, 1 << BUCKET_BITS), EMPTY, "<u2")
    rest = drawn[row, col] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    out[row, bucket[row, col]] = registers(rest, 64 - BUCKET_BITS)
    return out.reshape(ROUNDS // BAND, BAND, -1).transpose(0, 2, 1).tobytes()


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            rows, ids, texts = batch.columns
            keys, counts, small, large = [], [], [], []
            for _, _, data, offsets in A.slices(texts):
                words = A.Words(data, offsets)
                keys.append(np.stack(words.sequence_keys(words.hashes(lower=True)), 1))
                for s in shingle_sets(words, size):
                    counts.append(len(s))
                    small.append(small_sketch(s) if 0 < len(s) <= SMALL else None)
                    large.append(large_sketch(s) if len(s) >= LARGE else None)
            k = np.concatenate(keys) if keys else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [rows, ids, pa.array(A.signed(k[:, 0])), pa.array(A.signed(k[:, 1])),
                 pa.array(counts, pa.int64()), pa.array(small, pa.binary()), pa.array(large, pa.binary())],
                ["row", "doc_id", "k1", "k2", "n_shingles", "small", "large"])
    return run


def estimated(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, with the collisions of unlike values taken off."""
    used = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & used).sum(axis=-1)
    used = np.maximum(used.sum(axis=-1), 1)
    ratio = size_a / size_b
    chance = 0.1691 * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal / used - chance) / (1 - chance), 0, 1)


def margin(limit: float) -> float:
    return limit - 5 * (limit * (1 - limit) / REGISTERS) ** 0.5


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), REGISTERS)


def _likely(limit: float):
    """Keep the pairs whose estimate can reach the limit."""
    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            n = {s: batch.column(f"n_{s}").to_numpy() for s in "ab"}
            near = (100 * np.minimum(n["a"], n["b"]) >= 100 * limit * np.maximum(n["a"], n["b"]) - 1e-6)
            for family in ("small", "large"):
                a, b = (batch.column(f"{family}_{s}").to_pylist() for s in "ab")
                at = [i for i in np.flatnonzero(near) if a[i] is not None and b[i] is not None]
                if at:
                    keep[at] |= estimated(_matrix([a[i] for i in at]), _matrix([b[i] for i in at]),
                                          n["a"][at], n["b"][at]) >= margin(limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])
    return run


def _whole_cells(batches) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut anew, so that rows of one cell are never parted."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        cell = [batch.column(c).to_numpy() for c in ("key", "side", "other")]
        last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cell]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None:
        yield held


def _likely_pairs(batch: pa.RecordBatch, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and j of a cell that belong to unlike components and whose estimate can reach the limit.

    A pair is looked at in the first band it shares only, and in one cell of that bucket only.
    """
    col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side", "other", "spot", "root", "n", "band")}
    regs = _matrix(batch.column("regs").to_pylist())
    bands = np.ascontiguousarray(regs).view("<u8")
    new = np.ones(len(batch), bool)
    new[1:] = np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in ("key", "side", "other")])
    cell = np.cumsum(new)
    own = col["side"] == -1 - col["other"]  # a block of the rest against itself
    first, second = [], []
    for d in range(1, len(batch)):
        i = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(i):
            break
        j = i + d
        ok = (col["root"][i] != col["root"][j]) & (own[i] | (col["spot"][i] != col["spot"][j]))
        ok &= np.minimum(col["n"][i], col["n"][j]) >= limit * np.maximum(col["n"][i], col["n"][j]) - 1e-9
        i, j = i[ok], j[ok]
        if len(i):
            ok = (bands[i] == bands[j]).argmax(axis=1) == col["band"][i]
            i, j = i[ok], j[ok]
            ok = estimated(regs[i], regs[j], col["n"][i], col["n"][j]) >= margin(limit)
            first.append(i[ok]), second.append(j[ok])
    none = np.empty(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def _open_members(limit: float):
    """(key, row) of cell members that have a likely partner of another component there."""
    def run(batches):
        for batch in _whole_cells(batches):
            at = np.unique(np.concatenate(_likely_pairs(batch, limit)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("key", "row")], ["key", "row"])
    return run


def _linked_in_cells(limit: float):
    """Links inside cells that join unlike components, no more than join them."""
    def run(batches):
        for batch in _whole_cells(batches):
            rows, roots = batch.column("row").to_numpy(), batch.column("root").to_numpy()
            sets = batch.column("shingles")
            joined: dict[int, int] = {}

            def root(r):
                while r in joined:
                    r = joined[r]
                return r

            found = []
            for i, j in zip(*_likely_pairs(batch, limit)):
                r, s = root(int(roots[i])), root(int(roots[j]))
                if r != s and similar(*(np.frombuffer(sets[int(k)].as_buffer(), "<u8") for k in (i, j)), limit):
                    joined[max(r, s)] = min(r, s)
                    found.append((rows[i], rows[j]))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def similar(s: np.ndarray, t: np.ndarray, limit: float) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= 100 * limit * (len(s) + len(t) - both) - 1e-6


def _sets(size: int):
    """(row, shingles) of every row that is asked for."""
    def work(batch, _):
        for low, high, data, offsets in A.slices(batch.column(1)):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(A.Words(data, offsets), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(sets, pa.binary())], ["row", "shingles"])
    return work


def _texts(batch, _):
    yield batch


def _confirmed(size: int, limit: float):
    """Pairs whose full sets are alike enough."""
    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), CELL_ROWS):
                batch = whole.slice(at, CELL_ROWS)
                sets = []
                for side in ("text_a", "text_b"):
                    own = []
                    for _, _, data, offsets in A.slices(batch.column(side)):
                        own += shingle_sets(A.Words(data, offsets), size)
                    sets.append(own)
                keep = pa.array([similar(s, t, limit) for s, t in zip(*sets)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], ["a", "b"])
    return run


def _band_keys(heads: DataFrame) -> DataFrame:
    """One row (key, band, row) for each band of each text; the bands of the second kind of sketch come after the first's."""
    def keys(family: str, first: int):
        col = F.col(family)
        bands = [F.struct(F.xxhash64(F.lit(first + b), F.substring(col, 2 * BAND * b + 1, 2 * BAND)).alias("key"),
                          F.lit(first + b).cast("short").alias("band")) for b in range(BANDS)]
        return heads.where(col.isNotNull()).select("row", F.explode(F.array(*bands)).alias("b")).select("b.key", "b.band", "row")
    return keys("small", 0).union(keys("large", BANDS))


def _in_cells(entries: DataFrame, weight) -> DataFrame:
    """Bucket members (key, row, in_main and more) dealt over cells (key, side, other) of bounded weight.

    A bucket's largest component fills the blocks 0, 1, ... and the rest of it the blocks -1, -2, ...; a cell holds a
    block of the rest and one other block of either kind, so members of the largest component never meet.
    """
    mine = F.sum(F.when(F.col("in_main"), weight)), F.sum(F.when(~F.col("in_main"), weight))
    counts = entries.groupBy("key").agg(*[F.coalesce(F.ceil(m), F.lit(0)).cast("int").alias(c) for m, c in zip(mine, ("main_spots", "rest_spots"))])
    spot = F.pmod(F.xxhash64("row"), F.when(F.col("in_main"), F.col("main_spots")).otherwise(F.col("rest_spots"))).cast("int")
    dealt = entries.join(counts.where("rest_spots > 0"), "key").withColumn("place", spot)
    rest = F.sequence(F.lit(0), F.col("rest_spots") - 1)
    with_main = F.when(F.col("main_spots") > 0, F.sequence(F.lit(0), F.col("main_spots") - 1)).otherwise(F.array().cast("array<int>"))
    cells = F.when(F.col("in_main"), F.transform(rest, lambda t: F.struct(t.alias("side"), F.col("place").alias("other")))).otherwise(
        F.concat(F.transform(with_main, lambda m: F.struct(F.col("place").alias("side"), m.alias("other"))),
                 F.transform(rest, lambda t: F.struct(F.least("place", t).alias("side"), (-1 - F.greatest("place", t)).alias("other")))))
    out = dealt.select(*[c for c in entries.columns if c != "in_main"], F.explode(cells).alias("cell"),
                       F.when(F.col("in_main"), F.col("place")).otherwise(-1 - F.col("place")).alias("spot"))
    out = out.select("cell.side", "cell.other", *[c for c in out.columns if c != "cell"])
    return out.repartition("key", "side", "other").sortWithinPartitions("key", "side", "other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    limit: float = 0.8) -> DataFrame:
    """Row, doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Texts link when the Jaccard similarity of their sets of ``size``-word shingles (A-Z lower-cased) is at
    least ``limit``. ``component_id`` is the least id reachable by links and ``kept`` marks one row of each
    component: its least id, the first such row when an id repeats. ``row`` is the row's place
    (``monotonically_increasing_id`` over ``docs``), which tells repeated ids apart.

    Null, empty and blank texts have an empty set and link with nothing, not even each other. A null id counts
    as larger than all others: its component takes another member's id, or null with none. Equal word
    sequences are first folded into one class, so a thousand copies cost one comparison. Other columns of
    ``docs`` are not looked at. An empty table gives an empty result.

    Candidates come from bands in two steps that never pair up a whole bucket. First each member is compared
    with the member of its bucket that shares most bands with others, the likeliest centre of a group. What that
    leaves apart is settled in buckets that still hold unlike components: there blocks of members meet, those of
    the bucket's largest component never each other: first by registers, which leaves the members with a likely partner,
    then these by their full sets, and only links that join components come out.
    """
    docs = settled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    texts = rows.select("row", "text")
    sketches = stored(rows.mapInArrow(_signatures(size), SIGNATURES), "sketches")
    full = sketches.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2").agg(F.min("row").alias("class"))
    placed = full.select("row", "doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"]).drop("k1", "k2")
    placed = stored(placed.union(sketches.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row"))), "classes", narrow=True)
    # Of each class only the first text is compared.
    heads = sketches.join(placed.where("row = class and n_shingles > 0").select("row"), "row", "left_semi")
    heads = stored(heads.select("row", "n_shingles", "small", "large"), "heads")
    removed(sketches)

    bands = _band_keys(heads)
    sizes = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = stored(bands.join(sizes, "key"), "buckets")
    degrees = members.groupBy("row").agg(F.sum("members").alias("degree"))
    leads = members.join(degrees, "row").groupBy("key").agg(F.max_by("row", "degree").alias("lead"))
    first = members.join(leads, "key").where("row <> lead").select(F.least("row", "lead").alias("a"), F.greatest("row", "lead").alias("b")).distinct()
    # Only what shares a bucket needs its registers from here on.
    near = stored(heads.join(degrees.select("row"), "row", "left_semi"), "near-heads")
    removed(heads)
    sides = {s: near.select(F.col("row").alias(s), F.col("n_shingles").alias(f"n_{s}"),
                            F.col("small").alias(f"small_{s}"), F.col("large").alias(f"large_{s}")) for s in "ab"}
    pairs = stored(first.join(sides["a"], "a").join(sides["b"], "b").mapInArrow(_likely(limit), "a long, b long"), "pairs", narrow=True)
    asked = Beside(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "asked")
    used = stored(asked.mapped(texts, _texts, "row long, text string"), "pair-texts")
    both = pairs.join(used.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(used.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    links = stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(size, limit), "a long, b long"), "links")
    removed(pairs, used)
    roots = components(links)

    rooted = members.join(roots, members.row == roots.node, "left").select("key", "band", "row", F.coalesce("root", "row").alias("root"))
    per_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = per_root.groupBy("key").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots")).where("roots > 1")
    open_rows = stored(rooted.join(mixed, "key").select("key", "band", "row", "root", (F.col("root") == F.col("main")).alias("in_main")), "open-rows")
    removed(members)
    regs = F.when(F.col("band") < BANDS, F.col("small")).otherwise(F.col("large")).alias("regs")
    detail = open_rows.join(near, "row").select("key", F.pmod("band", F.lit(BANDS)).alias("band"), "row", "root", "in_main",
                                                F.col("n_shingles").cast("double").alias("n"), regs)
    flagged = _in_cells(detail, F.lit(1 / CELL_ROWS)).mapInArrow(_open_members(limit), "key long, row long").distinct()
    flagged = stored(flagged, "open-members", narrow=True)
    # Only what has a likely partner left is compared by its full set.
    asked = Beside(flagged.select("row").distinct(), "asked")
    sets = stored(asked.mapped(texts, _sets(size), "row long, shingles binary"), "sets")
    full_detail = detail.join(flagged, ["key", "row"], "left_semi").join(sets, "row")
    cells = _in_cells(full_detail, F.greatest(F.col("n") / CELL_SHINGLES, F.lit(1 / CELL_ROWS)))
    more = stored(cells.mapInArrow(_linked_in_cells(limit), "a long, b long"), "more-links")
    roots_all = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    removed(open_rows, flagged, sets, near, links, more)

    joined = placed.join(roots_all, placed["class"] == roots_all.node, "left")
    joined = stored(joined.select("row", "doc_id", "n_shingles", F.coalesce("root", "class").alias("root")), "members", narrow=True)
    removed(placed)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")
    heads_of = joined.groupBy("root").agg(head)
    return joined.join(heads_of, "root").select("row", "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"),
                                                (F.col("row") == F.col("head.row")).alias("kept"))
