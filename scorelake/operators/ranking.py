"""Ranks, first rows, samples and batches that stay exact and spread out under a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.draws import SEED, draw
from scorelake.session import durable


#: Low bits of ``monotonically_increasing_id``: a row's place in its partition.
PLACE_BITS = 33


def joined_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which a null key meets a null key; the keys are the left side's."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on]
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def with_row_index(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "row_index"
) -> DataFrame:
    """Number rows 0, 1, 2 … in order, per group when ``by`` is given; a null key is a group like any other.

    A plain ``row_number`` sends a whole group to one task. Here rows are range-partitioned on
    (group, order), so that a hot group covers many partitions, and sorted there; a row's place in its
    partition, less the place of its group's first row there, plus the group's rows in earlier partitions is its
    number. Rows are shuffled once; what is counted has one row per (group, partition). The sorted table is stored
    first: range bounds come from sampling and must not move between counting and numbering.
    The order must be total.
    """
    groups = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    staged = durable(ranged.withColumn("_seq", F.monotonically_increasing_id()))
    staged = staged.withColumn("_part", F.shiftright("_seq", PLACE_BITS)).withColumn(
        "_seq", F.col("_seq").bitwiseAND((1 << PLACE_BITS) - 1)
    )
    sizes = staged.groupBy(*by, "_part").agg(F.count("*").alias("_size"), F.min("_seq").alias("_first"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_size").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift")
    numbered = joined_null_safe(staged, sizes.select(*by, "_part", shift), [*by, "_part"])
    return numbered.withColumn(name, F.col("_shift") + F.col("_seq")).drop("_seq", "_part", "_shift")


def in_batches(
    df: DataFrame, size: int, order: Sequence[Column], by: Sequence[str] = (), name: str = "batch"
) -> DataFrame:
    """Sort within groups and cut into batches of ``size`` rows. The original order is a sort by id away."""
    indexed = with_row_index(df, order, by, "batch_row")
    return indexed.withColumn(name, F.floor(F.col("batch_row") / size))


def divided(df: DataFrame, parts: int, order: Sequence[Column], name: str = "part") -> DataFrame:
    """Cut into ``parts`` runs of near-equal length, the first ones a row longer."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    indexed = with_row_index(df, order, name="_row")
    total = indexed.agg(F.count("*")).scalar()
    short = F.floor(total / parts)
    extra = total % parts
    in_long = F.col("_row") < extra * (short + 1)
    place = F.when(in_long, F.floor(F.col("_row") / (short + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("_row") - extra * (short + 1), short))
    )
    return indexed.withColumn(name, place.cast("bigint") + 1).drop("_row")


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The first k rows per group. Spark keeps only k rows per group and task before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def latest(df: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """The row with the greatest order value per key, as a mergeable aggregate."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*by, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def first_lines(lines: DataFrame, limit: int, counted: Column | None = None) -> DataFrame:
    """The first ``limit`` counted lines of every file, in file order.

    Expects the columns ``file``, ``block`` and ``line`` of
    :func:`scorelake.sources.logs.read_lines`. Numbering happens inside a file split, whose size Spark
    bounds, and per-split totals are summed over the splits of a file; no file passes through one task.
    Lines that do not count (``counted`` false) are kept while the limit is not yet reached.
    """
    counted = F.lit(True) if counted is None else counted
    flagged = lines.withColumn("_n", counted.cast("int"))
    sizes = flagged.groupBy("file", "block").agg(F.sum("_n").alias("_size"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    needed = offsets.filter(F.col("_offset") < limit).drop("_size")
    inside = Window.partitionBy("file", "block").orderBy("line")
    running = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        flagged.join(needed, ["file", "block"])
        .withColumn("_seen", running + F.col("_offset"))
        .filter((F.col("_seen") < limit) | ((F.col("_seen") == limit) & (F.col("_n") == 1)))
        .drop("_n", "_offset", "_seen")
    )


def cut_offs(
    df: DataFrame, wanted: dict[str, int | Column], key: str, seed: int = SEED, by: Sequence[str] = (), bits: int = 12
) -> DataFrame:
    """Per group, the (draw, key) of the n-th row in the order of the draw, for every n of ``wanted``.

    One column per name; null where the group has fewer rows or n is not positive. Groups are counted per bucket
    of the draw, its leading ``bits``; the keys of the buckets in which an n-th row lies are stored, counted again
    by the next ``bits``, and only those of one small bucket are ranked. Two scans of (group, key).
    """
    keys = df.select(*by, F.col(key).alias("_key"), draw(F.col(key), 0, seed).alias("_draw"))
    keys = keys.withColumn("_bucket", F.shiftright("_draw", 32 - bits))
    names = F.array(*[F.struct(F.lit(n).alias("_name"), (F.lit(w) if isinstance(w, int) else w).cast("bigint").alias("_n"))
                      for n, w in wanted.items()])

    def crossing(rows: DataFrame, group: Sequence[str], bucket: str, need: Column) -> DataFrame:
        """The bucket of each group in which its ``need``-th row lies, and how far in."""
        sizes = rows.groupBy(*group, bucket).agg(F.count("*").alias("_size"), F.first(need).alias("_need"))
        ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.withColumn("_need", F.col("_need") - F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
        return before.filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_size"))).select(*group, bucket, "_need")

    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keys.groupBy(*by, "_bucket").agg(F.count("*").alias("_size")).withColumn(
        "_before", F.coalesce(F.sum("_size").over(ahead), F.lit(0))
    )
    coarse = sizes.select("*", F.explode(names).alias("_w")).select(
        *by, "_bucket", "_size", F.col("_w._name").alias("_name"), (F.col("_w._n") - F.col("_before")).alias("_need")
    ).filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_size"))).drop("_size")
    group = [*by, "_name"]
    inside = durable(joined_null_safe(keys, coarse, [*by, "_bucket"]))
    inside = inside.withColumn("_fine", F.shiftright("_draw", 32 - 2 * bits).bitwiseAND((1 << bits) - 1))
    fine = crossing(inside, group, "_fine", F.col("_need"))
    last = joined_null_safe(inside.drop("_need"), fine, [*group, "_fine"])
    order = Window.partitionBy(*group).orderBy("_draw", "_key")
    cut = last.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == F.col("_need"))
    return cut.groupBy(*by).agg(*[
        F.max(F.when(F.col("_name") == n, F.struct("_draw", "_key"))).alias(n) for n in wanted
    ])


def mark_sample(
    df: DataFrame,
    n: int | Column,
    key: str,
    seed: int = SEED,
    by: Sequence[str] = (),
    name: str = "taken",
) -> DataFrame:
    """Mark exactly n rows per group, chosen by the draw of a unique whole-number key.

    Full rows are read once and never shuffled: each is compared with the cut-off of its group, a table of one
    row per group. A null group key is a group like any other.
    """
    return marked_below(df, {name: n}, key, seed, by)


def marked_below(
    df: DataFrame, wanted: dict[str, int | Column], key: str, seed: int = SEED, by: Sequence[str] = ()
) -> DataFrame:
    """A column per name that marks the first n rows of each group in one random order."""
    cut = cut_offs(df, wanted, key, seed, by).withColumnsRenamed({n: f"_cut_{n}" for n in wanted})
    at = F.struct(draw(F.col(key), 0, seed).alias("_draw"), F.col(key).alias("_key"))
    joined = joined_null_safe(df, cut, by, "left") if by else df.join(F.broadcast(cut.agg(*[
        F.first(f"_cut_{n}").alias(f"_cut_{n}") for n in wanted])))  # one row
    marks = {n: F.coalesce(at <= F.col(f"_cut_{n}"), (F.lit(w) if isinstance(w, int) else w) > 0) for n, w in wanted.items()}
    return joined.withColumns(marks).drop(*[f"_cut_{n}" for n in wanted])


def sample_rows(df: DataFrame, n: int | Column, key: str, seed: int = SEED, by: Sequence[str] = ()) -> DataFrame:
    """Exactly n rows (all, if there are fewer) per group."""
    return mark_sample(df, n, key, seed, by).filter("taken").drop("taken")


def limit_size(total: Column, limit: float | None) -> Column:
    """Rows a limit stands for: a count, or below 1 a share rounded up."""
    if limit is None:
        return total.cast("bigint")
    if limit < 1.0:
        return F.ceil(total * F.lit(float(limit)))
    return F.lit(int(limit)).cast("bigint")


def rank_shard(doc_id: Column, rank: int, world: int, limit: int | None = None) -> Column:
    """Documents of one rank: every ``world``-th one from ``rank`` on, below a limit that holds before striding."""
    mine = (doc_id >= rank) & (F.pmod(doc_id - rank, F.lit(world)) == 0)
    return mine if limit is None else mine & (doc_id < limit)
