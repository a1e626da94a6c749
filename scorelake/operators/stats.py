"""Corpus statistics, standard errors and group scores."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.draws import SEED, key_state
from scorelake.functions.weights import add_picked, add_resampled
from scorelake.operators.ranking import joined_null_safe
from scorelake.session import durable, release

# ---- aggregates of one column ----


def perplexity(loglikelihood: Column) -> Column:
    return F.exp(-F.avg(loglikelihood))


def weighted_perplexity(loglikelihood: Column, weight: Column) -> Column:
    return F.exp(-F.sum(loglikelihood) / F.sum(weight))


def bits_per_byte(loglikelihood: Column, byte_count: Column) -> Column:
    return -F.sum(loglikelihood) / F.sum(byte_count) / math.log(2)


def bypass() -> Column:
    """Stands in for a metric that is only predicted, not scored."""
    return F.max(F.lit(999))


def mean_stderr(value: Column) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def success_mean(value: Column, success: Column) -> Column:
    return F.avg(F.when(success, value))


def confusion(gold: Column, pred: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((gold == 1) & (pred == 1)),
        "fp": F.count_if((gold != 1) & (pred == 1)),
        "fn": F.count_if((gold == 1) & (pred != 1)),
        "tn": F.count_if((gold != 1) & (pred != 1)),
    }


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2.0 * tp + fp + fn)


def mcc_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def f1_score(gold: Column, pred: Column) -> Column:
    c = confusion(gold, pred)
    return f1_of(c["tp"], c["fp"], c["fn"])


def matthews_corrcoef(gold: Column, pred: Column) -> Column:
    return mcc_of(**confusion(gold, pred))


# ---- order-dependent and two-level aggregates ----


def middle_in_order(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The value at place n // 2 in the given order, which is not a median unless the order sorts it. Rows alike in the
    order follow by value."""
    whole = df.select(*by, value, *[c for c in order if c not in (*by, value)])
    found = nth_in_order(whole, value, order, by, lambda n: F.floor(n / 2).cast("bigint"))
    return found.withColumnRenamed("_value", "median")


#: Rows of a group that are ranked at once; larger groups are narrowed down first.
RANKED_ROWS = 200_000
#: Keys of a group that its bounds are taken from, and how far on either side of the place sought, in deviations.
SAMPLED_KEYS, BOUND_DEVIATIONS = 4096, 4.0


def nth_in_order(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], place: Callable[[Column], Column]) -> DataFrame:
    """``by`` and ``_value``: the value at ``place`` (from 0, given a group's size) in the order of ``order``, nulls first.

    Nothing is sorted as a whole. In each round a sample of a large group's keys gives two bounds that very likely enclose the
    place; the rows below, between and above them are counted, which tells for certain where it lies, and only those rows go
    on, about a sixteenth. Groups that are small, or have become so, are ranked. A group with a third of all rows is counted and
    filtered in the tasks that read it; what meets in one task is a sample, or at most ``RANKED_ROWS`` rows.
    """
    group = list(by) or ["_all"]
    live = df.select(*by, *([] if by else [F.lit(0).alias("_all")]), F.struct(*order, F.col(value).alias("_value")).alias("_k"))
    state = durable(live.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("_t", place(F.col("_n"))))
    ranked, settled, turn = [], [], 0
    while True:
        sizes = state.agg(F.min("_n"), F.max("_n")).first()
        if sizes[0] is None:
            break
        if sizes[0] <= RANKED_ROWS:
            ranked.append(joined_null_safe(live, state.where(F.col("_n") <= RANKED_ROWS), group))
        if sizes[1] <= RANKED_ROWS:
            break
        large = joined_null_safe(live, state.where(F.col("_n") > RANKED_ROWS), group)
        drawn = large.where(F.rand(SEED + turn) * F.col("_n") < SAMPLED_KEYS).groupBy(*group, "_n", "_t").agg(F.array_sort(F.collect_list("_k")).alias("_s"))
        size = F.size("_s")
        at, share = F.col("_t") * size / F.col("_n"), F.col("_t") / F.col("_n")
        reach = F.least(BOUND_DEVIATIONS * F.sqrt(size * share * (1 - share)) + 1, size / 4)
        low, high = F.greatest(F.lit(0), F.floor(at - reach)).cast("int"), F.least(size - 1, F.ceil(at + reach)).cast("int")
        # A group that gave no sample stays as it is and is drawn from again.
        bounds = durable(state.where(F.col("_n") > RANKED_ROWS).select(*group, "_t").transform(
            lambda s: joined_null_safe(s, drawn.select(*group, F.get("_s", low).alias("_low"), F.get("_s", high).alias("_high")), group, "left")))
        part = F.when(F.col("_low").isNull(), 1).when(F.col("_k") < F.col("_low"), 0).when(F.col("_k") <= F.col("_high"), 1).otherwise(2)
        placed = joined_null_safe(live, bounds, group).withColumn("_part", part)
        counts = placed.groupBy(*group, "_t", "_low", "_high").agg(*[F.count_if(F.col("_part") == i).alias(f"_c{i}") for i in range(3)])
        held = F.when(F.col("_t") < F.col("_c0"), 0).when(F.col("_t") < F.col("_c0") + F.col("_c1"), 1).otherwise(2)
        counted = counts.withColumn("_held", held)
        before = F.when(F.col("_held") == 0, 0).when(F.col("_held") == 1, F.col("_c0")).otherwise(F.col("_c0") + F.col("_c1"))
        rows = F.when(F.col("_held") == 0, F.col("_c0")).when(F.col("_held") == 1, F.col("_c1")).otherwise(F.col("_c2"))
        one = (F.col("_held") == 1) & (F.col("_low") == F.col("_high"))  # all that is left is one key
        told = durable(counted.select(*group, F.col("_held"), (F.col("_t") - before).alias("_t"), rows.alias("_n"), F.coalesce(one, F.lit(False)).alias("_one"), F.col("_low")))
        settled.append(told.where("_one").select(*group, F.col("_low._value").alias("_value")))
        state = told.where("not _one").select(*group, "_n", "_t")
        going = joined_null_safe(placed.select(*group, "_k", "_part"), told.where("not _one").select(*group, "_held"), group)
        live = durable(going.where("_part = _held").select(*group, "_k"))
        turn += 1
    row = F.row_number().over(Window.partitionBy(*group).orderBy("_k")) - 1
    found = [r.withColumn("_row", row).where("_row = _t").select(*group, F.col("_k._value").alias("_value")) for r in ranked] + settled
    if not found:
        return df.limit(0).select(*by, F.col(value).alias("_value"))
    return functools.reduce(DataFrame.unionByName, found).select(*by, "_value")


def all_right(df: DataFrame, correct: Column, by: Sequence[str], stderr_by: Sequence[str]) -> DataFrame:
    """Share of questions whose every answer is right, and a standard error that groups by
    ``stderr_by`` only."""
    flagged = df.withColumn("_ok", correct.cast("int"))
    score = flagged.groupBy(*by).agg(F.min("_ok").alias("_ok")).agg(F.avg("_ok").alias("acc_all"))
    error = flagged.groupBy(*stderr_by).agg(F.min("_ok").alias("_ok")).agg(
        mean_stderr(F.col("_ok").cast("double")).alias("acc_all_stderr")
    )
    return score.withColumn("acc_all_stderr", error.scalar())


# ---- bootstrap ----


#: Bytes of resampled sums a task holds before it gives them out.
HELD_SUMS = 256 << 20
#: Rounds of a group that leave a task in one batch.
ROUNDS_OUT = 10_000


def _resampled_sums(groups: int, names: list[str], iterations: int):
    """Rows (group columns, state, totals) to (group columns, iteration, resampled, totals), summed over a task.

    The weights of a block of rows and rounds are a matrix, and its product with the totals their sums.
    """
    def run(batches):
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        most = max(1, HELD_SUMS // (8 * iterations * (len(names) + 1)))

        def out():
            for key, (sums, seen) in held.items():
                for low in range(0, iterations, ROUNDS_OUT):
                    part = sums[low:low + ROUNDS_OUT]
                    n = len(part)
                    totals = [pa.array(part[:, i]) if seen[i] else pa.nulls(n, pa.float64()) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.repeat(k, n) for k in key], pa.array(np.arange(low, low + n)), pa.array(part[:, -1]), *totals],
                        [*[f"g{i}" for i in range(groups)], "iteration", "resampled", *names])
            held.clear()

        for batch in batches:
            columns = batch.columns
            state = columns[groups].to_numpy(zero_copy_only=False).astype(np.uint32)
            values = np.ones((len(batch), len(names) + 1))
            for i, column in enumerate(columns[groups + 1:]):
                values[:, i] = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            known = np.array([column.is_valid().to_numpy(zero_copy_only=False) for column in columns[groups + 1:]]).reshape(len(names), -1)
            places: dict[tuple, list[int]] = {}
            scalars: dict[tuple, tuple] = {}
            for i, plain in enumerate(zip(*[c.to_pylist() for c in columns[:groups]]) if groups else [()] * len(batch)):
                places.setdefault(plain, []).append(i)
                if plain not in scalars:
                    scalars[plain] = tuple(c[i] for c in columns[:groups])
            for plain, rows in places.items():
                key = scalars[plain]
                if key not in held:
                    if len(held) >= most:
                        yield from out()
                    held[key] = np.zeros((iterations, len(names) + 1)), np.zeros(len(names), bool)
                sums, seen = held[key]
                add_resampled(sums, state[rows], values[rows])
                seen |= known[:, rows].any(axis=1)
        yield from out()
    return run


def bootstrap_totals(
    df: DataFrame, totals: dict[str, Column], key: str, iterations: int, by: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """Resampled sums, one row per group and iteration in which a row was drawn.

    Every row gets a Poisson(1) weight per iteration, which in place of drawing n of n rows needs no
    global view: rows never move, and what is shuffled is one partial sum per task, group and iteration. Weights
    depend on the key and the iteration alone. A task holds a few groups' sums and gives them out when there are more.
    A missing total counts as 0 beside known ones; a group that knows none has none.
    """
    names = list(totals)
    rows = df.select(*by, key_state(F.col(key), seed).alias("_state"), *[c.cast("double").alias(n) for n, c in totals.items()])
    kinds = [f"g{i} {rows.schema[n].dataType.simpleString()}" for i, n in enumerate(by)]
    schema = ", ".join([*kinds, "iteration long, resampled double", *[f"`{n}` double" for n in names]])
    sums = rows.mapInArrow(_resampled_sums(len(by), names, iterations), schema).withColumnsRenamed({f"g{i}": n for i, n in enumerate(by)})
    return sums.groupBy(*by, "iteration").agg(
        F.sum("resampled").alias("resampled"), *[F.sum(n).alias(n) for n in names]
    ).where("resampled > 0")


#: Shares that the rows of a large group are dealt over by key, resamples drawn of each, and rows from which a group is large.
SHARES, POOL, POOLED_ROWS = 4096, 4096, 20_000


def _pooled_sums(groups: int, names: list[str], iterations: int, pool: int, seed: int):
    """Rows (group columns, share, state, totals), in order of group and share, to (group columns, iteration, resampled, totals)
    summed over a task. One group's sums and one share's pool are held at a time."""
    def run(batches):
        sums, drawn, seen = np.zeros((iterations, len(names) + 1)), np.zeros((pool, len(names) + 1)), np.zeros(len(names), bool)
        group = share = scalars = None

        def picked():
            # A stream of draws of its own for each share, the same in every task and group.
            add_picked(sums, drawn, zlib.crc32(f"{seed} {share}".encode()))
            drawn.fill(0)

        def out():
            for low in range(0, iterations, ROUNDS_OUT):
                part = sums[low:low + ROUNDS_OUT].copy()
                totals = [pa.array(part[:, i]) if seen[i] else pa.nulls(len(part), pa.float64()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.repeat(k, len(part)) for k in scalars], pa.array(np.arange(low, low + len(part))), pa.array(part[:, -1]), *totals],
                    [*[f"g{i}" for i in range(groups)], "iteration", "resampled", *names])
            sums.fill(0)
            seen.fill(False)

        for batch in batches:
            columns = batch.columns
            shares = columns[groups].to_numpy(zero_copy_only=False)
            state = columns[groups + 1].to_numpy(zero_copy_only=False).astype(np.uint32)
            values = np.ones((len(batch), len(names) + 1))
            for i, column in enumerate(columns[groups + 2:]):
                values[:, i] = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            known = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns[groups + 2:]]).reshape(len(names), -1)
            keys = list(zip(*[c.to_pylist() for c in columns[:groups]])) if groups else [()] * len(batch)
            first = 0
            while first < len(batch):
                last = first + 1
                while last < len(batch) and shares[last] == shares[first] and keys[last] == keys[first]:
                    last += 1
                if scalars is not None and (keys[first], shares[first]) != (group, share):
                    picked()
                    if keys[first] != group:
                        yield from out()
                group, share, scalars = keys[first], shares[first], tuple(c[first] for c in columns[:groups])
                add_resampled(drawn, state[first:last], values[first:last])
                seen |= known[:, first:last].any(axis=1)
                first = last
        if scalars is not None:
            picked()
            yield from out()
    return run


def pooled_totals(
    df: DataFrame, totals: dict[str, Column], key: str, iterations: int, by: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """:func:`bootstrap_totals` for large groups, with rows times ``POOL`` draws in place of rows times iterations.

    The rows of a group are dealt by key over ``SHARES`` shares, and ``POOL`` resamples are drawn of each share, with the weights
    of :func:`bootstrap_totals`. Every iteration resamples all rows: it adds up one of these resamples of each share, picked
    anew. Within an iteration the weights of different keys are independent Poisson(1) draws, as there. Two iterations have the same
    resample of a share in one case of ``POOL``, so deviations over iterations come out low by a share of 1 / (2 * ``POOL``),
    and that of a row which outweighs all others together is known as well as ``POOL`` draws tell it, to about 1.4 %.
    """
    names = list(totals)
    state = key_state(F.col(key), seed)
    rows = df.select(*by, state.alias("_state"), *[c.cast("double").alias(n) for n, c in totals.items()])
    kinds = [f"g{i} {rows.schema[n].dataType.simpleString()}" for i, n in enumerate(by)]
    schema = ", ".join([*kinds, "iteration long, resampled double", *[f"`{n}` double" for n in names]])
    # Work is long for each row, so that tasks follow the cores and not the bytes.
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    dealt = rows.withColumn("_share", F.col("_state") % SHARES).repartition(parts, "_share").sortWithinPartitions(*by, "_share")
    sums = dealt.select(*by, "_share", "_state", *names).mapInArrow(_pooled_sums(len(by), names, iterations, POOL, seed), schema)
    return sums.withColumnsRenamed({f"g{i}": n for i, n in enumerate(by)}).groupBy(*by, "iteration").agg(
        F.sum("resampled").alias("resampled"), *[F.sum(n).alias(n) for n in names]
    ).where("resampled > 0")


# Fixed value: rounds of resampling a standard error takes unless told otherwise.
ROUNDS = 100_000


def _of_groups(df: DataFrame, sizes: DataFrame, by: Sequence[str], test: Column) -> DataFrame:
    """The rows of the groups whose ``_n`` passes the test."""
    held = sizes.where(test)
    return joined_null_safe(df, held.drop("_n"), by) if by else df.crossJoin(F.broadcast(held.select()))


def bootstrap_stderr(
    df: DataFrame,
    totals: dict[str, Column],
    statistic: Column,
    key: str,
    iterations: int = ROUNDS,
    by: Sequence[str] = (),
    seed: int = SEED,
    pooled: bool = False,
) -> DataFrame:
    """Sample deviation of a statistic over resamples; ``statistic`` is computed from the summed
    ``totals`` and ``resampled``. Null with fewer than two rows. The work is rows times rounds, a few nanoseconds each: where
    rows take few distinct values, :func:`bootstrap_cells` does with values times rounds, and with ``pooled`` groups of
    ``POOLED_ROWS`` rows and more do with rows times ``POOL`` (:func:`pooled_totals`). A null group is a group."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    if pooled:
        sizes = durable(sizes)
        large, small = (_of_groups(df, sizes, by, test) for test in (F.col("_n") >= POOLED_ROWS, F.col("_n") < POOLED_ROWS))
        resampled = pooled_totals(large, totals, key, iterations, by, seed).unionByName(bootstrap_totals(small, totals, key, iterations, by, seed))
    else:
        resampled = bootstrap_totals(df, totals, key, iterations, by, seed)
    samples = resampled.withColumn("_value", statistic)
    errors = samples.groupBy(*by).agg(F.stddev_samp("_value").alias("stderr"))
    if by:
        joined = joined_null_safe(errors, sizes, by)
    else:
        joined = errors.withColumn("_n", sizes.scalar())
    return joined.withColumn("stderr", F.when(F.col("_n") > 1, F.col("stderr"))).drop("_n")


#: Rounds one call of the generator draws.
BATCH = 1000
#: Distinct values of a group that :func:`bootstrap_cells` takes.
MAX_CELLS = 4096


def bootstrap_cells(
    df: DataFrame, totals: dict[str, Column], statistic: Column, iterations: int = ROUNDS, by: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """:func:`bootstrap_stderr` for rows of few distinct values of ``totals``, such as the cells of a confusion table.

    Equal rows are counted first. A round that draws n of n rows with replacement then draws one multinomial
    number of each value, so the work is values times rounds, whatever the number of rows. Batches of rounds are
    spread over tasks and draw from a generator seeded by their own number. A group of more than ``MAX_CELLS`` distinct
    values stops the job: such rows are for :func:`bootstrap_stderr`.
    """
    names = list(totals)
    cells = durable(df.select(*by, *[c.cast("double").alias(n) for n, c in totals.items()]).groupBy(*by, *names).agg(F.count("*").alias("_count")))
    widest = cells.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if widest > MAX_CELLS:
        raise ValueError(f"a group takes {widest} distinct values; use bootstrap_stderr")
    listed = F.array_sort(F.collect_list(F.struct(*names, "_count")))
    groups = cells.groupBy(*by).agg(F.sum("_count").alias("_n"), listed.alias("_cells"))
    last = (iterations - 1) // BATCH
    batches = groups.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(last)))).repartition("_batch")
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")

    def drawn(frames):
        for frame in frames:
            out = []
            for n, held, batch, name, key in zip(frame["_n"], frame["_cells"], frame["_batch"], frame["_group"], frame["_row"]):
                counts = np.array([c["_count"] for c in held], float)
                values = np.array([[c[v] for v in names] for c in held])
                rounds = min(BATCH, iterations - batch * BATCH)
                generator = np.random.default_rng([seed, batch, zlib.crc32(name.encode())])
                sums = generator.multinomial(n, counts / counts.sum(), size=rounds) @ values
                out.append(pd.DataFrame(sums, columns=names).assign(_row=key, resampled=float(n)))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*names, "_row", "resampled"])

    keyed = groups.select(*by, group.alias("_row"), "_n")
    work = batches.select("_n", "_cells", "_batch", group.alias("_group"), group.alias("_row"))
    sums = work.mapInPandas(drawn, ", ".join([*[f"`{n}` double" for n in names], "_row string", "resampled double"]))
    errors = sums.withColumn("_value", statistic).groupBy("_row").agg(F.stddev_samp("_value").alias("stderr"))
    return keyed.join(errors, "_row").select(*by, F.when(F.col("_n") > 1, F.col("stderr")).alias("stderr"))


# ---- task trees ----


def leaf_tasks(edges: DataFrame) -> DataFrame:
    """(group, task) for every task below a group at any depth. ``edges`` is the task tree, one row per
    (parent, child). Goes down until nothing is deeper; a group below itself stops the job."""
    edges = edges.select("parent", "child")
    pairs = durable(edges.select(F.col("parent").alias("group"), F.col("child").alias("task")))
    parents = edges.select(F.col("parent").alias("_p"), F.col("child").alias("_c"))
    while True:
        deeper = durable(pairs.join(parents, pairs["task"] == parents["_p"], "left"))
        state = deeper.agg(F.bool_or(F.col("_c").isNotNull()), F.bool_or(F.col("_c") == F.col("group"))).first()
        if state[1]:
            raise ValueError("a group of tasks holds itself")
        release(pairs)
        if not state[0]:
            return deeper.select("group", "task")
        pairs = durable(deeper.select("group", F.coalesce("_c", "task").alias("task")))
        release(deeper)


def group_scores(
    leaves: DataFrame, results: DataFrame, weight_by_size: bool = True, wanted: DataFrame | None = None
) -> DataFrame:
    """Mean of the subtasks' values per group and metric, with the pooled standard error.

    ``results`` has (task, metric, value, stderr, samples). A missing stderr makes the group's missing.
    ``wanted`` lists per group the metrics it reports and whether subtasks weigh by their size: (group, metric,
    weight_by_size), a metric being taken where its name holds the listed one; groups that list none get no score.
    """
    rows = leaves.join(results, "task")
    if wanted is None:
        rows = rows.withColumn("_weighted", F.lit(weight_by_size))
    else:
        listed = wanted.select(F.col("group").alias("_g"), F.col("metric").alias("_m"), F.col("weight_by_size").alias("_weighted"))
        rows = rows.join(listed, (F.col("group") == F.col("_g")) & F.contains("metric", "_m"))
    n = F.col("samples").cast("double")
    weight = F.when(F.col("_weighted"), n).otherwise(F.lit(1.0))
    pooled = F.sqrt(
        F.sum((n - 1) * F.col("stderr") * F.col("stderr") * n)
        / F.nullif(F.sum(n) - F.count("*"), F.lit(0.0)) / F.sum(n)
    )
    return rows.groupBy("group", "metric").agg(
        (F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"),
        F.when(~F.bool_or(F.col("stderr").isNull()), pooled).alias("stderr"),
        F.sum("samples").alias("samples"),
    )


def combined_stderr(results: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Standard error by merging subtasks pairwise in order. The first subtask's size stands for the
    merged size at every step. One row per configured task goes in."""
    step = F.struct(F.col(order), *[F.col(c).cast("double").alias(c) for c in ("stderr", "samples", "value")])
    ordered = results.groupBy(*by).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    first = F.col("_steps")[0]
    base = first["samples"]

    def merge(acc: Column, x: Column) -> Column:
        size = x["samples"]
        score = (acc["score"] * base + x["value"] * size) / (base + size)
        variance = ((base - 1) * acc["variance"] + (size - 1) * x["stderr"] * x["stderr"]) / (
            base + size - 1
        ) + base * size / ((base + size) * (base + size - 1)) * (score - x["value"]) * (score - x["value"])
        return F.struct(variance.alias("variance"), score.alias("score"))

    start = F.struct((first["stderr"] * first["stderr"]).alias("variance"), first["value"].alias("score"))
    rest = F.slice(F.col("_steps"), F.lit(2), F.size("_steps"))
    return ordered.select(
        *by, F.sqrt(F.aggregate(rest, start, merge)["variance"]).alias("combined_stderr")
    )


def group_direction(leaves: DataFrame, directions: DataFrame) -> DataFrame:
    """Whether higher is better for each metric of a group; null when the subtasks disagree."""
    return leaves.join(directions, "task").groupBy("group", "metric").agg(
        F.when(
            (F.min("higher_is_better") == F.max("higher_is_better"))
            & (F.count("higher_is_better") == F.count("*")),
            F.first("higher_is_better", ignorenulls=True),
        ).alias("higher_is_better")
    )


def dataset_sizes(docs: DataFrame, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """Documents there are and documents a limit lets through."""
    n = F.count("*")
    kept = n if limit is None else F.least(F.lit(limit).cast("bigint"), n)
    return docs.groupBy(*by).agg(n.alias("original"), kept.alias("effective"))
