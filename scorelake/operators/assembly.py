"""Putting data sets together: unions, splits, samples, subsets, pending work and cached responses."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.draws import SEED, draw
from scorelake.operators.ranking import latest, mark_sample, marked_below, with_row_index
from scorelake.session import durable


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns and struct fields one side lacks become null. Columns come out sorted."""
    if not tables:
        raise ValueError("nothing to union")
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_sorted_fields(t) for t in tables])
    return joined.select(*sorted(joined.columns))


def _sorted_fields(df: DataFrame) -> DataFrame:
    def tidy(name: str, kind: T.DataType) -> Column:
        col = F.col(f"`{name}`")
        if not isinstance(kind, T.StructType):
            return col
        fields = sorted(kind.fieldNames())
        return F.when(col.isNotNull(), F.struct(*[col.getField(f).alias(f) for f in fields])).alias(name)

    return df.select(*[tidy(f.name, f.dataType).alias(f.name) for f in df.schema])


def split_exact(df: DataFrame, validation: int, key: str, seed: int = SEED, name: str = "split") -> DataFrame:
    """Exactly ``validation`` rows become validation, the rest train."""
    marked = mark_sample(df, validation, key, seed, name="_held")
    return marked.withColumn(
        name, F.when(F.col("_held"), F.lit("validation")).otherwise(F.lit("train"))
    ).drop("_held")


def limited_split(
    df: DataFrame, train: int, validation: int, key: str, seed: int = SEED
) -> DataFrame:
    """Exactly ``validation`` rows for validation and at most ``train`` others (all when negative).

    Both cut-offs lie in one random order, so the training rows are a random part of the rest.
    """
    if validation <= 0 or train == 0:
        raise ValueError("validation must be positive and train must not be 0")
    if train < 0:
        return split_exact(df, validation, key, seed)
    marked = marked_below(df, {"_held": validation, "_in": validation + train}, key, seed).filter("_in")
    return marked.withColumn("split", F.when(F.col("_held"), F.lit("validation")).otherwise(F.lit("train"))).drop("_held", "_in")


def sample_limits(
    task_limits: dict[str, tuple[int, int]], per_task: tuple[int, int], listed: Sequence[str]
) -> dict[str, tuple[int, int]]:
    """(train, validation) limits per task kind: its own when positive, else the default, 0 when the
    kind has no task list."""
    def pick(kind: str) -> tuple[int, int]:
        if kind not in listed:
            return (0, 0)
        return tuple(own if own > 0 else default for own, default in zip(task_limits[kind], per_task))

    return {kind: pick(kind) for kind in task_limits}


def limit_column(limits: dict[str, tuple[int, int]], kind: Column, which: int) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, pair in limits.items():
        out = out.when(kind == name, F.lit(pair[which]))
    return out.otherwise(F.lit(0))


def subset_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def glob_pattern(pattern: str) -> str:
    """Regular expression of a shell-style pattern."""
    out = ""
    for piece in re.split(r"(\*|\?|\[[^\]]+\])", pattern):
        if piece == "*":
            out += ".*"
        elif piece == "?":
            out += "."
        elif piece.startswith("[") and piece.endswith("]") and len(piece) > 2:
            out += piece.replace("[!", "[^", 1)
        else:
            out += re.sub(r"([^\w\s])", r"\\\1", piece)
    return f"(?s)^{out}$"


def match_names(df: DataFrame, name: str, patterns: Sequence[str]) -> DataFrame:
    """Distinct names that match any pattern, sorted."""
    wanted = F.col(name).rlike("|".join(glob_pattern(p) for p in patterns))
    return df.filter(wanted).select(name).distinct().orderBy(name)


def oversubscribed(members: DataFrame, task: str = "task", group: str = "group") -> DataFrame:
    """Tasks claimed by more than one group, which must not be; empty when all is well."""
    return (
        members.select(task, group).groupBy(task)
        .agg(F.count("*").alias("claims"), F.min(group).alias("first_group"), F.max(group).alias("last_group"))
        .filter(F.col("claims") > 1)
    )


def upsert(current: DataFrame, updates: DataFrame, on: Sequence[str]) -> DataFrame:
    """Updates win over current rows with the same key. Keys must be unique within the updates."""
    return current.join(updates, list(on), "left_anti").unionByName(updates)


def record_done(status: DataFrame, finished: DataFrame) -> DataFrame:
    """(model, task, done) with newly finished pairs set to true."""
    pairs = finished.select("model", "task").distinct().withColumn("done", F.lit(True))
    return upsert(status, pairs, ["model", "task"])


def pending(tasks: DataFrame, status: DataFrame, model: str) -> DataFrame:
    """Tasks of the list the model has not completed."""
    done = status.filter((F.col("model") == model) & F.col("done"))
    return tasks.join(done, "task", "left_anti")


def append_numbered(base: DataFrame, extra: DataFrame, arrival: Sequence[Column], id_name: str = "id") -> DataFrame:
    """Append rows with ids that go on from the number of rows there are."""
    start = base.agg(F.count("*")).scalar()
    numbered = with_row_index(extra, arrival, name=id_name).withColumn(id_name, F.col(id_name) + start)
    return base.unionByName(numbered.select(*base.columns))


def first_n(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first n rows by key. A pool shorter than n stops the job."""
    total = df.agg(F.count("*")).scalar()
    short = F.raise_error(F.lit(f"fewer than {n} rows to take from")).cast("boolean")
    return df.filter(F.when(total >= n, F.lit(True)).otherwise(short)).orderBy(key).limit(n)


def few_shot_examples(docs: DataFrame, pool: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """n examples per document from a shuffled pool, never the document itself: (key, place, example).

    The pool is put in random order and numbered. Each document starts at a place drawn for it, takes
    n + 1 neighbours, drops itself and keeps the first n. Examples are met by an equality join on the
    number, so no document meets the whole pool. The pool needs more than n rows.
    """
    order = [draw(F.col(key), 0, seed), F.col(key)]
    numbered = durable(with_row_index(pool.select(key), order, name="_at"))
    size = numbered.agg(F.count("*")).scalar()
    enough = F.when(size > n, size).otherwise(F.raise_error(F.lit(f"the pool needs more than {n} rows")).cast("bigint"))
    placed = docs.select(key).join(numbered.withColumnRenamed("_at", "_own_at"), key, "left")
    # 63 random bits, so that pools of any size are reached in every place.
    wide = F.shiftleft(draw(F.col(key), 1, seed).bitwiseAND(0x7FFFFFFF), 32) + draw(F.col(key), 2, seed)
    start = F.pmod(wide, enough)
    spread = placed.withColumn("_start", start).select(
        key, "_start", F.pmod(F.col("_own_at") - F.col("_start"), size).alias("_own"),
        F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_step"),
    )
    others = spread.filter(F.col("_own").isNull() | (F.col("_step") != F.col("_own"))).withColumn(
        "place", F.col("_step") - F.when(F.col("_own") < F.col("_step"), 1).otherwise(0)
    )
    wanted = others.filter(F.col("place") < n).select(
        key, "place", F.pmod(F.col("_start") + F.col("_step"), size).alias("_at")
    )
    return wanted.join(numbered.withColumnRenamed(key, "example"), "_at").select(key, "place", "example")


# How examples are chosen, by name.
SAMPLERS = {"default": few_shot_examples, "first_n": first_n}


def few_shot_context(
    examples: DataFrame, pool: DataFrame, key: str, text: Column, target: Column,
    target_delimiter: str = " ", delimiter: str = "\n\n",
) -> DataFrame:
    """Prompt text of the examples of each document, in order. A document has n examples, so the
    collected list is as long as the prompt asks."""
    shots = pool.select(F.col(key).alias("example"), F.concat(text, F.lit(target_delimiter), target).alias("_shot"))
    return examples.join(shots, "example").groupBy(key).agg(
        F.concat(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("place", "_shot"))), lambda s: s["_shot"]), delimiter
            ),
            F.lit(delimiter),
        ).alias("context")
    )


def request_hash(kind: Column, *arguments: Column) -> Column:
    """Content hash of a request."""
    return F.sha2(F.to_json(F.array(kind, *[a.cast("string") for a in arguments])), 256)


def answered_from_cache(
    requests: DataFrame, cache: DataFrame, key: str = "request_hash", sampled: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached response, requests still to run). Sampled requests are never reused,
    or all their repeats would be alike."""
    reusable = F.lit(True) if sampled is None else ~sampled
    known = cache.groupBy(key).agg(F.first("response").alias("response")).withColumn("_hit", F.lit(True))
    met = requests.withColumn("_key", F.when(reusable, F.col(key))).join(
        known.withColumnRenamed(key, "_known"), F.col("_key") == F.col("_known"), "left"
    ).drop("_key", "_known")
    return met.filter("_hit").drop("_hit"), met.filter("_hit is null").drop("_hit", "response")


def cache_after(cache: DataFrame, answered: DataFrame, key: str = "request_hash") -> DataFrame:
    """The cache with newly answered requests added; equal requests count once."""
    fresh = answered.groupBy(key).agg(F.max_by("response", "request_id").alias("response"))
    return upsert(cache.select(key, "response"), fresh, [key])


def in_request_order(responses: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Responses grouped to documents and numbered in request order, one row each, so that a document
    with very many requests needs no single row or task to hold them."""
    return with_row_index(responses, [F.col(c) for c in order], by, "position")


def in_groups(samples: DataFrame, membership: DataFrame) -> DataFrame:
    """Samples of every group their task belongs to, then those of tasks in no group."""
    grouped = samples.join(membership.select("task", "group"), "task")
    alone = samples.join(membership, "task", "left_anti").withColumn("group", F.lit(None).cast("string"))
    return grouped.unionByName(alone)


def keep_last(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    return latest(df, by, F.col(order))


def with_dataset_name(df: DataFrame, tag: str, task: str = "task") -> DataFrame:
    """Data set a task was drawn from: the part of its name before ``_<tag>``."""
    return df.withColumn("dataset_name", F.substring_index(F.col(task), f"_{tag}", 1))


TRAINING_COLUMNS = ("messages", "labels", "image_file", "slice_dim", "slice_idx")


def keep_training_columns(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Only the listed columns, those of them that exist."""
    return df.select(*[c for c in df.columns if c in (*TRAINING_COLUMNS, *extra)])
