"""Functions of hundreds of tasks applied to one table, each row by its own task's functions only.

One choice among all functions nests or grows beyond what generated code can hold. Here rows are dealt by groups of a few dozen
tasks: stored once, in a folder for each group, and each folder is read by the functions of its own group. Whatever the number
of tasks, a row is written and read once more and meets a choice among few.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.registry import TASK_FUNCTIONS
from scorelake.session import scratch_path

Function = Callable[..., Column]

#: Tasks of a group.
GROUP = 32


def tasks_of(*roles: str) -> list[str]:
    """Registered tasks with a function in one of the roles, in order."""
    return sorted({task for task, role in TASK_FUNCTIONS if role in roles})


def dealt(rows: DataFrame, task: str, tasks: Sequence[str]) -> list[tuple[list[str], DataFrame]]:
    """Groups of tasks with their rows; last, without tasks, the rows of all others and of a null task.

    A few tasks are one group, not stored. Else rows are written with a folder for each group, by as many tasks of the job as
    the group's rows ask for, so that a task with a third of all rows is no hot spot and a rare one no tiny file of every split.
    """
    known = F.coalesce(F.col(task).isin(list(tasks)), F.lit(False))
    if len(tasks) <= GROUP:
        return [(list(tasks), rows.where(known)), ([], rows.where(~known))]
    groups = [list(tasks[i:i + GROUP]) for i in range(0, len(tasks), GROUP)]
    routes = rows.sparkSession.createDataFrame([(t, i) for i, own in enumerate(groups) for t in own], "_route string, _group int")
    # As many rows as tasks are registered.
    routed = rows.join(F.broadcast(routes), F.col(task) == F.col("_route"), "left").drop("_route")
    routed = routed.withColumn("_group", F.coalesce("_group", F.lit(-1)))
    path = scratch_path(rows.sparkSession, "by-task")
    routed.hint("rebalance", "_group").write.partitionBy("_group").parquet(path)
    read = rows.sparkSession.read.schema(routed.schema).parquet(path)
    return [(own, read.where(F.col("_group") == i).drop("_group")) for i, own in [*enumerate(groups), (-1, [])]]


def _functions(role: str, tasks: Sequence[str]) -> list[tuple[Function, list[str]]]:
    """The distinct functions of some tasks, each with its tasks."""
    found: dict[int, tuple[Function, list[str]]] = {}
    for task in tasks:
        function = TASK_FUNCTIONS.get((task, role))
        if function is not None:
            found.setdefault(id(function), (function, []))[1].append(task)
    return list(found.values())


def _column(role: str, task: str, tasks: Sequence[str], inputs: Sequence[Column], kind: str, default: Function | None) -> Column:
    """What a row's task, one of ``tasks``, makes of the inputs."""
    out = (default(*inputs) if default else F.lit(None)).cast(kind)
    choice = None
    for function, own in _functions(role, tasks):
        met, value = F.col(task).isin(own), function(*inputs).cast(kind)
        choice = F.when(met, value) if choice is None else choice.when(met, value)
    return out if choice is None else choice.otherwise(out)


def _aggregate(rows: DataFrame, task: str, tasks: Sequence[str], columns: Sequence[str], name: str, group: Sequence[str], kind: str,
               default: Function | None, also: dict[str, Column]) -> DataFrame | None:
    """Aggregates of rows whose tasks are among ``tasks``. A function sees the rows of its own tasks; to all others its columns
    are null, which aggregates leave out."""
    inputs, cells, choice = [F.col(c) for c in columns], [], None
    own = _functions("aggregation", tasks)
    rest = [t for t in tasks if not any(t in held for _, held in own)]
    for i, (function, held) in enumerate(own):
        mine = F.col(task).isin(held)
        cells.append(function(*[F.when(mine, c) for c in inputs]).cast(kind).alias(f"_v{i}"))
        choice = F.when(mine, F.col(f"_v{i}")) if choice is None else choice.when(mine, F.col(f"_v{i}"))
    if default is not None:
        cells.append(default(*inputs).cast(kind).alias("_default"))
    elif rest or not own:
        rows = rows.where(F.col(task).isin([t for _, held in own for t in held])) if own else None
    if rows is None:
        return None
    other = F.col("_default") if default is not None else F.lit(None).cast(kind)
    value = other if choice is None else choice.otherwise(other)
    wide = rows.groupBy(*group).agg(*cells, *[c.alias(n) for n, c in also.items()])
    return wide.select(*group, value.alias(name), *also)


def _together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def with_task_column(rows: DataFrame, role: str, task: str, columns: Sequence[str], name: str, kind: str = "double",
                     default: Function | None = None) -> DataFrame:
    """``rows`` with ``name``: what the row's own task makes of ``columns``; ``default`` for tasks without a function and a null
    task, else null. All functions give values that cast to ``kind``."""
    inputs = [F.col(c) for c in columns]
    return _together([part.withColumn(name, _column(role, task, own, inputs, kind, default)) for own, part in dealt(rows, task, tasks_of(role))])


def aggregated_by_task(rows: DataFrame, task: str, columns: Sequence[str], name: str = "value", by: Sequence[str] = (), kind: str = "double",
                       default: Function | None = None) -> DataFrame:
    """One row per ``by`` and task with ``name``, its own task's aggregate of ``columns``; ``default`` for tasks without an
    aggregation and a null task, which else have no rows."""
    group = list(dict.fromkeys([*by, task]))
    narrow = rows.select(*dict.fromkeys([*group, *columns]))
    parts = [_aggregate(part, task, own, columns, name, group, kind, default, {}) for own, part in dealt(narrow, task, tasks_of("aggregation"))]
    found = [p for p in parts if p is not None]
    return _together(found) if found else rows.limit(0).select(*group, F.lit(None).cast(kind).alias(name))


def with_own_functions(rows: DataFrame, task: str, target_of: Sequence[str], score_of: Sequence[str], by: Sequence[str] = (),
                       tasks: Sequence[str] | None = None) -> DataFrame:
    """Target, score and aggregate of every row's own task: (by, task, value, rows). ``target_of`` names the columns a target
    comes from, ``score_of`` those a score compares with it; a task without an aggregation takes the mean. Rows are dealt once.
    ``tasks`` are those whose functions read such columns, all that are registered unless told; others have none."""
    group, parts = list(dict.fromkeys([*by, task])), []
    narrow = rows.select(*dict.fromkeys([*group, *target_of, *score_of]))
    known = tasks_of("target", "score", "aggregation") if tasks is None else sorted(tasks)
    for own, part in dealt(narrow, task, known):
        scored = part.withColumn("_target", _column("target", task, own, [F.col(c) for c in target_of], "double", None))
        scored = scored.withColumn("_score", _column("score", task, own, [F.col("_target"), *[F.col(c) for c in score_of]], "double", None))
        parts.append(_aggregate(scored, task, own, ["_score"], "value", group, "double", F.avg, {"rows": F.count("*")}))
    return _together(parts)
