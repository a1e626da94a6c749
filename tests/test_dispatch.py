"""Functions of many tasks against plain Python."""

import statistics

import pytest
from pyspark.sql import functions as F

from scorelake.operators import dispatch, registry


@pytest.fixture(params=[3, 70])
def tasks(request, monkeypatch):
    """Tasks with targets, most with scores, some with aggregations; the first two share a function."""
    monkeypatch.setattr(registry, "TASK_FUNCTIONS", {})
    monkeypatch.setattr(dispatch, "TASK_FUNCTIONS", registry.TASK_FUNCTIONS)
    n = request.param
    shared = lambda a: a * 2
    for k in range(n):
        name = f"t{k:02d}"
        registry.register_task_function(name, "target", shared if k < 2 else (lambda a, k=k: a + k))
        if k % 5:
            registry.register_task_function(name, "score", lambda t, b, k=k: t - b * k)
        if k % 3 == 1:
            registry.register_task_function(name, "aggregation", F.max if k % 2 else F.min)
    return n


def given(spark, n):
    rows = [("t01" if i % 3 == 0 else f"t{i % n:02d}", float(i % 17), float(i % 5), i % 2) for i in range(600)]
    rows += [(None, 1.0, 2.0, 0), ("unknown", 1.0, 2.0, 1), ("t00", None, 2.0, 0)]
    return rows, spark.createDataFrame(rows, "task string, a double, b double, _group int").repartition(4)


def target(task, a):
    if a is None or task is None or task == "unknown":
        return None
    k = int(task[1:])
    return a * 2 if k < 2 else a + k


def test_columns_by_task(spark, tasks):
    rows, df = given(spark, tasks)
    got = dispatch.with_task_column(df.drop("_group"), "target", "task", ["a"], "t", default=lambda a: -a).collect()
    want = [(task, a, b, (None if a is None else -a) if task in (None, "unknown") else target(task, a)) for task, a, b, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_aggregates_by_task(spark, tasks):
    rows, df = given(spark, tasks)
    narrow = df.withColumnRenamed("_group", "g")
    for default in (None, F.avg):
        got = {(r.g, r.task): r.value for r in dispatch.aggregated_by_task(narrow, "task", ["a"], by=["g"], default=default).collect()}
        want = {}
        for g, task in {(r[3], r[0]) for r in rows}:
            own = [a for t, a, _, h in rows if (h, t) == (g, task) and a is not None]
            known = task not in (None, "unknown") and int(task[1:]) % 3 == 1
            if known:
                want[g, task] = (max if int(task[1:]) % 2 else min)(own)
            elif default is not None:
                want[g, task] = statistics.mean(own) if own else None
        assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_targets_scores_and_aggregates_of_one_deal(spark, tasks):
    rows, df = given(spark, tasks)
    got = {r.task: (r.value, r["rows"]) for r in dispatch.with_own_functions(df, "task", ["a"], ["b"]).collect()}
    assert set(got) == {r[0] for r in rows}
    for task, (value, n) in got.items():
        own = [(a, b) for t, a, b, _ in rows if t == task]
        k = int(task[1:]) if task not in (None, "unknown") else 0
        scores = [target(task, a) - b * k for a, b in own if target(task, a) is not None] if k % 5 else []
        assert n == len(own)
        want = None if not scores else (max if k % 2 else min)(scores) if k % 3 == 1 else statistics.mean(scores)
        assert value == (None if want is None else pytest.approx(want))


def test_no_tasks(spark, monkeypatch):
    monkeypatch.setattr(registry, "TASK_FUNCTIONS", {})
    monkeypatch.setattr(dispatch, "TASK_FUNCTIONS", registry.TASK_FUNCTIONS)
    _, df = given(spark, 3)
    assert {r.t for r in dispatch.with_task_column(df, "target", "task", ["a"], "t").select("t").collect()} == {None}
    assert dispatch.aggregated_by_task(df, "task", ["a"]).collect() == []
