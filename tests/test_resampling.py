"""Resampling and selection on whole tables, against plain Python."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import weights as W
from scorelake.functions.draws import SEED, key_state, poisson_one, uniform_from
from scorelake.functions.scoring import METRICS, with_scores
from scorelake.operators import baseline, stats


def test_weights_are_those_of_the_draws(spark):
    keys = [0, 1, -5, 1 << 40, 77, None]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").select(key_state(F.col("k"), SEED).alias("s"))
    states = [r.s for r in df.collect()]
    spread = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3999)))).withColumn("w", poisson_one(uniform_from(F.col("s"), F.col("i"))))
    got = W.weights(np.array(states, np.uint32), 0, 4000)
    want = {(r.s, r.i): r.w for r in spread.collect()}
    assert all(got[i, j] == want[s, i] for j, s in enumerate(states) for i in range(4000))
    assert got.max() >= 5 and abs(got.mean() - 1) < 0.02


def test_every_limit_of_a_weight():
    steps = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
    for k, limit in enumerate(W.LIMITS.tolist()):
        assert (limit - 1) / 2.0 ** 32 < steps[k] <= limit / 2.0 ** 32


@pytest.mark.parametrize("held", [stats.HELD_SUMS, 1])
def test_resampled_sums_of_hot_null_and_tiny_groups(spark, monkeypatch, held):
    monkeypatch.setattr(stats, "HELD_SUMS", held)
    monkeypatch.setattr(stats, "ROUNDS_OUT", 100)
    rng = random.Random(3)
    rows = [(i, "hot" if i % 2 else rng.choice(["a", "b", None]), i % 5 if i % 7 else None, rng.gauss(0, 1) if i % 3 else None) for i in range(500)]
    rows += [(1000, "one", 1, 2.0), (1001, "unknown", 1, None), (1002, "unknown", 1, None)]
    df = spark.createDataFrame(rows, "id bigint, g string, h int, v double").repartition(4)
    got = {(r.g, r.h, r.iteration): (r.resampled, r.t, r.u) for r in stats.bootstrap_totals(
        df, {"t": F.col("v"), "u": F.col("id") % 3}, "id", 250, ["g", "h"]).collect()}
    state = {r.id: r.s for r in df.select("id", key_state(F.col("id"), SEED).alias("s")).collect()}
    want = {}
    for i, g, h, v in rows:
        for it, w in enumerate(W.weights(np.array([state[i]], np.uint32), 0, 250)[:, 0].tolist()):
            if w:
                n, t, u = want.get((g, h, it), (0, None, 0))
                want[g, h, it] = n + w, t if v is None else (t or 0) + w * v, u + w * (i % 3)
    assert set(got) == set(want)
    for key, (n, t, u) in want.items():
        known = any(v is not None for _, g, h, v in rows if (g, h) == key[:2])
        assert got[key][0] == n and got[key][2] == u and (got[key][1] == pytest.approx(t or 0, abs=1e-9) if known else got[key][1] is None)


def test_pooled_rounds_resample_every_row(spark, monkeypatch):
    monkeypatch.setattr(stats, "SHARES", 5)
    monkeypatch.setattr(stats, "POOL", 64)
    monkeypatch.setattr(stats, "ROUNDS_OUT", 100)
    rng = random.Random(5)
    rows = [(i % 290 if i % 50 else None, rng.choice(["a", "b", None]), rng.gauss(0, 1) if i % 3 else None) for i in range(300)] + [(7, "unknown", None)]
    df = spark.createDataFrame(rows, "id bigint, g string, v double").repartition(3)
    got = {(r.g, r.iteration): (r.resampled, r.t) for r in stats.pooled_totals(df, {"t": F.col("v")}, "id", 250, ["g"]).collect()}
    state = {r.id: r.s for r in df.select("id", key_state(F.col("id"), SEED).alias("s")).collect()}
    picks = {}
    for share in range(5):
        sums = np.zeros((250, 1))
        W.add_picked(sums, np.arange(64.0)[:, None], zlib.crc32(f"{SEED} {share}".encode()))
        picks[share] = sums[:, 0].astype(int)
    want = {}
    for i, g, v in rows:
        drawn = W.weights(np.array([state[i]], np.uint32), 0, 64)[:, 0]
        for it in range(250):
            n, t = want.get((g, it), (0, 0.0))
            w = int(drawn[picks[state[i] % 5][it]])
            want[g, it] = n + w, t + w * (v or 0)
    want = {k: x for k, x in want.items() if x[0]}
    assert set(got) == set(want)
    for (g, it), (n, t) in want.items():
        assert got[g, it][0] == n and got[g, it][1] == (None if g == "unknown" else pytest.approx(t, abs=1e-9))


def test_pooled_error_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(stats, "POOLED_ROWS", 4000)
    df = spark.range(9000).selectExpr("id", "if(id < 8000, if(id % 2 = 0, 'large', null), 'small') as g", "cast(id * id % 1009 as double) as v")
    drawn = []
    monkeypatch.setattr(stats, "bootstrap_totals", lambda d, *a, kept=stats.bootstrap_totals: (drawn.append(d.count()), kept(d, *a))[1])
    errors = {r.g: r.stderr for r in stats.bootstrap_stderr(df, {"t": F.col("v")}, F.col("t") / F.col("resampled"), "id", 4000, ["g"], pooled=True).collect()}
    closed = {r.g: r.e for r in df.groupBy("g").agg((F.stddev_pop("v") / F.sqrt(F.count("*"))).alias("e")).collect()}
    assert set(errors) == {"large", None, "small"} and drawn == [1000]
    for g, e in closed.items():
        assert errors[g] == pytest.approx(e, rel=0.06)
    whole = stats.bootstrap_stderr(df, {"t": F.col("v")}, F.col("t") / F.col("resampled"), "id", 2000, pooled=True).first()["stderr"]
    assert whole == pytest.approx(df.agg(F.stddev_pop("v") / F.sqrt(F.count("*"))).first()[0], rel=0.08)


def test_too_many_cells_stop_the_job(spark):
    df = spark.range(stats.MAX_CELLS + 1).withColumn("v", F.col("id").cast("double"))
    with pytest.raises(ValueError, match="bootstrap_stderr"):
        stats.bootstrap_cells(df, {"t": F.col("v")}, F.col("t"), 10)


@pytest.mark.parametrize("ranked,sampled", [(10_000, 4096), (60, 64)])
def test_middle_of_hot_null_and_tied_groups(spark, monkeypatch, ranked, sampled):
    monkeypatch.setattr(stats, "RANKED_ROWS", ranked)
    monkeypatch.setattr(stats, "SAMPLED_KEYS", sampled)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", rng.randrange(40) if i % 11 else None, i, rng.randrange(9) / 2 if i % 13 else None) for i in range(1500)]
    rows += [("tied", 1, 7, 3.0)] * 200 + [("one", None, 5, None)]
    df = spark.createDataFrame(rows, "g string, o int, id bigint, v double").repartition(5)
    got = {r.g: r["median"] for r in stats.middle_in_order(df, "v", ["o", "id"], ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(((o is not None, o or 0), i, v) for h, o, i, v in rows if h == g) if g != "one" else [((False, 0), 5, None)]
        want[g] = own[len(own) // 2][2]
    assert got == want
    whole = sorted(((o is not None, o or 0), i, v or 0) for _, o, i, v in rows)
    assert [r[0] or 0 for r in stats.middle_in_order(df, "v", ["o", "id"]).collect()] == [whole[len(whole) // 2][2]]


def test_middle_needs_no_sort_of_all_rows(spark):
    df = spark.createDataFrame([(0, 9.0), (1, 1.0)], "id int, v double")
    plan = stats.middle_in_order(df, "v", ["id"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()
    assert stats.middle_in_order(df.limit(0), "v", ["id"]).collect() == []


def test_random_scores_are_those_of_the_drawn_boxes(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        x, y = sorted((rng.random(), rng.random())), sorted((rng.random(), rng.random()))
        rows.append((i, "k", [x[0], y[0], x[1], y[1]], [rng.randint(1, 40), rng.randint(1, 40)]))
    rows += [(60, "k", [0.5, 0.5, 0.5, 0.5], [9, 9]), (61, None, None, [9, 9]), (62, "k", [0.1], [9, 9]), (63, "k", [0.0, 0.0, 1.0, 1.0], [None, 9]),
             (64, "k", [0.0, None, 1.0, 1.0], [9, 9]), (65, "k", [0.0, 0.0, 1.0, 1.0], None), (None, "k", [0.0, 0.0, 1.0, 1.0], [5, 5])]
    df = spark.createDataFrame(rows, "id bigint, g string, target array<double>, image_size_2d array<int>").repartition(3)
    got = {r.id: r for r in baseline.random_scores(df, "id", ["g"], 30).collect()}
    drawn = df.select("id", "target", F.get("image_size_2d", F.lit(0)).alias("_ih"), F.get("image_size_2d", F.lit(1)).alias("_iw"), key_state(F.col("id"), SEED).alias("_state"))
    placed = baseline.with_random_box(drawn.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(29)))))
    scored = with_scores(placed, F.col("_box"), F.col("target"), "Detection").groupBy("id").agg(*[F.avg(m).alias(m) for m in METRICS["Detection"]])
    want = {r.id: r for r in scored.collect()}
    assert set(got) == set(want)
    for i, r in want.items():
        if i in (63, 64, 65):  # an image or a target of unknown size
            assert [got[i][m] for m in METRICS["Detection"]] == [None, 0.0, 0.0, 0.0, 0.0]
            continue
        for m in METRICS["Detection"]:
            assert got[i][m] == (None if r[m] is None else pytest.approx(r[m], abs=1e-9)), (i, m)
    assert got[61].g is None and got[61].success is True
    assert "Exchange" not in baseline.random_scores(df.coalesce(1), "id")._jdf.queryExecution().executedPlan().toString().split("Coalesce")[0]
    with pytest.raises(Exception, match="no pixels"):
        baseline.random_scores(df.withColumn("image_size_2d", F.array(F.lit(0), F.lit(3))), "id").collect()
