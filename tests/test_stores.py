"""Stores that grow by batches, and logs that arrive before or after their results files."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from scorelake.sources import commits, keyed
from scorelake.streaming import incremental

SCHEMA = "request_hash string, response string"


def hashed(spark, answers):
    rows = spark.createDataFrame(list(answers.items()), "k string, response string")
    return rows.select(F.sha2("k", 256).alias("request_hash"), "response")


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(root).rglob("part-*") if "/data/" in str(p)}


def contents(store):
    return {r.request_hash: r.response for r in store.rows().collect()}


def test_a_batch_leaves_other_folders_as_they_are(spark, tmp_path):
    store = keyed.KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, digits=1)
    changed = set()
    assert store.rows().collect() == [] and store.upsert(store.rows()) is None
    want = {}
    first = {f"q{i}": f"a{i}" for i in range(400)}
    for number, batch in enumerate((first, {"q7": "new", "extra": "x"}, {"q9": "newer"})):
        before = files(tmp_path)
        rows = hashed(spark, batch)
        assert store.upsert(rows.unionByName(spark.createDataFrame([(None, "no key")], SCHEMA))) == number
        touched = {r.request_hash[:1] for r in rows.collect()}
        changed |= touched if number else set()
        want |= {r.request_hash: r.response for r in rows.collect()}
        assert contents(store) == want
        after = files(tmp_path)
        for path, time in before.items():
            if not any(f"bucket={b}/" in path for b in changed):
                assert after[path] == time
        assert len([p for p in after if p not in before]) <= len(touched) and (number == 0 or len(touched) <= 2)
    # Only what the last two commits read is left: one file for each folder, and the one that the last commit replaced.
    assert commits.committed(spark, store.root) == [1, 2]
    assert len(files(tmp_path)) == 16 + 1
    some = store.rows_for(hashed(spark, {"q9": ""}))
    assert {r.response for r in some.collect()} >= {"newer"} and some.count() < 80


def test_a_batch_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = keyed.KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, digits=1)
    store.upsert(hashed(spark, {"a": "1", "b": "2"}))
    held = contents(store)
    monkeypatch.setattr(keyed.commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.upsert(hashed(spark, {"a": "9", "c": "3"}))
    assert contents(store) == held
    monkeypatch.undo()
    store.upsert(hashed(spark, {"c": "4"}))
    assert sorted(contents(store).values()) == ["1", "2", "4"]


def test_a_large_folder_gets_layers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "SMALL_BYTES", 0)
    monkeypatch.setattr(keyed, "LAYERS", 3)
    store = keyed.KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, digits=1)
    want = {}
    for number in range(5):
        before = files(tmp_path)
        rows = hashed(spark, {f"q{i}": f"a{number}-{i}" for i in range(number * 100, number * 100 + 200)})
        assert store.upsert(rows, dealt=number > 2) == number
        want |= {r.request_hash: r.response for r in rows.collect()}
        assert store.rows().count() == len(want) and contents(store) == want
        if number in (1, 2):
            # Nothing that was there is written again.
            assert before.items() <= files(tmp_path).items() and len(files(tmp_path)) == 16 * (number + 1)
    assert max(len(g) for g in store._generations(4).values()) <= 3
    keys = hashed(spark, {"q150": "", "none": ""}).selectExpr("1 as request_id", "request_hash", "false as s")
    hits, to_run = keyed.answered_from_store(keys, store, F.col("s"))
    assert [r.response for r in hits.collect()] == ["a1-150"] and to_run.count() == 1


def test_packed_keys_differ_where_keys_do(spark):
    digits = "0123456789abcdef" * 4
    keys = [digits, digits.upper(), digits[:-1], bytes.fromhex(digits[:2] * 32).decode("latin1"), "", "aa", "0aa", "\x00", "x" * 32, "78" * 32, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", keyed.packed(F.col("k")).alias("p")).withColumn("back", keyed.unpacked(F.col("p")))
    found = rows.collect()
    assert all(r.k == r.back for r in found) and len({None if r.p is None else bytes(r.p) for r in found}) == len(keys)
    assert len(found[0].p) == 32


def test_answers_from_the_store(spark, tmp_path):
    store = keyed.KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, digits=1)
    requests = spark.createDataFrame([(1, "aa", False), (2, "aa", True), (3, "bb", False), (4, "bb", False), (5, None, False), (6, "cc", None)],
                                     "request_id int, request_hash string, s boolean")
    store.upsert(spark.createDataFrame([("aa", "kept")], SCHEMA))
    hits, to_run = keyed.answered_from_store(requests, store, F.col("s"))
    assert [(r.request_id, r.response) for r in hits.collect()] == [(1, "kept")]
    assert sorted(r.request_id for r in to_run.collect()) == [2, 3, 4, 5, 6] and "response" not in to_run.columns
    keyed.record_answers(store, to_run.withColumn("response", F.col("request_id").cast("string")).where("s = false"))
    assert contents(store) == {"aa": "kept", "bb": "4"}


def batches(spark, out, n, by="g"):
    for number in n:
        spark.createDataFrame([(f"g{number % 5}", number)], "g string, n int").write.mode("overwrite").parquet(f"{out}/batch={number}")


def summary(spark, out):
    return {r.g: r.n for r in incremental.current_summary(spark, out, ["g"]).collect()}


def test_twenty_batches_stay_few_files(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/sum"
    with pytest.raises(FileNotFoundError):
        incremental.current_summary(spark, out, ["g"])
    for number in range(20):
        batches(spark, out, [number])
        if number % 4 == 3:
            incremental.compact(spark, out, ["g"], number)
            incremental.compact(spark, out, ["g"], number)  # a batch that is retried
        assert summary(spark, out) == {f"g{k % 5}": k for k in range(max(0, number - 4), number + 1)}
        assert len(commits.numbered(spark, out, "batch")) <= 8 and len(commits.numbered(spark, f"{out}/_snapshots", "upto")) <= 2
    want = summary(spark, out)
    batches(spark, out, [20])
    want["g0"] = 20
    kept = commits.commit
    monkeypatch.setattr(incremental.commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        incremental.compact(spark, out, ["g"], 20)
    assert summary(spark, out) == want
    monkeypatch.setattr(incremental.commits, "commit", kept)
    incremental.compact(spark, out, ["g"], 20)
    assert summary(spark, out) == want
    # A job that ended between the commit and the deletions leaves files that do not count.
    batches(spark, out, [2])
    assert summary(spark, out) == want


def log(root, model, name, ids):
    folder = root / model
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"doc_id": i, "target": "0 0 1 1", "resps": [["0 0 1 1"]], "doc": {"label": "x"}}) for i in ids]
    (folder / name).write_text("\n".join(lines) + "\n")


def results(root, model, prefix, task):
    (root / model).mkdir(parents=True, exist_ok=True)
    (root / model / f"{prefix}_results.json").write_text(json.dumps({"results": {task: {"acc,none": "1"}}}))


def test_logs_meet_their_results_in_any_order(spark, tmp_path):
    root, out, check = tmp_path / "logs", f"file://{tmp_path}/out", f"file://{tmp_path}/check"

    def step(wait_ms=3_600_000):
        incremental.pair_new_files(spark, f"file://{root}", out, check, wait_ms)
        pairs = spark.read.schema(incremental.PAIRS).parquet(f"{out}/pairs").collect()
        rows = spark.read.parquet(f"{out}/rows").collect() if (tmp_path / "out" / "rows").exists() else []
        return sorted((p.model, p.prefix, p.status) for p in pairs), sorted((r.model, r.prefix, r.results_task, r.doc_id) for r in rows)

    log(root, "A", "r1_samples_SetA_x.jsonl", [1, 2])
    results(root, "B", "r1", "tb")
    log(root, "C", "r2_samples_SetA_x.jsonl", [5])
    assert step() == ([], [])
    results(root, "A", "r1", "ta")
    log(root, "B", "r1_samples_SetA_x.jsonl", [3])
    log(root, "A", "r1_samples_SetB_x.jsonl", [4])
    paired = [("A", "r1", "paired")] * 2 + [("B", "r1", "paired")]
    held = [("A", "r1", "ta", 1), ("A", "r1", "ta", 2), ("A", "r1", "ta", 4), ("B", "r1", "tb", 3)]
    assert step(1) == (paired, held)
    log(root, "D", "r3_samples_SetA_x.jsonl", [6])
    before = step(1)
    assert before[1] == held
    log(root, "A", "r1_samples_SetC_x.jsonl", [7])
    assert ("D", "r3", "missing") in step(1)[0]
    results(root, "D", "r3", "td")
    pairs, rows = step()
    assert ("D", "r3", "paired") in pairs and pairs.count(("D", "r3", "missing")) == 1
    assert rows == sorted([*held, ("A", "r1", "ta", 7), ("D", "r3", "td", 6)])
