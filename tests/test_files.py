"""Readers, writers and streams on files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from scorelake.operators.ranking import first_lines
from scorelake.sources import datasets, logs, sinks, tasks
from scorelake.streaming import incremental


def log_line(i, answer, target="[0.1, 0.1, 0.5, 0.5]", nested=False, **doc):
    resps = [[[answer]]] if nested else [[answer]]
    return json.dumps({"doc_id": i, "target": target, "resps": resps, "doc": {"taskID": "1", "label": "3", "slice_dim": 2, **doc}, "unknown": 1})


@pytest.fixture
def task_dir(tmp_path):
    model = tmp_path / "modelA"
    model.mkdir()
    good = [log_line(0, "0.1,0.1,0.5,0.5"), "", "{}", log_line(1, "x", nested=True), "  ", log_line(2, "1 2 3 0.2 0.2 0.6 0.6")]
    (model / "r1_samples_SetA_BoxCoordinate_Task01_Axial.jsonl").write_text("\n".join(good) + "\n")
    (model / "r1_results.json").write_text(json.dumps({"results": {"SetA_Box": {"alias": "a", "avgMAE,none": 0.5}}}))
    return tmp_path


def test_logs(spark, task_dir):
    rows = logs.read_task_logs(spark, str(task_dir)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["model"], r["dataset"], r["response"]) for r in rows][:2] == [
        (0, "modelA", "SetA", "0.1,0.1,0.5,0.5"), (1, "modelA", "SetA", "x"),
    ]
    assert rows[0]["doc"]["label"] == "3"
    paired = logs.paired_with_results(logs.read_model_logs(spark, f"{task_dir}/modelA"), logs.read_results(spark, str(task_dir)))
    assert {r["results_task"] for r in paired.collect()} == {"SetA_Box"}


def test_missing_results_and_bad_lines_stop_the_job(spark, task_dir):
    (task_dir / "modelA" / "r2_samples_SetA_x.jsonl").write_text(log_line(9, "1") + "\n")
    rows = logs.read_task_logs(spark, str(task_dir))
    with pytest.raises(Exception, match="no results file"):
        logs.paired_with_results(rows, logs.read_results(spark, str(task_dir))).collect()
    (task_dir / "modelA" / "r2_samples_SetA_x.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        logs.read_task_logs(spark, str(task_dir)).collect()


def test_first_lines_count_records_in_file_order(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    lines = []
    for i in range(5000):
        lines.append(log_line(i, "1"))
        if i % 7 == 0:
            lines.append("")
    (folder / "a_samples_S_x.jsonl").write_text("\n".join(lines) + "\n")
    (folder / "b_samples_S_x.jsonl").write_text("\n".join(log_line(i, "1") for i in range(3)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        raw = logs.read_lines(spark, f"{tmp_path}/*/*.jsonl")
        assert raw.select("file", "block").distinct().count() > 4
        kept = logs.parse_lines(first_lines(raw, 1234, logs.is_record(F.col("value"))))
        got = {}
        for r in kept.select("file_name", "doc_id").collect():
            got.setdefault(r["file_name"], []).append(r["doc_id"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got["a_samples_S_x.jsonl"]) == list(range(1234)) and sorted(got["b_samples_S_x.jsonl"]) == [0, 1, 2]


def test_task_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('{"t1": 5, "t2": 7}')
    assert {(r["task"], r["n"]) for r in tasks.read_task_list(spark, f"{tmp_path}/list.json").collect()} == {("t1", 5), ("t2", 7)}
    (tmp_path / "status.json").write_text('{"m": {"t1": true}}')
    assert tuple(tasks.read_task_status(spark, f"{tmp_path}/status.json").first()) == ("m", "t1", True)
    (tmp_path / "c.csv").write_text("a,1\n\n b ,2\n,3\n")
    assert [r["config"] for r in tasks.read_config_names(spark, f"{tmp_path}/c.csv").collect()] == ["a", "b"]


def test_task_configs_inherit(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(text)

    put("a/base.yaml", "output_type: generate_until\nx: base\ny: base\nfn: !function utils.f\n")
    put("a/other.yaml", "y: other\nz: other\n")
    put("a/mid.yaml", "include: base.yaml\nx: mid\n")
    put("a/task.yaml", "task: T\ntag: one,two\ninclude:\n- mid.yaml\n- other.yaml\nz: own\n")
    put("a/group.yaml", "group: G\ntask:\n- T\n- U\n")
    put("a/py.yaml", "task: P\nclass: !function p.C\n")
    put("a/loose.yaml", "- 1\n- 2\n")
    configs = tasks.resolved_configs(tasks.read_task_configs(spark, str(tmp_path)))
    own = {r["item"]: r["value"] for r in configs.filter(F.col("path").endswith("/task.yaml")).collect()}
    assert (own["x"], own["y"], own["z"], own["output_type"]) == ('"mid"', '"base"', '"own"', '"generate_until"')
    catalog = tasks.task_catalog(configs)
    assert {(r["name"], r["kind"], r["output_type"]) for r in catalog.collect()} == {
        ("T", "task", "generate_until"), ("G", "group", ""), ("P", "python_task", ""),
    }
    assert {(r["tag"], r["task"]) for r in tasks.tag_index(catalog).collect()} == {("one,two", "T")}
    assert {(r["parent"], r["child"]) for r in tasks.group_members(configs).collect()} == {("G", "T"), ("G", "U")}


def test_includes_of_any_name_depth_and_place(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(text)

    put("outside/far", "deep: far\n")
    put("in/shared", "include: ../outside/far\nx: shared\n")
    put("in/0.yaml", "include: shared\n")
    for i in range(1, 12):
        put(f"in/{i}.yaml", f"include: ./{i - 1}.yaml\n")
    put("in/task.yaml", "task: T\ngroup: [old, G]\ninclude: 11.yaml\n")
    put("in/group.yaml", "group: G\ntask:\n- T\n- {task: T, n: 1}\n- {task: T, n: 2}\n- {group: H, task: [U]}\n")
    configs = tasks.resolved_configs(tasks.read_task_configs(spark, f"{tmp_path}/in"))
    own = {r["item"]: r["value"] for r in configs.filter(F.col("path").endswith("/task.yaml")).collect()}
    assert (own["x"], own["deep"]) == ('"shared"', '"far"')
    assert {(r["tag"], r["task"]) for r in tasks.tag_index(tasks.task_catalog(configs)).collect()} == {("old", "T")}
    assert {(r["parent"], r["child"]) for r in tasks.group_members(configs).collect()} == {
        ("G", "T"), ("G", "T-1"), ("G", "H"), ("H", "U"),
    }
    put("in/lost.yaml", "include: nowhere.yaml\n")
    with pytest.raises(Exception, match="nowhere"):
        tasks.read_task_configs(spark, f"{tmp_path}/in").collect()
    put("loop/a.yaml", "include: b.yaml\n")
    put("loop/b.yaml", "include: a.yaml\n")
    with pytest.raises(ValueError, match="includes itself"):
        tasks.resolved_configs(tasks.read_task_configs(spark, f"{tmp_path}/loop"))


def test_image_questions_and_captions(spark, tmp_path):
    images = tmp_path / "images"
    images.mkdir()
    for i in (1, 2):
        (images / f"val_{i:012}.jpg").write_bytes(bytes([i]))
    (tmp_path / "val.json").write_text(json.dumps({"questions": [{"image_id": 1, "question": "q1", "answer": "a1"}]}))
    (tmp_path / "test.json").write_text(json.dumps({"questions": [{"image_id": 2, "question": "q2"}]}))
    splits = {"val": (f"{tmp_path}/val.json", str(images), "val"), "test": (f"{tmp_path}/test.json", str(images), "val")}
    rows = {r["split"]: r for r in datasets.image_questions(spark, splits).collect()}
    assert bytes(rows["val"]["image"]) == b"\x01" and rows["test"]["answer"] is None and rows["test"]["question"] == "q2"
    (images / "val_000000000002.jpg").rename(images / "moved.png")
    with pytest.raises(Exception, match="no image"):
        datasets.image_questions(spark, splits).collect()
    (tmp_path / "cap.json").write_text(json.dumps([{"video": "v", "caption": "c", "timestamp": [0.5, 1.25]}]))
    assert datasets.caption_rows(spark, f"{tmp_path}/cap.json").first()["timestamp"] == [0.5, 1.25]
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "clip.one.txt").write_text("﻿first line\nsecond")
    row = datasets.described_videos(spark, str(texts)).first()
    assert (row["video_name"], row["answer"]) == ("clip", "first line\n")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "t", 1.5), ("m", "u", None)], "model string, task string, mae double")
    sinks.write_parsed(df, f"{tmp_path}/parsed")
    sinks.write_parsed(df.filter("task = 't'").withColumn("mae", F.lit(9.0)), f"{tmp_path}/parsed")
    assert {(r["task"], r["mae"]) for r in spark.read.parquet(f"{tmp_path}/parsed").collect()} == {("t", 9.0), ("u", None)}
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert "m,u,NaN" in "".join(r["value"] + "\n" for r in spark.read.text(f"{tmp_path}/csv").collect())
    sinks.write_summary_json(df, f"{tmp_path}/json")
    assert any('"mae":null' in r["value"] for r in spark.read.text(f"{tmp_path}/json").collect())
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "o int, line string")
    sinks.write_report(lines, f"{tmp_path}/report", [F.col("o")])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()] == ["a", "b"]
    res = spark.createDataFrame([("t", "acc", 0.5)], "task string, metric string, value double")
    sinks.write_results(res, spark.createDataFrame([("t", "h")], "task string, task_hash string"), f"{tmp_path}/res")
    assert spark.read.parquet(f"{tmp_path}/res").first()["task_hash"] == "h"


def test_each_file_is_parsed_once(spark, task_dir):
    out, check = f"{task_dir}/out", f"{task_dir}/check"
    pattern = f"{task_dir}/*/*.jsonl"
    incremental.parse_new_files(spark, pattern, "Detection", out, check)
    assert spark.read.parquet(out).count() == 3
    incremental.parse_new_files(spark, pattern, "Detection", out, check)
    assert spark.read.parquet(out).count() == 3
    (task_dir / "modelA" / "r1_samples_SetB_x.jsonl").write_text(log_line(7, "0 0 1 1") + "\n")
    incremental.parse_new_files(spark, pattern, "Detection", out, check)
    rows = {r["doc_id"]: r for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == [0, 1, 2, 7] and rows[0]["iou"] == pytest.approx(1, abs=1e-6) and rows[1]["success"] is False


def test_running_summary(spark, task_dir):
    out, check = f"{task_dir}/sum", f"{task_dir}/sumcheck"
    pattern = f"{task_dir}/*/*.jsonl"
    totals = {"n": F.count("*"), "ok": F.count("mae")}
    for name, want in (("", (3, 2)), ("r1_samples_SetC_x.jsonl", (4, 3))):
        if name:
            (task_dir / "modelA" / name).write_text(log_line(8, "0 0 1 1") + "\n")
        scored = incremental.scored_lines(incremental.stream_lines(spark, pattern), "Detection")
        incremental.running_summary(scored, ["model"], totals, out, check)
        r = incremental.current_summary(spark, out, ["model"]).first()
        assert (r["n"], r["ok"]) == want


def test_long_reports_are_parts_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "REPORT_LINES", 50)
    for n in (50, 51):
        lines = spark.range(n).select("id", F.format_string("line %03d", "id").alias("line")).repartition(4)
        sinks.write_report(lines, f"{tmp_path}/r{n}", [F.col("id")])
        parts = sorted((tmp_path / f"r{n}").glob("part-*"))
        assert len(parts) == 1 or n == 51  # small parts may be merged
        assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"line {i:03d}" for i in range(n)]


def test_attributes_of_every_shape_of_path(spark):
    paths = ["/a/b/m/x.jsonl", "m/x", "x", "", "/", "/x", "a/", "a//x", "m/parsed/x", "parsed/x", "/parsed/x", "a/parsed/parsed/x", "m/parsed/", "//parsed/x", "m/x y.jsonl", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    found = df.select("p", F.regexp_extract("p", r"([^/]+)/(?:parsed/)?[^/]+$", 1).alias("want"), *[c.alias(n) for n, c in logs.file_attributes(F.col("p")).items()])
    for r in found.collect():
        assert r.model == r.want and r.file_name == (None if r.p is None else r.p.split("/")[-1]), r.p
    # A search for the model from every place of the path took most of the time of reading a log.
    assert "regexp_extract" not in df.select(logs.file_attributes(F.col("p"))["model"])._jdf.queryExecution().toString()


def test_batches_of_logs_are_written_by_many_tasks(spark, monkeypatch):
    from scorelake.plans import files

    class Seen(Exception):
        pass

    def write_logs(lines, *_):
        raise Seen(lines.rdd.getNumPartitions())

    monkeypatch.setattr(files.sinks, "write_logs", write_logs)
    monkeypatch.setattr(files, "log_lines", lambda *_: spark.range(100, numPartitions=4).withColumnRenamed("id", "doc_id"))
    with pytest.raises(Seen) as seen:
        files.summary_of_compacted_batches(spark, "")
    assert seen.value.args == (4,)
