"""Whole jobs on a small task folder."""

import json

import pytest
from pyspark.sql import functions as F

from scorelake.functions import prompts, strings
from scorelake.operators import summaries
from scorelake.plans import jobs
from scorelake.sources import logs


def write_log(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"r_samples_{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    (folder / "r_results.json").write_text(json.dumps({"results": {f"task_{name}": {"alias": name}}}))


def box_row(i, answer):
    return {
        "doc_id": i, "target": "[0.1, 0.1, 0.5, 0.5]", "resps": [[answer]],
        "doc": {"taskID": "1", "label": "1" if i % 2 else "2", "slice_dim": 2, "image_size_2d": [100, 100],
                "bounding_boxes": {"dimensions": [[40, 40]]}},
    }


@pytest.fixture
def plan(spark):
    labels = spark.createDataFrame(
        [("SetA", 1, "1", "liver"), ("SetA", 1, "2", "liver tumor")], "dataset string, task_id int, label string, label_name string"
    )
    task = spark.createDataFrame([("SetA", 1, "CT", "2")], "dataset string, task_id int, image_modality string, target_label string")
    return labels, task


def test_detection_job(spark, tmp_path, plan):
    for model, answer in (("good", "0.1,0.1,0.5,0.5"), ("bad", "nothing")):
        write_log(tmp_path / "in" / model, "SetA_BoxCoordinate_Task01_Axial", [box_row(i, answer if i % 4 else "no") for i in range(240)])
    summary = jobs.parse_task(spark, str(tmp_path / "in"), "Detection", str(tmp_path / "parsed"))
    got = {r["model"]: r for r in summary.collect()}
    assert got["good"]["num_samples"] == 240 and got["good"]["success_rate"] == 0.75 and got["good"]["avg_iou"] == pytest.approx(1, abs=1e-6)
    assert got["bad"]["avg_iou"] is None
    table = jobs.summarise_detection_task(spark, str(tmp_path / "in"), *plan, str(tmp_path / "out"))
    rows = {(r["model"], r["kind"]): r for r in table.collect()}
    assert rows[("good", "anatomy")]["iou"] == pytest.approx(1, abs=1e-6)
    assert rows[("good", "T/L")]["iou"] == pytest.approx(0.5, abs=1e-6) and rows[("bad", "T/L")]["iou"] == 0
    sized = spark.read.option("header", "true").csv(str(tmp_path / "out" / "size_by_label")).collect()
    assert {r["size_bin"] for r in sized} == {"0.15~0.20"} and {r["label"] for r in sized} == {"Liver @ CT", "Liver Tumor/Lesion @ CT"}
    limited = jobs.read_logs(spark, str(tmp_path / "in"), limit=10)
    assert limited.groupBy("model").count().select("count").distinct().first()[0] == 10
    guess = jobs.random_detection(spark, str(tmp_path / "in"), "good", 10).collect()
    assert len(guess) == 1 and guess[0]["num_samples"] == 240 and 0 < guess[0]["iou"] < 0.5 and "mre_lt_10" in guess[0].asDict()


def test_angle_distance_job(spark, tmp_path):
    rows = [
        {"doc_id": i, "target": "10.0", "resps": [["about 11"]] if i else [["?"]],
         "doc": {"taskID": "1", "biometric_profile": {"metric_type": "distance", "metric_key": "M1", "metric_value": 10.0}}}
        for i in range(4)
    ]
    write_log(tmp_path / "in" / "m", "FeTA24_BiometricsFromLandmarks_Task01_Axial", rows)
    (tmp_path / "in" / "m" / "r_samples_Other_Task01.jsonl").write_text(json.dumps(rows[1]) + "\n")
    overall = jobs.summarise_angle_distance_task(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    assert overall["total_samples"] == 4 and overall["weighted_mae"] == pytest.approx(1) and overall["weighted_success"] == 0.75
    report = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert report[0].startswith("m FeTA24_distance_M1") and "| 1.0000   | 0.1000   | 0.7500" in report[0]


def test_lesion_job(spark, tmp_path, plan):
    rows = [{"doc_id": i, "target": "[10.0, 5.0]", "resps": [[["11 and 6"]]], "doc": {"taskID": "1", "slice_dim": 0}} for i in range(3)]
    write_log(tmp_path / "in" / "m", "SetA_TumorLesionSize_Task01_Axial", rows)
    overall = jobs.summarise_lesion_task(spark, str(tmp_path / "in"), *plan, str(tmp_path / "out")).first()
    assert overall["weighted_mae"] == pytest.approx(1) and overall["weighted_mre"] == pytest.approx(0.15)


def test_training_job(spark):
    docs = spark.range(50).select(
        F.col("id"), F.lit("img.nii").alias("image_file"), F.lit(2).alias("slice_dim"), F.lit(1).alias("slice_idx"),
        F.array(F.lit(0.12345), F.lit(0.2), F.lit(0.3), F.lit(0.4)).alias("t"), F.lit("x").alias("dropped"),
    )
    boxes = jobs.training_messages(docs, "Detection", prompts.box_prompt(F.lit("a CT"), F.lit("liver")), F.col("t"))
    angles = jobs.training_messages(docs.withColumn("id", F.col("id") + 100), "AD", F.lit("ask"), F.array(F.lit(12.5)))
    out = jobs.training_table([boxes, angles], "id", 60, 20, 1)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 60, "validation": 20}
    assert set(out.columns) == {"messages", "image_file", "slice_dim", "slice_idx", "split"}
    answers = {r["messages"][1]["content"][0]["text"] for r in out.collect()}
    assert answers == {"0.123, 0.200, 0.300, 0.400", "12.5"}


def test_float_text_is_spelled_as_python_does(spark):
    values = [12.5, 0.0005, 1e-5, 12345678.9, 1e16, 1.5e20, 0.1, 100.0, -0.00025, 3.0e7, 0.0, 123456789012345.6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(strings.float_text(F.col("v"))).collect()] == [str(v) for v in values]


def test_admitted_files_and_targets(spark):
    names = ["r_samples_Ceph-Biometrics-400_x.jsonl", "r_samples_FeTA24_BiometricsFromLandmarks_Task01_y.jsonl", "r_samples_FeTA24_z.jsonl"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(summaries.angle_distance_file(F.col("n"))).collect()] == [True, True, False]
    with pytest.raises(ValueError):
        logs.target_of("other")
