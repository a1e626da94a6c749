"""Sample logs: one JSON line per evaluated document, under ``<task dir>/<model>/``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.boxes import box_target
from scorelake.functions.numbers import first_response

DOC = (
    "STRUCT<taskID: STRING, label: STRING, image_file: STRING, mask_file: STRING, slice_dim: INT, slice_idx: INT, "
    "image_size_2d: ARRAY<INT>, ROI_area: DOUBLE, "
    "bounding_boxes: STRUCT<min_coords: ARRAY<ARRAY<DOUBLE>>, max_coords: ARRAY<ARRAY<DOUBLE>>, "
    "dimensions: ARRAY<ARRAY<DOUBLE>>>, "
    "biometric_profile: STRUCT<metric_type: STRING, metric_map_name: STRING, metric_key: STRING, "
    "metric_unit: STRING, metric_value: DOUBLE, metric_value_major_axis: ARRAY<DOUBLE>, "
    "metric_value_minor_axis: ARRAY<DOUBLE>>>"
)
# ``resps`` nests two or three deep, so it stays JSON text.
LOG_SCHEMA = (
    "doc_id BIGINT, target STRING, input STRING, resps STRING, filtered_resps ARRAY<STRING>, "
    f"doc_hash STRING, prompt_hash STRING, target_hash STRING, doc {DOC}"
)


def task_prefix(file_name: Column) -> Column:
    """What stands before ``_samples_``; a name without it stops the job."""
    found = F.regexp_extract(file_name, r"([^/\\]+)_samples_", 1)
    return F.when(found != "", found).otherwise(
        F.raise_error(F.concat(F.lit("no task in file name "), file_name))
    )


def dataset_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"samples_([^_]+)_", 1)


def logical_path(path: Column) -> Column:
    """Path of the log a file belongs to. A log written by Spark is a folder of part files, and a
    partition folder ``key=name`` counts as ``name``."""
    whole = F.regexp_replace(F.url_decode(path), r"/part-[^/]+$", "")
    return F.regexp_replace(whole, r"/\w+=([^/]+)", "/$1")


def file_attributes(path: Column) -> dict[str, Column]:
    """Model and file name of a logical path: the model is the folder of the file, or the one above if that is ``parsed``. By the
    parts of the path, as a search in the whole path tries every pair of places in it, for every line."""
    parts = F.split(path, "/")
    size = F.size(parts)

    def part(back: int) -> Column:
        return F.coalesce(F.get(parts, size - back), F.lit(""))

    model = F.when(part(1) == "", "").when((part(2) == "parsed") & (part(3) != ""), part(3)).otherwise(part(2))
    return {"model": F.when(path.isNotNull(), model), "file_name": F.element_at(parts, -1)}


def read_lines(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """Lines with where they stand: log, piece of the log (part file and split), and order inside it."""
    place = F.concat_ws(
        "#", F.col("_metadata.file_name"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")
    )
    return (
        spark.read.text(pattern)
        .select("value", logical_path(F.col("_metadata.file_path")).alias("file"), place.alias("block"))
        .withColumn("line", F.monotonically_increasing_id())
    )


def is_record(value: Column) -> Column:
    """Neither a blank line nor an empty JSON value."""
    return ~value.rlike(r'^\s*(\{\s*\}|\[\s*\]|""|null|false|0)?\s*$')


def parse_lines(lines: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Typed log rows with their file attributes. A malformed line stops the job."""
    schema = ", ".join([LOG_SCHEMA, *[f"{name} {kind}" for name, kind in (extra or {}).items()]])
    records = lines.filter(is_record(F.col("value")))
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    attributes = file_attributes(F.col("file"))
    return (
        records.withColumn("_row", row).withColumns(attributes)
        .withColumn("dataset", dataset_of(F.col("file_name")))
        .select("model", "file_name", "dataset", "file", "block", "line", "_row.*")
        .withColumn("response", first_response(F.col("resps")))
    )


def read_model_logs(spark: SparkSession, model_dir: str) -> DataFrame:
    """Every log of one model folder."""
    return parse_lines(read_lines(spark, f"{model_dir.rstrip('/')}/*.jsonl"))


def read_task_logs(spark: SparkSession, task_dir: str) -> DataFrame:
    """The logs of all models of a task folder in one scan; the model is a path segment."""
    return parse_lines(read_lines(spark, f"{task_dir.rstrip('/')}/*/*.jsonl"))


def read_parsed_logs(spark: SparkSession, task_dir: str) -> DataFrame:
    return parse_lines(
        read_lines(spark, f"{task_dir.rstrip('/')}/*/parsed/*.jsonl"), {"box_img_ratio": "double"}
    )


def read_results(spark: SparkSession, task_dir: str) -> DataFrame:
    """Long results (model, prefix, task, metric, value) of ``<prefix>_results.json`` files."""
    return read_results_files(spark, f"{task_dir.rstrip('/')}/*/*_results.json")


def read_results_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Long results of the files at the paths."""
    raw = spark.read.text(paths, wholetext=True).select(
        "value", logical_path(F.col("_metadata.file_path")).alias("file")
    )
    attributes = file_attributes(F.col("file"))
    body = F.from_json(
        "value", "results map<string,map<string,string>>", {"mode": "FAILFAST"}
    )["results"]
    return (
        raw.withColumns(attributes)
        .withColumn("prefix", F.regexp_replace("file_name", r"_results\.json$", ""))
        .select("model", "prefix", F.explode(body).alias("task", "metrics"))
        .select("model", "prefix", "task", F.explode("metrics").alias("metric", "value"))
    )


def paired_with_results(logs: DataFrame, results: DataFrame) -> DataFrame:
    """Logs with ``results_task``, the task of the results file beside them; a log without one stops the job."""
    known = results.select("model", "prefix", F.col("task").alias("results_task")).distinct()
    joined = logs.withColumn("prefix", task_prefix(F.col("file_name"))).join(known, ["model", "prefix"], "left")
    missing = F.raise_error(F.concat(F.lit("no results file for "), F.col("file_name")))
    return joined.withColumn("results_task", F.coalesce("results_task", missing))


def target_of(kind: str) -> Column:
    """Ground truth of a ``doc``: ``box``, ``lesion``, ``mask`` or ``biometric``, as an array of numbers."""
    first = F.lit(0)
    if kind == "box":
        boxes = F.col("doc.bounding_boxes")
        return box_target(
            F.get(boxes["min_coords"], first), F.get(boxes["max_coords"], first), F.col("doc.image_size_2d")
        )
    profile = F.col("doc.biometric_profile")
    if kind == "lesion":
        return F.array(
            F.get(profile["metric_value_major_axis"], first), F.get(profile["metric_value_minor_axis"], first)
        )
    if kind == "mask":
        return F.array(F.col("doc.ROI_area"))
    if kind == "biometric":
        return F.array(profile["metric_value"])
    raise ValueError("kind must be 'box', 'lesion', 'mask' or 'biometric'")
