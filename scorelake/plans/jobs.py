"""Whole jobs on a folder of logs: parse, summarise, report, and prepare training tables.

Plan tables (labels, modalities, landmarks of a task) are arguments, as they come from outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import prompts
from scorelake.functions.boxes import box_image_ratio, ratio_bin
from scorelake.functions.numbers import answer_length, last_numbers, last_numbers_text, parse_target
from scorelake.functions.scoring import METRICS, with_scores
from scorelake.functions.strings import float_text
from scorelake.operators import assembly, baseline, lookups, results, summaries
from scorelake.operators.ranking import first_lines
from scorelake.sources import logs, sinks


def read_logs(spark: SparkSession, task_dir: str, limit: int | None = None, skip_models: Sequence[str] = ()) -> DataFrame:
    """Logs of every model of a task folder, the first ``limit`` records of each."""
    lines = logs.read_lines(spark, f"{task_dir.rstrip('/')}/*/*.jsonl")
    if limit is not None:
        lines = first_lines(lines, limit, logs.is_record(F.col("value")))
    rows = logs.parse_lines(lines)
    return rows.filter(~F.col("model").isin(*skip_models)) if skip_models else rows


def scored_logs(rows: DataFrame, task_kind: str, on_failure: str = "null") -> DataFrame:
    """Answers pulled out of the responses, with their scores."""
    k = answer_length(task_kind)
    text = F.coalesce("response", F.lit(""))
    answered = rows.withColumns({"answer": last_numbers_text(text, k), "task_id": F.col("doc.taskID").cast("int")})
    parsed = answered.withColumns({"_pred": last_numbers(text, k), "_target": parse_target(F.col("target"))})
    scored = with_scores(parsed, F.col("_pred"), F.col("_target"), task_kind, on_failure)
    if task_kind == "Detection":
        ratio = box_image_ratio(F.col("doc.bounding_boxes.dimensions"), F.col("doc.image_size_2d"), F.col("_target"))
        scored = scored.withColumn("box_img_ratio", ratio)
    return scored.drop("_pred", "_target")


def parse_task(spark: SparkSession, task_dir: str, task_kind: str, out: str, limit: int | None = None) -> DataFrame:
    """Parse and score all logs of a task folder into a table by model and task, and summarise each log.

    The scored table is written once and the summary reads it back, so the logs are scanned once.
    """
    rows = logs.paired_with_results(read_logs(spark, task_dir, limit), logs.read_results(spark, task_dir))
    scored = scored_logs(rows, task_kind).withColumnRenamed("results_task", "task").drop("block", "line")
    sinks.write_parsed(scored, f"{out}/rows")
    summary = summaries.summarise_parse_stage(spark.read.parquet(f"{out}/rows"), ["model", "task", "file_name"], task_kind)
    sinks.write_summary(summary, f"{out}/summary", ["model", "task", "file_name"])
    return summary


def detection_rows(rows: DataFrame, plan_label: DataFrame, plan_task: DataFrame) -> DataFrame:
    """Scored rows with the group they are reported in; failed answers count as no overlap."""
    labelled = scored_logs(rows, "Detection", "zero").withColumn("label", F.col("doc.label"))
    named = lookups.with_anatomy(lookups.with_plan_label(labelled, plan_label, plan_task))
    return named.withColumn(
        "group_name", lookups.group_key(F.col("anatomy"), F.col("modality"), F.col("doc.slice_dim"))
    )


def summarise_detection_task(
    spark: SparkSession, task_dir: str, plan_label: DataFrame, plan_task: DataFrame, out: str, limit: int | None = None
) -> DataFrame:
    """Summaries per group, per size bin and label, and the table over all models, written below ``out``."""
    rows = detection_rows(read_logs(spark, task_dir, limit, ["random_detection"]), plan_label, plan_task)
    keep = ["model", "group_name", "anatomy", "modality", "box_img_ratio", *METRICS["Detection"], "success"]
    rows.select(*keep).write.mode("overwrite").parquet(f"{out}/values")
    values = spark.read.parquet(f"{out}/values")
    groups = summaries.summarise_detection(values, ["model", "group_name"])
    groups.write.mode("overwrite").parquet(f"{out}/groups")
    label = F.concat("anatomy", F.lit(" @ "), lookups.modality_code(F.col("modality")))
    binned = values.withColumns({"size_bin": ratio_bin(F.col("box_img_ratio")), "label": label})
    sinks.write_csv(binned.select("model", "size_bin", "label", "box_img_ratio", "iou", "f1", "precision", "recall"), f"{out}/per_sample")
    sinks.write_csv(summaries.box_size_by_label(binned, ["model"]), f"{out}/size_by_label")
    compared = summaries.anatomy_against_lesion(
        spark.read.parquet(f"{out}/groups"), summaries.MODEL_TABLE_METRICS, by=["model"]
    )
    table = summaries.model_table(compared)
    sinks.write_summary_json(table, f"{out}/all_models")
    return table


def random_detection(
    spark: SparkSession, task_dir: str, model: str, simulations: int = baseline.SIMULATIONS
) -> DataFrame:
    """Random-box scores on the targets of one model's logs."""
    rows = scored_logs(logs.read_model_logs(spark, f"{task_dir.rstrip('/')}/{model}"), "Detection")
    inputs = rows.select(
        F.xxhash64("file", "doc_id").alias("key"), parse_target(F.col("target")).alias("target"),
        F.col("doc.image_size_2d").alias("image_size_2d"), "box_img_ratio",
    )
    return baseline.random_baseline(inputs, "key", simulations)


def _relative_report(labels: DataFrame, out: str) -> None:
    values = ["avg_mae", "avg_mre", "success_rate", "mre_lt_10", "mre_lt_20", "mre_lt_30"]
    named = labels.withColumn("name", F.concat_ws(" ", "model", "label"))
    lines = results.report_lines(named, "name", values)
    sinks.write_report(lines, f"{out}/report", [F.desc("num_samples"), F.col("name")])


def summarise_angle_distance_task(spark: SparkSession, task_dir: str, out: str, limit: int | None = None) -> DataFrame:
    """Summaries per measurement and model, written with a text report; returns the overall averages."""
    rows = read_logs(spark, task_dir, limit).filter(summaries.angle_distance_file(F.col("file_name")))
    profile = F.col("doc.biometric_profile")
    label = summaries.measurement_label(F.col("dataset"), profile["metric_type"], profile["metric_key"])
    scored = scored_logs(rows, "AD").withColumn("label", label)
    summaries.summarise_relative(scored, ["model", "label"]).write.mode("overwrite").parquet(f"{out}/labels")
    labels = spark.read.parquet(f"{out}/labels")
    _relative_report(labels, out)
    sinks.write_summary(summaries.measurement_averages(labels, ["model"]), f"{out}/measurements", ["model", "measurement"])
    return summaries.overall_angle_distance(labels, ["model"])


def summarise_lesion_task(
    spark: SparkSession, task_dir: str, plan_label: DataFrame, plan_task: DataFrame, out: str, limit: int | None = None
) -> DataFrame:
    """Summaries per lesion label and model, written with a text report; returns the overall averages."""
    scored = scored_logs(read_logs(spark, task_dir, limit), "TL")
    named = lookups.with_anatomy(lookups.with_target_label(scored, plan_label, plan_task))
    label = lookups.group_key(F.col("reported"), F.col("modality"), F.col("doc.slice_dim"))
    keyed = named.withColumn("label", label)
    summaries.summarise_relative(keyed, ["model", "label"]).write.mode("overwrite").parquet(f"{out}/labels")
    labels = spark.read.parquet(f"{out}/labels")
    _relative_report(labels, out)
    return summaries.overall_lesion(labels, ["model"])


def training_messages(docs: DataFrame, kind: str, prompt: Column, target: Column) -> DataFrame:
    """Chat messages of training rows: boxes and lesions with three decimals, measurements as spelled."""
    if kind == "AD":
        answer = float_text(F.get(target, F.lit(0)))
    else:
        answer = prompts.numbers_answer(target, answer_length(kind))
    return docs.withColumn("messages", prompts.chat_messages(prompt, answer))


def training_table(parts: Sequence[DataFrame], key: str, train: int, validation: int, seed: int) -> DataFrame:
    """Union of formatted tasks, split exactly and cut to the wanted sizes, with training columns only."""
    split = assembly.limited_split(assembly.union_all(parts), train, validation, key, seed)
    return assembly.keep_training_columns(split, extra=["split"])
