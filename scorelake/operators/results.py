"""Result tables: metrics with their errors, hashes, per-sample tables, latest runs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.functions.strings import drop_default_filter, fixed, pad, run_task, run_time, sanitize_task_name
from scorelake.functions.textscores import arg_max


def flat_results(results: DataFrame) -> DataFrame:
    """(key, number, text): ``task/metric`` keys without ``,none``; values that are no numbers go to ``text``."""
    key = F.concat(F.col("task"), F.lit("/"), drop_default_filter(F.col("metric")))
    number = F.col("value").try_cast("double")
    return results.select(
        key.alias("key"), number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text")
    )


def with_errors(results: DataFrame) -> DataFrame:
    """Pair ``metric,filter`` values with their ``metric_stderr,filter`` twin; ``alias`` rows are left out."""
    parts = results.withColumn("name", F.substring_index("metric", ",", 1)).withColumn(
        "filter", F.when(F.contains("metric", F.lit(",")), F.regexp_extract("metric", "^[^,]*,(.*)$", 1)).otherwise("")
    )
    is_error = F.col("name").endswith("_stderr")
    errors = parts.filter(is_error).select(
        "task", "filter", F.regexp_replace("name", "_stderr$", "").alias("name"), F.col("value").alias("stderr")
    )
    values = parts.filter(~is_error & (F.col("name") != "alias"))
    return values.join(errors, ["task", "filter", "name"], "left").select(
        "task", "filter", F.col("name").alias("metric"), "value", "stderr"
    )


def content_hashes(samples: DataFrame, doc: Column, prompt: Column, target: Column) -> DataFrame:
    return samples.withColumns(
        {
            "doc_hash": F.sha2(doc, 256), "prompt_hash": F.sha2(prompt, 256), "target_hash": F.sha2(target, 256),
        }
    )


# Hexadecimal digits of a row digest that are added up as one number, and how many such numbers there are.
DIGITS, NUMBERS = 15, 4


def task_hashes(samples: DataFrame, by: Sequence[str], order: str, row_hash: Column) -> DataFrame:
    """One hash per task over its row hashes and their places; ``order`` is a unique whole number.

    Every row hash is hashed with its place; the task's hash is that of the count and the sums of four pieces
    of those digests. Sums merge in any order, so tasks of all sizes go through one aggregate that is combined
    before the shuffle, and equal rows in equal places give equal hashes.
    """
    tagged = samples.select(*by, F.sha2(F.concat_ws(":", F.col(order).cast("string"), row_hash), 256).alias("_digest"))
    parts = [
        F.sum(F.conv(F.substring("_digest", 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(38,0)")).cast("string")
        for i in range(NUMBERS)
    ]
    together = F.concat_ws(":", F.count("*").cast("string"), *parts)
    return tagged.groupBy(*by).agg(F.sha2(together, 256).alias("task_hash"))


def sample_table(samples: DataFrame, output_type: str, metrics: Sequence[str]) -> DataFrame:
    """Flat per-sample table: id, prompt, its length, label, raw and filtered prediction, metrics.

    Multiple-choice rows carry one value per choice and predict the greatest.
    """
    if output_type == "multiple_choice":
        raw, kept = arg_max(F.col("resps")), arg_max(F.col("filtered_resps"))
        numbered = F.transform("choices", lambda c, i: F.concat(i.cast("string"), F.lit(". "), c))
        extra = [F.array_join(numbered, "\n").alias("choices")]
    else:
        raw, kept, extra = F.get("resps", F.lit(0)), F.get("filtered_resps", F.lit(0)), []
    return samples.select(
        F.col("doc_id").alias("id"), F.col("input").alias("data"), *extra,
        F.char_length("input").alias("input_len"), F.col("target").alias("labels"),
        F.lit(output_type).alias("output_type"), raw.alias("raw_predictions"), kept.alias("filtered_predictions"),
        *metrics,
    )


def latest_runs(files: DataFrame, model: str = "model", name: str = "file_name") -> DataFrame:
    """Latest run time per model and task, with one ``results`` row per model; times compare as text."""
    parsed = files.select(
        F.col(model).alias("model"), sanitize_task_name(run_task(F.col(name))).alias("task"), run_time(F.col(name)).alias("time")
    )
    tasks = parsed.groupBy("model", "task").agg(F.max("time").alias("latest"))
    whole = parsed.groupBy("model").agg(F.max("time").alias("latest")).withColumn("task", F.lit("results"))
    return tasks.unionByName(whole)


def report_lines(
    labels: DataFrame, name: str, values: Sequence[str], width: int = 50, decimals: int = 4, keep: Sequence[str] = ()
) -> DataFrame:
    """Fixed-width report lines, groups with most samples first. One line per label of the table."""
    cells = [pad(F.col(name), width), *[fixed(F.col(v), decimals, 8) for v in values], pad(F.col("num_samples").cast("string"), 8)]
    line = F.concat_ws(" | ", *cells)
    return labels.select(*keep, name, "num_samples", line.alias("line")).orderBy(F.desc("num_samples"), name)


# Names and order of the metrics in a model's lines, and their columns.
MODEL_LINE = (
    ("Recall", "recall"), ("Precision", "precision"), ("F1", "f1"), ("IoU", "iou"), ("SuccessRate", "success_rate"),
    ("IoU>0.5", "iou_ge_50"), ("F1>0.5", "f1_ge_50"),
)


def model_lines(compared: DataFrame, columns: Sequence[tuple[str, str]] = MODEL_LINE, model: str = "model") -> DataFrame:
    """(model, place, line): each model's title, its underline and a line for each kind, in order of ``place``.

    ``compared`` has one row per model and kind (``anatomy``, ``T/L``) with the metrics, total_samples and num_regions.
    """
    title = F.concat(F.lit("Model: "), F.col(model))
    heads = compared.select(model).distinct().select(
        model, F.explode(F.array(
            F.struct(F.lit(0).alias("place"), F.concat(F.lit("\n"), title).alias("line")),
            F.struct(F.lit(1).alias("place"), F.repeat(F.lit("-"), F.char_length(title)).alias("line")),
        )).alias("_r"),
    ).select(model, "_r.*")
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{name}="), fixed(F.col(c), 3)) for name, c in columns])
    counts = F.format_string("(%2d regions, %4d samples): ", F.col("num_regions").cast("bigint"), F.col("total_samples").cast("bigint"))
    line = F.concat(F.lit("  "), pad(F.upper("kind"), 8), F.lit(" "), counts, shown)
    kinds = compared.select(model, F.when(F.col("kind") == "anatomy", 2).otherwise(3).alias("place"), line.alias("line"))
    return heads.unionByName(kinds)


def label_section(labels: DataFrame, name: str, values: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by, place, line): the label table of a report with its title, column names, rule and end, groups with most
    samples first. ``values`` are (title, column). Each section is numbered on its own, as many lines as labels."""
    cells = [pad(F.lit("Label"), 50), *[pad(F.lit(t), 8) for t, _ in values], pad(F.lit("Samples"), 8)]
    width = 50 + 11 * (len(values) + 1) + 1
    fixed_lines = [(0, F.lit("\nLabel-specific metrics:")), (1, F.concat_ws(" | ", *cells)), (2, F.lit("-" * width))]
    end = F.lit("\n" + "=" * 100 + "\n")
    sizes = labels.groupBy(*by).agg(F.count("*").alias("_n"))
    frame = sizes.select(*by, F.explode(F.array(
        *[F.struct(F.lit(k).cast("bigint").alias("place"), line.alias("line")) for k, line in fixed_lines],
        F.struct((F.col("_n") + 3).alias("place"), end.alias("line")),
    )).alias("_r")).select(*by, "_r.*")
    lines = report_lines(labels.select(*by, F.col(name).alias("_label"), "num_samples", *[c for _, c in values]), "_label", [c for _, c in values], keep=by)
    order = Window.partitionBy(*by).orderBy(F.desc("num_samples"), "_label")
    body = lines.select(*by, (F.row_number().over(order) + 2).cast("bigint").alias("place"), "line")
    return frame.unionByName(body)
