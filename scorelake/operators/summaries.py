"""Summaries of scored rows, and the averages of averages built on them.

Every aggregate here is a sum, a count or a ratio of them, so Spark combines rows within each task
before it shuffles and a hot group costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups left out of the anatomy/lesion comparison, and what marks a lesion.
MINIMUM_GROUP_SIZE = 50
EXCLUDED_WORDS = ("miscellaneous", "others")
LESION_WORDS = ("tumor", "lesion", "metastatic")

TENTHS = range(1, 11)
OVERLAP_STEPS = (50, 60, 70, 80, 90)


def share(condition: Column) -> Column:
    """Share of all rows of the group, failed ones included."""
    return F.count(F.when(condition, 1)) / F.count("*")


def share_of(condition: str, name: str) -> Column:
    """As :func:`share`, from a condition in SQL: one call where dozens of shares are asked for."""
    return F.expr(f"count(CASE WHEN {condition} THEN 1 END) / count(*)").alias(name)


def error_bin(value: Column, negative: str = "wrap") -> Column:
    """Tenth a value falls in, 0 to 9; the last is open.

    Values at or below -0.1 count from the end (-0.5 lands in 5), as list positions do, and below -1.0
    stop the job; ``negative="clamp"`` puts them in bin 0 instead.
    """
    place = F.when(value.isNotNull(), F.least(value * 10, F.lit(9.0)).cast("int"))
    if negative == "clamp":
        return F.when(place.isNotNull(), F.greatest(place, F.lit(0)))
    if negative != "wrap":
        raise ValueError("negative must be 'wrap' or 'clamp'")
    return (
        F.when(place >= 0, place)
        .when(place >= -10, place + 10)
        .when(place < -10, F.raise_error(F.lit("error below -1.0 has no bin")).cast("int"))
    )


def summarise_parse_stage(rows: DataFrame, by: Sequence[str], task_kind: str) -> DataFrame:
    """Averages over valid rows, success over all rows, and for relative errors the share below each
    tenth; an error of 1 or more is in none of them."""
    metrics = [F.avg("mae").alias("avg_mae")]
    if task_kind == "Detection":
        metrics.append(F.avg("iou").alias("avg_iou"))
    else:
        metrics.append(F.avg("mre").alias("avg_mre"))
        metrics += [share(F.col("mre") < k / 10).alias(f"mre_lt_{k * 10}") for k in TENTHS]
    metrics.append(F.avg(F.col("success").cast("double")).alias("success_rate"))
    metrics.append(F.count("*").alias("num_samples"))
    return rows.groupBy(*by).agg(*metrics)


def summarise_relative(rows: DataFrame, by: Sequence[str], negative: str = "wrap") -> DataFrame:
    """Angle/distance and lesion summaries. Shares come from bins whose last one is open, so the share
    below 100 equals the share of valid rows."""
    return rows.withColumn("_tenth", error_bin(F.col("mre"), negative)).groupBy(*by).agg(
        F.avg("mae").alias("avg_mae"),
        F.avg("mre").alias("avg_mre"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.count("*").alias("num_samples"),
        *[share_of(f"_tenth < {k}", f"mre_lt_{k * 10}") for k in TENTHS],
    )


def summarise_detection(rows: DataFrame, by: Sequence[str], error_prefix: str = "mae") -> DataFrame:
    """Detection summaries. ``iou_ge_50`` is the share at or above 0.5. The random baseline reports the
    same error shares under another prefix. The bin is a column of its own so that it is found once."""
    return rows.withColumn("_tenth", error_bin(F.col("mae"))).groupBy(*by).agg(
        F.avg("mae").alias("avg_mae"),
        *[F.avg(m).alias(m) for m in ("iou", "f1", "precision", "recall")],
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.count("*").alias("num_samples"),
        *[share_of(f"_tenth < {k}", f"{error_prefix}_lt_{k * 10}") for k in TENTHS],
        *[
            share_of(f"{m} >= {step / 100}D", f"{m}_ge_{step}")
            for m in ("iou", "f1", "precision", "recall") for step in OVERLAP_STEPS
        ],
    )


def finite(value: Column) -> Column:
    """The value, or null for NaN and infinity."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean weighted over the rows that have a value."""
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0))


def diluted_mean(value: Column, weight: Column) -> Column:
    """Missing values add nothing to the sum but their weight still counts, which pulls the mean down."""
    return F.coalesce(F.sum(value * weight), F.lit(0.0)) / F.nullif(F.sum(weight), F.lit(0))


def anatomy_or_lesion(group: Column, size: Column) -> Column:
    """``anatomy`` or ``T/L``; null for catch-all groups and groups too small to count."""
    name = F.lower(group)

    def has(words: Sequence[str]) -> Column:
        return name.rlike("|".join(words))

    kind = F.when(has(LESION_WORDS), F.lit("T/L")).otherwise(F.lit("anatomy"))
    return F.when(~has(EXCLUDED_WORDS) & (size >= MINIMUM_GROUP_SIZE), kind)


def anatomy_against_lesion(
    groups: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), group: str = "group_name"
) -> DataFrame:
    """Sample-weighted means of per-group metrics for anatomy and for tumour/lesion groups."""
    kind = anatomy_or_lesion(F.col(group), F.col("num_samples"))
    return (
        groups.withColumn("kind", kind).filter(F.col("kind").isNotNull()).groupBy(*by, "kind")
        .agg(
            *[weighted_mean(finite(F.col(m)), F.col("num_samples")).alias(m) for m in metrics],
            F.sum("num_samples").alias("total_samples"),
            F.count("*").alias("num_regions"),
            F.array_sort(F.collect_set(group)).alias("regions"),
        )
    )


# Metrics of the table over all models.
MODEL_TABLE_METRICS = ("recall", "precision", "f1", "iou", "success_rate", "iou_ge_50", "f1_ge_50")


def model_table(compared: DataFrame) -> DataFrame:
    """Per model and kind, the metrics models are compared by."""
    return compared.select("model", "kind", *MODEL_TABLE_METRICS, "total_samples", "num_regions")


def overall_angle_distance(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overall averages: error means keep the weight of labels without a value, share means do not."""
    n = F.col("num_samples")
    return labels.filter(n > 0).groupBy(*by).agg(
        diluted_mean(F.col("avg_mae"), n).alias("weighted_mae"),
        diluted_mean(F.col("avg_mre"), n).alias("weighted_mre"),
        diluted_mean(F.col("success_rate"), n).alias("weighted_success"),
        *[weighted_mean(F.col(f"mre_lt_{k}"), n).alias(f"weighted_mre_lt_{k}") for k in (10, 20, 30)],
        F.sum(n).alias("total_samples"),
    )


def merge_labels(labels: DataFrame, by: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """Fold rows of one label into one, in the order of ``order``.

    A value met so far weighs with all samples so far, also those of rows that had none; the first value met stands
    as it is. One row per task kind goes in, so the ordered list of a label is short.
    """
    cells = [F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias(v) for v in values]
    row = F.struct(F.col(order).alias("_order"), F.col("num_samples").cast("double").alias("_n"), *cells)
    listed = labels.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.sum("num_samples").alias("num_samples"))
    start = F.struct(F.lit(0.0).alias("_n"), *[F.lit(None).cast("double").alias(v) for v in values])

    def fold(acc: Column, x: Column) -> Column:
        total = acc["_n"] + x["_n"]
        merged = [
            F.when(acc[v].isNotNull() & x[v].isNotNull(), (acc[v] * acc["_n"] + x[v] * x["_n"]) / total)
            .otherwise(F.coalesce(acc[v], x[v])).alias(v) for v in values
        ]
        return F.struct(total.alias("_n"), *merged)

    folded = listed.withColumn("_f", F.aggregate("_rows", start, fold))
    return folded.select(*by, *[F.col(f"_f.{v}").alias(v) for v in values], "num_samples")


def overall_lesion(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overall averages where labels without a relative error are left out of everything."""
    return overall_angle_distance(labels.filter(F.col("avg_mre").isNotNull() & ~F.isnan("avg_mre")), by)


# Label prefixes of the reported measurement groups.
MEASUREMENT_GROUPS = (
    ("FeTA24_distance", "FeTA-Distance"),
    ("Ceph-Biometrics-400_angle", "Ceph-Angle"),
    ("Ceph-Biometrics-400_distance", "Ceph-Distance"),
)


def measurement_group(label: Column, groups: Sequence[tuple[str, str]] = MEASUREMENT_GROUPS) -> Column:
    chosen = F.when(F.lit(False), F.lit(""))
    for marker, name in groups:
        chosen = chosen.when(F.contains(label, F.lit(marker)), F.lit(name))
    return chosen


def measurement_averages(
    labels: DataFrame, by: Sequence[str] = (), groups: Sequence[tuple[str, str]] = MEASUREMENT_GROUPS
) -> DataFrame:
    """Averages per measurement group, each metric over the samples of labels that have it."""
    n = F.col("num_samples")
    values = ("avg_mae", "avg_mre", "success_rate", "mre_lt_10", "mre_lt_20", "mre_lt_30")
    return (
        labels.withColumn("measurement", measurement_group(F.col("label"), groups))
        .filter(F.col("measurement").isNotNull() & (n > 0)).groupBy(*by, "measurement")
        .agg(*[weighted_mean(F.col(v), n).alias(v) for v in values], F.sum(n).alias("num_samples"))
    )


# Files admitted to the angle/distance summary.
def angle_distance_file(file_name: Column) -> Column:
    return F.contains(file_name, F.lit("Ceph-Biometrics-400")) | F.contains(
        file_name, F.lit("FeTA24_BiometricsFromLandmarks_Task01")
    )


def measurement_label(dataset: Column, metric_type: Column, metric_key: Column) -> Column:
    missing = F.raise_error(F.lit("metric key is missing"))
    return F.concat_ws(
        "_", dataset, F.coalesce(metric_type, F.lit("")), F.coalesce(metric_key, missing)
    )


def half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest whole number (even on ties), scale back, all in binary."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def box_size_by_label(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean overlap per box-size bin and label, rounded half to even at six decimals."""
    return rows.groupBy(*by, "size_bin", "label").agg(
        half_even(F.avg("iou"), 6).alias("iou"),
        F.count("iou").alias("sample_size"),
        *[half_even(F.avg(m), 6).alias(m) for m in ("f1", "precision", "recall")],
    )


def judged_scores(rows: DataFrame, subtasks: Sequence[str] = ()) -> DataFrame:
    """Judge scores per subtask out of 100 with a Total row; -1 means not judged and is left out.
    Subtasks asked for by name appear with a count of 0 when nothing was judged."""
    judged = rows.filter(F.col("score") != -1)
    scores = judged.rollup("subtask").agg(
        F.count("*").alias("num_scored"),
        (F.avg(F.col("score") / 10) * 100).alias("score"),
        F.grouping("subtask").alias("_total"),
    ).select(
        F.when(F.col("_total") == 1, F.lit("Total")).otherwise(F.col("subtask")).alias("subtask"),
        "num_scored", "score",
    )
    if not subtasks:
        return scores
    names = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in subtasks])).alias("subtask"))
    empty = names.join(scores, "subtask", "left_anti")
    return scores.unionByName(
        empty.select("subtask", F.lit(0).cast("bigint").alias("num_scored"), F.lit(None).cast("double").alias("score"))
    )


def disagreements(published: DataFrame, computed: DataFrame, on: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Published scores that recomputation does not confirm; should be empty."""
    return published.join(computed.withColumnRenamed("score", "recomputed"), list(on), "left").filter(
        F.col("recomputed").isNull() | (F.abs(F.col("score") - F.col("recomputed")) > tolerance)
    )
