"""Dimension lookups: what a label is called, which class it belongs to, how it was imaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.labels import label_table

# Short codes of imaging kinds and slice directions.
MODALITY_CODES = {"MRI": "MR", "CT": "CT", "ultrasound": "US", "X-ray": "XR", "PET": "PET"}
SLICE_CODES = {0: "S", 1: "C", 2: "A"}

# Plan tables come from the caller and their size is unknown, so none of these joins carries a
# broadcast hint: adaptive execution broadcasts a side once it has measured it, and splits hot keys
# otherwise. Only the built-in label table, fixed in the code, is broadcast outright.


def modality_code(modality: Column) -> Column:
    code = modality
    for name, short in MODALITY_CODES.items():
        code = F.when(modality == name, F.lit(short)).otherwise(code)
    return code


def slice_code(slice_dim: Column) -> Column:
    code = F.when(F.lit(False), F.lit(""))
    for dim, letter in SLICE_CODES.items():
        code = code.when(slice_dim == dim, F.lit(letter))
    return code.otherwise(F.raise_error(F.concat(F.lit("unknown slice direction "), slice_dim.cast("string"))))


def group_key(name: Column, modality: Column, slice_dim: Column) -> Column:
    """``Kidney @ CT (A)``"""
    return F.concat(name, F.lit(" @ "), modality_code(modality), F.lit(" ("), slice_code(slice_dim), F.lit(")"))


def with_plan_label(rows: DataFrame, plan_label: DataFrame, plan_task: DataFrame) -> DataFrame:
    """Add ``label_name`` and ``modality`` by (dataset, task_id, label).

    Rows without a label, response or target, and rows whose label the plan does not list, drop out.
    """
    usable = rows.filter(
        F.col("label").isNotNull() & F.col("task_id").isNotNull()
        & F.col("answer").isNotNull() & F.col("target").isNotNull()
    )
    named = plan_label.filter(F.coalesce(F.col("label_name"), F.lit("")) != "").select(
        "dataset", "task_id", "label", "label_name"
    )
    return usable.join(named, ["dataset", "task_id", "label"]).join(
        plan_task.select("dataset", "task_id", F.col("image_modality").alias("modality")), ["dataset", "task_id"]
    )


def with_target_label(rows: DataFrame, plan_label: DataFrame, plan_task: DataFrame) -> DataFrame:
    """As :func:`with_plan_label`, but the label is the one the plan measures in that task."""
    tasks = plan_task.filter(F.col("target_label").isNotNull()).select(
        "dataset", "task_id", F.col("target_label").alias("label"), F.col("image_modality").alias("modality")
    )
    named = plan_label.filter(F.coalesce(F.col("label_name"), F.lit("")) != "").select(
        "dataset", "task_id", "label", "label_name"
    )
    usable = rows.drop("label").filter(F.col("answer").isNotNull() & F.col("target").isNotNull())
    return usable.join(tasks, ["dataset", "task_id"]).join(named, ["dataset", "task_id", "label"])


def with_anatomy(rows: DataFrame, on_missing: str = "error") -> DataFrame:
    """Add ``anatomy`` and ``reported``. A label missing from the table stops the job, or with
    ``on_missing="None"`` gets the text ``None``."""
    if on_missing not in ("error", "None"):
        raise ValueError("on_missing must be 'error' or 'None'")
    table = F.broadcast(label_table(rows.sparkSession))
    joined = rows.join(table, "label_name", "left")
    if on_missing == "None":
        missing = F.lit("None")
    else:
        missing = F.raise_error(F.concat(F.lit("label not in the label table: "), F.col("label_name")))
    return joined.withColumn("anatomy", F.coalesce("anatomy", missing)).withColumn(
        "reported", F.coalesce("reported", missing)
    )


def with_landmarks(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Add ``metric_name`` and ``points``, the landmark names of a distance (2) or an angle (4).

    ``elements`` holds one row per (dataset, task_id, map_name, key): a landmark has a ``name`` only, a
    line points at two landmarks, an angle at two lines, through ``element_map_name`` and ``element_keys``.
    """
    at = ["dataset", "task_id"]

    def level(tag: str, map_col: Column, key_col: Column) -> tuple[DataFrame, Column]:
        side = elements.select(
            *[F.col(c).alias(f"_{tag}_{c}") for c in at],
            F.col("map_name").alias(f"_{tag}_map"), F.col("key").alias(f"_{tag}_key"),
            F.col("name").alias(f"_{tag}_name"),
            F.col("element_map_name").alias(f"_{tag}_next"), F.col("element_keys").alias(f"_{tag}_keys"),
        )
        match = (
            (F.col("dataset") == F.col(f"_{tag}_dataset")) & (F.col("task_id") == F.col(f"_{tag}_task_id"))
            & (map_col == F.col(f"_{tag}_map")) & (key_col == F.col(f"_{tag}_key"))
        )
        return side, match

    def follow(df: DataFrame, tag: str, map_col: Column, key_col: Column, how: str = "left") -> DataFrame:
        side, match = level(tag, map_col, key_col)
        return df.join(side, match, how)

    def first_key(tag: str, i: int) -> Column:
        return F.get(F.col(f"_{tag}_keys"), F.lit(i))

    out = follow(rows, "m", F.col("metric_map_name"), F.col("metric_key"), "inner")
    out = follow(out, "a", F.col("_m_next"), first_key("m", 0))
    out = follow(out, "b", F.col("_m_next"), first_key("m", 1))
    for line in ("a", "b"):
        for i in (0, 1):
            out = follow(out, f"{line}{i}", F.col(f"_{line}_next"), first_key(line, i))
    points = F.when(
        F.col("metric_type") == "distance", F.array("_a_name", "_b_name")
    ).otherwise(F.array("_a0_name", "_a1_name", "_b0_name", "_b1_name"))
    return out.withColumn("metric_name", F.col("_m_name")).withColumn("points", points).select(
        *rows.columns, "metric_name", "points"
    )
