"""Box detection: from raw answers to summaries per group, per size bin and per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.boxes import box_image_ratio, box_target, ratio_bin
from scorelake.functions.numbers import (
    last_numbers, last_numbers_text, parse_fixed_target, parse_prediction, parse_target,
)
from scorelake.functions.scoring import online_scores, with_scores
from scorelake.operators import lookups, results, summaries
from scorelake.plans.carriers import BOXES, LABELS, PLAN_LABEL, PLAN_TASK
from scorelake.plans.catalogue import derived, plain, query, r6, rounded, table

OVERLAPS = ("iou", "f1", "precision", "recall")

# ---- jobs ----


def scored(answers: DataFrame, on_failure: str = "zero") -> DataFrame:
    """Answers with parsed boxes and scores."""
    parsed = answers.withColumns(
        {"pred": last_numbers(F.col("response"), 4), "target_box": parse_fixed_target(F.col("target"), 4)}
    )
    return with_scores(parsed, F.col("pred"), F.col("target_box"), "Detection", on_failure)


def labelled(answers: DataFrame, plan_label: DataFrame, plan_task: DataFrame) -> DataFrame:
    rows = answers.withColumn("answer", F.col("response"))
    named = lookups.with_plan_label(rows, plan_label, plan_task)
    return lookups.with_anatomy(named).withColumn(
        "group_name", lookups.group_key(F.col("anatomy"), F.col("modality"), F.col("slice_dim"))
    )


def summary_by_anatomy(answers, plan_label, plan_task, by=()) -> DataFrame:
    # Scored first, beside the scan: faster than to carry the answers through the joins, though rows off the plan are scored too.
    rows = labelled(scored(answers), plan_label, plan_task)
    return summaries.summarise_detection(rows, [*by, "group_name"])


def with_ratio(rows: DataFrame) -> DataFrame:
    dimensions = F.when(F.col("has_box"), F.array(F.array(F.col("box_h").cast("double"), F.col("box_w").cast("double"))))
    size = F.array("image_h", "image_w")
    return rows.withColumn("box_img_ratio", box_image_ratio(dimensions, size, F.col("target_box")))


def _inputs(spark: SparkSession, sf_dir: str):
    return derived(spark, sf_dir, BOXES, heavy=True), derived(spark, sf_dir, PLAN_LABEL), derived(spark, sf_dir, PLAN_TASK)


# ---- SQL shared by the checks ----

NUMBERS = "regexp_extract_all(response, '-?\\d+\\.?\\d*')"
SCORED = f"""
boxes AS ({plain(BOXES).replace('STRING', 'VARCHAR')}),
parsed AS (
  SELECT *, CASE WHEN len({NUMBERS}) >= 4
                 THEN list_transform({NUMBERS}[-4:], lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) END AS p,
         CAST(string_split(translate(target, '[] ', ''), ',') AS DOUBLE[]) AS t
  FROM boxes),
corners AS (
  SELECT *, greatest(p[1], t[1]) AS x1, greatest(p[2], t[2]) AS y1, least(p[3], t[3]) AS x2, least(p[4], t[4]) AS y2,
         (p[3] - p[1]) * (p[4] - p[2]) AS pa, (t[3] - t[1]) * (t[4] - t[2]) AS ta
  FROM parsed),
overlap AS (
  SELECT *, (x2 - x1) * (y2 - y1) AS inter, x1 >= x2 OR y1 >= y2 AS apart, p IS NOT NULL AS success,
         (abs(p[1] - t[1]) + abs(p[2] - t[2]) + abs(p[3] - t[3]) + abs(p[4] - t[4])) / 4 AS mae
  FROM corners),
plain_scores AS (
  SELECT *,
    CASE WHEN p IS NULL THEN NULL WHEN apart THEN 0.0 WHEN pa + ta - inter > 0 THEN inter / (pa + ta - inter) ELSE 0.0 END AS iou,
    CASE WHEN p IS NULL THEN NULL WHEN apart THEN 0.0 WHEN pa + ta > 0 THEN 2 * inter / (pa + ta) END AS f1,
    CASE WHEN p IS NULL THEN NULL WHEN apart THEN 0.0 WHEN pa > 0 THEN inter / pa END AS "precision",
    CASE WHEN p IS NULL THEN NULL WHEN apart THEN 0.0 WHEN ta > 0 THEN inter / ta END AS recall
  FROM overlap),
scored AS (
  SELECT * REPLACE (CASE WHEN success THEN iou ELSE 0 END AS iou, CASE WHEN success THEN f1 ELSE 0 END AS f1,
                    CASE WHEN success THEN "precision" ELSE 0 END AS "precision", CASE WHEN success THEN recall ELSE 0 END AS recall)
  FROM plain_scores)
"""
GROUPED = SCORED + f""",
plan_label AS ({plain(PLAN_LABEL).replace('STRING', 'VARCHAR')}),
plan_task AS ({plain(PLAN_TASK).replace('STRING', 'VARCHAR')}),
names AS ({LABELS}),
grouped AS (
  SELECT s.*, l.label_name, k.image_modality AS modality, n.anatomy, n.reported,
    CASE image_modality WHEN 'MRI' THEN 'MR' WHEN 'ultrasound' THEN 'US' WHEN 'X-ray' THEN 'XR' ELSE image_modality END AS code,
    CASE slice_dim WHEN 0 THEN 'S' WHEN 1 THEN 'C' ELSE 'A' END AS direction
  FROM scored s JOIN plan_label l USING (dataset, task_id, label) JOIN plan_task k USING (dataset, task_id)
       JOIN names n ON n.label_name = l.label_name)
"""
GROUP_NAME = "anatomy || ' @ ' || code || ' (' || direction || ')'"


def detection_sql(prefix: str = "mae", digits: int = 6) -> str:
    bin_of = "CASE WHEN mae IS NULL THEN NULL ELSE least(CAST(trunc(mae * 10) AS INT), 9) END"
    cells = [f"round(avg(mae), {digits}) AS avg_mae"]
    cells += [f'round(avg("{m}"), {digits}) AS "{m}"' for m in OVERLAPS]
    cells += [f"round(avg(CAST(success AS INT)), {digits}) AS success_rate", "count(*) AS num_samples"]
    cells += [
        f"round(count(*) FILTER (WHERE {bin_of} < {k}) / count(*), {digits}) AS {prefix}_lt_{k * 10}"
        for k in range(1, 11)
    ]
    cells += [
        f'round(count(*) FILTER (WHERE "{m}" >= {t / 100}) / count(*), {digits}) AS {m}_ge_{t}'
        for m in OVERLAPS for t in (50, 60, 70, 80, 90)
    ]
    return ", ".join(cells)


BIN_RANGE = "CASE " + " ".join(
    f"WHEN box_img_ratio < {k * 5 / 100} THEN '{'<0.05' if k == 1 else f'{(k - 1) * 5 / 100:.2f}~{k * 5 / 100:.2f}'}'"
    for k in range(1, 19)
) + " ELSE '>=0.90' END"
BIN_PERCENT = "CASE " + " ".join(
    f"WHEN box_img_ratio < {k * 5 / 100} THEN '{'Box/Image < 5%' if k == 1 else f'{(k - 1) * 5}% <= Box/Image < {k * 5}%'}'"
    for k in range(1, 19)
) + " ELSE '90% <= Box/Image' END"
RATIO = """CASE WHEN has_box THEN CAST(box_h AS DOUBLE) * box_w / (CAST(image_h AS DOUBLE) * image_w)
  ELSE abs(t[3] - t[1]) * abs(t[4] - t[2]) END AS box_img_ratio"""

# ---- queries ----


@query("last_numbers_of_answer", f"""
WITH boxes AS ({plain(BOXES).replace('STRING', 'VARCHAR')})
SELECT doc_id, CASE WHEN len({NUMBERS}) >= 4 THEN array_to_string({NUMBERS}[-4:], ',') ELSE '' END AS answer,
       CASE WHEN len({NUMBERS}) >= 2 THEN array_to_string({NUMBERS}[-2:], ',') ELSE '' END AS last_two
FROM boxes""")
def last_numbers_of_answer(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True)
    return rows.select(
        "doc_id", last_numbers_text(F.col("response"), 4).alias("answer"),
        last_numbers_text(F.col("response"), 2).alias("last_two"),
    )


@query("last_numbers_of_document", """
SELECT doc_id, len(regexp_extract_all(text, '-?\\d+\\.?\\d*')) AS n_numbers,
       CASE WHEN len(regexp_extract_all(text, '-?\\d+\\.?\\d*')) >= 2
            THEN array_to_string(regexp_extract_all(text, '-?\\d+\\.?\\d*')[-2:], ',') ELSE '' END AS last_two
FROM documents""")
def last_numbers_of_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", heavy=True)
    from scorelake.functions.numbers import all_numbers

    return docs.select(
        "doc_id", F.size(all_numbers(F.col("text"))).cast("bigint").alias("n_numbers"),
        last_numbers_text(F.col("text"), 2).alias("last_two"),
    )


@query("parsed_prediction_and_target", f"""
WITH {SCORED}
SELECT doc_id, round(p[1], 6) AS p0, round(p[4], 6) AS p3, round(t[1], 6) AS t0, round(t[4], 6) AS t3, success FROM overlap""")
def parsed_prediction_and_target(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True)
    text = last_numbers_text(F.col("response"), 4)
    parsed = rows.select("doc_id", parse_prediction(text, 4).alias("p"), parse_target(F.col("target")).alias("t"))
    at = lambda c, i: r6(F.get(F.col(c), F.lit(i)))
    return parsed.select(
        "doc_id", at("p", 0).alias("p0"), at("p", 3).alias("p3"), at("t", 0).alias("t0"), at("t", 3).alias("t3"),
        F.col("p").isNotNull().alias("success"),
    )


@query("box_overlap_per_row", f"""
WITH {SCORED}
SELECT doc_id, round(mae, 6) AS mae, round(iou, 6) AS iou, round(f1, 6) AS f1, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, success FROM plain_scores""")
def box_overlap_per_row(spark, sf_dir):
    rows = scored(derived(spark, sf_dir, BOXES, heavy=True), on_failure="null")
    return rounded(rows.select("doc_id", "mae", *OVERLAPS, "success"))


@query("failure_rules_side_by_side", f"""
WITH {SCORED}
SELECT a.model, round(avg(a.iou), 6) AS iou_without_failures, round(avg(b.iou), 6) AS iou_with_failures,
       round(avg(a.f1), 6) AS f1_without_failures, round(avg(b.f1), 6) AS f1_with_failures
FROM plain_scores a JOIN scored b USING (doc_id) GROUP BY a.model""")
def failure_rules_side_by_side(spark, sf_dir):
    rows = scored(derived(spark, sf_dir, BOXES, heavy=True), on_failure="null")
    zero = lambda m: F.avg(F.coalesce(F.col(m), F.when(~F.col("success"), 0.0)))
    return rounded(rows.groupBy("model").agg(
        F.avg("iou").alias("iou_without_failures"), zero("iou").alias("iou_with_failures"),
        F.avg("f1").alias("f1_without_failures"), zero("f1").alias("f1_with_failures"),
    ))


@query("box_targets_from_pixel_corners", f"""
WITH boxes AS ({plain(BOXES).replace('STRING', 'VARCHAR')})
SELECT doc_id, round(CAST(1 AS DOUBLE) / image_w, 6) AS x0, round(CAST(image_h - (2 + box_h) AS DOUBLE) / image_h, 6) AS y0,
       round(CAST(1 + box_w AS DOUBLE) / image_w, 6) AS x1, round(CAST(image_h - 2 AS DOUBLE) / image_h, 6) AS y1 FROM boxes""")
def box_targets_from_pixel_corners(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True)
    low = F.array(F.lit(2.0), F.lit(1.0))
    high = F.array(F.col("box_h") + F.lit(2.0), F.col("box_w") + F.lit(1.0))
    box = box_target(low, high, F.array("image_h", "image_w"))
    return rounded(rows.select("doc_id", *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


@query("box_share_of_image", f"""
WITH {SCORED}, r AS (SELECT doc_id, {RATIO} FROM parsed)
SELECT doc_id, box_img_ratio, {BIN_RANGE} AS size_bin, {BIN_PERCENT} AS size_bin_percent FROM r""")
def box_share_of_image(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True).withColumn("target_box", parse_fixed_target(F.col("target"), 4))
    ratio = F.col("box_img_ratio")
    return with_ratio(rows).select(
        "doc_id", ratio.alias("box_img_ratio"), ratio_bin(ratio).alias("size_bin"),
        ratio_bin(ratio, "percent").alias("size_bin_percent"),
    )


@query("detection_summary_by_anatomy", f"""
WITH {GROUPED}
SELECT {GROUP_NAME} AS group_name, {detection_sql()} FROM grouped GROUP BY 1""")
def detection_summary_by_anatomy(spark, sf_dir):
    return rounded(summary_by_anatomy(*_inputs(spark, sf_dir)))


@query("detection_summary_by_label", f"""
WITH {GROUPED}
SELECT model, reported || ' @ ' || code || ' (' || direction || ')' AS group_name, {detection_sql()}
FROM grouped GROUP BY ALL""")
def detection_summary_by_label(spark, sf_dir):
    rows = labelled(*_inputs(spark, sf_dir)).withColumn(
        "group_name", lookups.group_key(F.col("reported"), F.col("modality"), F.col("slice_dim"))
    )
    return rounded(summaries.summarise_detection(scored(rows), ["model", "group_name"]))


@query("detection_summary_by_size_bin", f"""
WITH {SCORED}, r AS (SELECT *, {RATIO} FROM scored)
SELECT {BIN_PERCENT} AS size_bin, {detection_sql()} FROM r GROUP BY 1""")
def detection_summary_by_size_bin(spark, sf_dir):
    rows = with_ratio(scored(derived(spark, sf_dir, BOXES, heavy=True))).withColumn(
        "size_bin", ratio_bin(F.col("box_img_ratio"), "percent")
    )
    return rounded(summaries.summarise_detection(rows, ["size_bin"]))


@query("overlap_by_size_bin_and_label", f"""
WITH {GROUPED}, r AS (SELECT *, {RATIO} FROM grouped)
SELECT {BIN_RANGE} AS size_bin, anatomy || ' @ ' || code AS label, round_even(avg(iou) * 1e6, 0) / 1e6 AS iou, count(iou) AS sample_size,
       round_even(avg(f1) * 1e6, 0) / 1e6 AS f1, round_even(avg("precision") * 1e6, 0) / 1e6 AS "precision", round_even(avg(recall) * 1e6, 0) / 1e6 AS recall
FROM r GROUP BY 1, 2""")
def overlap_by_size_bin_and_label(spark, sf_dir):
    answers, plan_label, plan_task = _inputs(spark, sf_dir)
    rows = lookups.with_anatomy(
        lookups.with_plan_label(scored(answers).withColumn("answer", F.col("response")), plan_label, plan_task),
        on_missing="None",
    )
    rows = with_ratio(rows).withColumn("size_bin", ratio_bin(F.col("box_img_ratio"))).withColumn(
        "label", F.concat("anatomy", F.lit(" @ "), lookups.modality_code(F.col("modality")))
    )
    return summaries.box_size_by_label(rows)


COMPARED = [*summaries.MODEL_TABLE_METRICS]
COMPARED_SQL = f"""
groups AS (SELECT model, {GROUP_NAME} AS group_name, {detection_sql(digits=15)} FROM grouped GROUP BY ALL),
kinds AS (
  SELECT *, CASE WHEN lower(group_name) SIMILAR TO '.*(tumor|lesion|metastatic).*' THEN 'T/L' ELSE 'anatomy' END AS kind
  FROM groups WHERE num_samples >= 50 AND NOT lower(group_name) SIMILAR TO '.*(miscellaneous|others).*'),
compared AS (
  SELECT model, kind, {", ".join(f'round(sum("{m}" * num_samples) / sum(num_samples) FILTER (WHERE "{m}" IS NOT NULL), 6) AS "{m}"' for m in COMPARED)},
         CAST(sum(num_samples) AS BIGINT) AS total_samples, count(*) AS num_regions,
         array_to_string(list_sort(list(group_name)), '; ') AS regions
  FROM kinds GROUP BY ALL)
"""


def compared_models(spark, sf_dir) -> DataFrame:
    groups = summary_by_anatomy(*_inputs(spark, sf_dir), by=["model"])
    return summaries.anatomy_against_lesion(groups, COMPARED, by=["model"])


@query("anatomy_against_lesion_by_model", f"WITH {GROUPED}, {COMPARED_SQL} SELECT * FROM compared")
def anatomy_against_lesion_by_model(spark, sf_dir):
    return rounded(compared_models(spark, sf_dir).withColumn("regions", F.array_join("regions", "; ")))


@query("model_table", f"WITH {GROUPED}, {COMPARED_SQL} SELECT * EXCLUDE (regions) FROM compared")
def model_table(spark, sf_dir):
    return rounded(summaries.model_table(compared_models(spark, sf_dir)))


@query("model_report_lines", f"""
WITH {GROUPED}, {COMPARED_SQL}
SELECT DISTINCT model, 0 AS place, chr(10) || 'Model: ' || model AS line FROM compared
UNION ALL SELECT DISTINCT model, 1, repeat('-', 7 + length(model)) FROM compared
UNION ALL SELECT model, CASE WHEN kind = 'anatomy' THEN 2 ELSE 3 END,
  printf('  %-8s (%2d regions, %4d samples): ', upper(kind), num_regions, total_samples) || {" || ', ' || ".join(f"""'{t}=' || printf('%.3f', "{c}")""" for t, c in results.MODEL_LINE)} FROM compared""")
def model_report_lines(spark, sf_dir):
    return results.model_lines(rounded(compared_models(spark, sf_dir)))


@query("parse_stage_detection", f"""
WITH {SCORED}
SELECT model, file_name, round(avg(mae), 6) AS avg_mae, round(avg(iou), 6) AS avg_iou,
       round(avg(CAST(success AS INT)), 6) AS success_rate, count(*) AS num_samples
FROM plain_scores GROUP BY 1, 2""")
def parse_stage_detection(spark, sf_dir):
    rows = scored(derived(spark, sf_dir, BOXES, heavy=True), on_failure="null")
    return rounded(summaries.summarise_parse_stage(rows, ["model", "file_name"], "Detection"))


@query("online_box_scores", f"""
WITH {SCORED}, rel AS (
  SELECT model, success, mae, t[1] <> 0 AND t[2] <> 0 AND t[3] <> 0 AND t[4] <> 0 AS finite_target,
    CASE WHEN t[1] <> 0 AND t[2] <> 0 AND t[3] <> 0 AND t[4] <> 0 THEN
      (abs(p[1] - t[1]) / t[1] + abs(p[2] - t[2]) / t[2] + abs(p[3] - t[3]) / t[3] + abs(p[4] - t[4]) / t[4]) / 4 END AS mre
  FROM overlap)
SELECT model, round(avg(mae), 6) AS avg_mae, round(avg(mre), 6) AS avg_finite_mre,
       round(avg(CAST(success AS INT)), 6) AS success_rate,
       count(*) FILTER (WHERE success AND NOT finite_target) AS unbounded
FROM rel GROUP BY 1""")
def online_box_scores(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True)
    pred, target = last_numbers(F.col("response"), 4), parse_fixed_target(F.col("target"), 4)
    s = rows.select("model", pred.alias("p"), target.alias("t")).select(
        "model", "t", online_scores(F.col("p"), F.col("t"), "box").alias("s")
    ).select("model", "t", "s.*")
    zero_target = F.exists("t", lambda v: v == 0)
    return rounded(s.groupBy("model").agg(
        F.avg("mae").alias("avg_mae"), F.avg(F.when(~zero_target, F.col("mre"))).alias("avg_finite_mre"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.count_if(F.col("success") & zero_target).alias("unbounded"),
    ))
