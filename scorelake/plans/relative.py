"""Angles, distances and lesion sizes: relative errors, their bins and the averages built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.numbers import last_numbers, parse_fixed_target
from scorelake.functions.scoring import online_scores, with_scores
from scorelake.operators import lookups, stats, summaries
from scorelake.operators.results import label_section, report_lines
from scorelake.plans.carriers import LABELS, LESIONS, MEASURES, PLAN_LABEL, PLAN_TASK
from scorelake.plans.catalogue import derived, plain, query, rounded

TENTHS = range(1, 11)


def scored(answers: DataFrame, task_kind: str) -> DataFrame:
    k = {"AD": 1, "TL": 2}[task_kind]
    return with_scores(
        answers, last_numbers(F.col("response"), k), parse_fixed_target(F.col("target"), k), task_kind
    )


def labelled_measures(spark, sf_dir) -> DataFrame:
    rows = scored(derived(spark, sf_dir, MEASURES, heavy=True), "AD")
    return rows.withColumn(
        "label", summaries.measurement_label(F.col("dataset"), F.col("metric_type"), F.col("metric_key"))
    )


def labelled_lesions(spark, sf_dir) -> DataFrame:
    answers = derived(spark, sf_dir, LESIONS, heavy=True).withColumn("answer", F.col("response"))
    named = lookups.with_target_label(
        answers, derived(spark, sf_dir, PLAN_LABEL), derived(spark, sf_dir, PLAN_TASK)
    )
    keyed = lookups.with_anatomy(named).withColumn(
        "label", lookups.group_key(F.col("reported"), F.col("modality"), F.col("slice_dim"))
    )
    return scored(keyed, "TL")


NUMBERS = "regexp_extract_all(response, '-?\\d+\\.?\\d*')"
SCORED = f"""
measures AS ({plain(MEASURES).replace('STRING', 'VARCHAR')}),
parsed AS (SELECT *, CAST(CAST({NUMBERS}[-1] AS FLOAT) AS DOUBLE) AS p, CAST(target AS DOUBLE) AS t,
           dataset || '_' || metric_type || '_' || metric_key AS label FROM measures),
scored AS (SELECT *, p IS NOT NULL AS success, abs(p - t) AS mae, abs(p - t) / (t + 1e-15) AS mre FROM parsed)
"""
TENTH = """CASE WHEN mre IS NULL THEN NULL WHEN trunc(least(mre * 10, 9)) >= 0 THEN CAST(trunc(least(mre * 10, 9)) AS INT)
  ELSE CAST(trunc(mre * 10) AS INT) + 10 END"""


def summary_sql(digits: int = 6) -> str:
    cells = [
        f"round(avg(mae), {digits}) AS avg_mae", f"round(avg(mre), {digits}) AS avg_mre",
        f"round(avg(CAST(success AS INT)), {digits}) AS success_rate", "count(*) AS num_samples",
    ]
    cells += [f"round(count(*) FILTER (WHERE {TENTH} < {k}) / count(*), {digits}) AS mre_lt_{k * 10}" for k in TENTHS]
    return ", ".join(cells)


def weighted(value: str, n: str = "num_samples") -> str:
    return f"sum({value} * {n}) / sum({n}) FILTER (WHERE {value} IS NOT NULL)"


LABEL_TABLE = f"{SCORED}, labels_of AS (SELECT model, label, {summary_sql(15)} FROM scored GROUP BY ALL)"
OVERALL = f"""
  round(coalesce(sum(avg_mae * num_samples), 0) / sum(num_samples), 6) AS weighted_mae,
  round(coalesce(sum(avg_mre * num_samples), 0) / sum(num_samples), 6) AS weighted_mre,
  round(coalesce(sum(success_rate * num_samples), 0) / sum(num_samples), 6) AS weighted_success,
  {", ".join(f"round({weighted(f'mre_lt_{k}')}, 6) AS weighted_mre_lt_{k}" for k in (10, 20, 30))},
  CAST(sum(num_samples) AS BIGINT) AS total_samples"""
LESION_TABLE = f"""
lesions AS ({plain(LESIONS).replace('STRING', 'VARCHAR')}),
plan_label AS ({plain(PLAN_LABEL).replace('STRING', 'VARCHAR')}),
plan_task AS ({plain(PLAN_TASK).replace('STRING', 'VARCHAR')}),
names AS ({LABELS}),
parsed AS (
  SELECT l.model, CASE WHEN len({NUMBERS}) >= 2 THEN list_transform({NUMBERS}[-2:], lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) END AS p,
    CAST(string_split(translate(target, '[] ', ''), ',') AS DOUBLE[]) AS t,
    n.reported || ' @ ' || CASE image_modality WHEN 'MRI' THEN 'MR' WHEN 'ultrasound' THEN 'US' WHEN 'X-ray' THEN 'XR' ELSE image_modality END
      || ' (' || CASE slice_dim WHEN 0 THEN 'S' WHEN 1 THEN 'C' ELSE 'A' END || ')' AS label
  FROM lesions l JOIN plan_task k USING (dataset, task_id)
       JOIN plan_label b ON b.dataset = l.dataset AND b.task_id = l.task_id AND b.label = k.target_label
       JOIN names n ON n.label_name = b.label_name),
scored AS (
  SELECT model, label, p IS NOT NULL AS success, (abs(p[1] - t[1]) + abs(p[2] - t[2])) / 2 AS mae,
         (abs(p[1] - t[1]) / (t[1] + 1e-15) + abs(p[2] - t[2]) / (t[2] + 1e-15)) / 2 AS mre FROM parsed)
"""


@query("measure_scores_per_row", f"""
WITH {SCORED} SELECT doc_id, round(mae, 6) AS mae, round(mre, 6) AS mre, success FROM scored""")
def measure_scores_per_row(spark, sf_dir):
    return rounded(scored(derived(spark, sf_dir, MEASURES, heavy=True), "AD").select("doc_id", "mae", "mre", "success"))


@query("parse_stage_angle_distance", f"""
WITH {SCORED}
SELECT model, dataset, round(avg(mae), 6) AS avg_mae, round(avg(mre), 6) AS avg_mre,
  {", ".join(f"round(count(*) FILTER (WHERE mre < {k / 10}) / count(*), 6) AS mre_lt_{k * 10}" for k in TENTHS)},
  round(avg(CAST(success AS INT)), 6) AS success_rate, count(*) AS num_samples
FROM scored GROUP BY 1, 2""")
def parse_stage_angle_distance(spark, sf_dir):
    rows = scored(derived(spark, sf_dir, MEASURES, heavy=True), "AD")
    return rounded(summaries.summarise_parse_stage(rows, ["model", "dataset"], "AD"))


@query("angle_distance_summary_by_label", f"""
WITH {SCORED} SELECT model, label, {summary_sql()} FROM scored GROUP BY 1, 2""")
def angle_distance_summary_by_label(spark, sf_dir):
    return rounded(summaries.summarise_relative(labelled_measures(spark, sf_dir), ["model", "label"]))


@query("overall_angle_distance", f"WITH {LABEL_TABLE} SELECT model, {OVERALL} FROM labels_of GROUP BY model")
def overall_angle_distance(spark, sf_dir):
    labels = summaries.summarise_relative(labelled_measures(spark, sf_dir), ["model", "label"])
    return rounded(summaries.overall_angle_distance(labels, ["model"]))


@query("measurement_group_averages", f"""
WITH {LABEL_TABLE}, m AS (
  SELECT *, CASE WHEN contains(label, 'FeTA24_distance') THEN 'FeTA-Distance' WHEN contains(label, 'Ceph-Biometrics-400_angle') THEN 'Ceph-Angle'
    WHEN contains(label, 'Ceph-Biometrics-400_distance') THEN 'Ceph-Distance' END AS measurement FROM labels_of)
SELECT model, measurement, {", ".join(f"round({weighted(c)}, 6) AS {c}" for c in ("avg_mae", "avg_mre", "success_rate", "mre_lt_10", "mre_lt_20", "mre_lt_30"))},
  CAST(sum(num_samples) AS BIGINT) AS num_samples
FROM m WHERE measurement IS NOT NULL GROUP BY 1, 2""")
def measurement_group_averages(spark, sf_dir):
    labels = summaries.summarise_relative(labelled_measures(spark, sf_dir), ["model", "label"])
    return rounded(summaries.measurement_averages(labels, ["model"]))


@query("angle_distance_report", f"""
WITH {LABEL_TABLE}, n AS (SELECT *, model || ' ' || label AS name FROM labels_of)
SELECT name, num_samples, rpad(name, 50, ' ') || ' | ' ||
  {" || ' | ' || ".join(f"rpad(printf('%.4f', round({c}, 6)), 8, ' ')" for c in ("avg_mae", "avg_mre", "success_rate", "mre_lt_10"))}
  || ' | ' || rpad(CAST(num_samples AS VARCHAR), 8, ' ') AS line
FROM n ORDER BY num_samples DESC, name""")
def angle_distance_report(spark, sf_dir):
    labels = rounded(summaries.summarise_relative(labelled_measures(spark, sf_dir), ["model", "label"]))
    named = labels.withColumn("name", F.concat_ws(" ", "model", "label"))
    return report_lines(named, "name", ["avg_mae", "avg_mre", "success_rate", "mre_lt_10"])


SECTION = (("MAE", "avg_mae"), ("MRE", "avg_mre"), ("SR", "success_rate"), ("MRE<0.1", "mre_lt_10"), ("MRE<0.2", "mre_lt_20"), ("MRE<0.3", "mre_lt_30"))


@query("angle_distance_section", f"""
WITH {LABEL_TABLE}, n AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY num_samples DESC, label) + 2 AS place, rpad(label, 50, ' ') || ' | ' ||
  {" || ' | ' || ".join(f"rpad(printf('%.4f', round({c}, 6)), 8, ' ')" for _, c in SECTION)} || ' | ' || rpad(CAST(num_samples AS VARCHAR), 8, ' ') AS line FROM labels_of),
s AS (SELECT model, count(*) AS k FROM n GROUP BY 1)
SELECT model, place, line FROM n UNION ALL SELECT model, 0, chr(10) || 'Label-specific metrics:' FROM s
UNION ALL SELECT model, 1, rpad('Label', 50, ' ') || ' | MAE      | MRE      | SR       | MRE<0.1  | MRE<0.2  | MRE<0.3  | Samples ' FROM s
UNION ALL SELECT model, 2, repeat('-', 128) FROM s UNION ALL SELECT model, 3 + k, chr(10) || repeat('=', 100) || chr(10) FROM s""")
def angle_distance_section(spark, sf_dir):
    labels = rounded(summaries.summarise_relative(labelled_measures(spark, sf_dir), ["model", "label"]))
    return label_section(labels, "label", SECTION, ["model"])


@query("lesion_summary_by_label", f"WITH {LESION_TABLE} SELECT model, label, {summary_sql()} FROM scored GROUP BY 1, 2")
def lesion_summary_by_label(spark, sf_dir):
    return rounded(summaries.summarise_relative(labelled_lesions(spark, sf_dir), ["model", "label"]))


@query("overall_lesion", f"""
WITH {LESION_TABLE}, labels_of AS (SELECT model, label, {summary_sql(15)} FROM scored GROUP BY ALL)
SELECT model, {OVERALL} FROM labels_of WHERE avg_mre IS NOT NULL GROUP BY model""")
def overall_lesion(spark, sf_dir):
    labels = summaries.summarise_relative(labelled_lesions(spark, sf_dir), ["model", "label"])
    return rounded(summaries.overall_lesion(labels, ["model"]))


MERGED = ("avg_mae", "avg_mre", "success_rate", "mre_lt_10")


def fold_sql(value: str) -> str:
    return (f"CASE WHEN f.{value} IS NULL THEN r.{value} WHEN r.{value} IS NULL THEN f.{value} "
            f"ELSE (f.{value} * f.n + r.{value} * r.n) / (f.n + r.n) END AS {value}")


@query("merged_labels", f"""
WITH RECURSIVE {LABEL_TABLE},
r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY model) AS k, num_samples::DOUBLE AS n, {", ".join(f"{c}::DOUBLE AS {c}" for c in MERGED)} FROM labels_of),
f AS (SELECT * FROM r WHERE k = 1 UNION ALL SELECT r.label, r.k, f.n + r.n AS n, {", ".join(map(fold_sql, MERGED))} FROM f JOIN r ON r.label = f.label AND r.k = f.k + 1)
SELECT label, {", ".join(f"round({c}, 6) AS {c}" for c in MERGED)}, CAST(n AS BIGINT) AS num_samples FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1""")
def merged_labels(spark, sf_dir):
    labels = summaries.summarise_relative(labelled_measures(spark, sf_dir), ["model", "label"])
    return rounded(summaries.merge_labels(labels, ["label"], MERGED, "model"))


@query("online_biometric_scores", f"""
WITH {SCORED}, o AS (SELECT model, coalesce(p >= 0, false) AS ok, mae, mre FROM scored)
SELECT model, round(avg(mae) FILTER (WHERE ok), 6) AS mae, round(avg(mre) FILTER (WHERE ok), 6) AS mre,
       round(avg(CAST(ok AS INT)), 6) AS success_rate FROM o GROUP BY model""")
def online_biometric_scores(spark, sf_dir):
    rows = derived(spark, sf_dir, MEASURES, heavy=True).select(
        "model", last_numbers(F.col("response"), 1).alias("p"), parse_fixed_target(F.col("target"), 1).alias("t")
    )
    s = rows.select("model", online_scores(F.col("p"), F.col("t"), "biometric").alias("s")).select("model", "s.*")
    return rounded(s.groupBy("model").agg(
        stats.success_mean(F.col("ae"), F.col("success")).alias("mae"),
        stats.success_mean(F.col("re"), F.col("success")).alias("mre"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
    ))


@query("two_kinds_of_error_shares", f"""
WITH {SCORED}
SELECT model, round(count(*) FILTER (WHERE mre < 1.0) / count(*), 6) AS below_one,
       round(count(*) FILTER (WHERE {TENTH} < 10) / count(*), 6) AS open_last_bin,
       round(count(*) FILTER (WHERE mre < 0.5) / count(*), 6) AS below_half,
       round(count(*) FILTER (WHERE {TENTH} < 5) / count(*), 6) AS first_five_bins
FROM scored GROUP BY model""")
def two_kinds_of_error_shares(spark, sf_dir):
    rows = scored(derived(spark, sf_dir, MEASURES, heavy=True), "AD").withColumn("tenth", summaries.error_bin(F.col("mre")))
    return rounded(rows.groupBy("model").agg(
        summaries.share(F.col("mre") < 1.0).alias("below_one"), summaries.share(F.col("tenth") < 10).alias("open_last_bin"),
        summaries.share(F.col("mre") < 0.5).alias("below_half"), summaries.share(F.col("tenth") < 5).alias("first_five_bins"),
    ))
