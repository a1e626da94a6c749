"""Operations over many tasks, settings of models, and written results."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.scoring import online_scores
from scorelake.operators import dispatch, registry, results, stats
from scorelake.plans.catalogue import derived, query, rounded, table
from scorelake.plans.statistics import LABELLED, LABELLED_SQL
from scorelake.plans.tables import content_hashes_per_task
from scorelake.session import scratch_path
from scorelake.sources import datasets, sinks

# ---- functions of five hundred tasks ----

TASKS = 500


def _register(k: int) -> None:
    targets = (lambda a: a + k, lambda a: a * k, lambda a: F.greatest(a, F.lit(float(k))))
    scores = (lambda t, b: F.abs(t - b) / (k + 1), lambda t, b: F.least(t, b) - k)
    aggregations = (F.avg, F.max, F.min, lambda s: F.sum(s) / (k + 2))
    task = f"unit_{k:03d}"
    registry.register_task_function(task, "target", targets[k % 3])
    registry.register_task_function(task, "score", scores[k % 2])
    if k % 7:
        chosen = aggregations[k % 4]
        registry.register_task_function(task, "aggregation", lambda s: chosen(s))


@query("functions_of_many_tasks", f"""
WITH r AS (SELECT l_partkey % {TASKS + 20} AS k, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE / 1000 AS b FROM lineitem),
t AS (SELECT k, b, CASE WHEN k >= {TASKS} THEN NULL WHEN k % 3 = 0 THEN a + k WHEN k % 3 = 1 THEN a * k ELSE greatest(a, k) END AS t FROM r),
s AS (SELECT k, CASE WHEN k >= {TASKS} THEN NULL WHEN k % 2 = 0 THEN abs(t - b) / (k + 1) ELSE least(t, b) - k END AS s FROM t)
SELECT 'unit_' || lpad(k::VARCHAR, 3, '0') AS task, round(CASE WHEN k % 7 = 0 OR k >= {TASKS} OR k % 4 = 0 THEN avg(s) WHEN k % 4 = 1 THEN max(s) WHEN k % 4 = 2 THEN min(s) ELSE sum(s) / (k + 2) END, 6) AS value,
  count(*) AS rows FROM s GROUP BY k""")
def functions_of_many_tasks(spark, sf_dir):
    """Five hundred tasks, each with a target and a score function of its own and most with an aggregation; twenty have none."""
    if ("unit_000", "target") not in registry.TASK_FUNCTIONS:
        for k in range(TASKS):
            _register(k)
    name = F.concat(F.lit("unit_"), F.lpad((F.col("l_partkey") % (TASKS + 20)).cast("string"), 3, "0"))
    rows = table(spark, sf_dir, "lineitem").select(
        name.alias("task"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") / 1000).alias("b"))
    return rounded(dispatch.with_own_functions(rows, "task", ["a"], ["b"], tasks=[f"unit_{k:03d}" for k in range(TASKS)]))


# ---- metrics and settings of tasks ----

#: Output type, metrics named by the task, whether it is only predicted.
TASK_METRICS = {
    "en": ("multiple_choice", None, False), "de": ("generate_until", None, False), "fr": ("multiple_choice", ["acc"], False),
    "es": ("multiple_choice", ["acc"], True),
}


@query("metrics_of_each_task", f"""
WITH l AS (SELECT lang, avg(CAST(gold = pred AS INT)) AS acc, avg(CAST(gold = pred AND n_chars > 300 AS INT)) AS norm, avg(CAST(gold = toxic AS INT)) AS em FROM ({LABELLED_SQL}) GROUP BY 1)
SELECT lang, 'acc' AS metric, round(acc, 6) AS value FROM l WHERE lang IN ('en', 'fr') UNION ALL SELECT lang, 'acc_norm', round(norm, 6) FROM l WHERE lang = 'en'
UNION ALL SELECT lang, 'exact_match', round(em, 6) FROM l WHERE lang = 'de' UNION ALL SELECT lang, 'bypass', 999.0 FROM l WHERE lang = 'es'""")
def metrics_of_each_task(spark, sf_dir):
    """The metrics a task names, else the default ones of its output type, or only the stand-in where it is predicted."""
    rows = derived(spark, sf_dir, LABELLED).withColumns({
        "acc": (F.col("gold") == F.col("pred")).cast("double"), "exact_match": (F.col("gold") == F.col("toxic")).cast("double"),
        "acc_norm": ((F.col("gold") == F.col("pred")) & (F.col("n_chars") > 300)).cast("double"), "bypass": F.lit(999.0),
    })
    chosen = [(task, m) for task, (kind, named, predict) in TASK_METRICS.items() for m in registry.metrics_of(kind, named, predict)]
    wanted = F.broadcast(spark.createDataFrame(chosen, "lang string, metric string"))  # a row for each task and metric
    scored = registry.aggregate(rows, ["lang"], ["acc", "acc_norm", "exact_match", "bypass"])
    long = scored.select("lang", *[F.col(m).cast("double").alias(m) for m in ("acc", "acc_norm", "exact_match", "bypass")]).unpivot(
        ["lang"], ["acc", "acc_norm", "exact_match", "bypass"], "metric", "value")
    return rounded(long.join(wanted, ["lang", "metric"]))


MODEL_SETTINGS = {"model_0": {"shots": "5"}, "model_1": None, "default": {"shots": "2"}}


@query("settings_of_each_model", """
SELECT 'model_' || (o_custkey % 3) AS model, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 3 = 0 THEN '5' ELSE '2' END ELSE '1' END AS shots, count(*) AS n
FROM orders GROUP BY 1, 2""")
def settings_of_each_model(spark, sf_dir):
    """A model's own settings, else the default ones, else those of the data set; data sets other than O have no per-model table."""
    pairs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("model_"), (F.col("o_custkey") % 3).cast("string")).alias("model"), (F.col("o_orderstatus") == "O").alias("per_model"))
    found = [(m, p, registry.settings_for(m, MODEL_SETTINGS if p else {}, {"shots": "1"})["shots"]) for m in ("model_0", "model_1", "model_2") for p in (True, False)]
    known = F.broadcast(spark.createDataFrame(found, "model string, per_model boolean, shots string"))  # six rows
    return pairs.join(known, ["model", "per_model"]).groupBy("model", "shots").agg(F.count("*").alias("n"))


# ---- scorers of a run that is going on ----

@query("online_lesion_and_mask_scores", """
WITH r AS (SELECT event_type, value AS v, user_id % 50 - 5 AS p, event_id % 11 = 0 AS lost FROM events),
l AS (SELECT event_type, CASE WHEN NOT lost THEN (abs(p - (v + 2)) + abs(p + 1 - (v / 2 + 1))) / 2 END AS mae,
  CASE WHEN NOT lost THEN (abs(p - (v + 2)) / (v + 2) + abs(p + 1 - (v / 2 + 1)) / (v / 2 + 1)) / 2 END AS mre, NOT lost AS ok FROM r),
m AS (SELECT event_type, CASE WHEN NOT lost AND p >= 0 THEN abs(p - (v * 3 + 1)) END AS ae, NOT lost AND p >= 0 AS ok FROM r)
SELECT event_type, 'lesion' AS kind, round(avg(mae) FILTER (WHERE ok), 6) AS error, round(avg(mre) FILTER (WHERE ok), 6) AS relative, round(avg(CAST(ok AS INT)), 6) AS success_rate FROM l GROUP BY 1
UNION ALL SELECT event_type, 'mask', round(avg(ae) FILTER (WHERE ok), 6), NULL, round(avg(CAST(ok AS INT)), 6) FROM m GROUP BY 1""")
def online_lesion_and_mask_scores(spark, sf_dir):
    """Both axes of a lesion, and a mask's area, for which a negative prediction fails."""
    p = (F.col("user_id") % 50 - 5).cast("double")
    lost = F.col("event_id") % 11 == 0
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.when(~lost, F.array(p, p + 1)).alias("axes"), F.array(F.col("value") + 2, F.col("value") / 2 + 1).alias("axes_target"),
        F.when(~lost, F.array(p)).alias("area"), F.array(F.col("value") * 3 + 1).alias("area_target"))
    scored = rows.select("event_type", online_scores(F.col("axes"), F.col("axes_target"), "lesion").alias("l"), online_scores(F.col("area"), F.col("area_target"), "mask").alias("m"))
    lesion = scored.groupBy("event_type").agg(
        stats.success_mean(F.col("l.mae"), F.col("l.success")).alias("error"), stats.success_mean(F.col("l.mre"), F.col("l.success")).alias("relative"),
        F.avg(F.col("l.success").cast("double")).alias("success_rate")).withColumn("kind", F.lit("lesion"))
    mask = scored.groupBy("event_type").agg(
        stats.success_mean(F.col("m.ae"), F.col("m.success")).alias("error"), F.lit(None).cast("double").alias("relative"),
        F.avg(F.col("m.success").cast("double")).alias("success_rate")).withColumn("kind", F.lit("mask"))
    return rounded(lesion.unionByName(mask).select("event_type", "kind", "error", "relative", "success_rate"))


# ---- groups that list their metrics ----

@query("group_scores_by_listed_metrics", """
WITH e AS (SELECT r_name AS "group", 'task_' || n_nationkey AS task FROM nation JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT 'task_' || c_nationkey AS task, avg(CASE WHEN c_acctbal > 4000 THEN 1.0::DOUBLE ELSE 0.0 END) AS acc, avg(c_acctbal::DOUBLE) AS mean, count(*)::DOUBLE AS n FROM customer GROUP BY 1)
SELECT "group", 'acc,none' AS metric, round(CASE WHEN "group" = 'ASIA' THEN avg(acc) ELSE sum(acc * n) / sum(n) END, 6) AS value, sum(n)::BIGINT AS samples FROM e JOIN t USING (task) WHERE "group" IN ('ASIA', 'EUROPE') GROUP BY 1
UNION ALL SELECT "group", 'mean,none', round(sum(mean * n) / sum(n), 6), sum(n)::BIGINT FROM e JOIN t USING (task) WHERE "group" = 'EUROPE' GROUP BY 1""")
def group_scores_by_listed_metrics(spark, sf_dir):
    """Two groups list the metrics they report, one of them without weights; the others list none and have no score."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    leaves = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("group"), F.concat(F.lit("task_"), F.col("n_nationkey").cast("string")).alias("task"))
    balance = F.col("c_acctbal").cast("double")
    wide = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("task_"), F.col("c_nationkey").cast("string")).alias("task")).agg(
        F.avg(F.when(balance > 4000, 1.0).otherwise(0.0)).alias("acc,none"), F.avg(balance).alias("mean,none"), F.count("*").alias("samples"))
    long = wide.unpivot(["task", "samples"], ["acc,none", "mean,none"], "metric", "value").withColumn("stderr", F.lit(None).cast("double"))
    wanted = spark.createDataFrame([("ASIA", "acc", False), ("EUROPE", "acc", True), ("EUROPE", "mean", True)], "group string, metric string, weight_by_size boolean")
    return rounded(stats.group_scores(leaves, long, wanted=wanted).select("group", "metric", "value", "samples"))


# ---- written results ----

@query("results_with_task_hashes", """
WITH h AS (SELECT doc_id, lang, sha256(text) AS doc_hash, sha256(lang || source) AS prompt_hash, sha256(CAST(n_chars AS VARCHAR)) AS target_hash FROM documents),
t AS (SELECT lang, sha256(doc_id || ':' || doc_hash || prompt_hash || target_hash) AS d FROM h),
p AS (SELECT lang, [('0x' || substr(d, 1 + 15 * i, 15))::BIGINT::HUGEINT FOR i IN range(0, 4)] AS n FROM t),
k AS (SELECT lang, sha256(concat_ws(':', count(*), sum(n[1]), sum(n[2]), sum(n[3]), sum(n[4]))) AS task_hash FROM p GROUP BY 1)
SELECT lang AS task, 'chars' AS metric, round(avg(n_chars), 6) AS value, task_hash FROM documents JOIN k USING (lang) GROUP BY 1, 2, 4""")
def results_with_task_hashes(spark, sf_dir):
    """Aggregated results in one written table, the hash of each task's content beside its metrics."""
    scores = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("task")).agg(F.avg("n_chars").alias("value")).withColumn("metric", F.lit("chars"))
    hashes = content_hashes_per_task(spark, sf_dir).withColumnRenamed("lang", "task")
    path = scratch_path(spark, "results")
    sinks.write_results(scores, hashes, path)
    return rounded(spark.read.parquet(path).select("task", "metric", "value", "task_hash"))


@query("questions_with_image_files", """
SELECT page_id AS question_id, 'pic_' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '.jpg' AS image_name, url AS question, octet_length(encode(coalesce(html, ''))) AS bytes, 'odd' AS split FROM pages WHERE page_id % 2 = 1
UNION ALL SELECT page_id, 'pic_' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '.jpg', NULL, octet_length(encode(coalesce(html, ''))), 'even' FROM pages WHERE page_id % 2 = 0""")
def questions_with_image_files(spark, sf_dir):
    """Question files and image folders of two splits, written from the pages and paired again; one split lacks a column."""
    pages = table(spark, sf_dir, "pages")
    root, splits = scratch_path(spark, "questions"), {}
    for name, remainder, columns in (("odd", 1, ["question_id", "image_id", "question"]), ("even", 0, ["question_id", "image_id"])):
        own = pages.where(F.col("page_id") % 2 == remainder).select(
            F.col("page_id").alias("question_id"), F.col("page_id").alias("image_id"), F.col("url").alias("question"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
        # A question file holds a hundred pages' questions at most.
        body = F.to_json(F.struct(F.collect_list(F.struct(*columns)).alias("questions")))
        listed = own.groupBy(F.floor(F.col("question_id") / 100).alias("part")).agg(body.alias("body")).select(
            F.format_string("q-%d.json", "part").alias("name"), F.encode("body", "UTF-8").alias("content"))
        listed.mapInArrow(sinks.one_file_per_row(f"{root}/{name}/questions"), "name string").write.format("noop").mode("overwrite").save()
        files = F.concat(F.lit("pic_"), F.lpad(F.col("image_id").cast("string"), 12, "0"), F.lit(".jpg"))
        own.select(files.alias("name"), "content").mapInArrow(sinks.one_file_per_row(f"{root}/{name}/images"), "name string").write.format("noop").mode("overwrite").save()
        splits[name] = (f"{root}/{name}/questions", f"{root}/{name}/images", "pic")
    found = datasets.image_questions(spark, splits)
    return found.select("question_id", "image_name", "question", F.octet_length("image").cast("long").alias("bytes"), "split")
