"""Logs, task files and tables on disk: written by one job, read back by the readers under test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.numbers import last_numbers, parse_target
from scorelake.functions.scoring import with_scores
from scorelake.operators import stats, summaries
from scorelake.operators.ranking import first_lines
from scorelake.plans.carriers import BOXES
from scorelake.plans.catalogue import derived, plain, query, rounded, table
from scorelake.plans.detection import SCORED
from scorelake.session import scratch_path
from scorelake.sources import commits, datasets, logs, sinks, tasks
from scorelake.streaming import incremental

LOG_NAME = "concat('r1_samples_', dataset, '_BoxCoordinate_Task01_Axial.jsonl')"


def log_lines(spark, sf_dir) -> DataFrame:
    """(model, log, doc_id, value): log lines whose responses nest two or three deep, with blank lines and
    empty objects in between."""
    rows = derived(spark, sf_dir, BOXES, heavy=True)
    doc = F.struct(
        F.col("task_id").cast("string").alias("taskID"), "label", "slice_dim", F.array("image_h", "image_w").alias("image_size_2d")
    )
    flat = F.to_json(F.array(F.array("response")))
    deep = F.to_json(F.array(F.array(F.array("response"))))
    body = F.to_json(F.struct("doc_id", "target", doc.alias("doc")))
    line = F.concat(
        F.expr("substring(b, 1, length(b) - 1)"), F.lit(',"resps":'), F.when(F.col("doc_id") % 2 == 0, F.col("flat")).otherwise(F.col("deep")), F.lit("}")
    )
    base = rows.withColumn("b", body).withColumn("flat", flat).withColumn("deep", deep)
    full = base.select("model", F.expr(LOG_NAME).alias("log"), "doc_id", line.alias("value"))
    noise = full.filter(F.col("doc_id") % 40 == 0).withColumn(
        "value", F.when(F.col("doc_id") % 80 == 0, F.lit(" ")).otherwise(F.lit("{ }"))
    )
    return full.unionByName(noise)


def results_lines(spark, sf_dir) -> DataFrame:
    models = derived(spark, sf_dir, BOXES, heavy=True).select("model").distinct()
    return models.select(
        "model", F.lit("r1_results.json").alias("log"),
        F.concat(F.lit('{"results":{"task_of_'), "model", F.lit('":{"avgMAE,none":"0.5","avgMAE_stderr,none":"N/A"}}}')).alias("value"),
    )


def written_logs(spark, sf_dir) -> str:
    root = scratch_path(spark, "logs")
    sinks.write_logs(log_lines(spark, sf_dir), root, order=["doc_id"])
    sinks.write_logs(results_lines(spark, sf_dir), root)
    return root


BOXES_SQL = f"boxes AS ({plain(BOXES).replace('STRING', 'VARCHAR')})"


@query("logs_read_from_files", f"""
WITH {BOXES_SQL}
SELECT doc_id, model, dataset, 'r1' AS prefix, 'task_of_' || model AS results_task, response, label, slice_dim, image_h, target FROM boxes""")
def logs_read_from_files(spark, sf_dir):
    root = written_logs(spark, sf_dir)
    rows = logs.paired_with_results(
        logs.parse_lines(logs.read_lines(spark, f"{root}/*/*.jsonl")), logs.read_results(spark, root)
    )
    return rows.select(
        "doc_id", "model", "dataset", "prefix", "results_task", "response", "doc.label", "doc.slice_dim",
        F.col("doc.image_size_2d")[0].alias("image_h"), "target",
    )


@query("targets_from_documents", """
SELECT event_id AS doc_id, round(value / 100, 6) AS x0, round((50 - 40 * 0.5::DOUBLE) / 50, 6) AS y0, round(value + 2, 6) AS major, round(value / 2, 6) AS minor, round(value * 3, 6) AS area, round(value, 6) AS measure FROM events""")
def targets_from_documents(spark, sf_dir):
    v = F.col("value")
    docs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        F.struct(
            F.array(F.lit(50), F.lit(100)).alias("image_size_2d"), (v * 3).alias("ROI_area"),
            F.struct(F.array(F.array(F.lit(10.0), v)).alias("min_coords"), F.array(F.array(F.lit(20.0), v + 1)).alias("max_coords")).alias("bounding_boxes"),
            F.struct(v.alias("metric_value"), F.array(v + 2).alias("metric_value_major_axis"), F.array(v / 2).alias("metric_value_minor_axis")).alias("biometric_profile"),
        ).alias("doc"),
    )
    cells = {"x0": ("box", 0), "y0": ("box", 1), "major": ("lesion", 0), "minor": ("lesion", 1), "area": ("mask", 0), "measure": ("biometric", 0)}
    return rounded(docs.select("doc_id", *[F.get(logs.target_of(k), F.lit(i)).alias(n) for n, (k, i) in cells.items()]))


@query("first_rows_of_each_log", f"""
WITH {BOXES_SQL} SELECT doc_id, model, dataset FROM boxes QUALIFY row_number() OVER (PARTITION BY model, dataset ORDER BY doc_id) <= 100""")
def first_rows_of_each_log(spark, sf_dir):
    root = written_logs(spark, sf_dir)
    lines = logs.read_lines(spark, f"{root}/*/*.jsonl")
    kept = first_lines(lines, 100, logs.is_record(F.col("value")))
    return logs.parse_lines(kept).select("doc_id", "model", "dataset")


@query("parsed_table_round_trip", f"""
WITH {SCORED} SELECT model, dataset AS task, round(avg(mae), 6) AS avg_mae, round(avg(iou), 6) AS avg_iou, round(avg(CAST(success AS INT)), 6) AS success_rate, count(*) AS num_samples FROM plain_scores GROUP BY 1, 2""")
def parsed_table_round_trip(spark, sf_dir):
    rows = logs.parse_lines(logs.read_lines(spark, f"{written_logs(spark, sf_dir)}/*/*.jsonl"))
    scored = with_scores(
        rows.select("model", F.col("dataset").alias("task"), "doc_id", "target", "response"),
        last_numbers(F.col("response"), 4), parse_target(F.col("target")), "Detection",
    )
    path = scratch_path(spark, "parsed")
    sinks.write_parsed(scored, path)
    return rounded(summaries.summarise_parse_stage(spark.read.parquet(path), ["model", "task"], "Detection"))


@query("summary_files_round_trip", f"""
WITH {SCORED} SELECT model, 'avg_mae' AS metric, round(avg(mae), 6) AS value, round(avg(mae), 6) AS csv_value FROM plain_scores GROUP BY 1
UNION ALL SELECT model, 'never', NULL, NULL FROM plain_scores GROUP BY 1""")
def summary_files_round_trip(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True)
    scored = with_scores(rows, last_numbers(F.col("response"), 4), parse_target(F.col("target")), "Detection")
    summary = rounded(scored.groupBy("model").agg(F.avg("mae").alias("avg_mae"))).withColumn("never", F.lit(None).cast("double"))
    parquet, csv, text = (scratch_path(spark, n) for n in ("summary", "csv", "json"))
    sinks.write_summary(summary, parquet, ["model"])
    sinks.write_csv(summary, csv)
    sinks.write_summary_json(summary, text)
    from_csv = spark.read.schema("model string, avg_mae double, never double").option("header", "true").option("nullValue", "NaN").csv(csv)
    from_json = spark.read.schema("model string, avg_mae double, never double").json(text)
    both = sinks.long_metrics(from_csv, ["model"]).withColumnRenamed("value", "csv_value").join(
        sinks.long_metrics(from_json, ["model"]).select("model", "metric"), ["model", "metric"]
    )
    return spark.read.parquet(parquet).join(both, ["model", "metric"])


@query("incrementally_parsed_logs", f"""
WITH {SCORED} SELECT model, count(*) AS num_samples, round(avg(mae), 6) AS avg_mae, round(avg(iou), 6) AS avg_iou FROM plain_scores GROUP BY 1""")
def incrementally_parsed_logs(spark, sf_dir):
    root, out, checkpoint = (scratch_path(spark, n) for n in ("arriving", "parsed", "checkpoint"))
    lines = log_lines(spark, sf_dir)
    for late in (False, True):
        arrived = lines.filter((F.col("model") == "model_P") == late)
        sinks.write_logs(arrived, root)
        incremental.parse_new_files(spark, f"{root}/*/*.jsonl", "Detection", out, checkpoint)
    rows = spark.read.parquet(out)
    return rounded(rows.groupBy("model").agg(F.count("*").alias("num_samples"), F.avg("mae").alias("avg_mae"), F.avg("iou").alias("avg_iou")))


@query("running_summary_of_logs", f"""
WITH {SCORED} SELECT model, count(*) AS num_samples, round(sum(mae), 6) AS sum_mae, count(mae) AS valid, round(avg(mae), 6) AS avg_mae FROM plain_scores GROUP BY 1""")
def running_summary_of_logs(spark, sf_dir):
    root, out, checkpoint = (scratch_path(spark, n) for n in ("arriving", "running", "checkpoint"))
    lines = log_lines(spark, sf_dir)
    totals = {"num_samples": F.count("*"), "sum_mae": F.sum("mae"), "valid": F.count("mae")}
    for late in (False, True):
        sinks.write_logs(lines.filter((F.col("doc_id") % 2 == 0) == late), root)
        scored = incremental.scored_lines(incremental.stream_lines(spark, f"{root}/*/*.jsonl"), "Detection")
        incremental.running_summary(scored, ["model"], totals, out, checkpoint)
    current = incremental.current_summary(spark, out, ["model"])
    return rounded(current.withColumn("avg_mae", F.col("sum_mae") / F.col("valid")))


@query("summary_of_compacted_batches", f"""
WITH {SCORED} SELECT model, count(*) AS num_samples, round(sum(mae), 6) AS sum_mae, count(mae) AS valid, 2 AS snapshots, true AS few_batches FROM plain_scores GROUP BY 1""")
def summary_of_compacted_batches(spark, sf_dir):
    """The running summary over eight batches of which every three are folded, with what is left on disk."""
    root, out, checkpoint = (scratch_path(spark, n) for n in ("arriving", "compacted", "checkpoint"))
    lines = log_lines(spark, sf_dir)
    totals = {"num_samples": F.count("*"), "sum_mae": F.sum("mae"), "valid": F.count("mae")}
    for turn in range(8):
        sinks.write_logs(lines.filter(F.col("doc_id") % 8 == turn), root)
        scored = incremental.scored_lines(incremental.stream_lines(spark, f"{root}/*/*.jsonl"), "Detection")
        incremental.running_summary(scored, ["model"], totals, out, checkpoint, compact_every=3)
    current = incremental.current_summary(spark, out, ["model"])
    left, held = commits.numbered(spark, out, "batch"), commits.numbered(spark, f"{out}/_snapshots", "upto")
    return rounded(current.withColumns({"snapshots": F.lit(len(held)), "few_batches": F.lit(len(left) < 8)}))


@query("logs_paired_as_they_arrive", f"""
WITH {BOXES_SQL}
SELECT model, 'paired' AS status, 'task_of_' || model AS results_task, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM boxes WHERE model <> 'model_P' GROUP BY 1
UNION ALL SELECT 'model_P', 'missing', NULL, NULL, NULL""")
def logs_paired_as_they_arrive(spark, sf_dir):
    """Half of the logs come before their results files and half after; the results of one model never come."""
    root, out, checkpoint = (scratch_path(spark, n) for n in ("arriving", "paired", "checkpoint"))
    lines, results = log_lines(spark, sf_dir), results_lines(spark, sf_dir).where("model <> 'model_P'")
    for arrived in (lines.filter(F.col("doc_id") % 2 == 0), results, lines.filter(F.col("doc_id") % 2 == 1)):
        sinks.write_logs(arrived, root)
        incremental.pair_new_files(spark, root, out, checkpoint, wait_ms=1)
    rows = spark.read.parquet(f"{out}/rows").groupBy("model", F.lit("paired").alias("status"), "results_task").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    missing = spark.read.schema(incremental.PAIRS).parquet(f"{out}/pairs").where("status = 'missing'").select("model", "status").distinct()
    return rows.unionByName(missing, allowMissingColumns=True)


@query("sample_log_sink", """
SELECT o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS target, o_orderstatus AS input, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS kept, o_orderpriority AS response FROM orders""")
def sample_log_sink(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("target"), F.array(F.array("o_orderpriority")).alias("resps"),
        F.array("o_orderpriority").alias("filtered_resps"),
        F.array(F.col("o_orderstatus"), F.col("o_totalprice").cast("string"), F.lit("x")).alias("arguments"),
    )
    path = scratch_path(spark, "samples")
    sinks.write_sample_log(rows, path)
    back = spark.read.schema(
        "doc_id bigint, target string, input string, resps array<array<string>>, arguments map<string,string>"
    ).json(path)
    return back.select(
        "doc_id", "target", "input", F.col("arguments")["0"].isNotNull().alias("kept"), F.col("resps")[0][0].alias("response")
    )


@query("task_lists_and_status", """
WITH t AS (SELECT 'task_' || c_nationkey AS task, count(*) AS n FROM customer GROUP BY 1)
SELECT task, n, n % 2 = 0 AS done FROM t""")
def task_lists_and_status(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("task_"), F.col("c_nationkey").cast("string")).alias("task")).agg(F.count("*").alias("n"))
    # one JSON object per file, one entry per nation
    listed = F.to_json(F.map_from_entries(F.collect_list(F.struct("task", "n")))).alias("value")
    status = F.to_json(F.create_map(F.lit("m"), F.map_from_entries(F.collect_list(F.struct("task", (F.col("n") % 2 == 0).alias("done")))))).alias("value")
    lists, statuses = scratch_path(spark, "lists"), scratch_path(spark, "status")
    counts.agg(listed).write.text(lists)
    counts.agg(status).write.text(statuses)
    return tasks.read_task_list(spark, lists).join(tasks.read_task_status(spark, statuses), "task").select("task", "n", "done")


@query("config_names_from_csv", "SELECT DISTINCT p_brand AS config FROM part")
def config_names_from_csv(spark, sf_dir):
    path = scratch_path(spark, "configs")
    names = table(spark, sf_dir, "part").select("p_brand").distinct().select(F.concat("p_brand", F.lit(",x")).alias("value"))
    names.unionByName(names.limit(1).withColumn("value", F.lit(""))).write.text(path)
    return tasks.read_config_names(spark, path)


CONFIGS = """
SELECT 'base_settings' AS file, concat('output_type: generate_until', char(10), 'dataset_path: d', char(10), 'num_fewshot: 0', char(10), 'doc_to_text: !function utils.f', char(10)) AS value
UNION ALL SELECT concat('region_', CAST(r_regionkey AS STRING), '.yaml'), concat('include: shared/../base_settings', char(10), 'tag: all,', r_name, char(10), 'num_fewshot: ', CAST(r_regionkey AS STRING), char(10)) FROM {region}
UNION ALL SELECT concat('task_', CAST(n_nationkey AS STRING), '.yaml'), concat('task: ', n_name, char(10), 'include: ./region_', CAST(n_regionkey AS STRING), '.yaml', char(10),
  CASE WHEN n_nationkey % 5 = 0 THEN concat('output_type: multiple_choice', char(10)) WHEN n_nationkey % 5 = 1 THEN concat('group: regional', char(10)) ELSE '' END) FROM {nation}
UNION ALL SELECT concat('group_', CAST(r_regionkey AS STRING), '.yaml'), concat('group: g_', r_name, char(10), 'task:', char(10), '  - NATION_', CAST(r_regionkey AS STRING), char(10),
  '  - task: NATION_', CAST(r_regionkey + 5 AS STRING), char(10), '    num_fewshot: 3', char(10), '  - group: inner_', r_name, char(10), '    task:', char(10),
  '      - NATION_20', char(10), '      - task: NATION_21', char(10), '      - task: NATION_21', char(10), '        num_fewshot: 1', char(10)) FROM {region}
"""


def written_configs(spark, sf_dir) -> DataFrame:
    root = scratch_path(spark, "tasks")
    derived(spark, sf_dir, CONFIGS).write.partitionBy("file").option("lineSep", "\n").text(root)
    return tasks.resolved_configs(tasks.read_task_configs(spark, root, "*"))


@query("task_catalogue", """
SELECT n_name AS name, 'task' AS kind, CASE WHEN n_nationkey % 5 = 0 THEN 'multiple_choice' ELSE 'generate_until' END AS output_type,
  'all,' || r_name || CASE WHEN n_nationkey % 5 = 1 THEN '|regional' ELSE '' END AS tags FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'g_' || r_name, 'group', '', '' FROM region""")
def task_catalogue(spark, sf_dir):
    catalog = tasks.task_catalog(written_configs(spark, sf_dir))
    return catalog.select("name", "kind", "output_type", F.array_join("tags", "|").alias("tags"))


@query("tags_and_members", """
WITH t AS (SELECT unnest(['NATION_20', 'NATION_21', 'NATION_21-1']) AS task)
SELECT 'tag' AS kind, 'all,' || r_name AS name, n_name AS task FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'tag', 'regional', n_name FROM nation WHERE n_nationkey % 5 = 1
UNION ALL SELECT 'group', 'g_' || r_name, 'NATION_' || r_regionkey FROM region UNION ALL SELECT 'group', 'g_' || r_name, 'NATION_' || (r_regionkey + 5) FROM region
UNION ALL SELECT 'group', 'g_' || r_name, task FROM region, t UNION ALL SELECT 'group', 'inner_' || r_name, task FROM region, t""")
def tags_and_members(spark, sf_dir):
    configs = written_configs(spark, sf_dir)
    tagged = tasks.tag_index(tasks.task_catalog(configs)).select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), "task")
    members = stats.leaf_tasks(tasks.group_members(configs)).select(F.lit("group").alias("kind"), F.col("group").alias("name"), "task")
    return tagged.unionByName(members)


@query("training_tasks_in_one_table", """
SELECT 'set' || (o_orderkey % 3) AS dataset_name, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS with_status FROM orders GROUP BY 1""")
def training_tasks_in_one_table(spark, sf_dir):
    root = scratch_path(spark, "train")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("img").alias("image"))
    names = [f"set{i}_BoxSize_Task0{i + 1}_Axial" for i in range(3)]
    for i, name in enumerate(names):
        part = orders.filter(F.col("o_orderkey") % 3 == i)
        (part if i == 1 else part.drop("o_orderstatus")).write.parquet(f"{root}/{name}_Train")
    rows = datasets.without_media(datasets.read_training_tasks(spark, root, names, "BoxSize"))
    return rows.groupBy("dataset_name").agg(F.count("*").alias("n"), F.count("o_orderstatus").alias("with_status"))


@query("reformatted_sources", """
SELECT p_partkey AS id, '<|audio_bos|><|AUDIO|><|audio_eos|>' || p_name AS prompt, p_type AS gt, CAST(p_size::FLOAT AS DOUBLE) AS first_time, 'https://www.youtube.com/watch?v=' || p_partkey AS url, CAST(p_size AS VARCHAR) AS "Q" FROM part""")
def reformatted_sources(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    audio, captions = scratch_path(spark, "audio"), scratch_path(spark, "captions")
    parts.select(key.alias("audio"), F.col("p_name").alias("prompt"), F.col("p_type").alias("gt"), F.lit("s").alias("source"), F.lit("t").alias("task")).write.json(audio)
    parts.select(key.alias("video"), F.col("p_name").alias("caption"), F.array("p_size", "p_size").alias("timestamp")).write.json(captions)
    heard = datasets.audio_rows(spark, audio).select(F.col("audio").cast("bigint").alias("id"), "prompt", "gt")
    seen = spark.read.schema(datasets.CAPTION_SCHEMA).json(captions).select(
        F.col("video").cast("bigint").alias("id"), F.col("timestamp")[0].cast("double").alias("first_time"), datasets.video_url(F.col("video")).alias("url")
    )
    asked = datasets.question_rows(
        parts.select("p_partkey", F.col("p_size").alias("Q"), F.col("p_name").alias("A"), F.lit("d").alias("DimensionName"), F.col("p_partkey").alias("VideoID"))
    ).select(F.col("VideoID").cast("bigint").alias("id"), "Q")
    return heard.join(seen, "id").join(asked, "id")


@query("described_videos", """
SELECT 'item' || item_id AS video_name, 'Please provide a detailed description of the video, focusing on the main subjects, their actions, and the background scenes' AS question,
  string_split(text, chr(10))[1] AS answer FROM benchmark""")
def described_videos(spark, sf_dir):
    root = scratch_path(spark, "videos")
    items = table(spark, sf_dir, "benchmark")
    items.select(F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(".mp4.txt")).alias("file"), F.col("text").alias("value")).write.partitionBy("file").text(root)
    return datasets.described_videos(spark, f"{root}/*").withColumn("answer", F.regexp_replace("answer", "\n$", ""))
