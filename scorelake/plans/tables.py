"""Joins, sets, samples, windows and comparisons on run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.draws import SEED, draw
from scorelake.operators import assembly, comparison, lookups, ranking, results, summaries
from scorelake.plans.carriers import BOXES, JUDGED, PLAN_LABEL, PLAN_TASK
from scorelake.plans.catalogue import derived, plain, query, r6, rounded, table
from scorelake.session import durable, release, scratch_path
from scorelake.sources import keyed


def draw_sql(key: str, stream: str = "0", seed: int = SEED) -> str:
    """The draw of :mod:`scorelake.functions.draws` in SQL."""
    def mix(x: str) -> str:
        for _ in range(2):
            x = f"((xor(({x}) >> 16, ({x})) * 73244475) & 4294967295)"
        return f"xor(({x}) >> 16, ({x}))"

    folded = f"xor(xor({key}, {key} >> 32) & 4294967295, {seed}::BIGINT)"
    return mix(f"(({mix(folded)}) + ({stream}) * 40503) & 4294967295")


def start_sql(key: str) -> str:
    """63 random bits of two draws."""
    return f"(((({draw_sql(key, '1')}) & 2147483647) << 32) + ({draw_sql(key, '2')}))"


# ---- lookups ----

PLAN_SQL = f"""plan_label AS ({plain(PLAN_LABEL).replace('STRING', 'VARCHAR')}), plan_task AS ({plain(PLAN_TASK).replace('STRING', 'VARCHAR')}),
boxes AS ({plain(BOXES).replace('STRING', 'VARCHAR')})"""


@query("labels_from_plan", f"""
WITH {PLAN_SQL}
SELECT b.doc_id, l.label_name, k.image_modality AS modality FROM boxes b JOIN plan_label l USING (dataset, task_id, label) JOIN plan_task k USING (dataset, task_id)""")
def labels_from_plan(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True).withColumn("answer", F.col("response"))
    return lookups.with_plan_label(rows, derived(spark, sf_dir, PLAN_LABEL), derived(spark, sf_dir, PLAN_TASK)).select(
        "doc_id", "label_name", "modality"
    )


@query("measured_label_of_task", f"""
WITH {PLAN_SQL}
SELECT b.doc_id, k.target_label AS label, l.label_name, k.image_modality AS modality FROM boxes b JOIN plan_task k USING (dataset, task_id)
JOIN plan_label l ON l.dataset = b.dataset AND l.task_id = b.task_id AND l.label = k.target_label""")
def measured_label_of_task(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True).withColumn("answer", F.col("response"))
    return lookups.with_target_label(rows, derived(spark, sf_dir, PLAN_LABEL), derived(spark, sf_dir, PLAN_TASK)).select(
        "doc_id", "label", "label_name", "modality"
    )


# landmarks P<k>, lines L<k> between landmarks, angles A<k> between lines, all per nation
ELEMENTS = """
SELECT concat('set', CAST(n_regionkey AS STRING)) AS dataset, CAST(1 AS INT) AS task_id, 'landmarks_map' AS map_name,
       concat('P', CAST(n_nationkey AS STRING)) AS key, n_name AS name, CAST(NULL AS STRING) AS element_map_name, '' AS k1, '' AS k2 FROM {nation}
UNION ALL
SELECT concat('set', CAST(n_regionkey AS STRING)), 1, 'lines_map', concat('L', CAST(n_nationkey AS STRING)),
       CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE concat('line of ', n_name) END, 'landmarks_map',
       concat('P', CAST(n_nationkey AS STRING)), concat('P', CAST((n_nationkey + 5) % 25 AS STRING)) FROM {nation}
UNION ALL
SELECT concat('set', CAST(n_regionkey AS STRING)), 1, 'angles_map', concat('A', CAST(n_nationkey AS STRING)), concat('angle of ', n_name), 'lines_map',
       concat('L', CAST(n_nationkey AS STRING)), concat('L', CAST((n_nationkey + 10) % 25 AS STRING)) FROM {nation}
"""
ASKED = """
SELECT c_custkey AS doc_id, concat('set', CAST(n_regionkey AS STRING)) AS dataset, CAST(1 AS INT) AS task_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'distance' ELSE 'angle' END AS metric_type,
       CASE WHEN c_custkey % 2 = 0 THEN 'lines_map' ELSE 'angles_map' END AS metric_map_name,
       concat(CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'A' END, CAST(c_nationkey AS STRING)) AS metric_key
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
"""


@query("landmark_prompts", f"""
WITH e AS ({plain(ELEMENTS).replace('STRING', 'VARCHAR')}), q AS ({plain(ASKED).replace('STRING', 'VARCHAR')}),
m AS (SELECT q.*, e.name AS metric_name, e.k1, e.k2 FROM q JOIN e ON e.dataset = q.dataset AND e.map_name = q.metric_map_name AND e.key = q.metric_key),
pts AS (SELECT dataset, key, name FROM e WHERE map_name = 'landmarks_map'), lin AS (SELECT dataset, key, k1, k2 FROM e WHERE map_name = 'lines_map'),
f AS (
  SELECT doc_id, metric_type, metric_name, a.name AS p0, b.name AS p1, NULL AS p2, NULL AS p3 FROM m
    LEFT JOIN pts a ON a.dataset = m.dataset AND a.key = m.k1 LEFT JOIN pts b ON b.dataset = m.dataset AND b.key = m.k2 WHERE metric_type = 'distance'
  UNION ALL
  SELECT doc_id, metric_type, metric_name, a.name, b.name, c.name, d.name FROM m
    LEFT JOIN lin x ON x.dataset = m.dataset AND x.key = m.k1 LEFT JOIN lin y ON y.dataset = m.dataset AND y.key = m.k2
    LEFT JOIN pts a ON a.dataset = m.dataset AND a.key = x.k1 LEFT JOIN pts b ON b.dataset = m.dataset AND b.key = x.k2
    LEFT JOIN pts c ON c.dataset = m.dataset AND c.key = y.k1 LEFT JOIN pts d ON d.dataset = m.dataset AND d.key = y.k2 WHERE metric_type = 'angle')
SELECT doc_id, CASE WHEN metric_type = 'distance' AND metric_name <> '' THEN 'estimate the distance of ' || metric_name || ' in millimeters, which is the distance between 2 landmark points: (landmark 1) ' || p0 || ', (landmark 2) ' || p1 || '.' || chr(10)
  WHEN metric_type = 'distance' THEN 'estimate the distance between 2 landmark points in millimeters: (landmark 1) ' || p0 || ', (landmark 2) ' || p1 || '.' || chr(10)
  ELSE 'estimate the angle of ' || metric_name || ' in degree, which is the angle between 2 lines: (line 1) the line connecting ' || p0 || ' and ' || p1 || ', (line 2) the line connecting ' || p2 || ' and ' || p3 || '.' || chr(10) END AS task
FROM f""")
def landmark_prompts(spark, sf_dir):
    from scorelake.functions import prompts

    elements = derived(spark, sf_dir, ELEMENTS).withColumn("element_keys", F.array("k1", "k2"))
    rows = lookups.with_landmarks(derived(spark, sf_dir, ASKED), elements)
    name, points = F.col("metric_name"), F.col("points")
    asked = F.when(F.col("metric_type") == "distance", prompts.distance_task(name, points, F.lit(" mm "))).otherwise(
        prompts.angle_task(name, points, F.lit("degree"))
    )
    return rows.select("doc_id", asked.alias("task"))


@query("items_joined_to_results", f"""
WITH j AS ({plain(JUDGED).replace('STRING', 'VARCHAR')}) SELECT id, j.subtask, j.score, p_name AS question, p_type AS images FROM j JOIN part ON p_partkey = j.id""")
def items_joined_to_results(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("images"))
    return comparison.with_item_data(derived(spark, sf_dir, JUDGED).select("id", "subtask", "score"), items)


@query("model_against_model", """
WITH a AS (SELECT p_partkey AS id, p_name AS question, CAST(p_size % 11 AS DOUBLE) AS score, p_type AS reason FROM part),
b AS (SELECT event_id AS id, CAST(user_id % 11 AS DOUBLE) AS score, event_type AS reason FROM events)
SELECT id, question, a.score AS score_1, a.reason AS reason_1, b.score AS score_2, b.reason AS reason_2, a.score - b.score AS delta FROM a JOIN b USING (id) ORDER BY delta DESC""")
def model_against_model(spark, sf_dir):
    first = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), (F.col("p_size") % 11).cast("double").alias("score"),
        F.col("p_type").alias("reason"),
    )
    second = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.lit("same").alias("question"), (F.col("user_id") % 11).cast("double").alias("score"),
        F.col("event_type").alias("reason"),
    )
    return comparison.against(first, second).orderBy(F.desc("delta"))


@query("run_against_run", """
WITH o AS (SELECT o_orderstatus AS model, o_orderpriority AS task, avg(o_totalprice / 1000000) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' GROUP BY 1, 2),
n AS (SELECT o_orderstatus AS model, o_orderpriority AS task, avg(o_totalprice / 1000000) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority <> '5-LOW' GROUP BY 1, 2)
SELECT coalesce(o.model, n.model) AS model, coalesce(o.task, n.task) AS task, round(coalesce(o.value, 0) * 100, 6) AS old_value, round(coalesce(n.value, 0) * 100, 6) AS new_value,
  round(coalesce(n.value, 0) * 100 - coalesce(o.value, 0) * 100, 6) AS difference,
  CASE WHEN coalesce(n.value, 0) > coalesce(o.value, 0) THEN printf('**+%.2f**', coalesce(n.value, 0) * 100 - coalesce(o.value, 0) * 100) ELSE printf('%.2f', coalesce(n.value, 0) * 100 - coalesce(o.value, 0) * 100) END AS shown
FROM o FULL JOIN n ON o.model = n.model AND o.task = n.task""")
def run_against_run(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("task"), "o_totalprice", "o_orderdate"
    )
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    mean = F.avg(F.col("o_totalprice") / 1000000).alias("value")
    old = orders.filter(early & (F.col("model") != "P")).groupBy("model", "task").agg(mean)
    new = orders.filter(~early & (F.col("task") != "5-LOW")).groupBy("model", "task").agg(mean)
    return rounded(comparison.run_difference(old, new))


# ---- pending work and caches ----

@query("pending_tasks", "SELECT c_custkey AS task FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"))
    status = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("task"), F.lit(True).alias("done")
    )
    return assembly.pending(tasks, status, "F")


@query("recorded_status", """
SELECT o_orderstatus AS model, o_custkey AS task, bool_or(o_orderpriority = '1-URGENT' OR o_orderkey % 2 = 0) AS done FROM orders GROUP BY 1, 2""")
def recorded_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("task"), "o_orderpriority", "o_orderkey")
    status = orders.groupBy("model", "task").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("done"))
    return assembly.record_done(status, orders.filter(F.col("o_orderkey") % 2 == 0))


@query("response_cache", """
WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity > 45 AS sampled, '["generate","' || l_partkey || '","' || l_suppkey || '"]' AS body FROM lineitem),
c AS (SELECT '["generate","' || p_partkey || '","' || p_size || '"]' AS body FROM part),
h AS (SELECT r.*, NOT sampled AND body IN (SELECT body FROM c) AS hit FROM r)
SELECT l_suppkey, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS to_run, min(sha256(body)) AS first_hash FROM h GROUP BY 1""")
def response_cache(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") > 45).alias("sampled"),
        assembly.request_hash(F.lit("generate"), F.col("l_partkey"), F.col("l_suppkey")).alias("request_hash"),
    )
    cache = table(spark, sf_dir, "part").select(
        assembly.request_hash(F.lit("generate"), F.col("p_partkey"), F.col("p_size")).alias("request_hash"), F.col("p_name").alias("response")
    )
    hits, to_run = assembly.answered_from_cache(requests, cache, sampled=F.col("sampled"))
    both = hits.select("l_suppkey", "request_hash", F.lit(True).alias("hit")).unionByName(
        to_run.select("l_suppkey", "request_hash", F.lit(False).alias("hit"))
    )
    return both.groupBy("l_suppkey").agg(
        F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("to_run"), F.min("request_hash").alias("first_hash")
    )


@query("response_store", """
WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, '["generate","' || l_partkey || '","' || l_suppkey || '"]' AS body, l_quantity > 45 AS sampled, l_orderkey % 4 AS turn FROM lineitem),
a AS (SELECT sha256(body) AS h, turn, id, sampled FROM r), f AS (SELECT h, min(turn) FILTER (WHERE NOT sampled) AS first_turn FROM a GROUP BY 1)
SELECT turn, count(*) FILTER (WHERE NOT sampled AND first_turn < turn) AS hits, count(*) FILTER (WHERE sampled OR first_turn >= turn) AS to_run, (SELECT count(DISTINCT h) FROM a WHERE NOT sampled) AS stored,
  (SELECT sum(m % 1009)::BIGINT FROM (SELECT max(id) AS m FROM a JOIN f USING (h) WHERE NOT sampled AND turn = first_turn GROUP BY h)) AS response_sum FROM a JOIN f USING (h) GROUP BY 1""")
def response_store(spark, sf_dir):
    """Requests in four turns: what earlier turns answered is found in the store, what is new is run and added to it."""
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    requests = table(spark, sf_dir, "lineitem").select(
        number.alias("request_id"), (F.col("l_quantity") > 45).alias("sampled"), (F.col("l_orderkey") % 4).alias("turn"),
        assembly.request_hash(F.lit("generate"), F.col("l_partkey"), F.col("l_suppkey")).alias("request_hash"),
    )
    store = keyed.KeyedStore(spark, scratch_path(spark, "responses"), "request_hash string, response string", digits=1)
    counts = None
    for turn in range(4):
        hits, to_run = keyed.answered_from_store(requests.where(F.col("turn") == turn), store, F.col("sampled"))
        # Kept, as the store they were looked up in is about to grow.
        met = durable(hits.drop("response").withColumn("hit", F.lit(True)).unionByName(to_run.withColumn("hit", F.lit(False))), "zstd")
        found = durable(met.groupBy("turn").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("to_run")))
        counts = found if counts is None else counts.unionByName(found)
        keyed.record_answers(store, met.where("not hit and not sampled").withColumn("response", F.col("request_id").cast("string")))
        release(met)
    whole = store.rows().agg(F.count("*").alias("stored"), F.sum(F.col("response").cast("long") % 1009).alias("response_sum"))
    return counts.crossJoin(F.broadcast(whole))  # one row


# ---- grouping and order ----

@query("responses_in_request_order", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS position FROM conversations""")
def responses_in_request_order(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return assembly.in_request_order(rows, ["conv_id"], ["turn", "text"]).select("conv_id", "turn", F.col("position").cast("bigint").alias("position"))


@query("sorted_batches", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY -n_chars, doc_id) - 1 AS k FROM documents) SELECT doc_id, lang, k AS batch_row, k // 20 AS batch FROM r""")
def sorted_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    out = ranking.in_batches(docs, 20, [-F.col("n_chars"), F.col("doc_id")], ["lang"])
    return out.select("doc_id", "lang", F.col("batch_row").cast("bigint").alias("batch_row"), "batch")


@query("near_equal_parts", "SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey) AS part FROM customer")
def near_equal_parts(spark, sf_dir):
    return ranking.divided(table(spark, sf_dir, "customer").select("c_custkey"), 7, [F.col("c_custkey")])


@query("rank_shards", "SELECT o_orderkey, o_orderkey % 3 AS rank FROM orders WHERE o_orderkey < 1000000")
def rank_shards(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    rank = F.coalesce(*[F.when(ranking.rank_shard(F.col("o_orderkey"), r, 3, 1000000), F.lit(r).cast("bigint")) for r in range(3)])
    return keys.withColumn("rank", rank).filter(F.col("rank").isNotNull())


@query("best_items_per_subtask", f"""
WITH j AS ({plain(JUDGED).replace('STRING', 'VARCHAR')}), r AS (SELECT id, CASE subtask WHEN 'Evaluative Questions' THEN 'Divergent Thinking' ELSE subtask END AS subtask, score FROM j WHERE score > 6 AND subtask <> 'Further Insights')
SELECT id, subtask, score, row_number() OVER (PARTITION BY subtask ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 50""")
def best_items_per_subtask(spark, sf_dir):
    items = derived(spark, sf_dir, JUDGED).filter(comparison.good_enough(F.col("score"), 6) & (F.col("subtask") != comparison.DROPPED_SUBTASK))
    recoded = items.select("id", comparison.recoded_subtask(F.col("subtask")).alias("subtask"), "score")
    return comparison.best_per_subtask(recoded, 50).withColumn("rank", F.col("rank").cast("bigint"))


@query("best_items_with_shuffled_ties", f"""
WITH j AS ({plain(JUDGED).replace('STRING', 'VARCHAR')})
SELECT id, subtask, score, row_number() OVER (PARTITION BY subtask ORDER BY score DESC, {draw_sql('id')}, id) AS rank FROM j QUALIFY rank <= 20""")
def best_items_with_shuffled_ties(spark, sf_dir):
    items = derived(spark, sf_dir, JUDGED).select("id", "subtask", "score")
    return comparison.best_per_subtask(items, 20, shuffled=True).withColumn("rank", F.col("rank").cast("bigint"))


@query("last_row_per_model", "SELECT user_id, last(event_type ORDER BY event_id) AS event_type, max(event_id) AS event_id, last(\"value\" ORDER BY event_id) AS \"value\" FROM events GROUP BY user_id")
def last_row_per_model(spark, sf_dir):
    return assembly.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id"], "event_id").select(
        "user_id", "event_type", "event_id", "value"
    )


@query("latest_runs", """
WITH f AS (SELECT o_orderstatus AS model, regexp_replace(o_orderpriority, '[^a-zA-Z0-9_]', '_', 'g') AS task, strftime(o_orderdate, '%Y%m%dT%H') AS t FROM orders)
SELECT model, task, max(t) AS latest FROM f GROUP BY 1, 2 UNION ALL SELECT model, 'results', max(t) FROM f GROUP BY 1""")
def latest_runs(spark, sf_dir):
    name = F.concat(F.lit("samples_"), "o_orderpriority", F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd'T'HH"), F.lit(".jsonl"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("model"), name.alias("file_name"))
    return results.latest_runs(files)


@query("labels_by_size", "SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, label")
def labels_by_size(spark, sf_dir):
    return comparison.counted(table(spark, sf_dir, "part").select(F.col("p_type").alias("label")), ["label"]).orderBy(F.desc("n"), "label")


# ---- samples and splits ----

@query("exact_split", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {draw_sql('o_orderkey')}, o_orderkey) <= 100 THEN 'validation' ELSE 'train' END AS split FROM orders""")
def exact_split(spark, sf_dir):
    return assembly.split_exact(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("limited_split", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {draw_sql('o_orderkey')}, o_orderkey) <= 50 THEN 'validation' ELSE 'train' END AS split
FROM orders QUALIFY row_number() OVER (ORDER BY {draw_sql('o_orderkey')}, o_orderkey) <= 250""")
def limited_split(spark, sf_dir):
    return assembly.limited_split(table(spark, sf_dir, "orders").select("o_orderkey"), 200, 50, "o_orderkey")


@query("sample_per_task", f"""
SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {draw_sql('event_id')}, event_id) <= CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 40 WHEN 'error' THEN 0 ELSE 25 END""")
def sample_per_task(spark, sf_dir):
    limits = assembly.sample_limits(
        {"view": (7, 1), "click": (40, 1), "error": (9, 1), "signup": (0, 1), "purchase": (-1, 1)}, (25, 5),
        listed=["view", "click", "signup", "purchase"],
    )
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ranking.sample_rows(rows, assembly.limit_column(limits, F.col("event_type"), 0), "event_id", by=["event_type"])


@query("limits_as_counts_and_shares", """
SELECT event_type, count(*) AS original, least(1500, count(*)) AS effective, CAST(ceil(count(*) * 0.015::DOUBLE) AS BIGINT) AS by_share FROM events GROUP BY 1""")
def limits_as_counts_and_shares(spark, sf_dir):
    from scorelake.operators.stats import dataset_sizes

    sizes = dataset_sizes(table(spark, sf_dir, "events"), ["event_type"], 1500)
    return sizes.withColumn("by_share", ranking.limit_size(F.col("original"), 0.015))


@query("few_shot_examples", f"""
WITH pool AS (SELECT s_suppkey, row_number() OVER (ORDER BY {draw_sql('s_suppkey')}, s_suppkey) - 1 AS k FROM supplier), n AS (SELECT count(*) AS n FROM supplier),
d AS (SELECT c_custkey AS s_suppkey, {start_sql('c_custkey')} % n AS start FROM customer, n),
w AS (SELECT d.s_suppkey, step, (start + step) % n AS k FROM d, n, (SELECT unnest(range(0, 4)) AS step)),
m AS (SELECT w.s_suppkey, step, pool.s_suppkey AS example FROM w JOIN pool USING (k) WHERE pool.s_suppkey <> w.s_suppkey)
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY step) - 1 AS INT) AS place, example FROM m QUALIFY place < 3""")
def few_shot_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"))
    return assembly.few_shot_examples(docs, table(spark, sf_dir, "supplier"), 3, "s_suppkey")


@query("few_shot_contexts", f"""
WITH pool AS (SELECT s_suppkey, row_number() OVER (ORDER BY {draw_sql('s_suppkey')}, s_suppkey) - 1 AS k, 'Q: ' || s_name || ' A: ' || s_nationkey AS shot FROM supplier), n AS (SELECT count(*) AS n FROM supplier),
w AS (SELECT s_suppkey, step, ({start_sql('s_suppkey')} % n + step) % n AS k FROM supplier, n, (SELECT unnest(range(0, 3)) AS step)),
m AS (SELECT w.s_suppkey, step, shot FROM w JOIN pool USING (k) WHERE pool.s_suppkey <> w.s_suppkey),
p AS (SELECT s_suppkey, shot, row_number() OVER (PARTITION BY s_suppkey ORDER BY step) AS place FROM m QUALIFY place <= 2)
SELECT s_suppkey, string_agg(shot, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) AS context FROM p GROUP BY 1""")
def few_shot_contexts(spark, sf_dir):
    pool = table(spark, sf_dir, "supplier")
    shots = assembly.few_shot_examples(pool, pool, 2, "s_suppkey")
    return assembly.few_shot_context(
        shots, pool, "s_suppkey", F.concat(F.lit("Q: "), "s_name"), F.concat(F.lit("A: "), F.col("s_nationkey").cast("string"))
    )


@query("first_rows_of_pool", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5")
def first_rows_of_pool(spark, sf_dir):
    return assembly.first_n(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), 5, "s_suppkey")


# ---- sets ----

@query("aligned_union", """
SELECT CAST(c_acctbal AS DOUBLE) AS acctbal, c_custkey AS id, c_mktsegment AS segment, '{"kind":"customer","size":null,"nation":' || c_nationkey || '}' AS s FROM customer
UNION ALL SELECT NULL, p_partkey, NULL, '{"kind":"part","size":' || p_size || ',"nation":null}' FROM part""")
def aligned_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
        F.struct(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).alias("s"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.struct(F.lit("part").alias("kind"), F.col("p_size").alias("size")).alias("s")
    )
    out = assembly.union_all([customers, parts])
    s = F.struct(F.col("s.kind").alias("kind"), F.col("s.size").alias("size"), F.col("s.nation").alias("nation"))
    return out.withColumn("s", F.to_json(s, {"ignoreNullFields": "false"}))


@query("subset_by_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def subset_by_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return assembly.subset_by_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


@query("names_by_glob", "SELECT DISTINCT p_name FROM part WHERE p_name GLOB 'red*' OR p_name GLOB '*b?lt' OR p_name GLOB '[a-c]*ring'")
def names_by_glob(spark, sf_dir):
    return assembly.match_names(table(spark, sf_dir, "part"), "p_name", ["red*", "*b?lt", "[a-c]*ring"])


@query("tasks_in_several_groups", "SELECT p_name AS task, count(*) AS claims, min(p_type) AS first_group, max(p_type) AS last_group FROM (SELECT DISTINCT p_name, p_type FROM part) GROUP BY 1 HAVING count(*) > 1")
def tasks_in_several_groups(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_name").alias("task"), F.col("p_type").alias("group")).distinct()
    return assembly.oversubscribed(members)


@query("appended_with_next_ids", """
SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
SELECT (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1, c_name FROM customer""")
def appended_with_next_ids(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    extra = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_acctbal", "c_custkey")
    return assembly.append_numbered(base, extra, [F.col("c_acctbal"), F.col("c_custkey")])


@query("samples_in_groups", """
WITH m AS (SELECT p_brand AS task, p_type AS "group" FROM part WHERE p_size = 1 GROUP BY 1, 2)
SELECT p_partkey, p_brand AS task, "group" FROM part JOIN m ON m.task = p_brand UNION ALL SELECT p_partkey, p_brand, NULL FROM part WHERE p_brand NOT IN (SELECT task FROM m)""")
def samples_in_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "task", "p_type": "group"})
    members = parts.filter(F.col("p_size") == 1).select("task", "group").distinct()
    return assembly.in_groups(parts.select("p_partkey", "task"), members).select("p_partkey", "task", "group")


# ---- judged items ----

@query("judge_scores_with_total", f"""
WITH j AS ({plain(JUDGED).replace('STRING', 'VARCHAR')})
SELECT coalesce(subtask, 'Total') AS subtask, count(*) AS num_scored, round(avg(score / 10) * 100, 6) AS score FROM j WHERE score <> -1 GROUP BY ROLLUP (subtask)
UNION ALL SELECT 'Divergent Thinking', 0, NULL""")
def judge_scores_with_total(spark, sf_dir):
    return rounded(summaries.judged_scores(derived(spark, sf_dir, JUDGED), comparison.SUBTASKS))


@query("published_scores_that_differ", f"""
WITH j AS ({plain(JUDGED).replace('STRING', 'VARCHAR')}), c AS (SELECT subtask, avg(score / 10) * 100 AS score FROM j WHERE score <> -1 GROUP BY 1),
p AS (SELECT subtask, CASE WHEN subtask LIKE 'A%' THEN score + 0.001 ELSE score END AS score FROM c)
SELECT p.subtask, round(p.score, 6) AS score, round(c.score, 6) AS recomputed FROM p JOIN c USING (subtask) WHERE abs(p.score - c.score) > 1e-6""")
def published_scores_that_differ(spark, sf_dir):
    computed = summaries.judged_scores(derived(spark, sf_dir, JUDGED)).select("subtask", "score").filter(F.col("subtask") != "Total")
    off = F.when(F.col("subtask").startswith("A"), F.col("score") + 0.001).otherwise(F.col("score"))
    return rounded(summaries.disagreements(computed.withColumn("score", off), computed, ["subtask"]))


@query("counts_per_subject", f"""
WITH j AS ({plain(JUDGED).replace('STRING', 'VARCHAR')}), s AS (SELECT regexp_extract(website, '''subject'': ''([^'']*)''', 1) AS subject FROM j), n AS (SELECT subject, count(*) AS n FROM s GROUP BY 1)
SELECT subject, n, round((SELECT avg(n) FROM n), 6) AS mean_count FROM n""")
def counts_per_subject(spark, sf_dir):
    rows = derived(spark, sf_dir, JUDGED).select(comparison.literal_field(F.col("website"), "subject").alias("subject"))
    counts = comparison.counted(rows, ["subject"])
    return counts.withColumn("mean_count", r6(comparison.mean_count(rows, "subject").select("mean_count").scalar()))


@query("results_with_errors", """
WITH r AS (SELECT n_name AS task, count(*) AS k, avg(c_acctbal) AS v, stddev_samp(c_acctbal) / sqrt(count(*)) AS e FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT task, 'none' AS filter, 'acc' AS metric, round(v, 6) AS "value", round(e, 6) AS stderr FROM r UNION ALL SELECT task, 'strict', 'n', CAST(k AS DOUBLE), NULL FROM r""")
def results_with_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    wide = rows.groupBy(F.col("n_name").alias("task")).agg(
        F.avg("c_acctbal").alias("acc,none"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("acc_stderr,none"),
        F.count("*").cast("double").alias("n,strict"), F.lit(1.0).alias("alias"),
    )
    long = wide.unpivot(["task"], ["acc,none", "acc_stderr,none", "n,strict", "alias"], "metric", "value")
    return rounded(results.with_errors(long))


@query("flat_results", """
WITH r AS (SELECT n_name AS task, count(*) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT task || '/n' AS key, CAST(k AS DOUBLE) AS number, NULL AS text FROM r UNION ALL SELECT task || '/alias', NULL, 'task of ' || task FROM r""")
def flat_results(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    wide = rows.groupBy(F.col("n_name").alias("task")).agg(F.count("*").cast("string").alias("n,none")).withColumn("alias", F.concat(F.lit("task of "), "task"))
    return results.flat_results(wide.unpivot(["task"], ["n,none", "alias"], "metric", "value"))


@query("content_hashes_per_task", """
WITH h AS (SELECT doc_id, lang, sha256(text) AS doc_hash, sha256(lang || source) AS prompt_hash, sha256(CAST(n_chars AS VARCHAR)) AS target_hash FROM documents),
t AS (SELECT lang, sha256(doc_id || ':' || doc_hash || prompt_hash || target_hash) AS d FROM h),
p AS (SELECT lang, [('0x' || substr(d, 1 + 15 * i, 15))::BIGINT::HUGEINT FOR i IN range(0, 4)] AS n FROM t)
SELECT lang, sha256(concat_ws(':', count(*), sum(n[1]), sum(n[2]), sum(n[3]), sum(n[4]))) AS task_hash FROM p GROUP BY 1""")
def content_hashes_per_task(spark, sf_dir):
    docs = results.content_hashes(
        table(spark, sf_dir, "documents"), F.col("text"), F.concat("lang", "source"), F.col("n_chars").cast("string")
    )
    row = F.concat("doc_hash", "prompt_hash", "target_hash")
    return results.task_hashes(docs, ["lang"], "doc_id", row)


@query("shuffled_order", f"SELECT o_orderkey, {draw_sql('o_orderkey')} AS drawn, {draw_sql('o_custkey', 'o_orderkey % 5', 7)} AS drawn_again FROM orders")
def shuffled_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", draw(F.col("o_orderkey")).alias("drawn"), draw(F.col("o_custkey"), F.col("o_orderkey") % 5, 7).alias("drawn_again")
    )


@query("table_upkeep", f"""
WITH j AS ({plain(JUDGED).replace('STRING', 'VARCHAR')}) SELECT id, subtask, CASE model WHEN 'model_1' THEN 'Model One' ELSE model END AS model FROM j WHERE id <> 35""")
def table_upkeep(spark, sf_dir):
    items = comparison.renamed(derived(spark, sf_dir, JUDGED), "model", {"model_1": "Model One"})
    return comparison.without(items, ["score", "website"], ids=[35])
