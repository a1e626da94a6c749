"""Corpus statistics, standard errors and group scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scorelake.functions import textscores
from scorelake.functions.draws import SPAN
from scorelake.operators import registry, stats, translation
from scorelake.operators.ranking import joined_null_safe
from scorelake.plans.catalogue import derived, query, rounded, table
from scorelake.plans.tables import draw_sql

LABELLED = """
SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS INT) AS gold, CAST(d.n_chars > 700 AS INT) AS pred,
       CAST(l.toxic AS INT) AS toxic, d.n_chars AS n_chars
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id
"""
LABELLED_SQL = LABELLED.replace("{documents}", "documents").replace("{labels}", "labels")


@query("perplexity_and_bits", f"""
SELECT event_type, round(exp(-avg(-value / 100)), 6) AS perplexity, round(exp(-sum(-value) / sum(user_id + 1)), 6) AS word_perplexity,
  round(-sum(-value) / sum(user_id + 1) / {math.log(2)!r}, 6) AS bits_per_byte, 999 AS bypass, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def perplexity_and_bits(spark, sf_dir):
    ll, weight = -F.col("value"), F.col("user_id") + 1
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(
        stats.perplexity(ll / 100).alias("perplexity"), stats.weighted_perplexity(ll, weight).alias("word_perplexity"),
        stats.bits_per_byte(ll, weight).alias("bits_per_byte"), stats.bypass().alias("bypass"), F.avg("value").alias("mean"),
    ))


@query("deviations_and_stderr", """
SELECT event_type, round(stddev_pop(value), 6) AS pop_stddev, round(stddev_samp(value), 6) AS sample_stddev, round(stddev_samp(value) / sqrt(count(*)), 6) AS stderr FROM events GROUP BY 1""")
def deviations_and_stderr(spark, sf_dir):
    v = F.col("value")
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.stddev_pop(v).alias("pop_stddev"), F.stddev_samp(v).alias("sample_stddev"), stats.mean_stderr(v).alias("stderr")
    ))


@query("f1_and_matthews", f"""
WITH c AS (SELECT lang, count(*) FILTER (WHERE gold = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (WHERE gold <> 1 AND pred = 1)::DOUBLE AS fp,
  count(*) FILTER (WHERE gold = 1 AND pred <> 1)::DOUBLE AS fn, count(*) FILTER (WHERE gold <> 1 AND pred <> 1)::DOUBLE AS tn FROM ({LABELLED_SQL}) GROUP BY 1)
SELECT lang, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c""")
def f1_and_matthews(spark, sf_dir):
    rows = derived(spark, sf_dir, LABELLED)
    return rounded(rows.groupBy("lang").agg(
        stats.f1_score(F.col("gold"), F.col("pred")).alias("f1"), stats.matthews_corrcoef(F.col("gold"), F.col("pred")).alias("mcc")
    ))


@query("brier_score", f"""
WITH p AS (SELECT source, gold, 1.0 / (1 + n_chars / 500.0::DOUBLE) AS q FROM ({LABELLED_SQL}))
SELECT source, round(avg(power(q - CASE WHEN gold = 0 THEN 1 ELSE 0 END, 2) + power((1 - q) - CASE WHEN gold = 1 THEN 1 ELSE 0 END, 2)), 6) AS brier FROM p GROUP BY 1""")
def brier_score(spark, sf_dir):
    rows = derived(spark, sf_dir, LABELLED)
    q = F.lit(1.0) / (1 + F.col("n_chars") / 500.0)
    return rounded(rows.groupBy("source").agg(F.avg(textscores.brier(F.array(q, 1 - q), F.col("gold"))).alias("brier")))


@query("all_answers_right", f"""
WITH r AS (SELECT lang, source, min(CAST(gold = pred AS INT)) AS ok FROM ({LABELLED_SQL}) GROUP BY 1, 2), s AS (SELECT source, min(CAST(gold = pred AS INT)) AS ok FROM ({LABELLED_SQL}) GROUP BY 1)
SELECT round(avg(ok), 6) AS acc_all, round((SELECT stddev_samp(ok) / sqrt(count(*)) FROM s), 6) AS acc_all_stderr FROM r""")
def all_answers_right(spark, sf_dir):
    rows = derived(spark, sf_dir, LABELLED)
    return rounded(stats.all_right(rows, F.col("gold") == F.col("pred"), ["lang", "source"], ["source"]))


@query("middle_value_in_order", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS median FROM r WHERE k = n // 2""")
def middle_value_in_order(spark, sf_dir):
    return stats.middle_in_order(table(spark, sf_dir, "events"), "value", ["event_id"], ["event_type"])


@query("registered_metrics", f"""
SELECT lang, round(avg(CAST(gold = pred AS INT)), 6) AS acc, round(exp(-avg(-n_chars / 1000.0::DOUBLE)), 6) AS perplexity FROM ({LABELLED_SQL}) GROUP BY 1""")
def registered_metrics(spark, sf_dir):
    rows = derived(spark, sf_dir, LABELLED).withColumns(
        {"acc": (F.col("gold") == F.col("pred")).cast("double"), "perplexity": -F.col("n_chars") / 1000.0}
    )
    return rounded(registry.aggregate(rows, ["lang"], ["acc", "perplexity"]))


CELLS_SQL = """count(*) FILTER (WHERE gold = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (WHERE gold <> 1 AND pred = 1)::DOUBLE AS fp,
  count(*) FILTER (WHERE gold = 1 AND pred <> 1)::DOUBLE AS fn, count(*) FILTER (WHERE gold <> 1 AND pred <> 1)::DOUBLE AS tn"""


# Standard errors of F1 and Matthews by the delta method: the gradient of the score by each cell of the confusion table.
F1_ERROR = "CASE WHEN 2 * tp + fp + fn > 0 THEN sqrt(tp * power(2 * (fp + fn), 2) + (fp + fn) * power(2 * tp, 2)) / power(2 * tp + fp + fn, 2) END"
MCC_ERROR = """CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN sqrt(
  tp * power(tn / root - score / 2 * (1 / (tp + fp) + 1 / (tp + fn)), 2) + tn * power(tp / root - score / 2 * (1 / (tn + fp) + 1 / (tn + fn)), 2)
  + fp * power(-fn / root - score / 2 * (1 / (tp + fp) + 1 / (tn + fp)), 2) + fn * power(-fp / root - score / 2 * (1 / (tp + fn) + 1 / (tn + fn)), 2)) END"""
MCC_CELLS = "SELECT *, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS root, (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS score FROM {cells}"
#: A resampled error is held against the closed form it tends to; with a dozen rows they may differ by a fifth.
TOLERANCE = 0.25


@query("registered_scores_and_errors", f"""
WITH l AS (SELECT *, CAST(gold = pred AS INT) AS ok, 1.0 / (1 + n_chars / 500.0::DOUBLE) AS q, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM ({LABELLED_SQL})),
c AS (SELECT lang, {CELLS_SQL} FROM l GROUP BY 1), m AS ({MCC_CELLS.format(cells="c")}), s AS (SELECT lang, source, min(ok) AS ok FROM l GROUP BY 1, 2), w AS (SELECT lang, source, toxic, min(ok) AS ok FROM l GROUP BY 1, 2, 3)
SELECT lang, 'acc' AS metric, round(avg(ok), 6) AS value, round(stddev_samp(ok) / sqrt(count(*)), 6) AS closed_stderr, true AS agrees FROM l GROUP BY 1
UNION ALL SELECT lang, 'perplexity', round(exp(avg(n_chars / 10000.0::DOUBLE)), 6), round(exp(avg(n_chars / 10000.0::DOUBLE)) * stddev_pop(n_chars / 10000.0::DOUBLE) / sqrt(count(*)), 6), true FROM l GROUP BY 1
UNION ALL SELECT lang, 'brier_score', round(avg(power(q - CASE WHEN gold = 0 THEN 1 ELSE 0 END, 2) + power((1 - q) - CASE WHEN gold = 1 THEN 1 ELSE 0 END, 2)), 6), NULL, true FROM l GROUP BY 1
UNION ALL SELECT lang, 'f1', round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6), round({F1_ERROR}, 6), true FROM c
UNION ALL SELECT lang, 'mcc', round(coalesce(score, 0), 6), round({MCC_ERROR}, 6), true FROM m
UNION ALL SELECT lang, 'acc_all', round(avg(w.ok), 6), (SELECT round(stddev_samp(ok) / sqrt(count(*)), 6) FROM s WHERE s.lang = w.lang), true FROM w GROUP BY 1
UNION ALL SELECT lang, 'bleu', NULL, NULL, count(*) > 1 FROM l GROUP BY 1
UNION ALL SELECT lang, 'chrf', NULL, NULL, count(*) > 1 FROM l GROUP BY 1
UNION ALL SELECT lang, 'ter', NULL, NULL, count(*) > 1 FROM l GROUP BY 1
UNION ALL SELECT lang, 'middle', round(any_value(CASE WHEN k = n // 2 THEN n_chars END)::DOUBLE, 6), round(stddev_pop(n_chars), 6), true FROM l GROUP BY 1""")
def registered_scores_and_errors(spark, sf_dir):
    """Every kind of metric by name with its error, from the rounds that are the default. ``closed_stderr`` is what the error is
    or tends to, worked out beside it, and ``agrees`` says that the one returned lies within the tolerance of it; for the translation
    metrics, which have none, that there is one. Their values are checked by the corpus_* queries."""
    if "middle" not in registry.METRICS:
        registry.register_metric("middle", "median", True, "generate_until")
    q = F.lit(1.0) / (1 + F.col("n_chars") / 500.0)
    rows = derived(spark, sf_dir, LABELLED, heavy=True)
    pred, refs = F.concat_ws(" ", "lang", "source", "gold"), F.array(F.concat_ws(" ", "lang", "source", "pred"))
    rows = rows.withColumns({
        "acc": (F.col("gold") == F.col("pred")).cast("double"), "perplexity": -F.col("n_chars") / 10000.0, "brier_score_0": F.array(q, 1 - q),
        "brier_score_1": F.col("gold"), "f1_0": F.col("gold"), "f1_1": F.col("pred"), "mcc_0": F.col("gold"), "mcc_1": F.col("pred"),
        "acc_all_0": F.col("toxic"), "acc_all_1": F.col("source"), "acc_all_2": F.col("gold") == F.col("pred"), "middle": F.col("n_chars").cast("double"),
        **{f"{m}_{i}": (pred, refs)[i] for m in ("bleu", "chrf", "ter") for i in (0, 1)},
    })
    names = ["acc", "perplexity", "brier_score", "f1", "mcc", "acc_all", "bleu", "chrf", "ter", "middle"]
    found = registry.scored_with_errors(rows, ["lang"], names, "doc_id")
    confusion = {n: c.cast("double").alias(n) for n, c in stats.confusion(F.col("gold"), F.col("pred")).items()}
    per_lang = rows.groupBy("lang").agg(*confusion.values(), (F.stddev_pop("n_chars") / 10000 / F.sqrt(F.count("*"))).alias("ll_error"), F.stddev_pop("n_chars").alias("spread"))
    cells = spark.sql(MCC_CELLS, cells=per_lang)
    known = cells.select("lang", F.expr(F1_ERROR).alias("f1_error"), F.expr(MCC_ERROR).alias("mcc_error"), "ll_error", "spread")
    metric, error = F.col("metric"), F.col("stderr")
    closed = (F.when(metric.isin("acc", "acc_all"), error).when(metric == "perplexity", F.col("value") * F.col("ll_error"))
              .when(metric == "f1", F.col("f1_error")).when(metric == "mcc", F.col("mcc_error")).when(metric == "middle", F.col("spread")))
    agrees = (F.when(metric.isin("bleu", "chrf", "ter"), error.isNotNull()).when(F.col("closed_stderr").isNull(), error.isNull() | (error == 0) | metric.isin("f1", "mcc"))
              .otherwise(F.abs(error - F.col("closed_stderr")) <= TOLERANCE * F.col("closed_stderr")))
    return rounded(found.join(known, "lang").withColumn("closed_stderr", closed).select(
        "lang", "metric", F.when(~metric.isin("bleu", "chrf", "ter"), F.col("value")).alias("value"), "closed_stderr", agrees.alias("agrees")))


# ---- standard errors by resampling ----

ITERATIONS = stats.ROUNDS


def poisson_sql(u: str) -> str:
    total, cases = 0.0, []
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        cases.append(f"WHEN {u} < {total!r} THEN {k}")
    return "CASE " + " ".join(cases) + " ELSE 12 END"


@query("bootstrap_of_f1", f"""
WITH d AS (SELECT doc_id, CAST(gold = 1 AND pred = 1 AS INT) AS tp, CAST(gold <> 1 AND pred = 1 AS INT) AS fp, CAST(gold = 1 AND pred <> 1 AS INT) AS fn FROM ({LABELLED_SQL})),
w AS (SELECT it, tp, fp, fn, ({draw_sql('doc_id', 'it')}) / {float(SPAN)!r} AS u FROM d, (SELECT unnest(range(0, {ITERATIONS})) AS it)),
p AS (SELECT it, tp, fp, fn, {poisson_sql('u')} AS w FROM w),
s AS (SELECT it, sum(tp * w)::DOUBLE AS tp, sum(fp * w)::DOUBLE AS fp, sum(fn * w)::DOUBLE AS fn FROM p GROUP BY 1)
SELECT round(stddev_samp(2 * tp / (2 * tp + fp + fn)), 6) AS stderr FROM s""")
def bootstrap_of_f1(spark, sf_dir):
    rows = derived(spark, sf_dir, LABELLED, heavy=True)
    value = stats.f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    return rounded(stats.bootstrap_stderr(rows, _confusion_totals(), value, "doc_id", ITERATIONS))


def _confusion_totals():
    gold, pred = F.col("gold") == 1, F.col("pred") == 1
    return {"tp": (gold & pred).cast("double"), "fp": (~gold & pred).cast("double"), "fn": (gold & ~pred).cast("double")}


@query("bootstrap_of_f1_by_cells", f"""
WITH c AS (SELECT nullif(lang, 'es') AS lang, {CELLS_SQL} FROM ({LABELLED_SQL}) GROUP BY 1) SELECT lang, round({F1_ERROR}, 6) AS closed_stderr, true AS agrees FROM c""")
def bootstrap_of_f1_by_cells(spark, sf_dir):
    """The resampled error against the delta method's."""
    rows = derived(spark, sf_dir, LABELLED).withColumn("lang", F.expr("nullif(lang, 'es')"))
    value = stats.f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    errors = stats.bootstrap_cells(rows, _confusion_totals(), value, by=["lang"])
    cells = rows.groupBy("lang").agg(*[c.cast("double").alias(n) for n, c in stats.confusion(F.col("gold"), F.col("pred")).items()])
    closed = cells.select("lang", F.expr(F1_ERROR).alias("closed_stderr"))
    return rounded(joined_null_safe(errors, closed, ["lang"]).select(
        "lang", "closed_stderr", (F.abs(F.col("stderr") - F.col("closed_stderr")) <= TOLERANCE * F.col("closed_stderr")).alias("agrees")))


@query("bootstrap_of_perplexity", """
SELECT event_type, count(*) AS n, round(exp(avg(value) / 1000) * stddev_pop(value) / 1000 / sqrt(count(*)), 6) AS closed_stderr, true AS agrees FROM events GROUP BY 1""")
def bootstrap_of_perplexity(spark, sf_dir):
    """All events resampled in every round, against the delta method's error, which so many rows come close to."""
    rows = table(spark, sf_dir, "events", heavy=True).select("event_id", "event_type", "value")
    errors = stats.bootstrap_stderr(rows, {"total": F.col("value")}, F.exp(F.col("total") / F.col("resampled") / 1000), "event_id", ITERATIONS, by=["event_type"], pooled=True)
    mean = F.exp(F.avg("value") / 1000)
    closed = rows.groupBy("event_type").agg(F.count("*").alias("n"), (mean * F.stddev_pop("value") / 1000 / F.sqrt(F.count("*"))).alias("closed_stderr"))
    return rounded(joined_null_safe(errors, closed, ["event_type"]).select(
        "event_type", "n", "closed_stderr", (F.abs(F.col("stderr") - F.col("closed_stderr")) <= 0.03 * F.col("closed_stderr")).alias("agrees")))


@query("bootstrap_of_perplexity_by_language", f"""
WITH w AS (SELECT lang, it, n_chars, ({draw_sql('doc_id', 'it')}) / {float(SPAN)!r} AS u FROM ({LABELLED_SQL}), (SELECT unnest(range(0, {ITERATIONS})) AS it)),
s AS (SELECT nullif(lang, 'es') AS lang, it, sum(n_chars * k) / nullif(sum(k), 0) AS mean FROM (SELECT *, {poisson_sql('u')} AS k FROM w) GROUP BY 1, 2)
SELECT lang, round(stddev_samp(exp(mean / 10000)), 6) AS stderr FROM s GROUP BY 1""")
def bootstrap_of_perplexity_by_language(spark, sf_dir):
    rows = derived(spark, sf_dir, LABELLED, heavy=True).withColumn("lang", F.expr("nullif(lang, 'es')"))
    mean = F.col("total") / F.col("resampled")
    return rounded(stats.bootstrap_stderr(rows, {"total": F.col("n_chars")}, F.exp(mean / 10000), "doc_id", ITERATIONS, by=["lang"]))


# ---- groups of tasks: regions hold nations, the world holds regions ----

TREE = """
SELECT concat('region_', r_name) AS parent, concat('task_', CAST(n_nationkey AS STRING)) AS child FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
UNION ALL SELECT 'world', concat('region_', r_name) FROM {region}
"""
TASK_RESULTS = """
SELECT concat('task_', CAST(c_nationkey AS STRING)) AS task, 'acc' AS metric, avg(CASE WHEN c_acctbal > 4000 THEN 1e0 ELSE 0e0 END) AS value,
       CASE WHEN c_nationkey = 3 THEN NULL ELSE stddev_samp(CASE WHEN c_acctbal > 4000 THEN 1e0 ELSE 0e0 END) / sqrt(count(*)) END AS stderr,
       count(*) AS samples
FROM {customer} GROUP BY c_nationkey
"""


def _sql(text: str) -> str:
    for t in ("nation", "region", "customer"):
        text = text.replace("{" + t + "}", t)
    return text.replace("STRING", "VARCHAR")


LEAVES_SQL = f"""e AS ({_sql(TREE)}), t AS ({_sql(TASK_RESULTS)}),
leaves AS (SELECT parent AS "group", child AS task FROM e WHERE child LIKE 'task%' UNION ALL SELECT a.parent, b.child FROM e a JOIN e b ON b.parent = a.child)"""


@query("group_scores", f"""
WITH {LEAVES_SQL}
SELECT "group", metric, round(sum(value * samples) / sum(samples), 6) AS value,
  round(CASE WHEN bool_or(stderr IS NULL) THEN NULL ELSE sqrt(sum((samples - 1) * stderr * stderr * samples) / (sum(samples) - count(*)) / sum(samples)) END, 6) AS stderr,
  CAST(sum(samples) AS BIGINT) AS samples FROM leaves JOIN t USING (task) GROUP BY 1, 2""")
def group_scores(spark, sf_dir):
    leaves = stats.leaf_tasks(derived(spark, sf_dir, TREE))
    return rounded(stats.group_scores(leaves, derived(spark, sf_dir, TASK_RESULTS)))


@query("plain_group_scores", f"""
WITH {LEAVES_SQL} SELECT "group", round(avg(value), 6) AS value FROM leaves JOIN t USING (task) GROUP BY 1""")
def plain_group_scores(spark, sf_dir):
    leaves = stats.leaf_tasks(derived(spark, sf_dir, TREE))
    return rounded(stats.group_scores(leaves, derived(spark, sf_dir, TASK_RESULTS), weight_by_size=False).select("group", "value"))


@query("combined_stderr", f"""
WITH RECURSIVE e AS ({_sql(TREE)}), t AS ({_sql(TASK_RESULTS)}),
o AS (SELECT parent, value, stderr, samples::DOUBLE AS n, row_number() OVER (PARTITION BY parent ORDER BY task) AS k FROM t JOIN e ON e.child = t.task WHERE stderr IS NOT NULL),
f AS (SELECT parent, k, n AS base, value AS score, stderr * stderr AS var FROM o WHERE k = 1
  UNION ALL SELECT f.parent, o.k, base, (score * base + value * n) / (base + n),
    ((base - 1) * var + (n - 1) * stderr * stderr) / (base + n - 1) + base * n / ((base + n) * (base + n - 1)) * power((score * base + value * n) / (base + n) - value, 2)
  FROM f JOIN o ON o.parent = f.parent AND o.k = f.k + 1)
SELECT parent AS "group", round(sqrt(last(var ORDER BY k)), 6) AS combined_stderr FROM f GROUP BY 1""")
def combined_stderr(spark, sf_dir):
    edges = derived(spark, sf_dir, TREE).withColumnsRenamed({"parent": "group", "child": "task"})
    rows = derived(spark, sf_dir, TASK_RESULTS).filter(F.col("stderr").isNotNull()).join(edges, "task")
    return rounded(stats.combined_stderr(rows, ["group"], "task"))


@query("group_directions", f"""
WITH {LEAVES_SQL}, d AS (SELECT task, metric, samples % 2 = 0 AS up FROM t UNION ALL SELECT task, 'mae', false FROM t)
SELECT "group", metric, CASE WHEN min(up) = max(up) THEN min(up) END AS higher_is_better FROM leaves JOIN d USING (task) GROUP BY 1, 2""")
def group_directions(spark, sf_dir):
    leaves = stats.leaf_tasks(derived(spark, sf_dir, TREE))
    t = derived(spark, sf_dir, TASK_RESULTS)
    directions = t.select("task", "metric", (F.col("samples") % 2 == 0).alias("higher_is_better")).unionByName(
        t.select("task", F.lit("mae").alias("metric"), F.lit(False).alias("higher_is_better"))
    )
    return stats.group_direction(leaves, directions)


# ---- translation scores: each assistant turn against the user turn it follows ----

TURNS = """
SELECT a.conv_id, a.turn, a.text AS pred, u.text AS ref FROM {conversations} a JOIN {conversations} u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.role = 'user'
"""
TURNS_SQL = TURNS.replace("{conversations}", "conversations")
TOKENS_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(replace(replace(replace(replace(replace(X, '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
 '([\\x7B-\\x7E\\x5B-\\x60\\x20-\\x26\\x28-\\x2B\\x3A-\\x40\\x2F])', ' \\1 ', 'g'), '([^0-9])([\\.,])', '\\1 \\2 ', 'g'), '([\\.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g'), '\\s+', ' ', 'g'))"""


def _bleu_sql() -> str:
    grams = []
    for n in range(1, 5):
        for side in ("p", "r"):
            grams.append(
                f"{side}{n} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len({side}) - {n} + 2), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g FROM k WHERE len({side}) >= {n}) GROUP BY 1, 2)"
            )
    totals = ", ".join(
        f"(SELECT coalesce(sum(least(a.c, b.c)), 0) FROM p{n} a JOIN r{n} b USING (id, g))::DOUBLE AS m{n}, (SELECT coalesce(sum(c), 0) FROM p{n})::DOUBLE AS t{n}"
        for n in range(1, 5)
    )
    return f"""WITH w AS (SELECT row_number() OVER () AS id, string_split({TOKENS_SQL.replace('X', 'pred')}, ' ') AS p, string_split({TOKENS_SQL.replace('X', 'ref')}, ' ') AS r FROM ({TURNS_SQL})),
k AS MATERIALIZED (SELECT * FROM w), {", ".join(grams)},
s AS (SELECT (SELECT sum(len(p)) FROM k)::DOUBLE AS hyp, (SELECT sum(len(r)) FROM k)::DOUBLE AS ref, {totals})
SELECT round(CASE WHEN hyp < ref THEN exp(1 - ref / hyp) ELSE 1 END * exp((ln(100 * m1 / t1)
  + ln(CASE WHEN m2 = 0 THEN 100 / (2 * t2) ELSE 100 * m2 / t2 END)
  + ln(CASE WHEN m3 = 0 THEN 100 / ((CASE WHEN m2 = 0 THEN 2 ELSE 1 END) * 2 * t3) ELSE 100 * m3 / t3 END)
  + ln(CASE WHEN m4 = 0 THEN 100 / ((CASE WHEN m2 = 0 THEN 2 ELSE 1 END) * (CASE WHEN m3 = 0 THEN 2 ELSE 1 END) * 2 * t4) ELSE 100 * m4 / t4 END)) / 4), 6) AS bleu FROM s"""


def _chrf_sql() -> str:
    grams, totals = [], []
    for n in range(1, 7):
        for side in ("p", "r"):
            grams.append(
                f"{side}{n} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len({side}) - {n} + 2), lambda i: substring({side}, i, {n}))) AS g FROM k WHERE len({side}) >= {n}) GROUP BY 1, 2)"
            )
        totals.append(
            f"(SELECT sum(c) FROM p{n} WHERE id IN (SELECT id FROM r{n}))::DOUBLE AS h{n}, (SELECT sum(c) FROM r{n})::DOUBLE AS f{n}, (SELECT coalesce(sum(least(a.c, b.c)), 0) FROM p{n} a JOIN r{n} b USING (id, g))::DOUBLE AS m{n}"
        )
    precision = "(" + " + ".join(f"m{n} / h{n}" for n in range(1, 7)) + ") / 6"
    recall = "(" + " + ".join(f"m{n} / f{n}" for n in range(1, 7)) + ") / 6"
    return f"""WITH w AS (SELECT row_number() OVER () AS id, regexp_replace(pred, '\\s', '', 'g') AS p, regexp_replace(ref, '\\s', '', 'g') AS r FROM ({TURNS_SQL})),
k AS MATERIALIZED (SELECT * FROM w), {", ".join(grams)}, s AS (SELECT {", ".join(totals)}), a AS (SELECT {precision} AS p, {recall} AS r FROM s)
SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM a"""


@query("corpus_bleu", _bleu_sql())
def corpus_bleu(spark, sf_dir):
    rows = derived(spark, sf_dir, TURNS, heavy=True)
    return rounded(translation.corpus_score(rows, "bleu", F.col("pred"), F.array("ref")))


@query("corpus_chrf", _chrf_sql())
def corpus_chrf(spark, sf_dir):
    rows = derived(spark, sf_dir, TURNS, heavy=True)
    return rounded(translation.corpus_score(rows, "chrf", F.col("pred"), F.array("ref")))


# Shift search has no SQL form; tests check it against brute force.
@query("corpus_ter")
def corpus_ter(spark, sf_dir):
    rows = derived(spark, sf_dir, TURNS, heavy=True)
    return rounded(translation.corpus_score(rows, "ter", F.col("pred"), F.array("ref")))


@query("corpus_ter_by_bounds", f"""
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(pred), '\\s+'), lambda x: x <> '') AS p, list_filter(string_split_regex(lower(ref), '\\s+'), lambda x: x <> '') AS r FROM ({TURNS_SQL})),
k AS (SELECT *, conv_id % 5 AS part FROM w),
a AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS x FROM k) GROUP BY ALL), b AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS x FROM k) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (conv_id, turn, x) GROUP BY ALL)
SELECT part, sum(greatest(len(p), len(r)) - coalesce(shared, 0))::BIGINT AS least_edits, sum(greatest(len(p), len(r)))::BIGINT AS most_edits, sum(len(r))::BIGINT AS ref_words, true AS inside
FROM k LEFT JOIN c USING (conv_id, turn) GROUP BY 1""")
def corpus_ter_by_bounds(spark, sf_dir):
    """TER between what no order of words can go below, the words not shared, and what replacing every word costs."""
    rows = derived(spark, sf_dir, TURNS, heavy=True).withColumn("part", F.col("conv_id") % 5)
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    worded = rows.select("part", split(F.col("pred")).alias("p"), split(F.col("ref")).alias("r"))
    at = lambda left, x: F.array_position(left, x).cast("int")
    without = lambda left, x: F.concat(F.slice(left, F.lit(1), at(left, x) - 1), F.slice(left, at(left, x) + 1, F.size(left)))
    # Every word of p takes its like out of r; what is gone is shared.
    shared = F.size("r") - F.size(F.aggregate("p", F.col("r"), lambda left, x: F.when(at(left, x) > 0, without(left, x)).otherwise(left)))
    longer = F.greatest(F.size("p"), F.size("r"))
    bounds = worded.groupBy("part").agg(F.sum(longer - shared).alias("least_edits"), F.sum(longer).alias("most_edits"), F.sum(F.size("r")).alias("ref_words"))
    score = translation.corpus_score(rows, "ter", F.col("pred"), F.array("ref"), ["part"])
    edits = F.col("ter") * F.col("ref_words") / 100
    return joined_null_safe(bounds, score, ["part"]).select(
        "part", "least_edits", "most_edits", "ref_words", ((edits >= F.col("least_edits") - 1e-6) & (edits <= F.col("most_edits") + 1e-6)).alias("inside"))
