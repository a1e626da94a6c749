"""Jobs that multiply rows or go over the data many times."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.draws import SPAN
from scorelake.functions.numbers import parse_fixed_target
from scorelake.operators import baseline, contamination, subset
from scorelake.plans.carriers import BOXES
from scorelake.plans.catalogue import derived, plain, query, r6, rounded, table
from scorelake.plans.detection import BIN_PERCENT, RATIO, detection_sql, with_ratio
from scorelake.plans.tables import draw_sql

SIMULATIONS = 100


def guessed_rows(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES, heavy=True).withColumn("target_box", parse_fixed_target(F.col("target"), 4))
    return with_ratio(rows).select(
        "doc_id", F.col("target_box").alias("target"), F.array("image_h", "image_w").alias("image_size_2d"), "box_img_ratio"
    )


def _guess_sql() -> str:
    u = lambda s: f"({draw_sql('doc_id', f'(rep * 4 + {s})')}) / {float(SPAN)!r}"
    return f"""
boxes AS ({plain(BOXES).replace('STRING', 'VARCHAR')}),
parsed AS (SELECT *, CAST(string_split(translate(target, '[] ', ''), ',') AS DOUBLE[]) AS t FROM boxes),
base AS MATERIALIZED (SELECT doc_id, image_h, image_w, t[1] AS t0, t[2] AS t1, t[3] AS t2, t[4] AS t3, {RATIO} FROM parsed),
sized AS (SELECT b.*, rep, 1 + CAST(floor({u(0)} * image_w) AS BIGINT) AS w, 1 + CAST(floor({u(1)} * image_h) AS BIGINT) AS h FROM base b, (SELECT unnest(range(0, {SIMULATIONS})) AS rep)),
placed AS (SELECT *, CAST(floor({u(2)} * (image_w - w + 1)) AS BIGINT) AS x, CAST(floor({u(3)} * (image_h - h + 1)) AS BIGINT) AS y FROM sized),
box AS (SELECT doc_id, box_img_ratio, t0, t1, t2, t3, (x / image_w)::FLOAT::DOUBLE AS p0, (y / image_h)::FLOAT::DOUBLE AS p1, ((x + w) / image_w)::FLOAT::DOUBLE AS p2, ((y + h) / image_h)::FLOAT::DOUBLE AS p3 FROM placed),
c AS (SELECT *, least(p2, t2) - greatest(p0, t0) AS iw, least(p3, t3) - greatest(p1, t1) AS ih, (p2 - p0) * (p3 - p1) AS pa, (t2 - t0) * (t3 - t1) AS ta, (abs(p0 - t0) + abs(p1 - t1) + abs(p2 - t2) + abs(p3 - t3)) / 4 AS mae FROM box),
i AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih ELSE 0 END AS it FROM c),
scored AS (SELECT doc_id, any_value(box_img_ratio) AS box_img_ratio, true AS success, avg(mae) AS mae, avg(CASE WHEN it > 0 THEN it / (pa + ta - it) ELSE 0 END) AS iou,
  avg(CASE WHEN it > 0 THEN 2 * it / (pa + ta) ELSE 0 END) AS f1, avg(CASE WHEN it > 0 THEN it / pa ELSE 0 END) AS "precision", avg(CASE WHEN it > 0 THEN it / ta ELSE 0 END) AS recall FROM i GROUP BY doc_id)"""


@query("random_box_baseline", f"WITH {_guess_sql()} SELECT {BIN_PERCENT} AS size_bin, {detection_sql('mre')} FROM scored GROUP BY 1")
def random_box_baseline(spark, sf_dir):
    return rounded(baseline.random_baseline(guessed_rows(spark, sf_dir), "doc_id", SIMULATIONS))


K_CENTERS = 12


def _k_center_sql(k: int) -> str:
    ctes = [
        "e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)",
        "c0 AS MATERIALIZED (SELECT vec_id, v, NULL::DOUBLE AS radius FROM e ORDER BY vec_id LIMIT 1)",
        "d0 AS MATERIALIZED (SELECT vec_id, v, list_distance(v, (SELECT v FROM c0)) AS d FROM e)",
    ]
    for i in range(1, k):
        ctes.append(f"c{i} AS MATERIALIZED (SELECT vec_id, v, d AS radius FROM d{i - 1} ORDER BY d DESC, vec_id LIMIT 1)")
        ctes.append(f"d{i} AS MATERIALIZED (SELECT vec_id, v, least(d, list_distance(v, (SELECT v FROM c{i}))) AS d FROM d{i - 1})")
    rows = " UNION ALL ".join(f"SELECT {i} AS place, vec_id, round(radius, 6) AS radius FROM c{i}" for i in range(k))
    return f"WITH {', '.join(ctes)} {rows}"


@query("k_center_subset", _k_center_sql(K_CENTERS))
def k_center_subset(spark, sf_dir):
    return rounded(subset.k_center(table(spark, sf_dir, "embeddings"), K_CENTERS, "vec_id", "embedding"))


@query("mean_and_joint_embeddings", """
WITH m AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT label, i, avg(x) AS x FROM m GROUP BY 1, 2)
SELECT label, round(sum(x), 6) AS total, round(first(x ORDER BY i), 6) AS first_value, round(last(x ORDER BY i), 6) AS last_value, 128 AS joint_width FROM a GROUP BY 1""")
def mean_and_joint_embeddings(spark, sf_dir):
    means = subset.mean_vector(table(spark, sf_dir, "embeddings"), "embedding", ["label"], 64)
    joint = subset.joint_embedding(F.lit(None).cast("array<double>"), F.col("mean_vector"), 64)
    rows = means.select("label", "mean_vector", joint.alias("joint"))
    total = F.aggregate("mean_vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "label", r6(total).alias("total"), r6(F.get("mean_vector", F.lit(0))).alias("first_value"),
        r6(F.get("mean_vector", F.lit(63))).alias("last_value"), F.size("joint").alias("joint_width"),
    )


@query("scores_by_contamination", """
WITH b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark), l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT DISTINCT doc_id FROM l JOIN b USING (line) WHERE len(line) >= 20), s AS (SELECT lang, n_chars, doc_id IN (SELECT doc_id FROM f) AS seen FROM documents)
SELECT lang, round(avg(n_chars) FILTER (WHERE NOT seen), 6) AS no_contamination, round(avg(n_chars) FILTER (WHERE seen), 6) AS only_contamination,
  count(*) AS num_samples, count(*) FILTER (WHERE seen) AS num_contaminated FROM s GROUP BY 1""")
def scores_by_contamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flagged = contamination.shared_line_ids(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", 20)
    return rounded(contamination.scores_by_contamination(docs, flagged, "doc_id", F.col("n_chars").cast("double"), ["lang"]))


@query("mean_duration_per_task", """SELECT event_type AS task, round(avg("value"), 6) AS mean_duration FROM events GROUP BY 1""")
def mean_duration_per_task(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.avg("value").alias("mean_duration")))
