"""Evaluation logs derived from the given tables.

Each definition is one SQL text: Spark runs it to make the input of a query, and the check engine runs
the same text, so both see identical rows while the operators under test are written separately.
Numbers are whole-number arithmetic on unique keys, so every row is repeatable at any size.
"""

from __future__ import annotations

from scorelake.operators.labels import inline_sql


# label index -> label, class, reported name
LABELS = inline_sql()

PLAN_LABEL = f"""
SELECT concat('set', CAST(p_partkey % 3 AS STRING)) AS dataset, CAST(1 + p_partkey % 4 AS INT) AS task_id,
       CAST(p_partkey AS STRING) AS label, l.label_name AS label_name
FROM {{part}} JOIN ({LABELS}) l ON l.idx = (p_partkey % 48) * 5
WHERE p_partkey % 29 <> 0
"""

PLAN_TASK = """
SELECT concat('set', CAST(p_partkey % 3 AS STRING)) AS dataset, CAST(1 + p_partkey % 4 AS INT) AS task_id,
       max(CASE (p_partkey % 12) % 6 WHEN 0 THEN 'MRI' WHEN 1 THEN 'CT' WHEN 2 THEN 'ultrasound'
           WHEN 3 THEN 'X-ray' WHEN 4 THEN 'PET' ELSE 'OCT' END) AS image_modality,
       CAST(min(CASE WHEN p_partkey % 29 <> 0 THEN p_partkey END) AS STRING) AS target_label,
       concat('a slice of ', max(p_type)) AS image_description
FROM {part} GROUP BY p_partkey % 3, p_partkey % 4
"""

# One detection answer per order. Some answers hold no numbers, too few, or more than needed.
BOXES = """
SELECT doc_id, model, file_name, dataset, task_id, label, slice_dim, image_h, image_w, has_box, box_h, box_w,
       printf('[%.2f, %.2f, %.2f, %.2f]', tx0, ty0, tx1, ty1) AS target,
       CASE WHEN doc_id % 11 = 0 THEN 'I cannot locate the structure.'
            WHEN doc_id % 13 = 0 THEN printf('Box: %.2f, %.2f and %.2f', px0, py0, px1)
            WHEN doc_id % 17 = 0 THEN printf('Between slices 3 and 12 it spans %.2f,%.2f,%.2f,%.2f.', px0, py0, px1, py1)
            WHEN doc_id % 19 = 0 THEN printf('x %.2f to %.2f, y %.2f-%.2f', px0, py0, px1, py1)
            ELSE printf('[%.2f, %.2f, %.2f, %.2f]', px0, py0, px1, py1) END AS response
FROM (
  SELECT o_orderkey AS doc_id, concat('model_', o_orderstatus) AS model, concat('run_', o_orderpriority) AS file_name,
         concat('set', CAST(o_custkey % 3 AS STRING)) AS dataset, CAST(1 + o_custkey % 4 AS INT) AS task_id,
         CAST(o_custkey AS STRING) AS label, CAST(o_custkey % 3 AS INT) AS slice_dim,
         CAST(64 + o_orderkey % 64 AS INT) AS image_h, CAST(96 + o_orderkey % 32 AS INT) AS image_w,
         o_orderkey % 5 <> 0 AS has_box,
         CAST(1 + (o_orderkey * 5) % 43 AS INT) AS box_h, CAST(1 + (o_orderkey * 11) % 37 AS INT) AS box_w,
         CAST((o_orderkey * 7) % 61 AS DOUBLE) / 100 AS tx0,
         CAST((o_orderkey * 13) % 53 AS DOUBLE) / 100 AS ty0,
         CAST((o_orderkey * 7) % 61 + 1 + (o_orderkey * 11) % 37 AS DOUBLE) / 100 AS tx1,
         CAST((o_orderkey * 13) % 53 + 1 + (o_orderkey * 5) % 43 AS DOUBLE) / 100 AS ty1,
         CAST((o_orderkey * 7) % 61 + o_orderkey % 9 - 4 AS DOUBLE) / 100 AS px0,
         CAST((o_orderkey * 13) % 53 + o_orderkey % 7 - 3 AS DOUBLE) / 100 AS py0,
         CAST((o_orderkey * 7) % 61 + 1 + (o_orderkey * 11) % 37 + o_orderkey % 5 - 2 AS DOUBLE) / 100 AS px1,
         CAST((o_orderkey * 13) % 53 + 1 + (o_orderkey * 5) % 43 + o_orderkey % 11 - 5 AS DOUBLE) / 100 AS py1
  FROM {orders}
) o
"""

# One angle or distance answer per event; some targets are negative, some answers hold no number.
MEASURES = """
SELECT doc_id, model, dataset, metric_type, metric_key, printf('%.2f', t) AS target,
       CASE WHEN doc_id % 14 = 0 THEN 'not visible' WHEN doc_id % 9 = 0 THEN printf('%.3f mm', p)
            WHEN doc_id % 8 = 0 THEN printf('2 landmarks are %.3f apart', p) ELSE printf('%.3f', p) END AS response
FROM (
  SELECT event_id AS doc_id, concat('model_', CAST(user_id % 4 AS STRING)) AS model,
         CASE WHEN event_id % 2 = 0 THEN 'FeTA24' ELSE 'Ceph-Biometrics-400' END AS dataset,
         CASE WHEN event_type IN ('view', 'click') THEN 'angle' ELSE 'distance' END AS metric_type,
         concat('M', CAST(user_id % 7 AS STRING)) AS metric_key,
         CASE WHEN event_id % 23 = 0 THEN -(value + 1) ELSE value + 1 END AS t,
         (CASE WHEN event_id % 23 = 0 THEN -(value + 1) ELSE value + 1 END)
           * (1 + CAST(event_id % 41 - 20 AS DOUBLE) / 23) AS p
  FROM {events}
) e
"""

# One lesion answer (major and minor axis) per event, labelled by the plan's target label.
LESIONS = """
SELECT event_id AS doc_id, concat('model_', CAST(user_id % 4 AS STRING)) AS model,
       concat('set', CAST(event_id % 3 AS STRING)) AS dataset, CAST(1 + event_id % 4 AS INT) AS task_id,
       CAST(event_id % 3 AS INT) AS slice_dim,
       printf('[%.2f, %.3f]', value + 2, value * 0.5e0 + 1) AS target,
       CASE WHEN event_id % 10 = 0 THEN 'no lesion' WHEN event_id % 7 = 0 THEN printf('%.2f', value)
            ELSE printf('major %.4f, minor %.4f', (value + 2) * (1 + CAST(event_id % 31 - 15 AS DOUBLE) / 20),
                        (value * 0.5e0 + 1) * (1 + CAST(event_id % 17 - 8 AS DOUBLE) / 10)) END AS response
FROM {events}
"""

# Four options per part with a loss each; every fifth right answer is out of range.
CHOICES = """
SELECT p_partkey AS doc_id, p_brand AS task, p_name AS c0, p_brand AS c1, p_type AS c2,
       concat(p_type, ' ', p_name) AS c3, p_partkey % 5 AS gold,
       CAST((p_partkey * 37) % 101 AS DOUBLE) / 10 AS l0, CAST((p_partkey * 53) % 97 AS DOUBLE) / 10 AS l1,
       CAST((p_partkey * 71) % 89 AS DOUBLE) / 10 AS l2, CAST((p_partkey * 29) % 103 AS DOUBLE) / 10 AS l3,
       CAST((p_partkey * 17) % 83 AS DOUBLE) / 10 AS u0, CAST((p_partkey * 19) % 79 AS DOUBLE) / 10 AS u1,
       CAST((p_partkey * 23) % 73 AS DOUBLE) / 10 AS u2, CAST((p_partkey * 31) % 71 AS DOUBLE) / 10 AS u3
FROM {part}
"""

# Judged items: score 0..10, -1 when not judged.
JUDGED = """
SELECT event_id AS id,
       CASE event_type WHEN 'view' THEN 'Concrete Recognition' WHEN 'click' THEN 'Analytical Questions'
         WHEN 'error' THEN 'Evaluative Questions' WHEN 'signup' THEN 'Further Insights' ELSE 'Real-world Assistance' END AS subtask,
       CAST(CASE WHEN event_id % 15 = 0 THEN -1 ELSE CAST(floor(value) AS INT) % 11 END AS DOUBLE) AS score,
       concat(chr(123), '''subject'': ''s', CAST(user_id % 9 AS STRING), ''', ''url'': ''u''', chr(125)) AS website,
       concat('model_', CAST(user_id % 3 AS STRING)) AS model
FROM {events}
"""
