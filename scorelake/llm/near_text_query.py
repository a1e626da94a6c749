"""Near-duplicate documents by shingles of two words."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.llm.near_text import near_duplicates
from scorelake.llm.registry import query, table

SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS head, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
items AS (SELECT head, n, unnest(s) AS g FROM classes),
counts AS (
  SELECT a.head AS x, b.head AS y, a.n AS nx, b.n AS ny, count(*) AS shared
  FROM items a JOIN items b ON a.g = b.g AND a.head < b.head AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT x, y FROM counts WHERE 100 * shared >= 80 * (nx + ny - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT head AS node, head AS root FROM classes
  UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.node WHERE r.root < e.y),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
placed AS (
  SELECT t.doc_id, len(t.s) AS n, coalesce(r.root, t.doc_id) AS component_id
  FROM sets t LEFT JOIN classes c ON c.s = list_sort(t.s) AND len(t.s) > 0 LEFT JOIN roots r ON r.node = c.head)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM placed
"""


@query("op2_hyperminhash_near_dedup", SQL)
def op2(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), size=2, limit=0.8)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
