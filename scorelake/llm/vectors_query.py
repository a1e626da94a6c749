"""Near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.llm.registry import query, table
from scorelake.llm.vectors import near_vectors

SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS root FROM v
  UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node WHERE r.root < l.y),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts ON x = e.vec_id LEFT JOIN roots ON node = e.vec_id
"""


@query("op3_sorted_projections", SQL)
def op3(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
