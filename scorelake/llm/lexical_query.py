"""The best documents for every benchmark item."""

from __future__ import annotations

from scorelake.llm.lexical import ranked_documents
from scorelake.llm.registry import query, table

SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
wanted AS (
  SELECT item_id, t, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
corpus AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM terms),
lengths AS (SELECT doc_id, 100 - 25 + (25 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m FROM terms, corpus GROUP BY 1),
tf AS (SELECT doc_id, t, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM wanted) GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY 1),
scores AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM wanted JOIN w USING (t) JOIN tf USING (t) JOIN lengths USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op13_bag_dedup_search", SQL)
def op13(spark, sf_dir):
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
