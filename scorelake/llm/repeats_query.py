"""Repeated passages of all documents."""

from __future__ import annotations

from scorelake.llm.registry import query, table
from scorelake.llm.repeats import repeated_passages


@query("op6_sparse_suffix_repeats")
def op6(spark, sf_dir):
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "n_words", "first_doc_id", "first_word",
                        ((found.row == found.first_row) & (found.start_word == found.first_word)).alias("is_first"))
