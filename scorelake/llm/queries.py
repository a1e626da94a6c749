"""All queries of this subpackage."""

from __future__ import annotations

import importlib

from scorelake.llm.registry import ORACLES, QUERIES

MODULES = ("near_text_query", "quality_queries", "repeats_query", "token_queries", "token_file_query", "archive_queries", "chat_query", "vectors_query", "lexical_query", "alignment_query")


def all_queries():
    for name in MODULES:
        importlib.import_module(f"scorelake.llm.{name}")
    return QUERIES, ORACLES
