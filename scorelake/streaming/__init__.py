"""Incremental parsing and running summaries."""
