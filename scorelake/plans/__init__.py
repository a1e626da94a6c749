"""End-to-end jobs and the queries registered with the driver."""

from __future__ import annotations

import importlib

MODULES = ("detection", "relative", "texts", "tables", "statistics", "heavy", "files", "proofs")


def all_queries():
    from scorelake.plans.catalogue import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"scorelake.plans.{name}")
    return QUERIES, ORACLES
