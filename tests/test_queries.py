"""Every registered query against its SQL."""

import os
import re

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = os.environ.get("SCORELAKE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Groups below fifty rows are left out, which leaves nothing at the smallest size: these run on more.
NEEDS_MORE_ROWS = {"anatomy_against_lesion_by_model", "model_table", "model_report_lines"}
MORE_ROWS = "/root/testdata/sf0.01"
# The queries of the optional subpackage have tests of their own beside it.
OWN = {n for n in QUERIES if n == "pipeline" or re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OWN))
def test_query(spark, con, name):
    sf_dir, connection = (MORE_ROWS, connect(MORE_ROWS)) if name in NEEDS_MORE_ROWS else (SF_DIR, con)
    problem = compare(spark, connection, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
