"""Every registered query of the training-data operators against its SQL, or at least for rows and contract columns."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = os.environ.get("SCORELAKE_TEST_SF", "/root/testdata/sf0.001")
QUERIES = {k: v for k, v in entry.queries().items() if k.startswith("op") and k[2].isdigit() or k == "pipeline"}
ORACLES = entry.oracle_sql()


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    problem = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None, problem
