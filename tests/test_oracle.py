"""Every registered query next to its DuckDB statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# The optional training-data queries have tests of their own.
OPTIONAL = {"pipeline", *(entry.llm.queries() if entry.llm else ())}
QUERIES = {k: q for k, q in entry.queries().items() if k not in OPTIONAL}
STATEMENTS = {k: s for k, s in entry.oracle_sql().items() if k not in OPTIONAL}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF_DIR, name, QUERIES[name], STATEMENTS.get(name))
    assert ok, text
