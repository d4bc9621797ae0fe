"""Every registered query runs; those with SQL give the same rows as DuckDB; no plan pairs all rows."""

import re

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from saltmarsh import catalog

QUERIES = catalog.all_queries()
SQL = catalog.all_sql()


# Queries without SQL; unit tests compare them with plain Python.
TESTED_ON_FIXTURES = {
    "g05_retrieved_chunks", "g05_evidence_context",
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    seen = {}

    def keep(session, folder):
        seen["frame"] = QUERIES[name](session, folder)
        return seen["frame"]

    verdict, rows, _ = compare(spark, con, small, name, keep, SQL.get(name))
    assert verdict.startswith("ok") or (name in TESTED_ON_FIXTURES and rows > 0), verdict
    plan = seen["frame"]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), plan


def test_sql_belongs_to_queries():
    assert set(QUERIES) - set(SQL) == TESTED_ON_FIXTURES and set(SQL) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["year", "month", "total_sales", "total_quantity"]
    assert frame.count() > 0
