"""Every register query against another engine, and the entry points."""

import pytest

import __spark_entry__ as entry
from registra import queries as engine


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_matches_sql(name, same):
    same(name)


@pytest.mark.parametrize("name", sorted(engine.QUERIES.keys() - engine.SQL.keys()))
def test_query_without_sql_runs(name, spark):
    assert engine.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_conformance_has_no_failure(spark):
    rows = engine.QUERIES["conformance"](spark, "/root/testdata/sf0.001").collect()
    assert {r["provider"] for r in rows} == {"parquet", "zone", "unfiltered"}
    assert not [r for r in rows if r["status"] == "FAIL"]


def test_entry(spark):
    assert entry.entry(spark).columns == ["year", "account_group", "company_key", "total_amt"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_whole_ordered_input_is_grouped(spark):
    sf = "/root/testdata/sf0.01"
    assert sum(r["n"] for r in engine.QUERIES["group_ordered_whole"](spark, sf).collect()) == spark.read.parquet(f"{sf}/events.parquet").count()
