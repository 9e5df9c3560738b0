"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from callweight.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(core.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in "part lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(core.ORACLES[name])
    got = core.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted([tuple(str(r[i]) for i in order) for r in rel.fetchall()])
    assert sorted([tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect()]) == want


@pytest.mark.parametrize("name", [q for q in core.QUERIES if q not in core.ORACLES])
def test_query_without_sql(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
