"""The driver contract: every query runs, and agrees with its SQL, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from convoflow.plans import queries as plans

SF = "/root/testdata/sf0.001"


def values(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    found = plans.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = [tuple(r) for r in found.select(*columns).collect()]
    if name not in plans.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    con.execute(f"CREATE TABLE o AS {plans.ORACLE_SQL[name]}")
    assert sorted(r[0] for r in con.execute("DESCRIBE o").fetchall()) == columns
    assert values(got) == values(con.execute(f"SELECT {', '.join(columns)} FROM o").fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
