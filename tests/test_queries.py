"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
TABLES = ["events", "customer", "orders", "lineitem"]
CHOSEN = ["hours_by_period", "gross_pay_by_period", "net_pay", "accepted_events", "search_nested", "uniqueness_check",
          "hours_worked", "merge_snapshot", "pay_attributes", "change_feed", "federal_tax_lookup", "ref_check", "target_check",
          "stream_pay_updates", "stream_replay"]


def test_every_query_has_sql():
    """All but those of the training-data folder, which SQL cannot express."""
    assert set(entry.QUERIES) == set(entry.ORACLE)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda row: tuple(repr(v) for v in row)
    left = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    right = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert left == right


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
