"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chatloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, bytearray | bytes):
        return bytes(v).hex()
    return str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    relation = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "id"
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_no_oracle_is_empty():
    c = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.01/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert [name for name, sql in catalogue.ORACLE_SQL.items() if not c.sql(sql).fetchall()] == []


def test_tables_on_the_way_go(spark):
    from chatloom import session

    def make():
        half = session.written(spark.range(10), "half")
        make.path = list(session._WRITTEN)[-1]
        return half.filter("id > 4")

    out = session.written_alone(make, "whole")
    assert make.path not in session._WRITTEN and not os.path.exists(make.path.removeprefix("file://"))
    assert out.count() == 5 and list(session._WRITTEN)[-1].endswith("-whole")
