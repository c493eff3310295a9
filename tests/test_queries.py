"""Every query with SQL against DuckDB on the smallest tables, and the contract's entry points."""

import os
import sys

import duckdb
import pytest

import __spark_entry__
from tilescape import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got, expected = engine.QUERIES[name](spark, DATA).toPandas(), con.sql(engine.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_package(monkeypatch):
    find = __spark_entry__.importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", lambda name: None if name == "tilescape.llm" else find(name))
    assert __spark_entry__.queries() == engine.QUERIES and __spark_entry__.oracle_sql() == engine.ORACLE_SQL


def test_an_import_error_in_the_llm_package_is_not_hidden(monkeypatch):
    if __spark_entry__.importlib.util.find_spec("tilescape.llm") is None:
        pytest.skip("not installed")
    monkeypatch.setitem(sys.modules, "tilescape.llm.queries", None)
    monkeypatch.delattr("tilescape.llm.queries", raising=False)
    with pytest.raises(ImportError):
        __spark_entry__.queries()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 500
