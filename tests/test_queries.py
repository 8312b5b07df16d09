"""Every query of the core with SQL against DuckDB on the smallest tables; the entry point; the rest must run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tandemlab.plans import registry
from tests.util import connect, rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(registry.SQL) <= set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db(smallest):
    db = connect(smallest)
    yield db
    db.close()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, smallest, db: duckdb.DuckDBPyConnection, name):
    got: pd.DataFrame = registry.QUERIES[name](spark, smallest).toPandas()
    if name in registry.SQL:
        want = db.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
