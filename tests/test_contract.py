"""Every registered query runs on the smallest tables, and agrees with its SQL there."""

import glob
import os

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection(small):
    c = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def _plain(value):
    import datetime as dt
    import decimal

    import numpy as np
    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, (float, np.floating)) and value != value):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating, decimal.Decimal)):
        return float(f"{float(value):.7g}")
    if isinstance(value, (dt.date, pd.Timestamp)):
        return str(value)[:10]
    return value


def _rows(df):
    columns = sorted(df.columns)
    return sorted([tuple(map(_plain, row)) for row in df[columns].itertuples(index=False, name=None)], key=repr)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.core.queries()))
def test_query(spark, small, connection, name):
    got = contract.queries()[name](spark, small).toPandas()
    sql = contract.core.oracle_sql().get(name)
    if sql:
        want = connection.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
