"""Every registered query with SQL gives the same rows as DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = Path("/root/testdata/sf0.001")
# Fits of half a minute and more: here they run on fewer matches.
LONG_FITS = {"walk_forward_rf_support", "holdout_gbt_support", "holdout_mlp_support", "feature_importance_names"}
FEWER = 1_200


def views(folder):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(TABLES)


@pytest.fixture(scope="module")
def fewer(tmp_path_factory):
    """The first orders by key and their customers, as tables of their own."""
    folder = tmp_path_factory.mktemp("fewer")
    orders = f"select * from '{TABLES}/orders.parquet' order by o_orderkey limit {FEWER}"
    for name, rows in {"orders": orders, "customer": f"select * from '{TABLES}/customer.parquet'"}.items():
        duckdb.sql(f"copy ({rows}) to '{folder}/{name}.parquet' (format parquet)")
    return folder


def cells(frame, columns):
    def cell(v):
        if v is None or v != v:
            return ""
        return str(v) if isinstance(v, str) else f"{float(v):.6f}"

    return sorted("|".join(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - LONG_FITS))
def test_same_as_sql(spark, duck, name):
    same_as_sql(spark, TABLES, duck, name)


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(LONG_FITS))
def test_long_fits_on_fewer_matches(spark, fewer, name):
    same_as_sql(spark, fewer, views(fewer), name)


def same_as_sql(spark, tables, duck, name):
    import pandas as pd

    got = contract.queries()[name](spark, str(tables)).toPandas()
    expected = duck.sql(contract.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    got, expected = (f.astype(object).where(pd.notna(f), None) for f in (got, expected))
    assert cells(got, columns) == cells(expected, columns)


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
