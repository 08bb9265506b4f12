from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from prospecta.plans import filing_queries, table_queries

QUERIES, ORACLES = table_queries.QUERIES | filing_queries.QUERIES, table_queries.ORACLES | filing_queries.ORACLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    columns = sorted(got)
    assert columns == sorted(want)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    same(QUERIES[name](spark, DIR).toPandas(), tables.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
