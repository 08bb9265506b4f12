"""Queries over small tables that the driver's smallest do not cover, against their SQL."""

from __future__ import annotations

import duckdb
import pandas as pd

from prospecta.operators import events as e
from prospecta.plans import filing_queries, table_queries
from prospecta.sources import parse
from tests.test_queries import DIR, same


def test_customers_with_numbers_of_listed_filers(spark, tmp_path):
    rows = "(1, 36405), (2, 51931), (3, 51931), (8, 1742912), (20, 1924868), (21, 7)"
    duckdb.sql(f"SELECT *, DATE '1996-01-02' AS o_orderdate, '5-LOW' AS o_orderpriority, 'F' AS o_orderstatus FROM (VALUES {rows}) o(o_orderkey, o_custkey)").write_parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    same(filing_queries.assembled_events(spark, str(tmp_path)).toPandas(), con.sql(filing_queries.ORACLES["assembled_events"]).df())


def test_rows_that_take_long_are_dealt_to_all_cores(spark):
    for query, sf_table in ((filing_queries.document_facts, "part"), (table_queries.elections, "orders"), (table_queries.table_entries, "customer")):
        tasks = query(spark, DIR).rdd.getNumPartitions()
        assert tasks >= 4 * spark.sparkContext.defaultParallelism, sf_table


def test_windows_that_are_alike_are_read_once(monkeypatch):
    seen = []
    monkeypatch.setattr(parse, "effectiveness", lambda x: seen.append(x) or ("", None, "", ""))
    out = parse.effectiveness_of.func(pd.Series(["a", "b", "a", None, None]))
    assert len(out) == 5 and sorted(seen, key=str) == [None, "a", "b"]


def test_large_map_moves_only_events_without_a_ticker(spark, monkeypatch):
    events = spark.createDataFrame([(1, "7", "s1", "c1", "", "x"), (2, "7", "s1", "c1", "OWN", "x"), (3, "8", "s1", "c1", None, "x"), (4, None, None, None, "", "x")], "id int, cik string, series_id string, class_id string, ticker string, ticker_source string")
    known = spark.createDataFrame([("0000000007", "S1", "C1 ", "abc"), ("7", "s1", "c1", "ABB"), ("8", "s1", "c1", "no symbol!")], "cik string, series_id string, class_id string, symbol string")
    want = [(1, "ABC", "sec_fund_ticker_map"), (2, "OWN", "x"), (3, None, "x"), (4, "", "x")]
    for rows in (3, 2):
        monkeypatch.setattr(e, "DIMENSION_ROWS", rows)
        out = e.enrich_from_map(events, known)
        assert out.columns == events.columns
        assert sorted((x.id, x.ticker, x.ticker_source) for x in out.collect()) == want
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
