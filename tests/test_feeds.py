from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from prospecta.schema import EVENT_SCHEMA
from prospecta.sources import feeds
from prospecta.sources.documents import cover_window
from prospecta.sources.store import Store, load_store_first
from prospecta.streaming.ingest import ingest, read_events
from tests.test_events import event, frame


def test_submissions(spark):
    recent = {"form": ["N-1A", "S-1/A", "485BPOS", "S-1"], "filingDate": ["2026-01-02", "2026-01-02", "2025-01-02", "2026-02-01"], "accessionNumber": ["a", "b", "c"], "primaryDocument": ["x.htm"], "acceptanceDateTime": []}
    rows = spark.createDataFrame([("1", json.dumps({"filings": {"recent": recent}}))], "cik string, body string")
    assert [tuple(x) for x in feeds.filings_of(rows, "2026-01-01", "2026-12-31").collect()] == [("0000000001", "N-1A", "2026-01-02", "a", "x.htm", "")]
    del recent["acceptanceDateTime"], recent["primaryDocument"]
    rows = spark.createDataFrame([("1", json.dumps({"filings": {"recent": recent}})), ("2", "{}"), ("3", None)], "cik string, body string")
    assert [tuple(x) for x in feeds.filings_of(rows, "2026-01-01", "2026-12-31").collect()] == [("0000000001", "N-1A", "2026-01-02", "a", "", "")]


def test_a_filing_listed_twice_counts_first(spark):
    from prospecta.plans.acquisition import Bounds, filings

    recent = {"form": ["N-1A", "S-1", "S-1"], "filingDate": ["2026-01-02"] * 3, "accessionNumber": ["a-1", "a-1", "b-1"], "primaryDocument": ["x.htm", "y.htm", ""]}
    rows = spark.createDataFrame([("0000000001", json.dumps({"name": "N", "filings": {"recent": recent}}))], "cik string, body string")
    got = filings(rows, Bounds.of(dt.date(2026, 1, 1), dt.date(2026, 2, 1), dt.datetime(2026, 3, 1))).collect()
    assert sorted((x.accession_number, x.form, x.primary_link and x.primary_link.rsplit("/", 2)[1:], x.link.rsplit("/", 3)[1:]) for x in got) == [
        ("a-1", "N-1A", ["a1", "x.htm"], ["1", "a1", "a-1-index.htm"]), ("b-1", "S-1", None, ["1", "b1", "b-1-index.htm"])]


def test_text_of_unknown_origin(spark):
    from prospecta.functions import dates, text

    row = spark.createDataFrame([("<b>A&eacute;&#8212;&#x41;</b>&nbsp; &amp;amp; x",), (None,)], "x string").select(text.clean_html_any(F.col("x")).alias("y")).collect()
    assert [x.y for x in row] == ["Aé—A &amp; x", ""]
    assert {dates.as_day(x) for x in (dt.date(2026, 1, 2), dt.datetime(2026, 1, 2, 3), "2026-01-02", "2026-01-02T10:00:00Z")} == {dt.date(2026, 1, 2)}


def test_ticker_map(spark):
    body = {"fields": ["symbol", "cik", "classId", "seriesId"], "data": [["ABC", 1, "c1", "s1"], ["???", 1, "c2", "s1"], ["ABD", 1, "c1", "s1"]]}
    rows = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert [tuple(x) for x in feeds.ticker_map_of(rows).collect()] == [("0000000001", "S1", "C1", "ABD")]
    assert feeds.ticker_map_of(spark.createDataFrame([(json.dumps({"fields": ["cik"], "data": [[1]]}),)], "body string")).count() == 0


def test_registration_feed(spark):
    rows = spark.createDataFrame([("S000000001", "<filing-date>2020-02-03</filing-date><filing-date>2019-01-01</filing-date>"), ("bad", "<filing-date>2018-01-01</filing-date>")], "series_id string, body string")
    assert [tuple(x) for x in feeds.first_filing_dates(rows).collect()] == [("S000000001", dt.date(2019, 1, 1))]


def test_links_and_windows(spark):
    page = '<a href="/ix?doc=/Archives/edgar/data/1/a.htm">x</a><a href="/Archives/edgar/data/1/index.htm">i</a><a href="/Archives/edgar/data/1/b.txt">y</a><a href="/Archives/edgar/data/1/a.htm">x</a>'
    text = "a" * 3000 + " It is proposed that this filing will become effective " + "b" * 9000
    row = spark.createDataFrame([(page, text)], "page string, text string").select(feeds.supporting_links(F.col("page"), "https://a.org").alias("l"), cover_window(F.col("text")).alias("w")).first()
    assert row.l == ["https://a.org/Archives/edgar/data/1/a.htm", "https://a.org/Archives/edgar/data/1/b.txt"]
    assert row.w == text[3001 - 2000:3001 + 8000]


def test_store_first_and_stream(spark, tmp_path):
    today = dt.date(2026, 7, 16)
    store = Store.open(spark, f"file://{tmp_path}/store", today)
    frame(spark, event(1), event(2)).write.parquet(f"{tmp_path}/in/a")
    for _ in range(2):  # delivered again, nothing changes
        ingest(read_events(spark, f"{tmp_path}/in/*"), store, f"{tmp_path}/check-{_}").awaitTermination()
    assert store.table("events").count() == 2 and store.table("ledger").count() == 2
    store.record_run({"completed_at": "x", "end_bound": "2026-07-10", "ciks_attempted": 1, "ciks_failed": 0})
    seen = []

    def live(start, end, ciks):
        seen.append((start, end))
        return frame(spark, event(2, etf_name="Live ETF"), event(3, date="2026-07-12")), {}

    got = load_store_first(store, dt.date(2026, 1, 1), today, ["0000000001"], live)
    assert seen == [(dt.date(2026, 7, 7), today)] and sorted(x.etf_name for x in got.events.collect()) == ["Example ETF", "Example ETF", "Live ETF"]
    assert [(x.status, x.source, x.n_events) for x in got.statuses.collect()] == [("success", "store+live", 3)] and got.notices == ()

    def broken(*_):
        raise OSError("no network")

    got = load_store_first(store, dt.date(2026, 1, 1), today, ["0000000001"], broken)
    assert got.events.count() == 2 and "no network" in got.notices[0] and got.statuses.first().status == "failed"
    assert spark.createDataFrame([], EVENT_SCHEMA).count() == 0
