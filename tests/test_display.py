from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prospecta import cli
from prospecta.operators import events as e
from prospecta.plans import display
from prospecta.plans import snapshot as s
from prospecta.sources import feeds
from prospecta.sources.cached import Cached
from prospecta.sources.store import Store, load_store_first
from tests.test_events import TODAY, event, frame


def test_formats(spark):
    row = spark.sql("SELECT timestamp_ntz '2026-07-01 20:05:00' AS summer, timestamp_ntz '2026-01-01 05:00:00' AS winter, date '2026-05-01' AS day, CAST(NULL AS date) AS none").select(
        display.clock(F.col("summer")), display.clock(F.col("winter")), display.short_date(F.col("day")), display.short_date(F.col("none"))).first()
    assert tuple(row) == ("4:05 PM ET", "12:00 AM ET", "5/1/26", "N/A")
    assert display.brief_lines({"as_of": "2026-01-01", "total": 3, "upcoming": 1, "initial_review": 2, "top_filers": [{"name": "A", "count": 2}], "top_themes": [{}]}) == [
        "As of 2026-01-01 - 3 funds in the forward pipeline (1 upcoming, 2 initial review).", "A: 2", "Other: 0"]


def test_statuses_and_dates(spark):
    rows = spark.createDataFrame([("B", "2", "failed"), ("", "1", "failed"), ("B", "3", "failed"), ("A", "4", "success"), (None, None, "failed")], "filer string, cik string, status string")
    assert tuple(display.status_counts(rows).first()) == (5, 1, 4, "1, B, Unknown")
    assert tuple(display.status_counts(rows.limit(0)).first()) == (0, 0, 0, "")
    dates = frame(spark, *[event(i, date=x) for i, x in enumerate(("2026-01-01", "soon", "", "2026-03-01", "2026-02-31"))])
    assert sorted(x.date for x in display.within(dates, dt.date(2026, 1, 1), dt.date(2026, 2, 28)).collect()) == ["2026-01-01"] and display.dated(dates).count() == 2


def test_widths_are_those_of_the_sheet(spark):
    rows = spark.createDataFrame([("x" * 60, "y", None), ("z", "", None)], "long string, s string, a_column_with_a_long_name string")
    assert display.widths(rows) == {"long": 48, "s": 12, "a_column_with_a_long_name": 27}
    assert display.widths(rows.limit(0))["s"] == 12


def test_order_of_a_search(spark):
    rows = frame(spark, event(1, date="2026-07-01", accepted_at="2026-07-01T10:00:00-04:00"), event(2, date="2026-07-01", accepted_at="2026-07-01T15:00:00Z"), event(3, date="2026-07-02"), event(4, date="2026-07-02"))
    assert [x.event_id for x in e.by_time(rows).collect()] == ["a-3:3", "a-4:4", "a-2:2", "a-1:1"]


@pytest.mark.parametrize("page, want", [
    ('<a href="/ix?doc=/Archives/edgar/data/1/a.htm">x</a><link href="/Archives/edgar/data/1/z.htm"><A class="q" HREF=\'/Archives/edgar/data/1/b.xml?x=1&amp;y\'>', ["/1/a.htm", "/1/b.xml?x=1&y"]),
    ('<a name="n">t</a><a href="/about.htm">no</a><x href="/Archives/edgar/data/1/c.txt"><x href="/Archives/edgar/data/1/b_htm.xml"><x href="/ix?doc=/Archives/edgar/data/1/a.htm"><x href="/Archives/edgar/data/1/d.html">',
     ["/1/a.htm", "/1/b_htm.xml", "/1/c.txt", "/1/d.html"]),
    ('<tr><td>2</td><td><x href="/Archives/edgar/data/1/e.htm"></td></tr><tr><td> 1 </td><td><x href="/Archives/edgar/data/1/f.htm"></td></tr>', ["/1/f.htm", "/1/e.htm"]),
    ('<a href="/Archives/edgar/data/1/index.html">i</a><x href="/Archives/edgar/data/1/g.htm">', ["/1/g.htm"]),
    ('<a href="/Archives/edgar/data/1/pic.jpg">i</a><x href="/Archives/edgar/data/1/g.htm">', []),
    ("", []),
])
def test_links_by_form(spark, page, want):
    got = spark.createDataFrame([(page,)], "page string").select(feeds.supporting_links(F.col("page"), "https://a.org", most=9).alias("l")).first().l
    assert got == [f"https://a.org/Archives/edgar/data{x}" for x in want]


def test_downloads_and_lookups(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/store", TODAY)
    cached = Cached(store)
    assert display.downloads(cached, TODAY) == [] and store.parser_version_of("a") is None and store.first_filing_dates().count() == 0
    store.upsert_events(frame(spark, event(1, cik="0001592900")))
    cli.brief_of_store(store, TODAY)
    assert [x.name for x in display.downloads(cached, TODAY)] == ["events.parquet", "events", "snapshot_2026", "launch_brief.json"]
    store.register_series(spark.createDataFrame([(" s000000001 ", "1", "2025-01-01", "x")], "series_id string, cik string, first_filing_date string, lookup_source string"))
    assert [tuple(x) for x in store.first_filing_dates().collect()] == [("S000000001", "2025-01-01")]
    store._read = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    assert store.first_filing_dates().count() == 0


def test_an_unreadable_store_gives_way_to_the_site(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/store", TODAY)
    store.upsert_events(frame(spark, event(1)))
    store.load_events = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    got = load_store_first(store, dt.date(2026, 1, 1), TODAY, ["0000000001"], lambda *_: (frame(spark, event(2)), {}))
    assert [x.event_id for x in got.events.collect()] == ["a-2:2"] and got.notices == ("the store could not be read: OSError",)
    assert [(x.status, x.source) for x in got.statuses.collect()] == [("success", "live")]


def test_cards_show_the_latest_date(spark):
    rows = spark.createDataFrame([("AAAA", "f", "x", False, "2026-05-01"), ("Not Listed", "g", "y", True, "2026-04-01")], "ticker string, filer string, launch_readiness string, etf_share_class boolean, date string")
    assert display.latest_card(rows).first().latest == "5/1/26" and s.cards(rows).first().n_rows == 2
