from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions import classify as c
from prospecta.functions import text as t
from prospecta.operators import events as e
from prospecta.operators import relational as r
from prospecta.plans import snapshot as s
from prospecta.schema import as_events
from prospecta.sources.store import Store, VersionError

TODAY = dt.date(2026, 7, 16)


def event(n, **values):
    base = dict(
        event_id=f"a-{n}:{values.get('class_id', '') or n}", accession_number=f"a-{n}", cik="0000000001", form="485APOS", date="2026-07-01", accepted_at="", etf_name="Example ETF",
        class_name="Example ETF", series_name="Example ETF", series_id="", class_id="", ticker="Not Listed", ticker_at_filing="Not Listed", ticker_source="not_listed", vehicle="ETF",
        identity_scope="name", filer="EXAMPLE TRUST", link="", effectiveness_basis="", effectiveness_days=None, designated_effective_date="", effectiveness_label="")
    return base | values


def frame(spark, *rows):
    from prospecta.schema import EVENT_SCHEMA

    return spark.createDataFrame([{f.name: row.get(f.name) for f in EVENT_SCHEMA} for row in rows], EVENT_SCHEMA)


def one(spark, *rows):
    return e.snapshot(frame(spark, *rows)).collect()


IDS = dict(series_id="S000000001", class_id="C000000001", identity_scope="class")


def test_rename_keeps_one_fund(spark):
    rows = one(spark, event(1, form="N-1A", date="2026-01-02", etf_name="Old ETF", **IDS), event(2, form="485BPOS", date="2026-04-02", etf_name="New ETF", **IDS))
    assert [(x.etf_name, x.filing_event_count, x.filing_form_history) for x in rows] == [("New ETF", 2, "N-1A -> 485BPOS")]


def test_name_only_filing_joins_the_identified_one(spark):
    rows = one(spark, event(1, form="N-1A", date="2026-01-02"), event(2, form="485BPOS", date="2026-04-02", **IDS))
    assert [x.filing_event_count for x in rows] == [2]


def test_amendments_and_order(spark):
    rows = one(spark, *[event(i, form=f, date=f"2026-0{i}-02", **IDS) for i, f in enumerate(("N-1A", "485APOS", "485BPOS"), 1)])
    assert [(x.filing_event_count, x.amendment_count, x.filing_form_history) for x in rows] == [(3, 2, "N-1A -> 485APOS -> 485BPOS")]


def test_times_compare_in_utc(spark):
    rows = one(spark, event(1, form="485BPOS", accepted_at="2026-07-01T00:30:00+05:00", **IDS), event(2, form="485APOS", **IDS))
    assert [(x.form, x.filing_form_history) for x in rows] == [("485APOS", "485BPOS -> 485APOS")]


@pytest.mark.parametrize("values", [dict(effectiveness_days=0, date="2026-05-01"), dict(designated_effective_date="April 30, 2026", date="2026-04-20")])
def test_prior_effectiveness(spark, values):
    rows = one(spark, event(1, form="485BPOS", **IDS, **values), event(2, form="485APOS", date="2026-07-17", **IDS))
    assert [x.prior_effective_485bpos for x in rows] == [True]


def test_prior_effectiveness_is_judged_by_row(spark):
    """Blank-name rows of one fund before and after an effective amendment do not share its answer."""
    blank = dict(etf_name="", **IDS)
    rows = one(spark, event(1, date="2026-01-01", **blank), event(2, form="485bpos", date="2026-03-01", effectiveness_days=0, **IDS), event(3, date="2026-06-01", **blank))
    assert {x.date: x.prior_effective_485bpos for x in rows} == {"2026-01-01": False, "2026-03-01": False, "2026-06-01": True}
    assert {x.filing_form_history for x in rows} == {"485BPOS"} and {x.amendment_count for x in rows} == {1}


def test_a_filing_counts_once_for_prior_effectiveness(spark):
    rows = one(spark, event(1, form="485BPOS", date="2026-03-01", **IDS), event(1, event_id="later", form="485BPOS", date="2026-03-02", effectiveness_days=0, **IDS), event(3, date="2026-06-01", **IDS))
    assert [(x.filing_event_count, x.prior_effective_485bpos) for x in rows] == [(2, False)]


def test_snapshot_does_not_depend_on_input_order(spark):
    rows = [event(i, date=f"2026-03-0{i % 3 + 1}", form=fixed.FORMS[i % 4], **IDS) for i in range(8)]
    a = e.snapshot(frame(spark, *rows)).collect()
    b = e.snapshot(frame(spark, *reversed(rows)).repartition(3)).collect()
    assert a == b


def test_two_vehicles_of_a_series(spark):
    rows = e.snapshot(frame(spark, event(1, **IDS), event(1, series_id="S000000001", class_id="C000000002", class_name="Class A", ticker="ABCDX"), event(1, series_id="S000000001", class_id="C000000003", class_name="Class C", ticker="ABCCX")))
    assert sorted((x.vehicle, x.identity_scope) for x in rows.collect()) == [("ETF", "class"), ("Mutual fund share class", "series")]
    ready = e.with_readiness(rows, TODAY).orderBy("vehicle").collect()
    assert [x.etf_share_class for x in ready] == [True, False]


def test_later_ticker_fills_rows_without_ids(spark):
    rows = frame(spark, event(1, date="2026-05-01"), event(2, date="2026-06-01", ticker="EXAM"))
    out = {x.accession_number: x for x in e.finalize(rows, dt.date(2026, 1, 1), TODAY).collect()}
    assert (out["a-1"].ticker, out["a-1"].ticker_source, out["a-1"].ticker_at_filing) == ("EXAM", fixed.FROM_LATER, "Not Listed")
    with_ids = frame(spark, event(1, date="2026-05-01", **IDS), event(2, date="2026-06-01", ticker="EXAM", **IDS))
    assert {x.ticker for x in e.finalize(with_ids, dt.date(2026, 1, 1), TODAY).collect()} == {"Not Listed", "EXAM"}


def test_map_gives_missing_tickers(spark):
    dim = spark.createDataFrame([("1", "S000000001", "C000000001", "abc.d")], "cik string, series_id string, class_id string, symbol string")
    out = e.finalize(frame(spark, event(1, **IDS)), dt.date(2026, 1, 1), TODAY, dim).first()
    assert (out.ticker, out.ticker_source, out.ticker_at_filing) == ("ABC.D", fixed.FROM_MAP, "Not Listed")


CASES = [
    ("485BPOS", "485BPOS", "2026-05-01", 0, fixed.ROUTINE), ("485APOS", "485APOS", "2026-04-17", 60, fixed.RECENT), ("485APOS", "485BPOS -> 485APOS", "2026-04-01", 60, fixed.EFFECTIVE),
    ("485APOS", "N-1A -> 485APOS", "2026-04-16", 61, fixed.RECENT), ("485APOS", "N-1A -> 485APOS", "2026-04-16", 60, fixed.STALE), ("N-1A", "N-1A", "2026-04-16", None, fixed.INITIAL_REVIEW),
    ("485APOS", "485APOS", "2026-04-16", None, fixed.UNDETECTED), ("485APOS", "485APOS", "2026-07-01", 75, fixed.UPCOMING),
]


def test_readiness(spark):
    rows = as_events(spark.createDataFrame([dict(event(i, form=f, date=day, effectiveness_days=n), filing_form_history=h, want=w) for i, (f, h, day, n, w) in enumerate(CASES)],
                     "form string, date string, effectiveness_days int, filing_form_history string, want string, vehicle string"))
    out = e.with_readiness(rows, TODAY).select("launch_readiness", "want").collect()
    assert [x.launch_readiness for x in out] == [x.want for x in out]


def test_existing_series(spark):
    registry = spark.createDataFrame([("s000000001 ", "2020-01-01"), ("S000000002", "2026-01-01")], "series_id string, first_filing_date string")
    rows = [event(i, form="485APOS", date="2026-07-01", effectiveness_days=75, series_id=f"S00000000{i}", class_id=f"C00000000{i}") for i in (1, 2, 3)]
    out = s.prepared(frame(spark, *rows), dt.date(2026, 1, 1), TODAY, TODAY, registry).orderBy("series_id").collect()
    assert [x.launch_readiness for x in out] == [fixed.EXISTING, fixed.UPCOMING, fixed.UPCOMING]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        t.sanitize_ticker(F.lit(" mid ")).alias("a"), t.sanitize_ticker(F.lit("abcde")).alias("b"), t.normalize_cik(F.lit("12-3")).alias("c"), t.normalize_cik(F.lit("")).alias("d"),
        t.normalize_name(F.lit("<b>A&amp;B</b>  fund")).alias("e"), t.is_share_class_name(F.lit("Fund: Class A-1 Shares")).alias("f"), t.group_of(F.lit("iShares Gold Trust")).alias("g"),
        t.segment_of(F.lit("TIDAL")).alias("h"), t.split_name_ticker(F.lit("new Alpha ETF ABCD")).alias("i"), t.is_host(F.lit("https://www.a.org/x"), "a.org").alias("j")).first()
    assert tuple(row)[:8] == ("Not Listed", "ABCDE", "0000000123", "", "A B FUND", True, "BlackRock", "Series Trusts") and tuple(row.i) == ("Alpha ETF", "ABCD") and row.j


@pytest.mark.parametrize("name, theme", [
    ("Long-Short Equity Fund", fixed.OTHER), ("2x Bull Gold", fixed.LEVERAGED), ("Short Duration Bond", fixed.BONDS), ("Bitcoin Covered Call", fixed.CRYPTO), ("Premium Income Bond", fixed.OPTIONS),
    ("iBonds 2030", fixed.MATURITY), ("Quality Dividend", fixed.DIVIDEND), ("Domain Fund", fixed.OTHER), ("AI Leaders", fixed.THEMATIC)])
def test_themes(spark, name, theme):
    assert spark.range(1).select(c.theme(F.lit(name)).alias("x")).first().x == theme


def test_brief_and_workbook(spark):
    rows = spark.createDataFrame([(f"F{i}", "Other", fixed.UPCOMING) for i in range(10)] + [("", "Other", fixed.INITIAL_REVIEW)], "filer string, themes string, launch_readiness string")
    got = json.loads(s.brief_json(s.brief(rows, TODAY)))
    assert (got["total"], got["upcoming"], got["initial_review"]) == (11, 10, 1) and [x["name"] for x in got["top_filers"]] == [f"F{i}" for i in range(8)]
    assert s.workbook(rows)[:2] == b"PK"
    assert s.brief(rows.limit(0), TODAY)["top_filers"] == []


def test_merge_keeps_places(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old"), ("", 3, "old")], "k string, ord int, v string")
    live = spark.createDataFrame([("b", 1, "new"), ("c", 2, "new"), ("", 3, "new")], "k string, ord int, v string")
    assert [(x.k, x.v) for x in r.merge_by_key(stored, live, "k").orderBy("place").collect()] == [("a", "old"), ("b", "new"), ("c", "new"), ("", "old"), ("", "new")]


def test_store(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/store", TODAY, now=lambda: "2026-07-16T00:00:00+00:00")
    assert store.backfill_floor == "2025-07-16" and not store.available() and store.last_good_run() is None
    assert store.upsert_events(frame(spark, event(1), event(2))) == {"added": 2, "updated": 0}
    assert store.upsert_events(frame(spark, event(2, etf_name="Changed"), event(3))) == {"added": 1, "updated": 1}
    assert sorted(x.etf_name for x in store.load_events("2026-01-01", "2026-12-31").collect()) == ["Changed", "Example ETF", "Example ETF"]
    assert store.load_events("2026-01-01", "2026-12-31", []).count() == 0
    with pytest.raises(ValueError):
        store.upsert_events(frame(spark, event(1, event_id=" ")))
    filings = spark.createDataFrame([("a-1", "1", "N-1A", "2026-07-01", 14, 1), ("a-2", "1", "N-1A", "2026-07-01", 15, 1)], "accession_number string, cik string, form string, filing_date string, parser_version int, event_count long")
    store.record_filings(filings)
    assert [x.accession_number for x in store.stale(filings).collect()] == ["a-1"]
    assert store.record_run({"mode": "backfill", "completed_at": "x", "end_bound": "2026-07-10", "ciks_attempted": 3, "ciks_failed": 3}) == 1
    assert store.record_run({"mode": "backfill", "completed_at": "x", "end_bound": "2026-07-12", "ciks_attempted": 3, "ciks_failed": 1}) == 2
    assert store.bounds("incremental", TODAY) == (dt.date(2026, 7, 9), TODAY)
    (tmp_path / "store" / "_meta").unlink()
    store._create(f"file://{tmp_path}/store/_meta", '[99, "2020-01-01"]')
    with pytest.raises(VersionError):
        Store.open(spark, f"file://{tmp_path}/store", TODAY)


def test_exports(spark):
    rows = frame(spark, event(1, effectiveness_days=75, form="485APOS", **IDS))
    assert s.events_csv(rows).decode().splitlines()[1].startswith("a-1:C000000001,a-1,0000000001,485APOS")
    assert b"Upcoming launch" in s.snapshot_csv(rows, TODAY)
    assert s.snapshot_csv(rows.limit(0), TODAY) is None
    assert s.ciks_of(spark, segment="Top 3")[0] == "0000036405"
