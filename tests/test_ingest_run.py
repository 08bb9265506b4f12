from __future__ import annotations

import datetime as dt
import json

import pytest

from prospecta import cli, fixed
from prospecta.plans import exports, ingest_run
from prospecta.plans import snapshot as s
from prospecta.plans.acquisition import Acquired
from prospecta.sources.acquire import MapStatus
from prospecta.sources.cached import SEARCH_SECONDS, Cached
from prospecta.sources.store import Store
from tests.test_acquisition import web
from tests.test_events import IDS, TODAY, event, frame

STATUS = "place int, cik string, filer string, status string, row_count int, error_summary string"
FOUND = "series_id string, success boolean, first_filing_date string, error_summary string"


def ok(cik, n=1):
    return cik, f"Trust {cik}", "success", n, ""


def bad(cik, why="HTTP 429"):
    return cik, f"Trust {cik}", "failed", 0, why


class Runs:
    """Runs over a store with what acquisition and lookups are to give."""

    def __init__(self, spark, tmp_path):
        self.spark, self.store, self.bounds, self.asked = spark, Store.open(spark, f"file://{tmp_path}/store", TODAY), [], []

    def __call__(self, rows, statuses, mode="backfill", today=dt.date(2026, 7, 20), found=(), mapping=MapStatus(True), **named):
        def acquire(start, end, ciks):
            self.bounds.append((start, end))
            return Acquired(frame(self.spark, *rows), self.spark.createDataFrame([(i, *x) for i, x in enumerate(statuses)], STATUS), mapping)

        def lookup(series):
            self.asked.append(sorted(x.series_id for x in series.collect()))
            return self.spark.createDataFrame(list(found), FOUND)

        return ingest_run.run_ingest(self.store, mode, [x[0] for x in statuses], acquire, lookup, today, **named)


@pytest.fixture
def runs(spark, tmp_path):
    return Runs(spark, tmp_path)


def test_bounds_of_a_backfill(runs):
    report = runs([], [ok("0000000001", 0)], days=90)
    assert runs.bounds == [(dt.date(2026, 4, 21), dt.date(2026, 7, 20))] and (report["start_bound"], report["end_bound"]) == ("2026-04-21", "2026-07-20")
    assert runs([], [ok("0000000001", 0)])["start_bound"] == "2025-07-20"
    with pytest.raises(ValueError):
        runs([], [ok("1")], mode="other")


def test_a_repeated_run_adds_nothing(runs):
    rows, statuses = [event(1), event(2, accession_number="a-1", event_id="a-1:2"), event(3)], [ok("0000000001", 3)]
    first = runs(rows, statuses)
    assert [first[x] for x in ("filings_processed", "filings_skipped", "filings_reprocessed", "events_added", "events_updated", "run_id", "exit_code")] == [2, 0, 0, 3, 0, 1, 0]
    assert {x.accession_number: x.event_count for x in runs.store.table("ledger").collect()} == {"a-1": 2, "a-3": 1}
    second = runs([*rows, event(4, accession_number="")], statuses, "incremental", dt.date(2026, 7, 21))
    assert [second[x] for x in ("filings_processed", "filings_skipped", "filings_reprocessed", "events_added", "events_updated", "run_id")] == [0, 2, 0, 0, 0, 2]
    assert runs.bounds[1] == (dt.date(2026, 7, 17), dt.date(2026, 7, 21)) and runs.store.table("events").count() == 3


def test_an_older_parser_is_read_again(runs):
    old = event(1)
    runs.store.upsert_events(frame(runs.spark, old), 12)
    runs.store.record_filings(runs.spark.createDataFrame([(old["accession_number"], old["cik"], old["form"], old["date"], 12, 1)], "accession_number string, cik string, form string, filing_date string, parser_version int, event_count long"))
    report = runs([old | {"effectiveness_basis": "rule_485_b_immediate", "effectiveness_days": 0}], [ok("0000000001")])
    assert [report[x] for x in ("filings_processed", "filings_reprocessed", "filings_skipped", "events_added", "events_updated")] == [1, 1, 0, 0, 1]
    stored = runs.store.table("events").first()
    assert (stored.effectiveness_basis, stored.effectiveness_days, stored.parser_version) == ("rule_485_b_immediate", 0, fixed.PARSER_VERSION)
    assert [x.parser_version for x in runs.store.table("ledger").collect()] == [fixed.PARSER_VERSION]


def test_some_failures_are_told_and_all_fail_the_run(runs):
    rows = [event(1), event(2, cik="0000000002", etf_name="of a failed filer")]
    report = runs(rows, [ok("0000000001"), bad("0000000002")])
    stored = runs.store.table("runs").first()
    assert report["exit_code"] == 0 and stored.ciks_failed == 1 and "Trust 0000000002: HTTP 429" in stored.error_summary and runs.store.table("events").count() == 1
    report = runs([], [bad("0000000001", "HTTP 403"), bad("0000000002", "")], mapping=MapStatus(False, "HTTP 403"))
    assert report["exit_code"] == 1 and report["error_summary"].split("\n") == ["Trust 0000000001: HTTP 403", "Trust 0000000002: Fetch failed", "SEC ticker mapping unavailable: HTTP 403"]
    assert runs.store.last_good_run()["run_id"] == 1
    assert runs([], [])["exit_code"] == 0


def test_of_co_registrants_the_first_gives_the_event(runs):
    rows = [event(1, cik="0000000002", event_id="a-1:C", filer="SECOND"), event(1, cik="0000000001", event_id="a-1:C", filer="FIRST")]
    report = runs(rows, [ok("0000000001"), ok("0000000002")])
    assert (report["events_added"], report["filings_processed"]) == (1, 1) and [x.filer for x in runs.store.table("events").collect()] == ["FIRST"]


def test_series(runs):
    rows = [event(i, series_id=f"S00000000{i}", class_id=f"C00000000{i}", identity_scope="class") for i in (1, 2, 3)]
    found = [("S000000001", True, "2025-01-01", ""), ("S000000002", False, "", "timeout"), ("S000000003", False, "", "")]
    report = runs(rows, [ok("0000000001", 3)], found=found)
    assert report["series_resolved"] == 1 and report["series_unresolved"] == [{"series_id": "S000000002", "error_summary": "timeout"}, {"series_id": "S000000003", "error_summary": "Lookup failed"}]
    assert report["error_summary"] == "Unresolved series: S000000002, S000000003"
    assert [(x.series_id, x.first_filing_date, x.lookup_source) for x in runs.store.table("registry").collect()] == [("S000000001", "2025-01-01", "sec_browse_edgar_atom")]
    runs(rows, [ok("0000000001", 3)])
    assert runs.asked == [["S000000001", "S000000002", "S000000003"], ["S000000002", "S000000003"]]


def test_command_line(spark, tmp_path, capsys):
    fake, site, ciks = web(tmp_path / "web")
    path = f"file://{tmp_path}/store"
    argv = ["ingest", "--backfill", "--store", path, "--days", "150"]
    assert cli.main(argv, spark, ciks, dt.date(2026, 6, 30), site) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["ciks_attempted"], report["ciks_failed"], report["events_added"], report["filings_processed"]) == (5, 2, 6, 6)
    assert report["series_unresolved"] == [{"series_id": "S000000001", "error_summary": "RequestError: HTTP 404"}]
    assert cli.main(argv, spark, ciks[1:2], dt.date(2026, 6, 30), site) == 1 and json.loads(capsys.readouterr().out)["run_id"] == 2
    assert cli.main(["brief", "--store", path, "--today", "2026-06-30"], spark) == 0
    printed = json.loads(capsys.readouterr().out)
    assert printed["as_of"] == "2026-06-30" and cli.load_brief(Store.open(spark, path, TODAY)) == printed
    for wrong in (["ingest", "--store", path], ["ingest", "--backfill", "--incremental", "--store", path], []):
        with pytest.raises(SystemExit):
            cli.main(wrong, spark)


def test_stored_briefs():
    assert [s.brief_of(x) for x in (None, "", " \n", "{", "[1]", '{"a": 1}')] == [None, None, None, None, None, {"a": 1}]


def test_exports_are_the_bytes_of_today(spark, tmp_path):
    known = fixed.FILERS[0][0]
    rows = [event(i, cik=known, date=f"2026-07-{1 + i % 9:02d}", etf_name=x, effectiveness_days=75 if i % 2 else None, **(IDS | {"class_id": f"C{i:09d}", "series_id": f"S{i:09d}"}))
            for i, x in enumerate(["Plain ETF", 'Quoted "A" ETF', "Comma, ETF", "Line\nETF", "Return\rETF", "é ETF", " spaced ETF ", "'single' ETF", "", "Semi;colon ETF"] * 3)]
    store = Store.open(spark, f"file://{tmp_path}/store", TODAY)
    assert not exports.export_events(store, f"file://{tmp_path}/none") and not exports.export_snapshot(store, TODAY, f"file://{tmp_path}/none") and not (tmp_path / "none").exists()
    store.upsert_events(frame(spark, *rows))
    assert exports.export_events(store, f"file://{tmp_path}/events")
    assert b"".join(exports.read_export(spark, f"file://{tmp_path}/events")) == s.events_csv(store.table("events"))
    assert exports.export_snapshot(store, TODAY, f"file://{tmp_path}/snapshot")
    assert b"".join(exports.read_export(spark, f"file://{tmp_path}/snapshot", 7)) == s.snapshot_csv(store.table("events"), TODAY, store.table("registry"))
    assert not exports.export_snapshot(store, dt.date(2020, 1, 1), f"file://{tmp_path}/none")


def test_cached_loaders(spark, tmp_path):
    store, clock, asked = Store.open(spark, f"file://{tmp_path}/store", TODAY), [0.0], []
    store.upsert_events(frame(spark, event(1)))
    cached = Cached(store, lambda: clock[0])

    def live(start, end, ciks):
        asked.append(ciks)
        return frame(spark, event(2, date="2026-07-12")), {}

    def search():
        return cached.search(dt.date(2026, 1, 1), TODAY, ["0000000001"], live).events.count()

    assert [search(), search()] == [2, 2] and len(asked) == 1
    clock[0] = SEARCH_SECONDS - 1
    assert search() == 2 and len(asked) == 1
    clock[0] = SEARCH_SECONDS
    assert search() == 2 and len(asked) == 2
    store.upsert_events(frame(spark, event(3)))
    assert search() == 3 and len(asked) == 3, "a new version is seen at once"
    assert cached.registry() is cached.registry()
    said = [cached.series("S1", lambda x: asked.append(x) or {"series_id": x}) for _ in range(2)]
    assert said == [{"series_id": "S1"}] * 2 and asked.count("S1") == 1
    first = cached.export("events", "all", lambda path: exports.export_events(store, path))
    assert cached.export("events", "all", lambda path: exports.export_events(store, path)) == first
    clock[0] += 1e9
    assert cached.export("events", "all", lambda path: exports.export_events(store, path)) == first, "exports stay until the store changes"
    registry = cached.registry()
    store.register_series(spark.createDataFrame([("S000000001", "1", "2025-01-01", "x")], "series_id string, cik string, first_filing_date string, lookup_source string"))
    assert cached.registry() is not registry and cached.registry().count() == 1
    assert cached.export("events", "all", lambda path: exports.export_events(store, path)) != first
    assert cached.export("events", "none", lambda path: False) is None
