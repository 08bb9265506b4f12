from __future__ import annotations

import datetime as dt
import json

from prospecta.operators import events as e
from prospecta.plans import acquisition as q
from prospecta.sources import acquire as a
from tests.fake_web import FakeWeb
from tests.test_assembly import HEAD, row

NOW = dt.datetime(2026, 12, 1, 10, 30)
START, END = dt.date(2026, 1, 1), dt.date(2026, 3, 31)


def link(cik, accession, name=None):
    return f"{a.SITE}/Archives/edgar/data/{int(cik)}/{accession.replace('-', '')}/{name or accession + '-index.htm'}"


def submissions(name, rows):
    form, date, accession, primary = zip(*rows)
    return [[200, json.dumps({"name": name, "filings": {"recent": {"form": form, "filingDate": date, "accessionNumber": accession, "primaryDocument": primary, "acceptanceDateTime": []}}}), {}]]


def named(title):
    return [[200, f"<oef:RiskReturnHeading>{title}</oef:RiskReturnHeading>", {}]]


def pair(title, ticker):
    return [[200, f"<tr><td>{title}</td><td>{ticker}</td></tr>", {}]]


REFUSED = [[403, "", {"Retry-After": "0"}]]
EMPTY_MAP = [[200, '{"fields": ["cik", "seriesId", "classId", "symbol"], "data": []}', {}]]


def web(tmp_path, more=()):
    """Filer 11: a fund named by a later filing within the horizon, one beyond it, a fund with a class, a fund told by its second document; 22: no list; 33: an index page
    that is refused; 44: nothing in bounds; 55: a supporting document that is refused, but not needed."""
    one, two, three, four, five = (f"00000000{i}{i}" for i in range(1, 6))
    answers = {
        a.TICKER_MAP: EMPTY_MAP,
        a.SUBMISSIONS.format(cik=one): submissions("Northwind Trust", [
            ("N-1A", "2026-03-01", "11-1", "p.htm"), ("485BPOS", "2026-06-19", "11-2", "p.htm"), ("N-1A", "2026-03-02", "11-3", "p.htm"), ("485BPOS", "2026-07-09", "11-4", "p.htm"),
            ("485APOS", "2026-02-01", "11-5", "p.htm"), ("N-1A", "2026-02-02", "11-6", ""), ("8-K", "2026-02-02", "11-7", "p.htm"), ("N-1A", "2025-12-31", "11-8", "p.htm")]),
        a.SUBMISSIONS.format(cik=two): REFUSED,
        a.SUBMISSIONS.format(cik=three): submissions("Southwind Trust", [("N-1A", "2026-03-01", "33-1", "p.htm"), ("N-1A", "2026-03-02", "33-2", "p.htm")]),
        a.SUBMISSIONS.format(cik=four): submissions("Quiet Trust", [("N-1A", "2020-01-01", "44-1", "")]),
        a.SUBMISSIONS.format(cik=five): submissions("Fifth Trust", [("N-1A", "2026-03-03", "55-1", "p.htm")]),
        link(one, "11-1", "p.htm"): named("Delta ETF"), link(one, "11-2", "p.htm"): pair("Delta ETF", "DLT"),
        link(one, "11-3", "p.htm"): named("Omega ETF"), link(one, "11-4", "p.htm"): pair("Omega ETF", "OMG"),
        link(one, "11-5"): [[200, HEAD + "<table>" + row("S000000001", "Alpha", "C000000001", "Alpha ETF", "ALP") + "</table>", {}]],
        link(one, "11-5", "p.htm"): [[200, "<p>[X] 75 days after filing</p>", {}]],
        link(one, "11-6"): [[200, '<a href="/Archives/edgar/data/11/x1.htm"></a><a href="/Archives/edgar/data/11/x2.htm"></a>', {}]],
        f"{a.SITE}/Archives/edgar/data/11/x1.htm": [[200, "nothing", {}]], f"{a.SITE}/Archives/edgar/data/11/x2.htm": pair("Kappa ETF", "KAP"),
        link(three, "33-1"): [[200, "x", {}]], link(three, "33-1", "p.htm"): pair("Sigma ETF", "SIG"), link(three, "33-2"): REFUSED,
        link(five, "55-1"): [[200, HEAD + '<a href="/Archives/edgar/data/55/x1.htm"></a>', {}]], link(five, "55-1", "p.htm"): pair("Fifth ETF", "FIF"),
        f"{a.SITE}/Archives/edgar/data/55/x1.htm": REFUSED,
    } | dict(more)
    return FakeWeb.made(tmp_path, answers), q.Site("tests.fake_web:FakeWeb", (str(tmp_path),), 3, 1000), [one, two, three, four, five]


def test_many_filers(spark, tmp_path):
    fake, site, ciks = web(tmp_path)
    got = q.acquire_events(spark, START, END, [ciks[i] for i in (3, 1, 0, 2, 4)], NOW, site)
    assert [(x.cik, x.filer, x.status, x.row_count, x.error_summary) for x in got.statuses.orderBy("place").collect()] == [
        (ciks[3], "QUIET TRUST", "success", 0, ""), (ciks[1], ciks[1], "failed", 0, "RequestError: HTTP 403"), (ciks[0], "NORTHWIND TRUST", "success", 5, ""),
        (ciks[2], "SOUTHWIND TRUST", "failed", 0, "RequestError: HTTP 403"), (ciks[4], "NORTHWIND TRUST", "success", 1, "")]
    events = {x.event_id: (x.ticker, x.ticker_source, x.effectiveness_days) for x in got.events.collect()}
    assert events == {
        "11-1:DELTA ETF": ("DLT", "later_filing_fallback", None), "11-3:OMEGA ETF": ("Not Listed", "not_listed", None), "11-5:C000000001": ("ALP", "filing", 75),
        "11-6:KAPPA ETF": ("KAP", "filing", None), "55-1:FIFTH ETF": ("FIF", "filing", None)}
    assert got.mapping.available
    assert fake.asked(link(ciks[0], "11-4")) == 0 and fake.asked(link(ciks[0], "11-8")) == 0, "beyond the horizon and before the start nothing is read"
    assert fake.asked(f"{a.SITE}/Archives/edgar/data/55/x1.htm") == 0, "what is not needed is not read"
    assert all(fake.asked(x) <= 3 for x in {y[1] for y in fake.log()})
    assert {x.event_id for x in q.acquire_snapshot(spark, START, END, ciks[:1], NOW, site).collect()} == {x for x in events if x.startswith("11")}


def test_failed_map_and_confirmed_tickers(spark, tmp_path):
    more = {a.TICKER_MAP: [[200, '{"fields": ["cik", "seriesId", "classId", "symbol"], "data": [[11, "S000000001", "C000000001", "ALPX"]]}', {}]]}
    _, site, ciks = web(tmp_path / "a", more | {link("11", "11-5"): [[200, HEAD + row("S000000001", "Alpha", "C000000001", "Alpha ETF", ""), {}]]})
    got = {x.event_id: x for x in q.acquire_events(spark, START, END, ciks[:1], NOW, site).events.collect()}["11-5:C000000001"]
    assert (got.ticker, got.ticker_source, got.ticker_at_filing) == ("ALPX", "sec_fund_ticker_map", "Not Listed")
    _, site, ciks = web(tmp_path / "b", {a.TICKER_MAP: REFUSED})
    got = q.acquire_events(spark, START, END, ciks[3:4], NOW, site)
    assert got.mapping == a.MapStatus(False, "RequestError: HTTP 403") and got.events.count() == 0


def test_bounds():
    b = q.Bounds.of(START, END, NOW)
    assert (b.first_day, b.last_day) == ("2026-01-01", "2026-06-29")
    b = q.Bounds.of(None, None, NOW)
    assert b.start == dt.datetime(2026, 10, 2, 10, 30) and (b.first_day, b.last_day, b.end) == ("2026-10-03", "2026-12-01", NOW)
    assert q.Bounds.of(START, dt.date(2026, 11, 30), NOW).horizon == NOW


def test_a_bound_with_a_time_of_day(spark):
    from tests.test_events import event, frame

    rows = frame(spark, event(1, date="2026-10-02"), event(2, date="2026-10-03"), event(3, date="2026-12-01"))
    b = q.Bounds.of(None, None, NOW)
    assert sorted(x.date for x in e.finalize(rows, b.start, b.end).collect()) == ["2026-10-03", "2026-12-01"]
