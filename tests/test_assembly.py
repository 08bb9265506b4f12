from __future__ import annotations

import pytest

from prospecta.plans import assembly
from prospecta.sources import extract

BASE = "https://files.example.com"
HEAD = '<span class="companyName">Northwind Trust (Filer)</span>'
FILINGS = "accession_number string, cik string, form string, date string, accepted_at string, link string, primary_link string, filer string, extra int"


def row(series: str, name: str, cls: str, label: str, ticker: str) -> str:
    return f'<tr><td class="seriesName">{series}</td><td class="seriesCell">{name}</td></tr><tr class="contractRow"><td>{cls}</td><td></td><td>{label}</td><td>{ticker}</td></tr>'


def run(spark, filings, documents, ticker_map=None):
    f = spark.createDataFrame([(a, "0000000077", form, "2026-05-01", "", f"{BASE}/{a}", p and f"{BASE}/{p}", filer, 1) for a, form, p, filer in filings], FILINGS)
    d = spark.createDataFrame([(f"{BASE}/{u}", x) for u, x in documents], "url string, text string")
    m = spark.createDataFrame(ticker_map, "cik string, series_id string, class_id string, symbol string") if ticker_map is not None else None
    got = assembly.assemble(f, d, BASE, m)
    return {r.event_id: r for r in got.events.collect()}, got.statuses.collect()


def test_classes_pairs_and_map(spark):
    index = HEAD + "<table>" + row("S000000001", "Alpha Fund", "C000000001", "Class A", "") + row("S000000002", "Beta", "C000000002", "Beta ETF", "") + "</table>"
    primary = "<tr><td>Beta ETF</td><td>BETA</td></tr><tr><td>Gamma ETF</td><td>GAMA</td></tr><p>[X] 75 days after filing</p><p>The Fund is an exchange-traded fund.</p>"
    events, statuses = run(spark, [("a", "485APOS", "p", "x")], [("a", index), ("p", primary)], [("77", "S000000001", "C000000001", "ALPHX"), ("77", "S000000003", "C000000003", "GAMA")])
    assert set(events) == {"a:C000000001", "a:C000000002", "a:C000000003"}
    alpha, beta, gamma = (events[f"a:C00000000{i}"] for i in (1, 2, 3))
    assert (alpha.etf_name, alpha.ticker, alpha.ticker_at_filing, alpha.ticker_source, alpha.identity_scope) == ("Alpha Fund", "ALPHX", "Not Listed", "sec_fund_ticker_map", "series")
    assert (beta.ticker, beta.ticker_at_filing, beta.ticker_source, beta.vehicle, beta.identity_scope) == ("BETA", "BETA", "filing", "ETF", "class")
    assert (gamma.ticker, gamma.series_name, gamma.filer, gamma.effectiveness_days) == ("GAMA", "Gamma ETF", "NORTHWIND TRUST", 75)
    assert [(s.status, s.row_count, s.filer) for s in statuses] == [("success", 3, "NORTHWIND TRUST")]


def test_sole_class_takes_the_ticker_and_listing_makes_a_vehicle(spark):
    index = HEAD + row("S000000001", "Plain", "C000000001", "Plain Shares", "")
    events, _ = run(spark, [("a", "N-1A", "p", "")], [("a", index), ("p", 'Shares of the Fund are listed on the NYSE under the ticker symbol "PLN".')])
    got = events["a:C000000001"]
    assert (got.ticker, got.ticker_at_filing, got.ticker_source, got.vehicle) == ("PLN", "PLN", "filing", "ETF")


def test_without_classes(spark):
    documents = [
        ("pairs", "<p>x</p>"), ("p1", "<tr><td>Alpha ETF</td><td>ALP</td></tr><tr><td>Beta ETF</td><td>BET</td></tr>"),
        ("one", '<a href="/Archives/edgar/data/1/doc.htm">d</a>'), ("Archives/edgar/data/1/doc.htm", f"Delta Core Fund | DCF | NYSE {HEAD}"),
        ("nobody", "nothing here"), ("blank", None),
    ]
    filings = [("pairs", "N-1A", "p1", "Some Trust"), ("one", "N-1A", None, ""), ("nobody", "S-1", "", ""), ("blank", "S-1", "gone", "")]
    events, statuses = run(spark, filings, documents)
    assert {k: (v.ticker, v.filer, v.identity_scope) for k, v in events.items()} == {
        "pairs:ALPHA ETF": ("ALP", "SOME TRUST", "name"), "pairs:BETA ETF": ("BET", "SOME TRUST", "name"), "one:DELTA CORE FUND": ("DCF", "NORTHWIND TRUST", "name")}
    assert statuses[0].row_count == 3


def test_second_document_only_while_something_is_unknown(spark):
    links = '<a href="/Archives/edgar/data/1.htm"></a><a href="/Archives/edgar/data/2.htm"></a>'
    second = ("Archives/edgar/data/2.htm", "<tr><td>Omega ETF</td><td>OMG</td></tr>")
    whole, part = ("Archives/edgar/data/1.htm", "<tr><td>Alpha ETF</td><td>ALP</td></tr>"), ("Archives/edgar/data/1.htm", "nothing")
    filing = [("a", "N-1A", None, "Trust")]
    assert set(run(spark, filing, [("a", links), whole, second])[0]) == {"a:ALPHA ETF"}
    assert set(run(spark, filing, [("a", links), part, second])[0]) == {"a:OMEGA ETF"}


def test_co_registrants_of_one_accession(spark):
    """Two filers of one filing have their own rows, with the tickers and confirmed pairs of each."""
    index = HEAD + row("S000000001", "Alpha", "C000000001", "Alpha ETF", "")
    filings = spark.createDataFrame([("a", cik, "485APOS", "2026-05-01", "", f"{BASE}/a", f"{BASE}/p", "x", 1) for cik in ("0000000077", "0000000088")], FILINGS)
    documents = spark.createDataFrame([(f"{BASE}/a", index), (f"{BASE}/p", "<tr><td>Alpha ETF</td><td>ALPH</td></tr><tr><td>Gamma ETF</td><td>GAMA</td></tr>"), (f"{BASE}/other", "x" * 50)], "url string, text string")
    maps = spark.createDataFrame([("88", "S000000003", "C000000003", "GAMA")], "cik string, series_id string, class_id string, symbol string")
    for ticker_map, want in ((None, {"0000000077": 1, "0000000088": 1}), (maps, {"0000000077": 1, "0000000088": 2})):
        got = assembly.assemble(filings, documents, BASE, ticker_map)
        events = got.events.collect()
        assert {x.cik: x.row_count for x in got.statuses.collect()} == want
        assert sorted((x.cik, x.event_id, x.ticker) for x in events if x.ticker == "ALPH") == [(cik, "a:C000000001", "ALPH") for cik in want]
        assert len(events) == sum(want.values())


def test_only_referred_documents_are_parsed(spark):
    filings = spark.createDataFrame([("a", "1", "N-1A", "2026-05-01", "", f"{BASE}/a", None, "x", 1)], FILINGS)
    documents = spark.createDataFrame([(f"{BASE}/a", "x"), (f"{BASE}/b", "y")], "url string, text string")
    assert [x.url for x in assembly.document_facts(documents, assembly.references(filings, documents, BASE)).collect()] == [f"{BASE}/a"]


def test_guards(spark):
    rows = spark.createDataFrame([("class", "Alpha", "Alpha", ""), ("named", "Alpha", "Alpha", ""), ("named", "Alpha fund", "x", ""), ("class", "Class A", "Class A", ""), ("class", " n/a ", "x", ""), ("class", "", "x", "")], "kind string, etf_name string, class_name string, series_id string")
    assert [(x.kind, x.etf_name) for x in assembly.guarded(rows).collect()] == [("class", "Alpha"), ("named", "Alpha fund")]


def test_empty_tables_and_repeats(spark):
    assert run(spark, [("a", "N-1A", None, "")], [])[0] == {}
    index = HEAD + row("S000000001", "Alpha", "C000000001", "Alpha ETF", "ALP")
    assert set(run(spark, [("a", "N-1A", None, "")] * 2, [("a", index), ("a", index)])[0]) == {"a:C000000001"}


@pytest.mark.parametrize("text, want", [(None, ""), (5, "TypeError")])
def test_error_of_one_document(text, want):
    assert (extract.facts(text, None)[-1] or "").startswith(want)


def test_rows_of_classes_are_joined_once(spark):
    """Filings whose index pages say all meet their facts in one join; what does not occur (other documents, pairs, errors) costs none."""
    index = HEAD + row("S000000001", "Alpha", "C000000001", "Alpha ETF", "ALP")
    filings = spark.createDataFrame([("a", "0000000077", "485BPOS", "2026-05-01", "", f"{BASE}/a", "", "x", 1)], FILINGS)
    events = assembly.assemble(filings, spark.createDataFrame([(f"{BASE}/a", index)], "url string, text string"), BASE).events
    assert events._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert [(x.event_id, x.ticker, x.filer) for x in events.collect()] == [("a:C000000001", "ALP", "NORTHWIND TRUST")]


def test_a_filer_with_an_unreadable_document_has_no_rows(spark):
    index = HEAD + row("S000000001", "Alpha", "C000000001", "Alpha ETF", "ALP")
    filings = spark.createDataFrame([(a, cik, "485BPOS", "2026-05-01", "", f"{BASE}/{a}", "", "x", 1) for a, cik in (("a", "0000000077"), ("b", "0000000077"), ("c", "0000000088"))], FILINGS)
    documents = spark.createDataFrame([(f"{BASE}/a", index, ""), (f"{BASE}/b", None, "no answer"), (f"{BASE}/c", index, None)], "url string, text string, error string")
    got = assembly.assemble(filings, documents, BASE)
    assert [x.event_id for x in got.events.collect()] == ["c:C000000001"]
    assert sorted((x.cik, x.status, x.row_count, x.error_summary) for x in got.statuses.collect()) == [("0000000077", "failed", 0, "no answer"), ("0000000088", "success", 1, "")]
