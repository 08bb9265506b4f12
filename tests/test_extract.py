from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from prospecta.sources import extract, parse

D = extract.Document


@pytest.mark.parametrize("text, want", [
    ("[ ABCD ] | Northwind Small Cap ETF and more", "Northwind Small Cap ETF"),
    ("Northwind Growth Fund | NWGF | NYSE", "Northwind Growth Fund"),
    ("The Northwind Value ETF is listed on the exchange", "The Northwind Value ETF"),
    ("Series S000000001 Northwind Bond ETF Class/Contract C000000001", "Northwind Bond ETF"),
    ("Series S000000001 new Northwind Trust Class/Contract C000000001 Northwind Shares NWSX Mailing Address", "Northwind Shares"),
    ('<tr class="contractRow"><td>C1</td><td></td><td>Plain &amp; Simple</td></tr>', "Plain & Simple"),
    ("<oef:RiskReturnHeading id='1'>Northwind <b>Income</b></oef:RiskReturnHeading>", "Northwind Income"),
    ("prospectus of Northwind Core Fund for you", "Northwind Core Fund"),
    ("nothing of the kind", "N/A"),
    ("", "N/A"),
])
def test_fund_name(text, want):
    assert extract.fund_name(D(text)) == want


@pytest.mark.parametrize("text, want", [
    ("shares are under the ticker symbol \"nwnd.\"", "NWND"),
    ("[ ARCA ] | Northwind ETF, Ticker Symbol: NWND", "NWND"),
    ('<tr class="contractRow"><td>C1</td><td>x</td><td>nwv</td></tr>', "NWV"),
    ("<p>Ticker <b>x</b></p> <p>Ticker Symbol</p><p>NWB</p>", "NWB"),
    ("Northwind Growth Fund | NWGF | NYSE", "NWGF"),
    ("The ticker is to be announced", ""),
    ("", ""),
])
def test_fund_ticker(text, want):
    assert extract.fund_ticker(D(text), []) == want
    assert extract.fund_ticker(D(text), [("Any ETF", "SOLE")]) == "SOLE"


def test_pairs():
    table = "<table><tr><th>Fund Name</th><th>Ticker Symbol</th></tr><tr><td>Alpha ETF</td><td></td><td>ALP</td></tr><tr><td>Alpha, ETF</td><td>ALP</td></tr><tr><td>Beta Fund</td><td>BET</td></tr><tr><td>Gamma ETF</td><td>NONE</td></tr></table>"
    assert extract.name_ticker_pairs(D(table)) == [("Alpha ETF", "ALP")]
    assert extract.name_ticker_pairs(D("<tr><td>Beta ETF (BETA)</td></tr>")) == [("Beta ETF", "BETA")]
    assert extract.name_ticker_pairs(D("<p>GAM Gamma Select ETF</p>")) == [("Gamma Select ETF", "GAM")]
    assert extract.name_ticker_pairs(D("Omega Yield ETF | OMG | NYSE")) == [("Omega Yield ETF", "OMG")]
    assert extract.name_ticker_pairs(D("")) == []


@pytest.mark.parametrize("text, want", [
    ('<span class="companyName">Northwind Trust (Filer) <acronym>CIK</acronym></span>', "NORTHWIND TRUST"),
    ("<p>Northwind Series</p><p>-</p><p>(Exact Name of Registrant as Specified in Charter)</p>", "NORTHWIND SERIES"),
    ("<p>a\n1\n2\n3\n4\n5\n(Exact Name of Registrant as Specified in Charter)</p>", "A 1 2 3 4 5"),
    ("nobody", ""),
])
def test_registrant(text, want):
    assert extract.registrant(D(text)) == want


@pytest.mark.parametrize("text, want", [
    ("As with all exchange-traded funds, there is risk.", True),
    ("The Fund is an exchange traded fund.", True),
    ("Shares of the Fund are listed and traded on the NYSE Arca.", True),
    ("Fund shares may be bought and sold in the market at market prices. They are on Nasdaq.", True),
    ("Fund shares may be bought and sold in the market at market prices.", False),
    ("Unlike exchange-traded funds, shares of the Fund are redeemed at net asset value.", False),
    ("", False),
])
def test_exchange_listed(text, want):
    assert extract.exchange_listed(D(text)) is want


def test_entries_without_structured_rows():
    short = '<tr class="contractRow"><td>C1</td><td></td><td>Alpha</td><td>alp</td></tr>'
    assert [x["ticker"] for x in parse.series_entries(short)] == ["ALP"]
    crooked = '<tr class="contractRow"><td>C1</td><p><td></td><th>x</th><td>Alpha</td><td>1</td></tr>'
    assert [x["class_name"] for x in parse.series_entries(crooked)] == ["Alpha"]
    text = "Series S000000001 Alpha Trust Fund Class/Contract C000000001 Alpha Core ETF ALP Status Name Ticker Symbol Series S000000002 Beta Class/Contract C000000002 Existing Class A Mailing Address"
    assert [(x["class_name"], x["ticker"], x["series_id"]) for x in parse.series_entries(text)] == [("Alpha Core ETF", "ALP", ""), ("Class A", "", "")]


def test_facts_column(spark):
    rows = spark.createDataFrame([(1, "The Northwind Value ETF is listed on NYSE. [X] immediately upon filing"), (2, None)], "i int, x string")
    got = {r.i: r.f for r in rows.select("i", extract.facts_of("x", "x").alias("f")).collect()}
    assert (got[1].fund_name, got[1].election.basis, got[1].election.days, got[1].error) == ("The Northwind Value ETF", "rule_485_b_immediate", 0, None)
    assert (got[2].fund_name, got[2].fund_ticker, got[2].pairs, got[2].entries, got[2].election.days) == ("N/A", "", [], [], None)


def test_an_error_is_kept_by_document(monkeypatch):
    monkeypatch.setattr(extract, "fund_name", lambda d: 1 / 0)
    assert extract.facts("x", "x")[-1].startswith("ZeroDivisionError")


@pytest.mark.parametrize("text, want", [
    (f"Cover page Alpha & Beta Trust ({extract.REGISTRANT_MARK}) more", "COVER PAGE ALPHA & BETA TRUST"),
    (f"x ({extract.REGISTRANT_MARK}) y) ({extract.REGISTRANT_MARK}) Gamma Trust({extract.REGISTRANT_MARK.lower()})", "X"),
    (f")({extract.REGISTRANT_MARK})", ""),
    ("no mark", ""),
])
def test_registrant_before_the_mark(text, want):
    assert extract._before_mark(extract.Document(text)).upper() == want


def test_long_unpunctuated_text_is_read_in_linear_time():
    took = []
    for n in (10_000, 80_000):
        start = time.perf_counter()
        extract.facts("word and other " * (n // 15), "")
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * max(took[0], 0.05)


def test_literals_are_in_every_match():
    """What a pattern is said to need is in whatever it matches."""
    samples = ["[ ABC ] | Alpha Core Fund", "ABC | Alpha Core Fund | NYSE |", "Alpha Core ETF is listed on", 'under the ticker symbol "ABC"', "Alpha Core ETF (ABC)", "Series S1 Alpha Core ETF Class/Contract C1 Alpha ETF ABC Mailing Address"]
    for pattern in (*extract.NAME_PATTERNS, extract.NAME_OF_CLASS, extract.TICKER_BRACKETED, *extract.TICKER_LISTED, *extract.TICKER_LAST, *extract.PAIR_PATTERNS):
        for text in samples:
            if re.search(pattern, text, re.IGNORECASE):
                assert all(x in text.casefold() for x in extract.needed(pattern))


def test_choices_are_in_every_match():
    """Of the words that a pattern is said to choose from, one is in whatever it matches."""
    samples = ["[ ABC ] | Alpha Core Fund", "Alpha Core ETF ABC Cboe BZX", "Alpha Core ETF ABC Stock Exchange", "as with all exchange traded funds", "Shares of the Fund are traded on the NYSE", "ABC Alpha Core ETF"]
    for pattern in (*extract.NAME_PATTERNS, *extract.TICKER_LISTED, *extract.TICKER_LAST, *extract.PAIR_PATTERNS, *extract.LISTED):
        for text in samples:
            if re.search(pattern, text, re.IGNORECASE):
                assert all(any(x in text.casefold() for x in words) for words in extract.choices(pattern))


def test_a_document_is_walked_once(monkeypatch):
    """Rows of both kinds, lines and the election of a text come from one walk."""
    seen, fed = [], HTMLParser.feed
    monkeypatch.setattr(HTMLParser, "feed", lambda self, text: seen.append(text) or fed(self, text))
    page = "<table><tr class=contractRow><td>C000000001</td><td></td><td>Walked Once ETF</td><td>ONC</td></tr><tr><th>[X]</th><td>60 days after filing</td></tr></table>"
    got = extract.facts(page, page)
    assert (len(got[5]), got[6]["days"], seen) == (1, 60, [page])
    extract.facts(page.replace("class=contractRow", 'class="contractRow"'), None)
    assert seen == [page]  # plain markup needs no parser
