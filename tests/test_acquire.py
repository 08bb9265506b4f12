from __future__ import annotations

import collections
import pickle
from email.utils import format_datetime
from datetime import datetime, timedelta, timezone

import pytest

from prospecta.sources import acquire as a
from tests.fake_web import FakeWeb

HERE = "https://www.sec.gov"


class Clock:
    """Time that passes by sleeping alone."""

    def __init__(self, now: float = 1_000_000.0) -> None:
        self.now, self.slept = now, []

    def __call__(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.slept.append(seconds)
        self.now += seconds


def client(answers, clock, url_log=None, **own):
    left = list(answers)

    def transport(url, timeout):
        if url_log is not None:
            url_log.append((clock(), url, timeout))
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return a.Client(transport, clock=clock, sleep=clock.sleep, **own)


def test_slots_of_lanes_are_never_shared():
    taken = collections.Counter()
    for lane in range(7):
        last = -1
        for now in (0.0, 0.01, 3.3, 3.3, 3.31, 100.0):
            last = a.next_slot(now, lane, 7, 8.0, last)
            assert last % 7 == lane and last / 8.0 >= now
            taken[last] += 1
    assert set(taken.values()) == {1}


def test_one_lane_keeps_an_eighth_of_a_second():
    clock, log = Clock(10.0), []
    c = client([a.Response(200)] * 3, clock, log)
    for _ in range(3):
        c.get(f"{HERE}/x")
    assert [x[0] for x in log] == [10.0, 10.125, 10.25] and log[0][2] == 20


def test_other_hosts_are_not_slowed():
    clock = Clock(10.01)
    c = client([a.Response(200)] * 3, clock)
    for url in ("https://example.com/a", "https://notsec.gov/a", "https://sec.gov.example.com"):
        c.get(url)
    assert clock.slept == []


@pytest.mark.parametrize("said, want", [
    ("86400", 30.0), ("2.5", 2.5), ("-4", 0.0), ("", 1.0), ("soon", 1.0), ("inf", 30.0),
    (format_datetime(datetime.fromtimestamp(1_000_012, timezone.utc), usegmt=True), 12.0),
    (format_datetime(datetime.fromtimestamp(1_000_012, timezone.utc).replace(tzinfo=None)), 12.0),
    (format_datetime(datetime.fromtimestamp(1_000_000, timezone.utc) + timedelta(days=1), usegmt=True), 30.0),
    (format_datetime(datetime.fromtimestamp(900_000, timezone.utc), usegmt=True), 0.0),
])
@pytest.mark.parametrize("status", [403, 429])
def test_retry_after(said, want, status):
    clock = Clock()
    c = client([a.Response(status, "", {"retry-after": said}), a.Response(200, "abcdef")], clock, rate=1e9)
    assert c.text(f"{HERE}/x", 3) == "abc"
    assert max(clock.slept, default=0.0) == pytest.approx(want, abs=1e-6)


def test_a_last_refusal_is_an_error_and_other_failures_are_no_text():
    clock = Clock()
    with pytest.raises(a.RequestError, match="HTTP 403"):
        client([a.Response(403)] * 3, clock).text(f"{HERE}/x", 9)
    assert clock.slept[-1] == 2.0 and 1.0 in clock.slept
    assert client([a.Response(404)] * 3, Clock()).text(f"{HERE}/x", 9) == ""
    assert client([a.RequestError("ConnectionError: x")] * 3, Clock()).text(f"{HERE}/x", 9) == ""
    assert client([a.RequestError("x"), a.Response(500), a.Response(200, "ok")], Clock()).text(f"{HERE}/x", 9) == "ok"
    with pytest.raises(a.RequestError, match="HTTP 429"):
        client([a.Response(500), a.Response(403), a.Response(429)], Clock()).get(f"{HERE}/x")


def test_transports_travel():
    web = pickle.loads(pickle.dumps(a.Web("me")))
    assert web.user_agent == "me" and isinstance(a.named_transport(f"{a.__name__}:Web", '["you"]'), a.Web)
    assert str(pickle.loads(pickle.dumps(a.RequestError("HTTP 403", 403)))) == "HTTP 403"


def test_documents(spark, tmp_path):
    web = FakeWeb.made(tmp_path, {
        f"{HERE}/a": [[200, "abcdef", {}]], f"{HERE}/b": [[429, "", {"Retry-After": "0"}], [200, "late", {}]], f"{HERE}/c": [[403, "", {"Retry-After": "0"}]],
        f"{HERE}/gone": [[200, None, {}]]})
    urls = spark.createDataFrame([(f"{HERE}/{x}", n) for x, n in (("a", 3), ("a", 4), ("b", 9), ("c", 9), ("missing", 9))] + [(None, 1)], "url string, most int")
    got = {x.url[len(HERE) + 1:]: (x.text, x.error) for x in a.fetched(urls, web, lanes=3, rate=500).collect()}
    assert got == {"a": ("abcd", ""), "b": ("late", ""), "c": (None, "RequestError: HTTP 403"), "missing": ("", "")}
    assert web.asked(f"{HERE}/a") == 1 and web.asked(f"{HERE}/c") == 3
    assert a.fetched(urls.limit(0), web).count() == 0


def test_all_partitions_together_keep_the_rate(spark, tmp_path):
    rate, n = 20.0, 40
    web = FakeWeb.made(tmp_path, {f"{HERE}/{i}": [[200, "x", {}]] for i in range(n)})
    urls = spark.createDataFrame([(f"{HERE}/{i}", 1) for i in range(n)], "url string, most int")
    assert a.fetched(urls, web, lanes=4, rate=rate).count() == n
    times = [x[0] for x in web.log()]
    assert len(times) == n and len({x[2] for x in web.log()}) > 1, "several workers"
    for i in range(n):
        assert sum(times[i] <= x < times[i] + 1.0 for x in times) <= rate + 2  # a late waker may slip into the next slot


def test_submissions_source(spark, tmp_path):
    web = {a.SUBMISSIONS.format(cik=f"{i:010d}"): [[200, f'{{"name": "Filer {i}"}}', {}]] for i in (1, 2, 3)}
    web |= {a.SUBMISSIONS.format(cik="0000000004"): [[200, "<html>", {}]], a.SUBMISSIONS.format(cik="0000000005"): [[200, "[]", {}]]}
    FakeWeb.made(tmp_path, web)
    ciks = [f"{i:010d}" for i in (3, 9, 1, 4, 2, 5)]
    df = a.submissions(spark, ciks, "tests.fake_web:FakeWeb", (str(tmp_path),), lanes=4, rate=500)
    assert df.rdd.getNumPartitions() == 4
    rows = df.orderBy("place").collect()
    assert [x.cik for x in rows] == ciks and [bool(x.body) for x in rows] == [True, False, True, False, True, False]
    assert rows[1].error == "RequestError: HTTP 404" and rows[3].error.startswith("JSONDecodeError") and rows[5].error == "ValueError: no object"


def page(dates, following=None):
    link = f'<link rel="next" href="{following}"/>' if following else ""
    entries = "".join(f"<entry><content><filing-date>{d}</filing-date></content></entry>" for d in dates)
    return f'<feed xmlns="http://www.w3.org/2005/Atom">{link}{entries}<entry/></feed>'


def test_paged_feeds(spark, tmp_path):
    def first(i):
        return a.feed_address(f"S{i:09d}")

    def more(i, n):
        return f"{HERE}/feed/{i}/{n}"

    web = FakeWeb.made(tmp_path, {
        first(1): [[200, page(["2024-05-06", "2024-01-02"], more(1, 1)), {}]], more(1, 1): [[200, page(["2019-03-04"], more(1, 2)), {}]], more(1, 2): [[200, page(["2021-01-01"]), {}]],
        first(2): [[200, page(["2024-05-06"], more(2, 1)), {}]], more(2, 1): [[200, page(["2018-01-01"], more(2, 1)), {}]],
        first(3): [[200, page([]), {}]], first(4): [[200, "<feed", {}]], first(5): [[200, page(["2024-13-01"]), {}]],
        first(6): [[200, page(["2024-05-06"], more(6, 1)), {}]],
        first(8): [[429, "", {"Retry-After": "0"}], [200, page(["2020-02-02"]), {}]]})
    ids = [f"S{i:09d}" for i in range(1, 7)] + ["s000000001", "S000000008", "bad", None]
    got = {x.series_id: (x.success, x.first_filing_date, x.error_summary) for x in a.first_filings(spark.createDataFrame([(x,) for x in ids], "series_id string"), web, 3, 500).collect()}
    assert got["S000000001"] == (True, "2019-03-04", "") and web.asked(first(1)) == 1
    assert got["S000000002"] == (False, "", "SEC series filing history repeated a page")
    assert got["S000000003"] == (False, "", "SEC series filing history returned no filing dates")
    assert got["S000000004"][2].startswith("ParseError") and got["S000000005"][2].startswith("ValueError") and got["S000000006"][2] == "RequestError: HTTP 404"
    assert got["S000000008"] == (True, "2020-02-02", "") and got["BAD"][2] == got[""][2] == "Invalid SEC series ID"


def test_endless_feed_is_bounded():
    n = [0]

    def transport(url, timeout):
        n[0] += 1
        return a.Response(200, page(["2024-01-01"], f"{HERE}/{n[0]}"))

    clock = Clock()
    assert a.first_filing("S000000001", a.Client(transport, clock=clock, sleep=clock.sleep)) == ("", "SEC series filing history exceeded pagination limit") and n[0] == a.FEED_PAGES


def test_registered_series_are_not_looked_up(spark):
    asked = []

    def lookup(missing):
        asked.append(sorted(x.series_id for x in missing.collect()))
        return spark.createDataFrame([("S000000002", True, "2026-01-15", ""), ("S000000003", False, "", "timeout")], "series_id string, success boolean, first_filing_date string, error_summary string")

    registry = spark.createDataFrame([("S000000001", "2025-01-15"), ("S000000009", "")], "series_id string, first_filing_date string")

    def resolved(ids, by=lookup):
        return {x.series_id: (x.success, x.first_filing_date, x.error_summary) for x in a.resolved_series(spark.createDataFrame([(x,) for x in ids], "series_id string"), registry, by).collect()}

    assert resolved(["s000000001", "S000000001"]) == {"S000000001": (True, "2025-01-15", "")} and asked == []
    assert resolved(["s000000001", "S000000002", "S000000002", "S000000003", "S000000009"]) == {
        "S000000001": (True, "2025-01-15", ""), "S000000002": (True, "2026-01-15", ""), "S000000003": (False, "", "timeout"), "S000000009": (False, "", "Lookup failed")}
    assert asked == [["S000000002", "S000000003", "S000000009"]]

    def broken(missing):
        raise OSError("offline")

    assert resolved(["S000000001", "S000000002"], broken)["S000000002"] == (False, "", "OSError: offline")


def test_ticker_map_status(spark, tmp_path):
    def said(i, answers):
        return a.ticker_map(spark, FakeWeb.made(tmp_path / str(i), {a.TICKER_MAP: answers}), 500)

    good = '{"fields": ["cik", "seriesId", "classId", "symbol"], "data": []}'
    assert said(1, [[200, good, {}]]) == (good, a.MapStatus(True))
    assert said(2, [[200, '{"fields": ["cik"]}', {}]])[1].error_summary == "SEC fund-ticker mapping fields are incomplete"
    assert said(3, [[404, "", {}]])[1].error_summary == "SEC fund-ticker mapping returned no data"
    assert said(4, [[403, "", {"Retry-After": "0"}]])[1] == a.MapStatus(False, "RequestError: HTTP 403")
    assert said(5, [[200, "nope", {}]])[1].error_summary.startswith("JSONDecodeError")
