"""Reading from the regulator's site: bounded, retried, and at one rate for all tasks together.

Requests are rows. Addresses are dealt to a fixed number of lanes, a lane is a partition, and the second is cut into as many slots
as requests are allowed in it: slot s of the clock belongs to lane s % lanes. Lanes on whatever machines never share a
slot, so their requests together keep the rate without speaking to each other, and a task that is run again keeps it too.

Submissions lists are a data source (format `filer_submissions`) with a partition for each lane of filers; documents and series feeds are
read by mapInPandas over dealt addresses. A transport is any picklable callable (address, timeout) -> Response.

Defined results: a refused or overloaded answer (403, 429) that stays so is an error of its row; any other failure of a document
reads as no text, of a submissions list or feed as its row's error; null addresses are not asked for, equal ones once.
"""

from __future__ import annotations

import importlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import urlencode, urlparse
from xml.etree import ElementTree

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prospecta.functions import text as t

#: The rate and the host it is for, tries, what is tried again, the longest wait that an answer may ask for.
RATE, LIMITED_HOST = 8.0, "sec.gov"
TRIES, TIMEOUT, RETRYABLE, LONGEST_WAIT = 3, 20, (403, 429), 30.0
#: Addresses, and how a series' feed is paged.
SITE, SUBMISSIONS, TICKER_MAP = "https://www.sec.gov", "https://data.sec.gov/submissions/CIK{cik}.json", "https://www.sec.gov/files/company_tickers_mf.json"
TICKER_MAP_CHARS, FEED_PAGE, FEED_PAGES, ATOM = 20_000_000, 100, 100, "{http://www.w3.org/2005/Atom}"
#: Lanes of a read: tasks that ask at once, at the most.
LANES = 6


@dataclass(frozen=True)
class Response:
    status: int
    text: str = ""
    headers: Mapping[str, str] = field(default_factory=dict)


class RequestError(Exception):
    """A request that failed; `status` is that of its answer, if there was one."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message, status)
        self.status = status

    def __str__(self) -> str:
        return self.args[0]


Transport = Callable[[str, float], Response]


class Web:
    """The transport over HTTP: one opener for each worker, made there."""

    def __init__(self, user_agent: str = "") -> None:
        self.user_agent = user_agent
        self._opener: urllib.request.OpenerDirector | None = None

    def __getstate__(self) -> dict:
        return {"user_agent": self.user_agent, "_opener": None}

    def __call__(self, url: str, timeout: float) -> Response:
        if self._opener is None:
            self._opener = urllib.request.build_opener()
            self._opener.addheaders = [("User-Agent", self.user_agent)]
        try:
            with self._opener.open(url, timeout=timeout) as answer:
                return Response(answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), dict(answer.headers))
        except urllib.error.HTTPError as error:
            return Response(error.code, "", dict(error.headers or {}))
        except OSError as error:
            raise RequestError(f"{type(error).__name__}: {error}") from error


def next_slot(now: float, lane: int, lanes: int, rate: float, last: int = -1) -> int:
    """The first slot of a lane that begins at or after now and comes after `last`."""
    slot = max(math.ceil(now * rate), last + 1)
    return slot + (lane - slot) % lanes


class Client:
    """Requests of one lane."""

    def __init__(self, transport: Transport, lane: int = 0, lanes: int = 1, rate: float = RATE, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.transport, self.lane, self.lanes, self.rate, self.clock, self.sleep = transport, lane, lanes, rate, clock, sleep
        self.last = -1

    def _wait(self, url: str) -> None:
        host = (urlparse(url).hostname or "").lower()
        if host != LIMITED_HOST and not host.endswith("." + LIMITED_HOST):
            return
        now = self.clock()
        self.last = next_slot(now, self.lane, self.lanes, self.rate, self.last)
        if self.last / self.rate > now:
            self.sleep(self.last / self.rate - now)

    def get(self, url: str) -> Response:
        """The answer, after up to TRIES tries; RequestError if it is none or an error."""
        for attempt in range(TRIES):
            self._wait(url)
            try:
                answer = self.transport(url, TIMEOUT)
                if answer.status < 400:
                    return answer
                error, delay = RequestError(f"HTTP {answer.status}", answer.status), 1.0 + attempt
                if answer.status in RETRYABLE:
                    delay = retry_delay(answer.headers, attempt, self.clock())
            except RequestError as failed:
                error, delay = failed, 1.0 + attempt
            if attempt < TRIES - 1:
                self.sleep(delay)
        raise error

    def text(self, url: str, most: int) -> str:
        """At most so many characters; nothing of what cannot be had, but an error where the site refuses or is overloaded."""
        try:
            return self.get(url).text[:most]
        except RequestError as error:
            if error.status in RETRYABLE:
                raise
            return ""


def retry_delay(headers: Mapping[str, str], attempt: int, now: float) -> float:
    """Seconds to wait: what Retry-After says (a number, or a date), LONGEST_WAIT at most, else longer by each attempt."""
    said = next((str(v).strip() for k, v in headers.items() if k.lower() == "retry-after"), "")
    if not said:
        return 1.0 + attempt
    try:
        wait = float(said)
    except ValueError:
        try:
            at = parsedate_to_datetime(said)
            wait = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() - now
        except (TypeError, ValueError, OverflowError):
            return 1.0 + attempt
    return min(max(0.0, wait), LONGEST_WAIT)


def named_transport(name: str, args: str = "[]") -> Transport:
    """The transport `module:name` made with JSON arguments: what a data source's options can say."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)(*json.loads(args))


def _told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


# Documents


def fetched(urls: DataFrame, transport: Transport, lanes: int = LANES, rate: float = RATE) -> DataFrame:
    """url, text and error of each distinct url of (url, most): read when the result is, so write it before it is used twice.
    One read runs at a time: two would each keep the rate."""
    asked = urls.filter("url is not null").repartition(lanes, "url").groupBy("url").agg(F.max("most").alias("most"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(transport, TaskContext.get().partitionId() % lanes, lanes, rate)
        for frame in frames:
            for url, most in zip(frame["url"], frame["most"]):
                try:
                    row = (url, client.text(url, int(most)), "")
                except RequestError as error:
                    row = (url, None, _told(error))
                yield pd.DataFrame([row], columns=["url", "text", "error"])

    return asked.mapInPandas(read, "url string, text string, error string")


# Submissions lists


@dataclass
class FilerLane(InputPartition):
    lane: int
    filers: list[tuple[int, str]]


class SubmissionsReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = dict(options)
        self.filers = [x for x in json.loads(self.options["ciks"])]
        self.lanes = max(1, min(int(self.options.get("lanes", LANES)), len(self.filers)))

    def partitions(self) -> list[FilerLane]:
        each = list(enumerate(self.filers))
        return [FilerLane(i, each[i::self.lanes]) for i in range(self.lanes)]

    def read(self, partition: FilerLane) -> Iterator[tuple]:
        transport = named_transport(self.options.get("transport", f"{__name__}:Web"), self.options.get("transportargs", "[]"))
        client = Client(transport, partition.lane, self.lanes, float(self.options.get("rate", RATE)))
        for place, cik in partition.filers:
            try:
                body = client.get(SUBMISSIONS.format(cik=cik)).text
                if not isinstance(json.loads(body), dict):
                    raise ValueError("no object")
                yield place, cik, body, ""
            except (RequestError, ValueError) as error:
                yield place, cik, None, _told(error)


class SubmissionsSource(DataSource):
    """Submissions lists of the filers in option `ciks` (a JSON list), dealt to `lanes`; `transport` and `transportArgs` name
    what reads, `rate` is for all lanes together."""

    @classmethod
    def name(cls) -> str:
        return "filer_submissions"

    def schema(self) -> str:
        return "place int, cik string, body string, error string"

    def reader(self, schema) -> SubmissionsReader:
        return SubmissionsReader(self.options)


def submissions(spark: SparkSession, ciks: list[str], transport: str = f"{__name__}:Web", args: tuple = (), lanes: int = LANES, rate: float = RATE) -> DataFrame:
    """place, cik, body and error of the filers' lists, in the order asked for by `place`."""
    spark.dataSource.register(SubmissionsSource)
    options = {"ciks": json.dumps(ciks), "transport": transport, "transportArgs": json.dumps(list(args)), "lanes": lanes, "rate": rate}
    return spark.read.format("filer_submissions").options(**options).load()


# Ticker map


@dataclass(frozen=True)
class MapStatus:
    available: bool
    error_summary: str = ""


def ticker_map(spark: SparkSession, transport: Transport, rate: float = RATE) -> tuple[str, MapStatus]:
    """(the official ticker map's text, whether there is one and else why not)."""
    row = fetched(spark.createDataFrame([(TICKER_MAP, TICKER_MAP_CHARS)], "url string, most int"), transport, 1, rate).first()
    if row.error:
        return "", MapStatus(False, row.error)
    if not row.text:
        return "", MapStatus(False, "SEC fund-ticker mapping returned no data")
    try:
        spec = json.loads(row.text)
        if not {"cik", "seriesId", "classId", "symbol"} <= set(spec.get("fields", [])):
            return "", MapStatus(False, "SEC fund-ticker mapping fields are incomplete")
    except (ValueError, AttributeError, TypeError) as error:
        return "", MapStatus(False, _told(error))
    return row.text, MapStatus(True)


# Series feeds


def feed_address(series_id: str) -> str:
    return f"{SITE}/cgi-bin/browse-edgar?" + urlencode({"action": "getcompany", "CIK": series_id, "output": "atom", "count": FEED_PAGE, "start": 0})


def first_filing(series_id: str, client: Client) -> tuple[str, str]:
    """(first filing date, '') of a series from all pages of its feed, or ('', why there is none): what is read in part is no evidence."""
    if not re.fullmatch(r"S\d{9}", series_id):
        return "", "Invalid SEC series ID"
    dates, seen, url = [], set(), feed_address(series_id)
    try:
        while url:
            if url in seen:
                return "", "SEC series filing history repeated a page"
            if len(seen) == FEED_PAGES:
                return "", "SEC series filing history exceeded pagination limit"
            seen.add(url)
            page = ElementTree.fromstring(client.get(url).text)
            found = (x.findtext(f".//{ATOM}filing-date", default="").strip() for x in page.findall(f"{ATOM}entry"))
            dates += [datetime.strptime(x, "%Y-%m-%d").date().isoformat() for x in found if x]
            link = page.find(f"{ATOM}link[@rel='next']")
            url = str(link.get("href", "") or "").strip() if link is not None else ""
    except Exception as error:  # whatever a page holds, it is this series' failure alone
        return "", _told(error)
    return (min(dates), "") if dates else ("", "SEC series filing history returned no filing dates")


def first_filings(series: DataFrame, transport: Transport, lanes: int = LANES, rate: float = RATE) -> DataFrame:
    """series_id, success, first_filing_date and error_summary of each distinct series_id; read when the result is."""
    asked = series.select(t.key_text(F.col("series_id")).alias("series_id")).repartition(lanes, "series_id").distinct()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(transport, TaskContext.get().partitionId() % lanes, lanes, rate)
        for frame in frames:
            for series_id in frame["series_id"]:
                date, error = first_filing(series_id, client)
                yield pd.DataFrame([(series_id, not error, date, error)], columns=["series_id", "success", "first_filing_date", "error_summary"])

    return asked.mapInPandas(read, "series_id string, success boolean, first_filing_date string, error_summary string")


def resolved_series(wanted: DataFrame, registry: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """series_id, success, first_filing_date and error_summary of each distinct wanted series: as registered, else looked up,
    each once and in one call. A lookup that fails, or leaves a series out, is the failure of what it was asked for."""
    ids = wanted.select(t.key_text(F.col("series_id")).alias("series_id")).distinct()
    known = registry.filter("first_filing_date <> ''").groupBy(t.key_text(F.col("series_id")).alias("series_id")).agg(F.min("first_filing_date").alias("first_filing_date"))
    told = ids.join(known, "series_id").select("series_id", F.lit(True).alias("success"), "first_filing_date", F.lit("").alias("error_summary"))
    missing = ids.join(known, "series_id", "left_anti")
    if missing.isEmpty():
        return told
    none = "Lookup failed"
    try:
        found = lookup(missing)
    except Exception as error:
        found, none = wanted.sparkSession.createDataFrame([], "series_id string, success boolean, first_filing_date string, error_summary string"), _told(error)
    found = missing.join(found.dropDuplicates(["series_id"]), "series_id", "left").select(
        "series_id", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("first_filing_date", F.lit("")).alias("first_filing_date"),
        F.when(F.col("success").isNull(), none).otherwise(F.coalesce("error_summary", F.lit(""))).alias("error_summary"))
    return told.unionByName(found)
