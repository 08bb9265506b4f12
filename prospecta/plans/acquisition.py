"""Filings of many filers, from the site to events: submissions, documents, assembly, enrichment, bounds.

Each step reads what the one before asks for, and one read runs at a time, so that the rate of requests holds: the ticker map once,
submissions by filer, index pages and primary documents, then the supporting documents of filings that still lack
something. Filings are read up to ENRICHMENT_DAYS after the end (never beyond now), as later ones may name a ticker, and are bounded
only after that.

Defined results: no filers asked for means all known ones; a filer whose list or documents cannot be read has no rows and a
failed status, the others theirs; statuses are in the order asked for; a map that cannot be had is a status, not an error.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions import text as t
from prospecta.operators import events as e
from prospecta.operators import relational as r
from prospecta.plans import assembly
from prospecta.sources import acquire, feeds

#: Fixed value: how much of a primary document is read.
PRIMARY_CHARS = 1_000_000


@dataclass(frozen=True)
class Site:
    """What reads, and how fast: a transport by name and JSON-able arguments, lanes, requests a second for all together."""

    transport: str = f"{acquire.__name__}:Web"
    args: tuple = ()
    lanes: int = acquire.LANES
    rate: float = acquire.RATE

    def made(self) -> acquire.Transport:
        return acquire.named_transport(self.transport, acquire.json.dumps(list(self.args)))

    def documents(self, urls: DataFrame) -> DataFrame:
        return acquire.fetched(urls, self.made(), self.lanes, self.rate)


@dataclass(frozen=True)
class Bounds:
    """What is searched, and until when filings are read for what they say of earlier ones."""

    start: dt.datetime
    end: dt.datetime
    horizon: dt.datetime

    @classmethod
    def of(cls, start: dt.date | None, end: dt.date | None, now: dt.datetime) -> Bounds:
        """Whole days; without a start the last DAYS_BACK days to the minute, without an end until now."""
        begin = dt.datetime.combine(start, dt.time.min) if start else now - dt.timedelta(days=fixed.DAYS_BACK)
        until = dt.datetime.combine(end, dt.time.max) if end else now
        return cls(begin, until, min(now, until + dt.timedelta(days=fixed.LOOKAHEAD_DAYS)))

    @property
    def first_day(self) -> str:
        """The first day whose filings are within: a day begins at midnight."""
        day = self.start.date()
        return (day if self.start.time() == dt.time.min else day + dt.timedelta(days=1)).isoformat()

    @property
    def last_day(self) -> str:
        return self.horizon.date().isoformat()


@dataclass(frozen=True)
class Acquired:
    """Events within bounds; statuses (place, cik, filer, status, row_count, error_summary) of the filers; the map's status."""

    events: DataFrame
    statuses: DataFrame
    mapping: acquire.MapStatus


def filings(lists: DataFrame, bounds: Bounds) -> DataFrame:
    """assembly.FILING of the filings in submissions lists (cik, body), with the addresses of index page and primary document."""
    rows = feeds.filings_of(lists, bounds.first_day, bounds.last_day, place=True)
    rows = r.latest_by(rows, ["cik", "accession_number"], [F.asc("place")])  # a filing listed twice counts where it comes first
    names = lists.select(t.normalize_cik(F.col("cik")).alias("cik"), F.get_json_object("body", "$.name").alias("filer"))
    folder = F.concat(F.lit(f"{acquire.SITE}/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"), F.replace("accession_number", F.lit("-"), F.lit("")), F.lit("/"))
    primary = F.when(F.col("primary_document") != "", F.concat(folder, "primary_document"))
    return rows.join(names, "cik", "left").withColumns({"link": F.concat(folder, "accession_number", F.lit("-index.htm")), "primary_link": primary}).select(*assembly.FILING)


def acquire_events(
        spark: SparkSession, start: dt.date | None = None, end: dt.date | None = None, ciks: Sequence[str] | None = None, now: dt.datetime | None = None, site: Site = Site(),
        final: bool = True) -> Acquired:
    """Events of the filers' filings from start to end; if not final, as the filings say, for a store: nothing is read beyond
    the end, and no later filing is asked for a ticker."""
    bounds = Bounds.of(start, end, now or dt.datetime.now())
    bounds = bounds if final else replace(bounds, horizon=bounds.end)
    asked = list(ciks) if ciks else [x[0] for x in fixed.FILERS]
    body, mapping = acquire.ticker_map(spark, site.made(), site.rate)
    ticker_map = assembly.settled(feeds.ticker_map_of(spark.createDataFrame([(body,)], "body string"))) if mapping.available else None
    lists = assembly.settled(acquire.submissions(spark, asked, site.transport, site.args, site.lanes, site.rate))
    own = assembly.settled(filings(lists.filter("error = ''"), bounds))
    first = own.select(F.inline(F.array(
        F.struct(F.col("link").alias("url"), F.lit(fixed.INDEX_CHARS).alias("most")), F.struct(F.col("primary_link").alias("url"), F.lit(PRIMARY_CHARS).alias("most")))))
    documents = assembly.settled(site.documents(first))

    def more(urls: DataFrame) -> DataFrame:
        most = F.when(F.col("url").endswith(assembly.VIEWER_SUFFIX), assembly.VIEWER_CHARS).otherwise(fixed.INDEX_CHARS)
        return site.documents(urls.withColumn("most", most))

    made = assembly.assemble(own, documents, acquire.SITE, ticker_map, more)
    known = spark.createDataFrame(fixed.FILERS, "cik string, configured string").dropDuplicates(["cik"])
    name = t.filer_label(F.col("cik"), F.coalesce("configured", F.lit("")), F.coalesce(F.get_json_object("body", "$.name"), "configured", "cik"))
    each = lists.join(F.broadcast(known), "cik", "left").select("place", "cik", name.alias("named"), "error")
    told = made.statuses.select("cik", F.col("filer").alias("shown"), "status", "row_count", "error_summary")
    error = F.coalesce(F.nullif("error", F.lit("")), "error_summary", F.lit(""))
    statuses = each.join(told, each["cik"] == told["cik"], "left").select(
        "place", each["cik"], F.coalesce("shown", "named").alias("filer"), F.when(error == "", "success").otherwise("failed").alias("status"),
        F.when(error == "", F.coalesce("row_count", F.lit(0))).otherwise(F.lit(0)).alias("row_count"), error.alias("error_summary"))
    return Acquired(e.finalize(made.events, bounds.start, bounds.end, ticker_map) if final else made.events, statuses, mapping)


def acquire_snapshot(spark: SparkSession, *args, **named) -> DataFrame:
    """The latest row of each fund among what acquire_events gives."""
    return e.snapshot(acquire_events(spark, *args, **named).events)
