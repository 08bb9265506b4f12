"""One ingest run: bounds, acquisition, upsert of new and stale filings, first filings of new series, a report.

The report's counts are observed on the plans that write, so nothing is read again to be counted. Filings that a current
parser has read are skipped; a run that is repeated adds nothing.

Defined results: failed filers have no rows and are told in the report, which fails (exit code 1) only if all did; of co-registrants
who file one event the first asked for gives it; rows without accession are not stored; no filers is a run that does nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.plans.acquisition import Acquired
from prospecta.plans.assembly import settled
from prospecta.sources.store import Store

MODES = ("backfill", "incremental")
#: Fixed value: where first filings come from, as the registry says it.
LOOKUP_SOURCE = "sec_browse_edgar_atom"
Acquire = Callable[[dt.date, dt.date, list[str]], Acquired]
Lookup = Callable[[DataFrame], DataFrame]


def store_filings(store: Store, got: Acquired, parser_version: int = fixed.PARSER_VERSION) -> dict[str, int]:
    """Upserts the events of filings not read yet, or read by an older parser, and records those; counts of filings and events."""
    order = got.statuses.filter("status = 'success'").select("cik", "place")
    events = got.events.filter(F.trim("accession_number") != "").join(F.broadcast(order), "cik").withColumn("ord", -F.col("place"))
    first = Window.partitionBy("accession_number").orderBy("place", "event_id")
    filings = events.withColumn("nth", F.row_number().over(first)).groupBy("accession_number").agg(
        *[F.max(F.when(F.col("nth") == 1, F.col(x))).alias(y) for x, y in (("cik", "cik"), ("form", "form"), ("date", "filing_date"))], F.countDistinct("event_id").alias("event_count"))
    seen, stale = Observation(), F.col("read_by").isNull() | (F.col("read_by") < parser_version)
    counted = store.with_versions(filings).observe(
        seen, F.count_if(stale).alias("filings_processed"), F.count_if(stale & F.col("read_by").isNotNull()).alias("filings_reprocessed"), F.count_if(~stale).alias("filings_skipped"))
    wanted = settled(counted.filter(stale).drop("read_by").withColumn("parser_version", F.lit(parser_version)))
    counts = store.upsert_events(events.join(wanted.select("accession_number"), "accession_number", "left_semi").drop("place"), parser_version)
    store.record_filings(wanted)  # after its events: a run that is cut short between them reads the filing again
    return {k: int(v) for k, v in seen.get.items()} | {"events_added": counts["added"], "events_updated": counts["updated"]}


def store_series(store: Store, lookup: Lookup) -> dict:
    """Registers the first filings of stored series that have none."""
    wanted = settled(store.unresolved_series().groupBy("series_id").agg(F.min("cik").alias("cik")))
    if wanted.isEmpty():
        return {"series_resolved": 0, "series_unresolved": []}
    found = settled(lookup(wanted.select("series_id")))
    good = F.col("success") & (F.col("first_filing_date") != "")
    registered = found.filter(good).join(wanted, "series_id").select("series_id", "cik", "first_filing_date", F.lit(LOOKUP_SOURCE).alias("lookup_source"))
    counts = store.register_series(registered)
    failed = found.filter(~good).select("series_id", F.coalesce(F.nullif("error_summary", F.lit("")), F.lit("Lookup failed")).alias("error_summary"))
    return {"series_resolved": counts["added"] + counts["updated"], "series_unresolved": [x.asDict() for x in failed.orderBy("series_id").collect()]}


def run_ingest(store: Store, mode: str, ciks: Sequence[str], acquire: Acquire, lookup: Lookup, today: dt.date, days: int | None = None, progress: Callable[[str], None] = lambda _: None) -> dict:
    """The report of a run, as it is printed and (but for its lists) stored."""
    if mode not in MODES:
        raise ValueError("Ingest mode must be 'backfill' or 'incremental'.")
    start, end = store.bounds(mode, today, days)
    report = {"mode": mode, "started_at": store.now(), "start_bound": start.isoformat(), "end_bound": end.isoformat(), "ciks_attempted": len(ciks)}
    counts = dict.fromkeys(("filings_processed", "filings_reprocessed", "filings_skipped", "events_added", "events_updated"), 0)
    statuses, errors = [], []
    if ciks:
        got = acquire(start, end, list(ciks))
        statuses = [x.asDict() for x in got.statuses.orderBy("place").drop("place").collect()]  # a row for each filer asked for
        progress(f"CIKs completed: {len(statuses)}/{len(ciks)}")
        counts |= store_filings(store, got)
        errors = [f"{x['filer']}: {x['error_summary'] or 'Fetch failed'}" for x in statuses if x["status"] != "success"]
        if not got.mapping.available:
            errors.append(f"SEC ticker mapping unavailable: {got.mapping.error_summary or 'fetch failed'}")
    failed = sum(x["status"] != "success" for x in statuses)
    series = store_series(store, lookup)
    progress(f"Series resolved: {series['series_resolved']}; unresolved: {len(series['series_unresolved'])}")
    if series["series_unresolved"]:
        errors.append("Unresolved series: " + ", ".join(x["series_id"] for x in series["series_unresolved"]))
    report |= {"completed_at": store.now(), "ciks_failed": failed, **counts, "error_summary": "\n".join(errors)}
    report["run_id"] = store.record_run(report)
    store.vacuum()
    return report | series | {"statuses": statuses, "exit_code": int(bool(ciks) and failed == len(ciks))}
