"""What a search shows: rows within the chosen dates, how filers fared, formats for people, and what can be downloaded."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.plans import exports
from prospecta.plans import snapshot as s
from prospecta.sources.cached import Cached

#: Fixed value: the zone of the regulator's clock.
ZONE = "America/New_York"


def day(date: Column) -> Column:
    return F.try_to_date(date, "yyyy-MM-dd")


def dated(rows: DataFrame) -> DataFrame:
    """Rows whose filing date is one."""
    return rows.filter(day(F.col("date")).isNotNull())


def within(rows: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Dated rows from start to end, both included."""
    return rows.filter(day(F.col("date")).between(F.lit(start), F.lit(end)))


def status_counts(statuses: DataFrame) -> DataFrame:
    """searched, succeeded, failed, and the names of failed filers, each once, in order."""
    bad = F.col("status") != "success"
    name = F.coalesce(F.nullif("filer", F.lit("")), F.nullif("cik", F.lit("")), F.lit("Unknown"))
    return statuses.agg(
        F.count(F.lit(1)).alias("searched"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"),
        F.array_join(F.sort_array(F.collect_set(F.when(bad, name))), ", ").alias("failed_filers"))


def short_date(date: Column) -> Column:
    """5/1/26; N/A without a date."""
    return F.coalesce(F.date_format(date, "M/d/yy"), F.lit("N/A"))


def clock(utc: Column) -> Column:
    """4:05 PM ET of a UTC time."""
    return F.concat(F.date_format(F.from_utc_timestamp(utc, ZONE), "h:mm a"), F.lit(" ET"))


def column_lengths(rows: DataFrame) -> DataFrame:
    """For each column the longest text of its values and its name."""
    return rows.agg(*[F.greatest(F.coalesce(F.max(F.length(F.col(x).cast("string"))), F.lit(0)), F.lit(len(x))).alias(x) for x in rows.columns])


def widths(rows: DataFrame) -> dict[str, int]:
    """Column widths of a sheet: two more than the longest text, 12 to 48."""
    return {k: min(48, max(12, n + 2)) for k, n in column_lengths(rows).first().asDict().items()}


def brief_lines(brief: dict) -> list[str]:
    """The brief in words, a line each."""
    head = f"As of {brief.get('as_of', 'unknown')} - {brief.get('total', 0)} funds in the forward pipeline ({brief.get('upcoming', 0)} upcoming, {brief.get('initial_review', 0)} initial review)."
    named = [f"{x.get('name', fallback)}: {x.get('count', 0)}" for part, fallback in (("top_filers", "Unknown filer"), ("top_themes", "Other")) for x in brief.get(part, [])]
    return [head, *named]


@dataclass(frozen=True)
class Download:
    name: str
    media_type: str
    path: str


def downloads(cached: Cached, today: dt.date) -> list[Download]:
    """What there is to download of a store, absent ones left out; exports are written once for each version."""
    store = cached.store
    known = [("events", "text/csv", cached.export("events", "all", lambda path: exports.export_events(store, path))),
             (f"snapshot_{today.year}", "text/csv", cached.export("snapshot", today.isoformat(), lambda path: exports.export_snapshot(store, today, path)))]
    files, path = store._files()
    for name, media_type in (("launch_brief.json", "application/json"), ("data_spec.md", "text/markdown")):
        at = f"{store.path}/{name}"
        known.append((name, media_type, at if files.exists(path(at)) else None))
    if store.available():
        known.insert(0, ("events.parquet", "application/vnd.apache.parquet", f"{store.path}/events"))
    return [Download(name, media_type, at) for name, media_type, at in known if at]


def latest_card(rows: DataFrame) -> DataFrame:
    """The cards of a snapshot, with the latest filing date as it is shown."""
    return s.cards(rows).withColumn("latest", short_date(day(F.col("latest"))))
