"""Command lines: `python -m prospecta.cli ingest ...` and `python -m prospecta.cli brief ...`."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from prospecta import fixed
from prospecta.plans import snapshot as s
from prospecta.plans.acquisition import Site, acquire_events
from prospecta.plans.ingest_run import run_ingest
from prospecta.sources import acquire
from prospecta.sources.store import Store

BRIEF_NAME = "launch_brief.json"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Ingest filing events, or summarise the pipeline of launches.")
    commands = out.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="read filings into the store and print the run's report")
    mode = ingest.add_mutually_exclusive_group(required=True)
    mode.add_argument("--backfill", action="store_true")
    mode.add_argument("--incremental", action="store_true")
    ingest.add_argument("--store", required=True)
    ingest.add_argument("--days", type=int, help="days of a backfill; an incremental run goes on from the last good one")
    ingest.add_argument("--user-agent", default="", help="who asks, as the site wants it said")
    brief = commands.add_parser("brief", help="write and print the brief of a store")
    brief.add_argument("--store", required=True)
    brief.add_argument("--today", type=dt.date.fromisoformat)
    return out


def brief_of_store(store: Store, today: dt.date) -> dict:
    """The brief of the year's forward pipeline, written beside the store's tables."""
    start = s.year_start(today)
    events = store.load_events(start.isoformat(), today.isoformat(), [x[0] for x in fixed.FILERS])
    brief = s.brief(s.forward(events, today, store.table("registry")).persist(), today)
    files, path = store._files()
    stream = files.create(path(f"{store.path}/{BRIEF_NAME}"), True)
    stream.write(bytearray(s.brief_json(brief).encode()))
    stream.close()
    return brief


def load_brief(store: Store) -> dict | None:
    return s.brief_of(store._text(f"{store.path}/{BRIEF_NAME}"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, ciks: Sequence[str] | None = None, today: dt.date | None = None, site: Site | None = None) -> int:
    args = parser().parse_args(argv)
    spark, today = spark or SparkSession.builder.getOrCreate(), today or getattr(args, "today", None) or dt.date.today()
    store = Store.open(spark, args.store, today)
    if args.command == "brief":
        print(json.dumps(brief_of_store(store, today), indent=2))
        return 0
    site = site or Site(args=(args.user_agent,))
    asked = [x[0] for x in fixed.FILERS] if ciks is None else list(ciks)
    report = run_ingest(
        store, "backfill" if args.backfill else "incremental", asked,
        lambda start, end, who: acquire_events(spark, start, end, who, dt.datetime.combine(end, dt.time.max), site, final=False),
        lambda series: acquire.first_filings(series, site.made(), site.lanes, site.rate),
        today, args.days, lambda message: print(message, file=sys.stderr, flush=True))
    print(json.dumps(report, indent=2, default=str))
    return report["exit_code"]


if __name__ == "__main__":
    raise SystemExit(main())
