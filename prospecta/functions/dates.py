"""Filing times and effective dates. Values come from text, so nothing here throws under ANSI mode."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions.text import text

ISO = r"^\d{4}-\d{2}-\d{2}"
LOWEST, HIGHEST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _at(value: Column, pattern: str) -> Column:
    return F.try_to_timestamp(value, F.lit(pattern))


def filing_date(date: Column) -> Column:
    """Midnight of an ISO date; the lowest time if it is none."""
    day = F.trim(text(date))
    return F.coalesce(F.when(day.rlike(rf"{ISO}\z"), _at(day, "yyyy-MM-dd")), F.lit(LOWEST).cast("timestamp"))


def event_time(accepted_at: Column, date: Column) -> Column:
    """When a filing was accepted (offsets to UTC; the session's zone is UTC), else its date, else the lowest time."""
    accepted = F.trim(text(accepted_at))
    return F.coalesce(F.when(accepted.rlike(ISO), accepted.try_cast("timestamp")), filing_date(date))


def _designated(value: Column) -> Column:
    return F.coalesce(_at(value, "MMMM d, yyyy"), _at(value, "M/d/yyyy"), F.when(value.rlike(rf"{ISO}\z"), _at(value, "yyyy-MM-dd")))


def days_of(days: Column) -> Column:
    return F.trim(days.cast("string")).try_cast("int")


def effective_for_history(designated: Column, date: Column, days: Column) -> Column:
    """Date by which an earlier filing counts as effective: a designated date that cannot be read is never."""
    named, never = F.trim(text(designated)), F.lit(HIGHEST).cast("timestamp")
    base = filing_date(date)
    added = F.when(base > F.lit(LOWEST).cast("timestamp"), F.date_add(base, days_of(days)).cast("timestamp"))
    return F.when(named != "", F.coalesce(_designated(named), never)).otherwise(F.coalesce(added, never))


def earliest_effective(designated: Column, date: Column, days: Column) -> Column:
    """Date on which a filing becomes effective by itself: a designated date that cannot be read is passed over for the
    days; null without a filing date. Also reads short month names."""
    named = F.trim(text(designated))
    parsed = F.when(named != "", F.coalesce(_designated(named), _at(named, "MMM d, yyyy")))
    day = F.when(F.trim(text(date)).rlike(rf"{ISO}\z"), filing_date(date))
    return F.when(day.isNotNull(), F.coalesce(parsed.cast("date"), F.date_add(day, days_of(days))))


def age_cutoff(start: Column, months: int = fixed.SERIES_NEW_MONTHS) -> Column:
    return F.add_months(start, -months)


def as_day(value: dt.date | dt.datetime | str) -> dt.date:
    """A day given as a date, a time or text that begins with an ISO date."""
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])
