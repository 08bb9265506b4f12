"""Vehicle, identity, theme and readiness as Column expressions over event rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions import text as t


def vehicle(ticker: Column, class_name: Column, name: Column, series_name: Column, exchange_listed: Column | None = None) -> Column:
    symbol = F.upper(F.trim(t.text(ticker)))
    own = F.trim(F.coalesce(F.nullif(t.text(class_name), F.lit("")), t.text(name)))
    both = F.upper(F.concat_ws(" ", F.trim(t.text(series_name)), own))
    listed = F.coalesce(exchange_listed, F.lit(False)) if exchange_listed is not None else F.lit(False)
    is_etf = both.rlike(r"\bETF\b") | both.rlike(r"\b(?:BULL|BEAR)\s+[0-9]X\s+SHARES\b") | symbol.rlike(r"^[A-Z]{1,4}\z") | listed
    return F.when(t.is_mutual_fund_ticker(symbol) | t.is_share_class_name(own), fixed.MUTUAL_FUND).when(is_etf, fixed.ETF).otherwise(fixed.UNKNOWN)


def row_vehicle(exchange_listed: Column | None = None) -> Column:
    return vehicle(F.col("ticker"), F.col("class_name"), F.col("etf_name"), F.col("series_name"), exchange_listed)


def uses_series_identity(kind: Column) -> Column:
    """A series stands for its mutual fund classes."""
    return (F.trim(t.text(F.col("series_id"))) != "") & ((kind == fixed.MUTUAL_FUND) | t.is_share_class_name(F.col("class_name")))


def has_any_id() -> Column:
    return (F.trim(F.col("series_id")) != "") | (F.trim(F.col("class_id")) != "")


def known_identity(cik: Column, series_id: Column, class_id: Column, scope: Column) -> Column:
    """struct<kind, cik, id1, id2> by series or class, null if ids are missing."""
    series, own = t.key_text(series_id), t.key_text(class_id)

    def key(kind: str, second: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), t.normalize_cik(cik).alias("cik"), series.alias("id1"), second.alias("id2"))

    return F.when(series != "", F.when((scope == "series") | (own == ""), key("series", F.lit(""))).otherwise(key("class", own)))


def name_identity(cik: Column, name: Column) -> Column:
    return F.struct(F.lit("name").alias("kind"), t.normalize_cik(cik).alias("cik"), t.normalize_name(name).alias("id1"), F.lit("").alias("id2"))


def theme(name: Column) -> Column:
    """The first theme that a name's words show; leveraged and inverse names come before all."""
    words = t.theme_name(name)
    geared = words.rlike(r"\b[+-]?[0-9]+(?:\.[0-9]+)?x\b") | words.rlike(rf"\b(?:{'|'.join(fixed.GEARED_WORDS)})\b")
    short = words.rlike(r"\bshort\b") & ~words.rlike(rf"\bshort\s+(?:{'|'.join(fixed.SHORT_FOLLOWERS)})\b")
    out = F.when((words != "") & ~words.rlike(r"\blong\s+short\b") & (geared | short), fixed.LEVERAGED)
    for label, terms in fixed.THEME_TERMS:
        out = out.when(words.rlike(t.any_word(terms)), label)
    return out.otherwise(fixed.OTHER)


def filing_stage(form: Column) -> Column:
    kind = F.upper(t.text(form))
    return F.when(kind.isin(*fixed.INITIAL_FORMS), "Initial filing").when(kind == "485APOS", "Rule 485(a) amendment").when(
        kind == "485BPOS", "Rule 485(b) amendment").otherwise("Filing")


def history_forms(history: Column, form: Column) -> Column:
    """Forms of a history in order; the row's own form if it has none."""
    parts = F.filter(F.transform(F.split(t.text(history), "->"), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    own = F.upper(F.trim(t.text(form)))
    return F.when(F.size(parts) > 0, parts).when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))


def readiness(form: Column, history: Column, vehicle_: Column, effective: Column, today: dt.date) -> Column:
    forms, now = history_forms(history, form), F.lit(today)
    launch = F.coalesce(F.try_element_at(forms, F.lit(1)).isin(*fixed.LAUNCH_FORMS), F.lit(False)) & (vehicle_ == fixed.ETF)
    routine = (F.size(forms) > 0) & F.forall(forms, lambda x: x == "485BPOS")
    return F.when(F.upper(t.text(form)).isin(*fixed.INITIAL_FORMS), fixed.INITIAL_REVIEW).when(effective.isNull(), fixed.UNDETECTED).when(
        launch & (effective > now), fixed.UPCOMING).when(launch & (F.datediff(now, effective) <= fixed.RECENT_DAYS), fixed.RECENT).when(
        launch, fixed.STALE).when(routine, fixed.ROUTINE).otherwise(fixed.EFFECTIVE)


def wants_series_age(state: Column, form: Column) -> Column:
    return state.isin(fixed.UPCOMING, fixed.RECENT, fixed.STALE) | ((state == fixed.UNDETECTED) & F.upper(t.text(form)).isin(*fixed.AMENDMENT_FORMS))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def needs_ticker(ticker: Column, source: Column, vehicle_: Column) -> Column:
    mapped = (source == fixed.FROM_MAP) & (t.official_ticker(ticker) != "")
    fund = (vehicle_ == fixed.MUTUAL_FUND) & t.is_mutual_fund_ticker(ticker)
    return ~(mapped | fund | (t.sanitize_ticker(ticker) != "Not Listed"))
