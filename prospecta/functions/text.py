"""Scalar functions over names, tickers, numbers and addresses, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.schema import NOT_LISTED

#: Entities decoded without a UDF; parse functions, which see any document, decode all of them.
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]+"


def text(value: Column) -> Column:
    """Missing text is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def one_spaced(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, SPACES, " "))


def clean_html(value: Column) -> Column:
    """Text without tags, with the common entities decoded and white space collapsed."""
    plain = F.regexp_replace(text(value), "<[^>]+>", " ")
    return one_spaced(reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, plain))


def clean_html_any(value: Column) -> Column:
    """As clean_html, with every entity there is decoded: for text of unknown origin. A UDF over Arrow batches."""
    from prospecta.sources.parse import clean

    @F.pandas_udf("string")
    def cleaned(x: pd.Series) -> pd.Series:
        return x.map(lambda v: clean(v or ""))

    return cleaned(text(value))


def normalize_name(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(clean_html(value)), "[^A-Z0-9]+", " "))


def without_status(value: Column) -> Column:
    """A series entry's name without its leading status word."""
    return F.trim(F.regexp_replace(clean_html(value), r"(?i)^(?:new|existing|active|inactive)\s+", ""))


def split_name_ticker(value: Column) -> Column:
    """struct<name, ticker>: a trailing word of 3 or 4 capitals is a ticker unless denied."""
    clean = without_status(value)
    ticker = F.regexp_extract(clean, r"\s+([A-Z]{3,4})$", 1)
    good = (ticker != "") & ~ticker.isin(*fixed.DENIED_TICKERS)
    return F.when(good, F.struct(F.trim(F.regexp_replace(clean, r"\s+[A-Z]{3,4}$", "")).alias("name"), ticker.alias("ticker"))).otherwise(
        F.struct(clean.alias("name"), F.lit("").alias("ticker")))


def _upper(value: Column) -> Column:
    return F.upper(F.trim(text(value)))


def sanitize_ticker(value: Column) -> Column:
    ticker = _upper(value)
    return F.when(ticker.rlike(r"^[A-Z]{2,5}\z") & ~ticker.isin(*fixed.DENIED_TICKERS), ticker).otherwise(NOT_LISTED)


def official_ticker(value: Column) -> Column:
    ticker = _upper(value)
    return F.when(ticker.rlike(r"^[A-Z0-9.\-]{1,10}\z"), ticker).otherwise("")


def normalize_cik(value: Column) -> Column:
    digits = F.regexp_replace(text(value), "[^0-9]", "")
    return F.when((digits == "") | (F.length(digits) >= 10), digits).otherwise(F.lpad(digits, 10, "0"))


def key_text(value: Column) -> Column:
    """Ids compare trimmed and upper-cased."""
    return _upper(value)


def is_mutual_fund_ticker(value: Column) -> Column:
    return _upper(value).rlike(r"^[A-Z]{4}X\z")


def is_share_class_name(value: Column) -> Column:
    name, label = F.trim(text(value)), r"Class\s+[A-Z0-9]+(?:-[A-Z0-9]+)*(?:\s+Shares)?"
    return name.rlike(rf"(?i)^(?:{label}|(?:Institutional|Investor|Retail)\s+Class(?:\s+Shares)?)\z") | name.rlike(rf"(?i):\s*{label}$")


def has_exchange_prefix(name: Column) -> Column:
    return F.trim(text(name)).rlike(rf"(?i)^(?:{'|'.join(fixed.EXCHANGE_PREFIXES)})\b")


def display_ticker(ticker: Column, source: Column, vehicle: Column) -> Column:
    """A mapped ticker as it is, a mutual fund's of its own form, else a sanitized one."""
    return F.when((source == fixed.FROM_MAP) & (official_ticker(ticker) != ""), official_ticker(ticker)).when(
        (vehicle == fixed.MUTUAL_FUND) & is_mutual_fund_ticker(ticker), _upper(ticker)).otherwise(sanitize_ticker(ticker))


def event_id(accession: Column, class_id: Column, series_id: Column, name: Column) -> Column:
    token = F.coalesce(*[F.nullif(text(x), F.lit("")) for x in (class_id, series_id)], normalize_name(name))
    return F.concat_ws(":", text(accession), token)


def absolute_url(path: Column, base: str) -> Column:
    return F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), path))


def is_host(url: Column, host: str) -> Column:
    """The host itself or one below it."""
    own = F.lower(F.parse_url(url, F.lit("HOST")))
    return F.coalesce((own == host) | own.endswith(f".{host}"), F.lit(False))


def has_document_suffix(url: Column) -> Column:
    return F.lower(F.split(url, r"\?")[0]).rlike(r"\.(?:htm|html|txt|xml)\z")


def theme_name(value: Column) -> Column:
    return one_spaced(F.regexp_replace(F.lower(text(value)), "[-/]", " "))


def group_of(name: Column) -> Column:
    """The first rule that a name meets, else the name."""
    low = F.lower(name)

    def met(needle: str) -> Column:
        return low.startswith(needle[1:]) if needle.startswith("^") else low.contains(needle)

    out = name
    for group, needles in reversed(fixed.GROUP_RULES):
        out = F.when(reduce(lambda a, b: a | b, map(met, needles)), F.lit(group)).otherwise(out)
    return out


def segment_of(group: Column) -> Column:
    return F.when(group.isin(*fixed.TOP_GROUPS), "Top 3").when(group.isin(*fixed.SERIES_TRUST_GROUPS), "Series Trusts").otherwise("The Field")


def filer_label(cik: Column, configured: Column, filer: Column, shared: Sequence[str] = fixed.TIDAL_FILERS) -> Column:
    """The configured name before the filed one, in capitals; `shared` filers, and those of their name, share a label."""
    name = F.upper(F.coalesce(F.nullif(configured, F.lit("")), text(filer)))
    return F.when(cik.isin(*shared) | name.contains(fixed.TIDAL_NAME), fixed.TIDAL_LABEL).otherwise(name)


def any_word(terms: tuple[str, ...]) -> str:
    """A pattern: several words anywhere, one word at word borders."""
    return "|".join(re.escape(t).replace(r"\ ", " ") if " " in t else rf"\b{re.escape(t)}\b" for t in terms)
