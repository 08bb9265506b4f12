"""Acquisition inputs as tables: submissions lists, the official ticker map, registration feeds, supporting links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions import text as t

RECENT = (
    "filings struct<recent: struct<form: array<string>, filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>, "
    "acceptanceDateTime: array<string>>>, name string"
)


def filings_of(submissions: DataFrame, start: str, end: str, place: bool = False) -> DataFrame:
    """Filings of the known forms within bounds from (cik, body) rows: parallel arrays zipped, ragged ends skipped where a
    required value is missing, blank where an optional one, or all of its array, is. Filters come before any document is read. `place`,
    if asked for, is the filing's in its list."""
    recent = F.from_json("body", RECENT)["filings"]["recent"]
    rows = submissions.select(t.normalize_cik(F.col("cik")).alias("cik"), F.posexplode(F.arrays_zip(*[F.coalesce(recent[x], F.array().cast("array<string>")).alias(x) for x in ("form", "filingDate", "accessionNumber", "primaryDocument", "acceptanceDateTime")])))
    rows = rows.select("cik", "col.*", *["pos"] * place).toDF("cik", "form", "date", "accession_number", "primary_document", "accepted_at", *["place"] * place).filter("form is not null and date is not null and accession_number is not null")
    return rows.filter(F.col("form").isin(*fixed.FORMS) & F.col("date").between(start, end)).fillna("", ["primary_document", "accepted_at"])


def ticker_map_of(body: DataFrame) -> DataFrame:
    """cik, series_id, class_id and symbol from (body) rows of {fields, data}: columns are looked up by name, rows without
    a valid symbol are skipped, the last of equal keys counts. Without a needed field there are no rows."""
    parsed = body.select(F.from_json("body", "fields array<string>, data array<array<string>>").alias("m")).select("m.fields", F.posexplode("m.data").alias("pos", "row"))

    def value(name: str) -> Column:
        at = F.array_position("fields", name)
        return F.when(at > 0, F.get("row", (at - 1).cast("int")))

    rows = parsed.select("pos", t.normalize_cik(value("cik")).alias("cik"), t.key_text(value("seriesId")).alias("series_id"), t.key_text(value("classId")).alias("class_id"), t.official_ticker(value("symbol")).alias("symbol"),
                         F.forall(F.array(*map(F.lit, ("cik", "seriesId", "classId", "symbol"))), lambda x: F.array_contains("fields", x)).alias("whole"))
    good = rows.filter("whole and symbol <> '' and cik <> ''")
    return good.groupBy("cik", "series_id", "class_id").agg(F.max_by("symbol", "pos").alias("symbol"))


def first_filing_dates(feeds: DataFrame) -> DataFrame:
    """series_id and its first filing date from (series_id, body) rows of feed pages; invalid ids and dates give none."""
    dates = F.regexp_extract_all("body", F.lit(r"<filing-date>\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\s*</filing-date>"), F.lit(1))
    rows = feeds.filter(F.col("series_id").rlike(r"^S[0-9]{9}\z")).select("series_id", F.explode(dates).alias("date"))
    return rows.groupBy("series_id").agg(F.min(F.col("date").try_cast("date")).alias("first_filing_date"))


# Links of an index page: those of anchors; without any, by their form in this order.
PATH = r"/Archives/edgar/data/"
ANCHORS = rf"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*{PATH}[^"']*)["']"""
GROUPS = (
    rf'(?i)href="/ix\?doc=({PATH}[^"]+\.(?:htm|html))"', rf'(?is)<tr[^>]*>\s*<td[^>]*>\s*1\s*</td>.*?href="({PATH}[^"]+\.(?:htm|html))"',
    rf'(?i)href="({PATH}[^"]+_htm\.xml)"', rf'(?i)href="({PATH}[^"]+\.txt)"', rf'(?i)href="({PATH}[^"]+\.(?:htm|html))"',
)


def supporting_links(index: Column, base: str, excluded: Column | None = None, most: int = 2) -> Column:
    """Up to `most` document addresses of an index page, each once: those of its anchors in order (viewer prefixes stripped), or if it has no such
    anchor, those of other tags by form. Index pages, excluded addresses and what is no document are skipped."""
    def found(pattern: str) -> Column:
        return F.filter(F.regexp_extract_all(index, F.lit(pattern), F.lit(1)), lambda x: ~F.lower(x).rlike(r"/index\.html?\z"))

    anchors = F.transform(found(ANCHORS), lambda x: F.regexp_replace(F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")), r"(?i)^/ix\?doc=", ""))
    links = F.when(~F.lower(index).contains(PATH.lower()), F.array().cast("array<string>")).when(F.size(anchors) > 0, anchors).otherwise(F.concat(*map(found, GROUPS)))
    whole = F.array_distinct(F.transform(F.filter(links, t.has_document_suffix), lambda x: t.absolute_url(x, base)))
    return F.slice(F.array_except(whole, excluded) if excluded is not None else whole, 1, most)
