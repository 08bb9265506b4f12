"""The engine's plans: forward pipeline, brief, cards, exports and search."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions import classify as c
from prospecta.functions import text as t
from prospecta.operators import events as e
from prospecta.operators import relational as r
from prospecta.schema import EVENT_FIELDS, as_events

#: Columns of the snapshot as it is shown and exported, in order.
DISPLAY = (
    "date", "accepted_at", "form", "filing_stage", "launch_readiness", "earliest_auto_effective_date", "days_to_readiness", "etf_name", "class_name",
    "series_name", "ticker", "needs_ticker", "vehicle", "etf_share_class", "themes", "filer", "filing_event_count", "amendment_count", "filing_form_history",
    "effectiveness_label", "link",
)


def year_start(today: dt.date) -> dt.date:
    return dt.date(today.year, 1, 1)


def prepared(events: DataFrame, start: dt.date, end: dt.date, today: dt.date, registry: DataFrame | None = None, ticker_map: DataFrame | None = None) -> DataFrame:
    """Snapshot rows with display tickers, themes and readiness."""
    rows = e.snapshot(e.finalize(as_events(events), start, end, ticker_map))
    rows = rows.withColumn("ticker", t.display_ticker(F.col("ticker"), F.col("ticker_source"), F.col("vehicle"))).withColumn("themes", c.theme(F.col("etf_name")))
    return e.with_readiness(rows, today, registry, start)


def forward(events: DataFrame, today: dt.date, registry: DataFrame | None = None) -> DataFrame:
    """Funds in review or about to launch, from the start of the year, by effective date (unknown ones last)."""
    rows = prepared(events, year_start(today), today, today, registry).filter(F.col("launch_readiness").isin(*fixed.VISIBLE_STATUSES))
    return rows.orderBy(F.asc_nulls_last("earliest_auto_effective_date"), "filer", "etf_name", "event_id")


def brief_counts(rows: DataFrame) -> DataFrame:
    state = F.col("launch_readiness")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(state == fixed.UPCOMING).alias("upcoming"), F.count_if(state == fixed.INITIAL_REVIEW).alias("initial_review"))


def brief(rows: DataFrame, today: dt.date) -> dict:
    """Totals and the most frequent filers and themes (eight each)."""
    counts = brief_counts(rows).first().asDict()

    def top(column: str, fallback: str) -> list[dict]:
        return [x.asDict() for x in r.top_counts(rows, F.col(column), fallback, 8).collect()]

    return {"as_of": today.isoformat(), **counts, "top_filers": top("filer", "Unknown filer"), "top_themes": top("themes", fixed.OTHER)}


def cards(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ticker") != "Not Listed").alias("listed"), F.countDistinct("filer").alias("filers"),
        F.count_if(F.col("launch_readiness") == fixed.UPCOMING).alias("upcoming"), F.count_if("etf_share_class").alias("share_classes"), F.max("date").alias("latest"))


def hidden_counts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("launch_readiness").isin(*fixed.HIDDEN_STATUSES)).groupBy("launch_readiness").agg(F.count(F.lit(1)).alias("count"))


def theme_counts(rows: DataFrame, name: str = "etf_name") -> DataFrame:
    return r.zero_filled(rows, c.theme(F.col(name)), fixed.THEMES)


def display_order() -> list:
    return [F.desc("date"), F.asc("link"), F.asc("ticker"), F.asc("etf_name"), F.asc("event_id")]


def sorted_display(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*display_order()).select(*DISPLAY)


def to_csv(rows: DataFrame, columns: tuple[str, ...]) -> bytes:
    """An export for people: header, `\\n`, UTF-8, null as blank; streamed by partition to the driver."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    for row in rows.select(*columns).toLocalIterator():
        writer.writerow(["" if x is None else x for x in row])
    return out.getvalue().encode()


def events_csv(events: DataFrame) -> bytes:
    return to_csv(as_events(events).orderBy(*e.store_order()), EVENT_FIELDS)


def snapshot_csv(events: DataFrame, today: dt.date, registry: DataFrame | None = None) -> bytes | None:
    """The year's snapshot; None if it is empty."""
    rows = sorted_display(prepared(events, year_start(today), today, today, registry))
    return None if rows.isEmpty() else to_csv(rows, DISPLAY)


def brief_of(text: str | None) -> dict | None:
    """A stored brief, None for blank text or anything but a JSON object."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def brief_json(data: dict) -> str:
    return json.dumps(data, indent=2) + "\n"


def workbook(rows: DataFrame, title: str = "Latest snapshot") -> bytes:
    """One sheet with a frozen header, a filter and fitted widths (12 to 48), as an OOXML package."""
    names = rows.columns
    table = [names, *[["" if x is None else str(x) for x in row] for row in rows.toLocalIterator()]]
    widths = [min(48, max(12, 2 + max(len(line[i]) for line in table))) for i in range(len(names))]

    def at(i: int, j: int) -> str:
        letters = ""
        j += 1
        while j:
            j, rest = divmod(j - 1, 26)
            letters = chr(65 + rest) + letters
        return f"{letters}{i + 1}"

    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{at(i, j)}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for j, x in enumerate(line)) + "</row>" for i, line in enumerate(table))
    columns = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>{cells}</sheetData><autoFilter ref="A1:{at(len(table) - 1, len(names) - 1)}"/></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package_:
        for name, text in files.items():
            package_.writestr(name, text)
    return out.getvalue()


def filers(spark: SparkSession) -> DataFrame:
    """ord, cik, name, group and segment of the known filers; the first name of a number counts."""
    rows = list({cik: (i, cik, name) for i, (cik, name) in reversed(list(enumerate(fixed.FILERS)))}.values())
    dim = spark.createDataFrame(rows, "ord int, cik string, name string").withColumn("group", t.group_of(F.col("name")))
    return dim.withColumn("segment", t.segment_of(F.col("group")))


def groups(spark: SparkSession) -> DataFrame:
    """group and its filers in order, groups by name in any case."""
    by = filers(spark).groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "cik"))), lambda x: x.cik).alias("ciks"))
    return by.orderBy(F.lower("group"))


def ciks_of(spark: SparkSession, chosen: list[str] | None = None, segment: str = "All") -> list[str]:
    """Sorted filer numbers of the chosen groups, or of a segment."""
    dim = filers(spark)
    dim = dim if segment == "All" else dim.filter(F.col("segment") == segment)
    dim = dim if chosen is None else dim.filter(F.col("group").isin(*chosen) if chosen else F.lit(False))
    return [x.cik for x in dim.select("cik").distinct().orderBy("cik").collect()]


@dataclass(frozen=True)
class SearchResult:
    rows: DataFrame
    visible: DataFrame
    cards: DataFrame
    themes: DataFrame
    wanted_ages: DataFrame


def search(events: DataFrame, start: dt.date, end: dt.date, today: dt.date, registry: DataFrame | None = None, ticker_map: DataFrame | None = None, show_hidden: bool = False) -> SearchResult:
    """One lazy plan from events to what a search shows; series whose age is unknown are listed for a lookup."""
    rows = prepared(events, start, end, today, registry, ticker_map)
    visible = rows if show_hidden else rows.filter(F.col("launch_readiness").isin(*fixed.VISIBLE_STATUSES))
    return SearchResult(rows, sorted_display(visible), cards(rows), theme_counts(rows), e.series_wanting_age(rows, registry))
