"""Exports of a store as CSV, written in order by the cluster: a folder of parts whose bytes, one after another, are the file.

A global sort deals rows to parts by range, each part writes its own lines, and the header is a part of its own before them;
no row passes through the driver.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta import fixed
from prospecta.operators import events as e
from prospecta.plans import snapshot as s
from prospecta.schema import EVENT_FIELDS
from prospecta.sources.store import Store

HEADER = "00-header.csv"


def csv_field(name: str, kind: T.DataType) -> Column:
    """A value as the CSV has it: null is blank, quotes only where they are needed."""
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    if isinstance(kind, T.BooleanType):
        text = F.initcap(text)
    if not isinstance(kind, T.StringType):
        return text
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def write_csv(rows: DataFrame, columns: Sequence[str], order: Sequence[Column | str], path: str) -> None:
    """Rows in order, as a folder that read_export gives as one file."""
    kinds = {f.name: f.dataType for f in rows.schema}
    line = F.concat_ws(",", *[csv_field(x, kinds[x]) for x in columns])
    rows.orderBy(*order).select(line.alias("line")).write.text(path)
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(columns)
    files, hadoop_path = _files(rows.sparkSession, path)
    stream = files.create(hadoop_path(f"{path}/{HEADER}"), False)
    stream.write(bytearray(header.getvalue().encode()))
    stream.close()


def _files(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def read_export(spark: SparkSession, path: str, block: int = 1 << 20) -> Iterator[bytes]:
    """The file's bytes, a block at a time."""
    files, hadoop_path = _files(spark, path)
    names = sorted(n for n in (x.getPath().getName() for x in files.listStatus(hadoop_path(path))) if not n.startswith(("_", ".")))
    for name in names:
        stream = files.open(hadoop_path(f"{path}/{name}"))
        try:
            while data := stream.readNBytes(block):
                yield bytes(data)
        finally:
            stream.close()


def export_events(store: Store, path: str) -> bool:
    """All events in store order; without a store nothing is written."""
    if not store.available():
        return False
    write_csv(store.table("events"), EVENT_FIELDS, e.store_order(), path)
    return True


def export_snapshot(store: Store, today: dt.date, path: str) -> bool:
    """The year's snapshot of the known filers; nothing is written if there is none."""
    if not store.available():
        return False
    start = s.year_start(today)
    events = store.load_events(start.isoformat(), today.isoformat(), [x[0] for x in fixed.FILERS])
    rows = s.prepared(events, start, today, today, store.table("registry"))
    if rows.isEmpty():
        return False
    write_csv(rows, s.DISPLAY, s.display_order(), path)
    return True
