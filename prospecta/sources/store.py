"""A versioned event store on Parquet: parts are written as new folders, and numbered files say which ones make a version.

A reader keeps its version while a writer makes the next; nothing that is being read is overwritten.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.operators import events as e
from prospecta.operators import relational as r
from prospecta.schema import EVENT_FIELDS, LEDGER_SCHEMA, REGISTRY_SCHEMA, RUN_SCHEMA, STORED_SCHEMA, as_events

TABLES = {"events": STORED_SCHEMA, "ledger": LEDGER_SCHEMA, "registry": REGISTRY_SCHEMA, "runs": RUN_SCHEMA}
#: Tables that are kept by the month of a date column; the others are one part.
DATED = {"events": "date", "ledger": "filing_date"}
#: Rows without a month, and tables without dates.
UNDATED = "other"
#: Times that an update is made anew because another writer came first, and how long a claimed number may stay without content.
ATTEMPTS, CLAIM_SECONDS = 8, 60.0


class VersionError(ValueError):
    pass


class Conflict(RuntimeError):
    """Another writer has published a version since the one that an update was made from."""


@dataclass(frozen=True)
class Version:
    """What a table is: its number, the folder of each part, and the last batch of each stream that is in it."""

    number: int
    parts: dict[str, str]
    batches: dict[str, int]

    @property
    def content(self) -> str:
        return json.dumps({"parts": self.parts, "batches": self.batches}, sort_keys=True)


def month(date: Column) -> Column:
    return F.when(date.rlike(r"^[0-9]{4}-[0-9]{2}"), F.substring(date, 1, 7)).otherwise(UNDATED)


@dataclass
class Store:
    """events, ledger (filings read), registry (first filing of a series) and runs.

    A version is a numbered file that names the folder of each part. An update writes the parts that it touches, then claims
    the number after the version it was made from; if that number is taken, it is made anew from the newer version, so of two
    writers neither loses the other's rows. Parts are months of events and filings: a search lists the months it needs, an
    update rewrites those it changes.
    """

    spark: SparkSession
    path: str
    now: Callable[[], str] = lambda: dt.datetime.now(dt.timezone.utc).isoformat()

    @classmethod
    def open(cls, spark: SparkSession, path: str, today: dt.date, now: Callable[[], str] | None = None) -> Store:
        """Makes the store if there is none; another version is an error."""
        store = cls(spark, path.rstrip("/"), *([now] if now else []))
        meta = store._meta()
        if meta is None:
            floor = today - dt.timedelta(days=fixed.BACKFILL_DAYS)
            try:
                store._create(f"{store.path}/_meta", json.dumps([fixed.STORE_VERSION, floor.isoformat()]))
            except Conflict:
                return cls.open(spark, path, today, now)
        elif int(meta[0]) != fixed.STORE_VERSION:
            raise VersionError(f"store version {meta[0]}, expected {fixed.STORE_VERSION}")
        return store

    # Files, by the Hadoop API: a store may lie wherever Spark can write.

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _listed(self, folder: str) -> list:
        files, path = self._files()
        return list(files.listStatus(path(folder))) if files.exists(path(folder)) else []

    def _text(self, name: str) -> str | None:
        files, path = self._files()
        if not files.exists(path(name)):
            return None
        stream = files.open(path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        """A new file; Conflict if there is one. Local disks have no exclusive create in the Hadoop API, so there the file is first
        claimed by their own."""
        files, path = self._files()
        jvm = self.spark.sparkContext._jvm
        files.mkdirs(path(name).getParent())
        claimed = files.getScheme() == "file"
        try:
            if claimed:
                nio = jvm.java.nio.file
                nothing = self.spark.sparkContext._gateway.new_array(nio.attribute.FileAttribute, 0)
                nio.Files.createFile(nio.Paths.get(path(name).toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.String, 0)), nothing)
            stream = files.create(path(name), claimed)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(name) from None
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def _meta(self) -> list | None:
        text = self._text(f"{self.path}/_meta")
        return json.loads(text) if text else None

    @property
    def backfill_floor(self) -> str:
        return self._meta()[1]

    # Versions

    def versions(self, name: str) -> list[tuple[int, int]]:
        """(number, time of writing in milliseconds) of the published versions, and of claims without content: in order."""
        return sorted((int(x.getPath().getName()), x.getModificationTime()) for x in self._listed(f"{self.path}/_{name}") if not x.getPath().getName().startswith("."))

    def version(self, name: str) -> Version:
        """The newest version with content; number 0 is a table without any."""
        for number, _ in reversed(self.versions(name)):
            if text := self._text(f"{self.path}/_{name}/{number:012d}"):
                return Version(number, **json.loads(text))
        return Version(0, {}, {})

    def token(self) -> tuple[int, ...]:
        """Changes with every change of any table."""
        return tuple(self.version(name).number for name in TABLES)

    def _publish(self, name: str, base: Version, parts: dict[str, str], batches: dict[str, int]) -> None:
        """Makes the version after `base`. A number that was claimed and never got content is passed over once it is old."""
        number, late = base.number + 1, (time.time() - CLAIM_SECONDS) * 1000
        for taken, written in self.versions(name):
            if taken >= number:
                if written > late or self._text(f"{self.path}/_{name}/{taken:012d}"):
                    raise Conflict(f"{name}: {taken}")
                number = taken + 1
        self._create(f"{self.path}/_{name}/{number:012d}", Version(number, parts, batches).content)

    def update(self, name: str, change: Callable[[Version], tuple[dict[str, str], dict[str, int]] | None]) -> Version:
        """Publishes what `change` makes of the newest version (parts and batches; None: nothing to do); anew if another writer was first."""
        for _ in range(ATTEMPTS):
            base = self.version(name)
            made = change(base)
            if made is None:
                return base
            try:
                self._publish(name, base, *made)
            except Conflict:
                continue
            return self.version(name)
        raise Conflict(f"{name}: {ATTEMPTS} writers came first")

    def _read(self, name: str, folders: Iterable[str]) -> DataFrame:
        folders = sorted(set(folders))
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(self._schema(name)).parquet(*[f"{self.path}/{name}/{x}" for x in folders])

    def _schema(self, name: str):
        return self.spark.createDataFrame([], TABLES[name]).schema

    def _written(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Folders of the parts that rows fall into; a part of very many rows gets many files."""
        folder, part = uuid.uuid4().hex, month(F.col(DATED[name])) if name in DATED else F.lit(UNDATED)
        rows = rows.select(*self._schema(name).names, part.alias("part"))
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/{name}/{folder}")
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in (x.getPath().getName() for x in self._listed(f"{self.path}/{name}/{folder}")) if n.startswith("part=")}

    def table(self, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """A table, or the parts of it that may have dates from first to last."""
        parts = self.version(name).parts
        within = [x for k, x in parts.items() if k == UNDATED or ((first is None or k >= first[:7]) and (last is None or k <= last[:7]))]
        return self._read(name, within)

    def available(self) -> bool:
        return self.version("events").number > 0

    def load_events(self, start: str, end: str, ciks: list[str] | None = None) -> DataFrame:
        """Events of filing dates within bounds, in store order; only the months between are listed and read. Stored text is never
        null, so the bounds reach the scan."""
        return as_events(e.range_scan(self.table("events", start, end), start, end, ciks)).select(*EVENT_FIELDS)

    def _upsert(self, name: str, rows: DataFrame, key: str, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Rows by key, the last of equal keys by `ord` wins. Rewrites the parts that the rows, or the stored rows of their keys,
        are in. A batch (stream, number) that is in the table already changes nothing. The counts are observed as the parts are written."""
        last = r.upsert(self._read(name, []), rows, [key], "ord").persist()
        counts = {"added": 0, "updated": 0}

        def change(base: Version) -> tuple[dict[str, str], dict[str, int]] | None:
            counts.update(added=0, updated=0)
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return None
            batches = base.batches | ({batch[0]: batch[1]} if batch else {})
            part = month(F.col(DATED[name])) if name in DATED else F.lit(UNDATED)
            old = self._read(name, base.parts.values())
            met = old.join(last.select(key), key, "left_semi").select(part.alias("part")).distinct()
            touched = {x.part for x in met.unionAll(last.select(part.alias("part")).distinct()).collect()}  # months, not rows
            if not touched:
                return base.parts, batches
            before = self._read(name, [base.parts[x] for x in touched & set(base.parts)])
            known = before.select(key, F.lit(True).alias("known")).distinct()
            seen = Observation()
            new = last.join(known, key, "left").observe(seen, F.count_if(F.col("known")).alias("updated"), F.count_if(F.col("known").isNull()).alias("added")).drop("known")
            parts = self._written(name, before.join(last.select(key), key, "left_anti").unionByName(new.select(*before.columns)))
            counts.update({k: int(v) for k, v in seen.get.items()})
            return {k: v for k, v in base.parts.items() if k not in touched} | parts, batches

        try:
            self.update(name, change)
        finally:
            last.unpersist()
        return counts

    def upsert_events(self, events: DataFrame, parser_version: int = fixed.PARSER_VERSION, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Events by id; a blank id is an error. Of equal ids the last by column `ord` wins, without one the last by acceptance, date
        and then values. Returns how many were added and updated."""
        if not events.filter(F.coalesce(F.trim("event_id"), F.lit("")) == "").isEmpty():
            raise ValueError("an event without an id")
        own = as_events(events)
        ordered = own if "ord" in events.columns else own.withColumn("ord", F.struct("accepted_at", "date", F.to_json(F.struct(*EVENT_FIELDS)).alias("values")))
        return self._upsert("events", ordered.withColumns({"ingested_at": F.lit(self.now()), "parser_version": F.lit(parser_version)}), "event_id", batch)

    def record_filings(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """accession_number, cik, form, filing_date, parser_version and event_count of filings read; the newest parser of equal accessions counts."""
        order = F.struct("parser_version", "event_count", F.to_json(F.struct("cik", "form", "filing_date")).alias("values"))
        return self._upsert("ledger", rows.withColumns({"ingested_at": F.lit(self.now()), "ord": order}), "accession_number", batch)

    def with_versions(self, rows: DataFrame) -> DataFrame:
        """rows with `read_by`: the parser version that has read their filing, null for none."""
        return rows.join(self.table("ledger").select("accession_number", F.col("parser_version").alias("read_by")), "accession_number", "left")

    def parser_version_of(self, accession: str) -> int | None:
        """The parser version that has read a filing."""
        found = self.table("ledger").filter(F.col("accession_number") == accession).select("parser_version").first()
        return found.parser_version if found else None

    def first_filing_dates(self) -> DataFrame:
        """series_id (upper, trimmed) and first_filing_date of the registry; nothing if it cannot be read."""
        try:
            rows = self.table("registry")
        except Exception:  # a search goes on without ages
            rows = self.spark.createDataFrame([], TABLES["registry"])
        return rows.select(F.upper(F.trim("series_id")).alias("series_id"), "first_filing_date")

    def is_processed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table("ledger").select("accession_number"), "accession_number", "left_semi")

    def stale(self, rows: DataFrame, version: int = fixed.PARSER_VERSION) -> DataFrame:
        """Filings not read yet, or read by an older parser."""
        return r.unseen(rows, self.table("ledger").filter(F.col("parser_version") >= version), ["accession_number"])

    def register_series(self, rows: DataFrame) -> dict[str, int]:
        order = F.struct("first_filing_date", "cik", "lookup_source")
        return self._upsert("registry", rows.withColumns({"series_id": F.upper(F.trim("series_id")), "resolved_at": F.lit(self.now()), "ord": order}), "series_id")

    def unresolved_series(self) -> DataFrame:
        own = self.table("events").select(F.upper(F.trim("series_id")).alias("series_id"), "cik").filter("series_id <> ''").distinct()
        return r.unseen(own, self.table("registry"), ["series_id"]).orderBy("series_id")

    def record_run(self, run: dict) -> int:
        """Appends a run; its number is one more than the last."""
        numbers = {"int", "bigint"}
        row = {f.name: run.get(f.name, 0 if f.dataType.simpleString() in numbers else "") for f in self._schema("runs").fields}

        def change(base: Version) -> tuple[dict[str, str], dict[str, int]]:
            runs = self._read("runs", base.parts.values())
            row["run_id"] = (runs.agg(F.max("run_id").alias("n")).first().n or 0) + 1
            return self._written("runs", runs.unionByName(self.spark.createDataFrame([row], RUN_SCHEMA))), base.batches

        self.update("runs", change)
        return row["run_id"]

    def last_good_run(self) -> dict | None:
        """The newest finished run in which some filer did not fail."""
        found = self.table("runs").filter("completed_at <> '' and ciks_attempted > ciks_failed").orderBy(F.desc("run_id")).limit(1).collect()
        return found[0].asDict() if found else None

    def bounds(self, mode: str, today: dt.date, days: int | None = None) -> tuple[dt.date, dt.date]:
        """Dates to read: a backfill's days, or from three days before the end of the last good run."""
        last = self.last_good_run() if mode == "incremental" else None
        if last:
            return dt.date.fromisoformat(last["end_bound"]) - dt.timedelta(days=fixed.OVERLAP_DAYS), today
        return today - dt.timedelta(days=fixed.BACKFILL_DAYS if days is None or mode != "backfill" else days), today

    # Upkeep

    def compact(self, name: str = "events") -> None:
        """Rewrites all parts of a table into as few files as their sizes ask for."""
        self.update(name, lambda base: (self._written(name, self._read(name, base.parts.values())), base.batches) if base.parts else None)

    def vacuum(self, keep: dt.timedelta = dt.timedelta(days=7), now: float | None = None) -> list[str]:
        """Removes versions older than `keep` but for the newest, and folders that no version left names and that are older
        too, so that neither a reader of a kept version nor a writer who has yet to publish loses one. Returns what went."""
        files, path = self._files()
        late, gone = ((now or time.time()) - keep.total_seconds()) * 1000, []
        for name in TABLES:
            newest, named = self.version(name), set()
            for number, written in self.versions(name):
                pointer = f"_{name}/{number:012d}"
                if number >= newest.number or written >= late:
                    text = self._text(f"{self.path}/{pointer}")
                    named |= {x.split("/")[0] for x in json.loads(text)["parts"].values()} if text else set()
                else:
                    gone.append(pointer)
            gone += [f"{name}/{n}" for n, written in ((x.getPath().getName(), x.getModificationTime()) for x in self._listed(f"{self.path}/{name}")) if n not in named and written < late]
        for x in gone:
            files.delete(path(f"{self.path}/{x}"), True)
        return gone


@dataclass(frozen=True)
class Loaded:
    """Events of a search, how each filer fared, and notices."""

    events: DataFrame
    statuses: DataFrame
    notices: tuple[str, ...]


def load_store_first(store: Store, start: dt.date, end: dt.date, ciks: list[str], live: Callable[[dt.date, dt.date, list[str]], tuple[DataFrame, dict[str, str]]] | None = None) -> Loaded:
    """Stored events, topped up from three days before their end where the search reaches beyond it, finalized.

    live gives (events, errors by filer). A failed top-up leaves the stored events and a notice.
    """
    spark, notices, errors, source = store.spark, [], {}, "store"
    try:
        available = store.available()
        stored = store.load_events(start.isoformat(), end.isoformat(), ciks) if available else store._read("events", []).select(*EVENT_FIELDS)
        run = store.last_good_run() if available else None
    except Exception as error:  # what is stored cannot be read; what is on the site can
        notices.append(f"the store could not be read: {type(error).__name__}")
        stored, run = store._read("events", []).select(*EVENT_FIELDS), None
    covered = dt.date.fromisoformat(run["end_bound"]) if run else None
    merged = stored
    if live is not None and (covered is None or covered < end):
        begin = max(start, covered - dt.timedelta(days=fixed.OVERLAP_DAYS)) if covered else start
        try:
            found, errors = live(begin, end, ciks)
        except Exception as error:
            notices.append(f"the top-up failed: {error}")
            found, errors = None, dict.fromkeys(ciks, str(error))
        if found is not None:
            source, number = "store+live" if covered else "live", F.monotonically_increasing_id()
            merged = r.merge_by_key(stored.withColumn("ord", number), as_events(found).select(*EVENT_FIELDS).withColumn("ord", number), "event_id").drop("ord", "place")
            if errors:
                notices.append("the top-up is incomplete for some filers")
    events = e.finalize(merged, start, end)
    dim = spark.createDataFrame([(x, errors.get(x, "")) for x in ciks], "cik string, error string")
    counts = events.groupBy("cik").agg(F.count(F.lit(1)).alias("n_events"))
    statuses = dim.join(counts, "cik", "left").select(
        "cik", F.when(F.col("error") != "", "failed").otherwise("success").alias("status"), F.lit(source).alias("source"), F.coalesce("n_events", F.lit(0)).alias("n_events"), "error")
    return Loaded(events, statuses, tuple(notices))
