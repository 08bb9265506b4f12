from __future__ import annotations

import datetime as dt
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from prospecta.sources import store as m
from prospecta.sources.store import Conflict, Store
from prospecta.streaming.ingest import ingest, read_events
from tests.test_events import TODAY, event, frame


def opened(spark, tmp_path):
    return Store.open(spark, f"file://{tmp_path}/store", TODAY)


def ids(store):
    return sorted((x.event_id, x.date, x.etf_name) for x in store.table("events").collect())


def test_only_touched_months_are_rewritten(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.upsert_events(frame(spark, event(1, date="2026-01-05"), event(2, date="2026-02-05"), event(3, date="2026-03-05"), event(4, date="soon")))
    before = store.version("events").parts
    assert sorted(before) == ["2026-01", "2026-02", "2026-03", "other"]
    assert store.upsert_events(frame(spark, event(2, date="2026-02-06", etf_name="New"), event(5, date="2026-04-01"))) == {"added": 1, "updated": 1}
    after = store.version("events").parts
    assert {k for k in after if after[k] != before.get(k)} == {"2026-02", "2026-04"}
    # An event whose date moves leaves its month.
    assert store.upsert_events(frame(spark, event(1, date="2026-03-09"))) == {"added": 0, "updated": 1}
    assert "2026-01" not in store.version("events").parts
    assert ids(store) == [("a-1:1", "2026-03-09", "Example ETF"), ("a-2:2", "2026-02-06", "New"), ("a-3:3", "2026-03-05", "Example ETF"), ("a-4:4", "soon", "Example ETF"), ("a-5:5", "2026-04-01", "Example ETF")]


def test_a_search_reads_its_months_alone(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.upsert_events(frame(spark, *[event(i, date=f"2026-{i:02d}-15") for i in range(1, 8)]))
    found = store.load_events("2026-03-01", "2026-04-15")
    assert sorted(x.date for x in found.collect()) == ["2026-03-15", "2026-04-15"]
    months = {x.split("part=")[1][:7] for x in store.table("events", "2026-03-01", "2026-04-15").inputFiles()}
    assert months == {"2026-03", "2026-04"} and "GreaterThanOrEqual(date,2026-03-01)" in found._jdf.queryExecution().executedPlan().toString()


def test_of_two_writers_neither_loses(spark, tmp_path):
    """A writer that made its version from an old one makes it anew."""
    store, other = opened(spark, tmp_path), opened(spark, tmp_path)
    store.upsert_events(frame(spark, event(1)))
    publish, raced = store._publish, []

    def late(*args):
        if not raced:
            raced.append(other.upsert_events(frame(spark, event(2), event(1, etf_name="Other"))))
        return publish(*args)

    store._publish = late
    assert store.upsert_events(frame(spark, event(2, etf_name="Mine"), event(3))) == {"added": 1, "updated": 1}
    assert raced == [{"added": 1, "updated": 1}] and ids(store) == [("a-1:1", "2026-07-01", "Other"), ("a-2:2", "2026-07-01", "Mine"), ("a-3:3", "2026-07-01", "Example ETF")]


def test_writers_at_once(spark, tmp_path):
    stores = [opened(spark, tmp_path) for _ in range(3)]
    threads = [threading.Thread(target=s.upsert_events, args=(frame(spark, event(i), event(9)),)) for i, s in enumerate(stores)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert [x[0] for x in ids(stores[0])] == ["a-0:0", "a-1:1", "a-2:2", "a-9:9"]
    assert [n for n, _ in stores[0].versions("events")] == [1, 2, 3]


def test_a_writer_that_is_always_late_gives_up(spark, tmp_path):
    store = opened(spark, tmp_path)

    def late(*_):
        raise Conflict("late")

    store._publish = late
    with pytest.raises(Conflict):
        store.record_run({})


def test_an_abandoned_claim_is_passed_over(spark, tmp_path, monkeypatch):
    store = opened(spark, tmp_path)
    store.upsert_events(frame(spark, event(1)))
    store._create(f"{store.path}/_events/{2:012d}", "")
    assert store.version("events").number == 1
    monkeypatch.setattr(m, "ATTEMPTS", 2)
    with pytest.raises(Conflict):
        store.upsert_events(frame(spark, event(2)))
    monkeypatch.setattr(m, "CLAIM_SECONDS", -5.0)
    store.upsert_events(frame(spark, event(2)))
    assert store.version("events").number == 3 and len(ids(store)) == 2


def test_equal_ids_in_one_call(spark, tmp_path):
    store = opened(spark, tmp_path)
    rows = frame(spark, event(1, etf_name="Late", accepted_at="2026-07-01T10:00:00"), event(1, etf_name="Early", accepted_at="2026-07-01T09:00:00"))
    assert store.upsert_events(rows.repartition(3)) == {"added": 1, "updated": 0} and ids(store)[0][2] == "Late"
    store.upsert_events(rows.withColumn("ord", F.when(F.col("etf_name") == "Early", 2).otherwise(1)))
    assert ids(store)[0][2] == "Early"


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = opened(spark, tmp_path)
    assert store.upsert_events(frame(spark, event(1)), batch=("s", 4)) == {"added": 1, "updated": 0}
    token = store.token()
    for number in (4, 3):
        assert store.upsert_events(frame(spark, event(1, etf_name="Again"), event(2)), batch=("s", number)) == {"added": 0, "updated": 0}
    assert store.token() == token and [x[2] for x in ids(store)] == ["Example ETF"]
    store.upsert_events(frame(spark, event(2)), batch=("t", 0))
    assert store.version("events").batches == {"s": 4, "t": 0}


def test_a_stream_whose_commit_was_lost(spark, tmp_path):
    """The rows of a batch are in the store, its offset is not: the replay leaves the version as it is."""
    store = opened(spark, tmp_path)
    frame(spark, event(1), event(2)).write.parquet(f"{tmp_path}/in/a")
    check = f"{tmp_path}/check"
    ingest(read_events(spark, f"{tmp_path}/in/*"), store, check).awaitTermination()
    token = store.token()
    for name in os.listdir(f"{check}/commits"):
        os.remove(f"{check}/commits/{name}")
    ingest(read_events(spark, f"{tmp_path}/in/*"), store, check).awaitTermination()
    assert store.token() == token and store.table("events").count() == 2
    frame(spark, event(3)).write.parquet(f"{tmp_path}/in/b")
    ingest(read_events(spark, f"{tmp_path}/in/*"), store, check).awaitTermination()
    assert store.table("events").count() == 3 and store.table("ledger").count() == 3


def test_vacuum(spark, tmp_path):
    store = opened(spark, tmp_path)
    for i in range(3):
        store.upsert_events(frame(spark, event(1, etf_name=f"n{i}"), event(2, date="2026-05-05") if i == 0 else event(1, etf_name=f"n{i}")))
    frame(spark, event(7)).write.parquet(f"file://{tmp_path}/store/events/unpublished")
    reader = store.table("events")
    assert store.vacuum(dt.timedelta(hours=1)) == [], "young versions and folders stay"
    gone = store.vacuum(dt.timedelta(hours=1), time.time() + 7200)
    assert {x for x in gone if x.startswith("_events")} == {f"_events/{i:012d}" for i in (1, 2)} and "events/unpublished" in gone
    named = {x.split("/")[0] for x in store.version("events").parts.values()}
    assert set(os.listdir(tmp_path / "store" / "events")) == named and len(named) == 2
    assert sorted(x.etf_name for x in reader.collect()) == ["Example ETF", "n2"]


def test_compact(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.upsert_events(frame(spark, *[event(i, date=f"2026-0{1 + i % 2}-01") for i in range(20)]))
    before = ids(store)
    store.compact()
    assert ids(store) == before and len(store.table("events").inputFiles()) == 2
    store.compact("registry")
    assert store.version("registry").number == 0


def test_versions_of_filings(spark, tmp_path):
    store = opened(spark, tmp_path)
    rows = spark.createDataFrame([("a", "1", "N-1A", "2026-01-01", 12, 1), ("b", "1", "N-1A", "2026-02-01", 15, 2)], "accession_number string, cik string, form string, filing_date string, parser_version int, event_count long")
    assert store.record_filings(rows) == {"added": 2, "updated": 0}
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "accession_number string")
    assert {x.accession_number: x.read_by for x in store.with_versions(asked).collect()} == {"a": 12, "b": 15, "c": None}
    assert sorted(x.accession_number for x in store.stale(asked).collect()) == ["a", "c"]
    assert store.record_filings(rows.withColumn("parser_version", F.lit(15)).limit(1)) == {"added": 0, "updated": 1}
