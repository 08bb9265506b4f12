"""Micro-batch ingest of events into the store, safe to repeat.

Each batch is upserted by event id and its number is part of the version that has its rows: a batch that is delivered again
changes nothing, not even the version, and late events of any age are taken. drop_repeats() is the cheaper form for sinks that only append: events seen again within the overlap are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from prospecta import fixed
from prospecta.schema import EVENT_SCHEMA
from prospecta.sources.store import Store


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(events: DataFrame, store: Store, checkpoint: str, parser_version: int = fixed.PARSER_VERSION) -> StreamingQuery:
    """Upserts all available events and their filings' ledger rows, batch by batch. A checkpoint is a stream: its batches count on."""

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.persist()
        store.upsert_events(batch, parser_version, (checkpoint, number))
        filings = batch.groupBy("accession_number").agg(F.min("cik").alias("cik"), F.min("form").alias("form"), F.min("date").alias("filing_date"), F.count(F.lit(1)).alias("event_count"))
        store.record_filings(filings.withColumn("parser_version", F.lit(parser_version)), (checkpoint, number))
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(events: DataFrame, time: str, key: str = "event_id", days: int = fixed.OVERLAP_DAYS) -> DataFrame:
    return events.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark([key])
