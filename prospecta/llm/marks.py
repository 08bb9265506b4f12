"""Fetching a part of the texts by key: a bit table of fixed size saves moving most of the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from prospecta.llm.common import mixed

#: The table's bits (8 MB at any size of the input; with more keys more texts pass that a join then drops, none is lost).
MARK_BITS = 26
ROWS = 64


def _slots(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _batch(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], names=["block", "bits"])


def marks(keys: DataFrame) -> Broadcast:
    """The bit table of `keys` (one long column), for every task."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            bits[_slots(np.asarray(batch.column(0)))] = True
        packed = np.packbits(bits).reshape(ROWS, -1)
        yield _batch({i: x for i, x in enumerate(packed) if x.any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                total[block] = total.get(block, np.uint8(0)) | np.frombuffer(raw, np.uint8)
        yield _batch(total)

    packed = np.zeros((ROWS, (1 << MARK_BITS) // (8 * ROWS)), np.uint8)
    for row in keys.mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary").collect():
        packed[row.block] |= np.frombuffer(row.bits, np.uint8)  # ROWS rows, as long as the table
    return keys.sparkSession.sparkContext.broadcast(packed.reshape(-1))


def maybe(table: Broadcast, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the table; one that is not is surely not."""
    at = _slots(keys)
    return (table.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def marked(docs: DataFrame, keys: DataFrame, keyed: Callable[[pa.RecordBatch], tuple[pa.RecordBatch, np.ndarray]]) -> DataFrame:
    """The rows of docs whose key may be in `keys` (one long column), as batches that keyed() gives with their keys: its
    key column (named as in `keys`) and text."""
    table = marks(keys)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, own = keyed(batch)
            yield batch.filter(pa.array(maybe(table, own)))

    return docs.mapInArrow(pick, f"{keys.columns[0]} long, text string")
