"""Token-id files: ids by frequency rank, in byte-aligned variable-length coding with separate control bytes.

File format (one Parquet row is a block; Parquet only carries the bytes, so any store that Spark writes will do):
file_no, block_no, start_in_file (ids of the file before the block), n_ids, doc_ids (int64, little-endian), doc_lens
(uint32 each), control (2 bits an id, four ids a byte, lowest bits first: bytes of the id's rank less one), data (the
ranks' bytes, little-endian). Ranks are by falling frequency in all documents, ties by id, so common ids take a byte.
The table of ids by rank is one row beside the blocks. Readers decode a block by table lookup: a control byte gives
four lengths, their running sum the offsets.

Each file has a range of doc_id, files and blocks are in ascending order. Encoded ids are written once before the
ranks are counted, so that no text is encoded twice. What reaches the driver is bounded: a count for each id of the
vocabulary and a total for each file.

Defined results: a null or empty text is the end id alone; documents of equal id follow each other in the order of
their ids; null doc_ids come first; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from prospecta.llm.common import docs_only, slices, written
from prospecta.llm.word_encoder import WordEncoder

#: A block is closed at this many ids.
BLOCK_IDS = 1 << 18
NULL_ID = np.iinfo(np.int64).min
BLOCKS = "file_no int, block_no int, start_in_file long, n_ids long, doc_ids binary, doc_lens binary, control binary, data binary"
#: For each control byte, the bytes of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


@dataclass(frozen=True)
class TokenFiles:
    """Written blocks, and the ids by rank (as long as the vocabulary at most)."""

    blocks: DataFrame
    by_rank: np.ndarray


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of an array of ranks below 2 ** 32."""
    ranks = np.asarray(ranks, np.uint32)
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < sizes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of pack()."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id and ids (uint16, or uint32 for larger vocabularies) of every document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        kind, tail = id_type(encoder), np.array([] if end_id is None else [end_id])
        for batch in slices(batches):
            ids = [np.concatenate([x, tail]).astype(kind).tobytes() for x in encoder.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return written(docs_only(docs).mapInArrow(run, "doc_id long, ids binary"), "ids")


def id_type(encoder: WordEncoder) -> str:
    return "<u2" if encoder.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _ids_by_rank(encoded: DataFrame, kind: str) -> np.ndarray:
    """Ids that occur, by falling frequency; the sums are as many as the vocabulary's ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            size = max(len(own), len(total))
            total = np.pad(total, (0, size - len(total))) + np.pad(own, (0, size - len(own)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = rows.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return counts["id"].to_numpy(np.int64)


def write_tokens(docs: DataFrame, path: str, end_id: int | None = None) -> TokenFiles:
    """Encodes every document, appends end_id, and writes the files."""
    kind = id_type(WordEncoder(path))
    encoded = _encoded(docs, path, end_id)
    by_rank = _ids_by_rank(encoded, kind)
    rank_of = np.zeros(1 << 16 if kind == "<u2" else int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, lens, ids, held, start, number, file_no = [], [], [], 0, 0, 0, None

        def closed() -> pa.RecordBatch:
            ranks = rank_of[np.frombuffer(b"".join(ids), kind)]
            control, data = pack(ranks)
            values = [file_no, number, start, len(ranks), np.array(docs_, "<i8").tobytes(), np.array(lens, "<u4").tobytes(), control, data]
            return pa.RecordBatch.from_pylist([dict(zip(_schema.names, values, strict=True))], schema=_schema)

        for batch in batches:
            for doc, raw, file_no in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("file_no").to_pylist(), strict=True):
                docs_.append(NULL_ID if doc is None else doc)
                lens.append(len(raw) // np.dtype(kind).itemsize)
                ids.append(raw)
                held += lens[-1]
                if held >= BLOCK_IDS:
                    yield closed()
                    docs_, lens, ids, held, start, number = [], [], [], 0, start + held, number + 1
        if docs_:
            yield closed()

    _schema = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("start_in_file", pa.int64()), ("n_ids", pa.int64()),
                         ("doc_ids", pa.binary()), ("doc_lens", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ids = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").withColumn("file_no", F.spark_partition_id())
    return TokenFiles(written(sorted_ids.select("doc_id", "ids", "file_no").mapInArrow(blocks, BLOCKS), "tokens"), by_rank)


def read_back(files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (uint32, little-endian) of every document, from the files."""
    by_rank = files.by_rank.astype("<u4")
    totals = files.blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = totals.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("before"))
    placed = files.blocks.join(F.broadcast(before), "file_no").select((F.col("before") + F.col("start_in_file")).alias("at"), "n_ids", "doc_ids", "doc_lens", "control", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[unpack(row["control"], row["data"], row["n_ids"])]
                docs, ends = np.frombuffer(row["doc_ids"], "<i8"), np.cumsum(np.frombuffer(row["doc_lens"], "<u4").astype(np.int64))
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64(), mask=docs == NULL_ID), pa.array(starts + row["at"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], names=["doc_id", "start", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def index_of(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_back() gives."""
    return tokens.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast(T.LongType()).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
