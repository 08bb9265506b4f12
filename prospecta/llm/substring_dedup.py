"""Suffix-array dedup: removal of every byte inside a string of SPAN bytes that starts anywhere else.

1. Each text is cut by a window minimum over hashes of ANCHOR bytes, so that every string of SPAN bytes holds an anchor,
   chosen by its own bytes alone. Anchors are grouped by hash; an anchor alone in its group shows that no string around
   it repeats, and one whose whole surroundings (all strings of SPAN bytes that hold it) also occur elsewhere, that all
   of them do. Both need no more than hashes.
2. What is left are surroundings that share an anchor with others but differ somewhere. Their bytes are fetched, one for
   each distinct surroundings; the anchors' groups are dealt to tasks. There, what the strings of CELL neighbouring starts
   have in common must occur twice, else none of them repeats; the surroundings that remain are shards whose
   Burrows-Wheeler transforms are merged by interleave refinement (bwt.py): intervals with a common prefix of SPAN bytes
   are the repeats. Suffixes of different anchors' groups need no comparison, so nothing larger is ever sorted.
3. Where one cell's strings are more than a merge holds, they are hashed (128 bits) and counted in the task instead;
   anchors of more than LARGE distinct surroundings would be too much for a task, and their strings are hashed and counted
   over all tasks.
4. Spans are united for each text and cut.

Equal texts are one text with a number; if it has SPAN bytes or more, all of its rows are removed whole.

Defined results: a null or empty text has no bytes and nothing removed; texts below SPAN bytes are kept; repeated rows
are copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm import bwt
from prospecta.llm.common import docs_only, slices, written
from prospecta.llm.marks import marked

SPAN = bwt.BLOCK * bwt.DEPTH
ANCHOR = 100
WINDOW = SPAN - ANCHOR + 1
#: Distinct surroundings of one anchor beyond which step 3 is taken, and bytes of surroundings that a merge holds.
LARGE, MERGE_BYTES = 50_000, 1 << 19
#: Starts whose common bytes must occur twice before their strings are merged.
CELL = 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[:len(values) - (width - step)], values[width - step:]) if step < width else values


def anchors(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of anchors in joined texts."""
    if len(raw) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = bwt.rolling(raw, ANCHOR)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(raw))
    hashes[left < ANCHOR] = NONE
    least = _slide(hashes, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == hashes) & (hashes != NONE))
    return at, hashes[at]


def _texts(docs: DataFrame) -> DataFrame:
    """Written doc_id, n_bytes, digest (128 bits), key (64 bits) and sha256 of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in texts], pa.binary()),
                pa.array(list(map(_key, texts)), pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
            ], names=["doc_id", "n_bytes", "digest", "key", "sha"])

    return written(docs.mapInArrow(run, "doc_id long, n_bytes long, digest binary, key long, sha binary"), "texts")


def _anchors(docs: DataFrame) -> DataFrame:
    """anchor, around (hash of its surroundings), key and pos of every anchor; a task reads equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 2 << 20):
            texts = [x for x in batch.column("text").cast(pa.binary()).to_pylist() if len(x) >= SPAN]
            keys = list(map(_key, texts))
            new = [i for i, x in enumerate(keys) if x not in seen]
            if len(seen) < 1 << 19:
                seen.update(keys)
            texts, keys = [texts[i] for i in new], [keys[i] for i in new]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            raw = b"".join(texts)
            at, hashes = anchors(np.frombuffer(raw, np.uint8), sizes)
            ends = np.cumsum(sizes)
            of = np.searchsorted(ends, at, side="right")
            begin, end = (ends - sizes)[of], ends[of]
            low, high = np.maximum(begin, at - WINDOW + 1), np.minimum(end, at + SPAN)
            whole, digest = memoryview(raw), xxhash.xxh3_64_intdigest
            around = np.fromiter((digest(whole[a:b], c) for a, b, c in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)), np.uint64, len(at))
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes.view(np.int64)), pa.array(around.view(np.int64)), pa.array(np.array(keys, np.int64)[of] if len(of) else np.zeros(0, np.int64)),
                pa.array((at - begin).astype(np.int32))], names=["anchor", "around", "key", "pos"])

    return docs.mapInArrow(run, "anchor long, around long, key long, pos int")


def _surroundings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """anchor, key, pos, low (of the bytes in the text), bytes and large for the asked anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {x: [] for x in ("anchor", "key", "pos", "low", "bytes", "large")}
            for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                for x in wanted:
                    low = max(0, x["pos"] - WINDOW + 1)
                    for name, value in zip(out, (x["anchor"], key, x["pos"], low, raw[low:x["pos"] + SPAN], x["large"]), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("low", pa.int32()), ("bytes", pa.binary()), ("large", pa.bool_())]))

    by_text = asked.groupBy("key").agg(F.collect_list(F.struct("anchor", "pos", "large")).alias("wanted"))  # a text's anchors
    texts = marked(docs, by_text.select("key"), _with_key)
    return texts.join(by_text, "key").select("key", "text", "wanted").mapInArrow(run, "anchor long, key long, pos int, low int, bytes binary, large boolean")


def _with_key(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    keys = np.fromiter(map(_key, batch.column("text").cast(pa.binary()).to_pylist()), np.int64, batch.num_rows)
    return pa.RecordBatch.from_arrays([pa.array(keys), batch.column("text")], names=["key", "text"]), keys


def _cells(raw: bytes, at: int) -> Iterator[tuple[int, int, int]]:
    """(first, last start, hash of what all their strings hold) for each CELL starts up to the anchor at `at`."""
    for last in range(at, max(-1, at - WINDOW), -CELL):
        stop = last - CELL + 1 + SPAN
        if last + SPAN - CELL + 1 <= len(raw):
            yield max(0, last - CELL + 1), last, xxhash.xxh3_64_intdigest(memoryview(raw)[last:stop], at - last)


def _narrowed(held: list[tuple]) -> tuple[list[list[tuple[int, int, bytes]]], list[tuple[int, int]]]:
    """(blocks of (key, low, bytes) to merge, (key, start) of repeats found on the way) of surroundings held by a task.

    Starts whose cell shows no repeat are left out. If one anchor's surroundings are more than a merge holds, each cell's
    strings are a block of their own, and those of a cell that is still too large are counted by 128-bit hash.
    """
    cells: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i, (anchor, _, pos, low, raw) in enumerate(held):
        for a, b, h in _cells(raw, pos - low):
            cells.setdefault((anchor, h), []).append((i, a, b))
    several = [x for x in cells.values() if len({(held[i][1], held[i][3] + b) for i, _, b in x}) > 1]
    if sum(len(x[4]) for x in held) <= 2 * MERGE_BYTES:
        reach: dict[int, tuple[int, int]] = {}
        for own in several:
            for i, a, b in own:
                low, high = reach.get(i, (a, b))
                reach[i] = min(low, a), max(high, b)
        return [[(held[i][1], held[i][3] + a, held[i][4][a:b + SPAN]) for i, (a, b) in reach.items()]], []
    blocks, size, found = [[]], 0, []
    for own in several:
        if len(own) * (SPAN + CELL) > MERGE_BYTES:
            at: dict[bytes, list[tuple[int, int]]] = {}
            for i, a, b in own:
                for j in range(a, b + 1):
                    if len(string := held[i][4][j:j + SPAN]) == SPAN:
                        at.setdefault(xxhash.xxh3_128_digest(string), []).append((held[i][1], held[i][3] + j))
            found += [place for places in at.values() if len(set(places)) > 1 for place in places]
            continue
        if size > MERGE_BYTES:
            blocks.append([])
            size = 0
        blocks[-1] += [(held[i][1], held[i][3] + a, held[i][4][a:b + SPAN]) for i, a, b in own]
        size += len(own) * (SPAN + CELL)
    return blocks, found


def _merged(contexts: DataFrame) -> DataFrame:
    """key, start and stop of repeats that the merged transforms of each anchor's surroundings show."""
    names = ["key", "start", "stop"]

    def spans(held: list[tuple]) -> pa.RecordBatch:
        blocks, found = _narrowed(held)
        key, start, stop = [x for x, _ in found], [x for _, x in found], [x + SPAN for _, x in found]
        for block in filter(None, blocks):
            # The key of a place: which text, and where in it.
            _, text = np.unique(np.array([x[0] for x in block], np.int64), return_inverse=True)
            places = text.astype(np.int64) * (1 << 32) + np.array([x[1] for x in block], np.int64)
            for (own, low, _), at in zip(block, bwt.repeats([x[2] for x in block], places, text % 2), strict=True):
                if len(at):
                    edge = np.flatnonzero(np.diff(at) > 1)
                    begin, end = at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])]
                    key += [own] * len(begin)
                    start += (begin + low).tolist()
                    stop += (end + low + SPAN).tolist()
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "key", "pos", "low", "bytes")), strict=True):
                if size > MERGE_BYTES and row[0] != last:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield spans(held)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "key", "pos", "low", "bytes").mapInArrow(run, "key long, start int, stop int")


def _counted(contexts: DataFrame) -> DataFrame:
    """The same for anchors of very many surroundings: their strings are counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [(xxhash.xxh3_128_digest(raw[j:j + SPAN]), key, low + j) for key, low, raw in zip(*(part.column(x).to_pylist() for x in ("key", "low", "bytes")), strict=True) for j in range(len(raw) - SPAN + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int32())], names=["string", "key", "start"])

    rows = contexts.select("key", "low", "bytes").mapInArrow(run, "string binary, key long, start int")
    many = rows.distinct().groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(written(many.select("string"), "strings"), "string").select("key", "start", (F.col("start") + SPAN).alias("stop"))


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """digest, n_removed, n_spans and sha of each text with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {x: [] for x in ("digest", "n_removed", "n_spans", "cut_sha")}
            for text, starts, stops in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True):
                raw = text.encode()
                change = np.bincount(starts, minlength=len(raw) + 1) - np.bincount(np.minimum(stops, len(raw)), minlength=len(raw) + 1)
                inside = np.cumsum(change[:len(raw)]) > 0
                kept = np.frombuffer(raw, np.uint8)[~inside].tobytes()
                runs = int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum())
                for name, value in zip(out, (xxhash.xxh3_128_digest(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).digest()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("cut_sha", pa.binary())]))

    by_text = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))  # a text's spans
    texts = marked(docs, by_text.select("key"), _with_key)
    return texts.join(by_text, "key").select("text", "starts", "stops").mapInArrow(run, "digest binary, n_removed long, n_spans long, cut_sha binary")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs = docs_only(docs)
    texts = _texts(docs)
    copies = texts.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("copies"))
    by_anchor, by_both = Window.partitionBy("anchor"), Window.partitionBy("anchor", "around")
    rows = _anchors(docs).repartition("anchor")
    rows = rows.withColumn("nth", F.row_number().over(by_both.orderBy("key", "pos"))).withColumn("alike", F.count(F.lit(1)).over(by_both))
    rows = rows.withColumn("kinds", F.count(F.when(F.col("nth") == 1, 1)).over(by_anchor)).filter("alike > 1 or kinds > 1")
    rows = written(rows.select("anchor", "key", "pos", "nth", "alike", "kinds"), "anchors")
    whole = rows.filter("alike > 1").select("key", F.greatest(F.lit(0), F.col("pos") - (WINDOW - 1)).alias("start"), (F.col("pos") + SPAN).alias("stop"))
    asked = rows.filter("nth = 1 and kinds > 1").select("anchor", "key", "pos", (F.col("kinds") > LARGE).alias("large"))
    contexts = _surroundings(docs, asked)
    if not rows.filter(F.col("kinds") > LARGE).isEmpty():
        contexts = written(contexts, "contexts")
        found = _merged(contexts.filter("not large")).unionAll(_counted(contexts.filter("large")))
    else:
        found = _merged(contexts)
    single = copies.filter("copies = 1").select("key")  # copies go whole, so their spans are not needed
    found = written(found, "repeats")  # read twice below
    spans = whole.unionAll(found).join(single, "key", "left_semi")
    cut = written(_cut(docs, spans), "cut")
    counts = written(copies.select("digest", "copies"), "copies")
    all_rows = texts.join(counts, "digest").join(cut, "digest", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)
    return all_rows.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex(F.coalesce("cut_sha", "sha")))).alias("kept_sha256"))
