"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts each text into chunks where its low bits are zero, so texts that share a
passage share its chunks wherever it stands. A worker encodes each distinct chunk once and keeps its ids in a bounded
table. A chunk's border may divide a word: each join is repaired by encoding the window between the nearest white
space on both sides anew; the ids at the chunks' edges must agree exactly with those of the window's parts, else the
window is widened, in the end to the whole text. White space ends every pre-token of the vocabulary and is dropped,
special strings have none, so ids on both sides of the window are final.

The chunk table is a worker's own: to share chunks across workers, either the texts or the ids of shared chunks
would have to be shuffled, which costs more than encoding.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded each; an
empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from prospecta.llm.common import docs_only, slices
from prospecta.llm.word_encoder import WordEncoder

#: A chunk has 2 ** CUT_BITS bytes on average; a worker keeps the ids of chunks of so many bytes.
CUT_BITS, KEPT_BYTES = 10, 32 << 20
#: Texts of up to this many bytes are one chunk, and no chunk is shorter.
LEAST_CHUNK = 256
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cuts(raw: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Positions in UTF-8 bytes where a rolling hash of the 16 bytes before ends in zeros and a character begins."""
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    h, span, factor = raw.astype(np.uint32) + np.uint32(1), 1, 0x01000193
    while span < 16:
        older = np.concatenate([np.zeros(min(span, len(h)), np.uint32), h[:-span]])
        h = h + older * np.uint32(pow(factor, span, 1 << 32))
        span *= 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    at = at[at < len(raw)]
    return at[(raw[at] & 0xC0) != 0x80]


class ChunkEncoder:
    """Encodes texts chunk by chunk."""

    def __init__(self, path: str, bits: int = CUT_BITS, least: int = LEAST_CHUNK) -> None:
        self.words, self.bits, self.least = WordEncoder(path), bits, least
        self.chunks: dict[bytes, np.ndarray] = {}
        self.held = self.asked = self.reused = 0

    def _edges(self, text: bytes, found: list[int]) -> list[int]:
        edges = [0]
        for at in found:
            if at - edges[-1] >= self.least and len(text) - at >= self.least:
                edges.append(at)
        return [*edges, len(text)]

    def _windows(self, text: bytes, spaces: np.ndarray, edges: list[int]) -> list[tuple[int, int]]:
        """For each inner edge, what lies between the nearest white space before and after it."""
        inner = np.array(edges[1:-1], np.int64)
        k = np.searchsorted(spaces, inner)
        left = np.where(k > 0, spaces[np.maximum(k - 1, 0)] + 1, 0) if len(spaces) else np.zeros(len(inner), np.int64)
        right = np.where(k < len(spaces), spaces[np.minimum(k, len(spaces) - 1)], len(text)) if len(spaces) else np.full(len(inner), len(text))
        out: list[tuple[int, int]] = []
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            if not out or out[-1] != (a, b):
                out.append((a, b))
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        at = cuts(raw, self.bits)
        spaces = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
        by_cut, by_space = np.searchsorted(at, ends), np.searchsorted(spaces, ends)
        plans, wanted = [], {}
        for i, text in enumerate(texts):
            edges = self._edges(text, (at[by_cut[i]:by_cut[i + 1]] - ends[i]).tolist()) if len(text) > 2 * self.least else [0, len(text)]
            windows = self._windows(text, spaces[by_space[i]:by_space[i + 1]] - ends[i], edges) if len(edges) > 2 else []
            steps, w = [], 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                head = next((r for left, r in reversed(windows[:w]) if left <= a < r), a)
                if head >= b and windows:
                    continue  # a window holds the whole chunk
                tail, window = b, None
                if w < len(windows) and windows[w][0] <= b <= windows[w][1] and b != len(text):
                    tail, window = max(windows[w][0], a), windows[w]
                    w += 1
                chunk, parts = text[a:b], (text[a:head], text[tail:b])
                steps.append((chunk, *parts, text[slice(*window)] if window else b""))
                wanted.update(dict.fromkeys((chunk, *steps[-1][1:])))
            plans.append(steps)
        new = [x for x in wanted if x not in self.chunks]
        self.asked, self.reused = self.asked + len(wanted), self.reused + len(wanted) - len(new)
        if self.held > KEPT_BYTES:
            self.chunks, self.held, new = {}, 0, list(wanted)
        for x, ids in zip(new, self.words.encode(pa.array(new, pa.binary()).cast(pa.string())), strict=True):
            self.chunks[x] = ids.copy()
            self.held += len(x) + 4 * len(ids) + 200
        return [self._joined(text, steps) for text, steps in zip(texts, plans, strict=True)]

    def _joined(self, text: bytes, steps: list[tuple[bytes, bytes, bytes, bytes]]) -> np.ndarray:
        if len(steps) == 1 and not steps[0][3]:
            return self.chunks[steps[0][0]]
        out = []
        for chunk, head, tail, window in steps:
            ids, first, last = self.chunks[chunk], self.chunks[head], self.chunks[tail]
            if len(first) + len(last) > len(ids) or not (np.array_equal(ids[:len(first)], first) and np.array_equal(ids[len(ids) - len(last):], last)):
                return self.words.encode(pa.array([text.decode()]))[0]
            out += [ids[len(first):len(ids) - len(last)], self.chunks[window]]
        return np.concatenate(out) if out else np.zeros(0, np.int32)


class Names:
    """The strings of ids; the vocabulary has no decoder, so decoding joins them with spaces."""

    def __init__(self, encoder: WordEncoder) -> None:
        self.of = [encoder.library.id_to_token(i) for i in range(encoder.library.get_vocab_size(with_added_tokens=True))]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.of.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array<int> of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in slices(batches):
            ids = encoder.encode([x.encode() for x in batch.column("text").to_pylist()])
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return docs_only(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the library decodes from `ids`, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(WordEncoder(path))
        for batch in batches:
            texts = [names.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """n_tokens and the digests of ids and decoded text of every document, in one pass; the ids too, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        names = Names(encoder.words)
        for batch in slices(batches):
            all_ids = encoder.encode(pc.cast(batch.column("text"), pa.binary()).to_pylist())
            lengths = list(map(len, all_ids))
            out = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(lengths, pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in all_ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(names.decode(ids).encode()).hexdigest() for ids in all_ids], pa.string()),
            }
            if with_ids:
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids]), pa.int32())
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), flat)
            yield pa.RecordBatch.from_pydict(out)

    return docs_only(docs).mapInArrow(run, DIGESTS + ", ids array<int>" * with_ids)
