"""Quality rules by suffix-array repetition.

The words of each whole text are its symbols. A suffix array over the words of a batch of documents is built by
prefix doubling in numpy, with the document in the first key, so that no repeat crosses documents; common prefixes
of neighbours come from the saved doubling ranks by binary lifting. A word's longest repeated prefix is the larger
common prefix with its two neighbours; the intervals of those of at least `min_words` words are the maximal repeated
substrings. Their spans are united; the covered fraction and the longest repeat are limited.

Defined results: a null or empty text has no words and fails the base rule (n_words < 50); repeated rows are judged
each on its own; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prospecta.llm.common import docs_only, slices, words_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The verdict of the method: repeats of this many words count; at most this share of the words may be in them, and
#: the longest may not exceed this share of the document.
MIN_WORDS, MAX_COVERED, MAX_LONGEST = 10, 0.4, 0.25
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_covered_words long, longest_repeat long, kept boolean"
)


def longest_repeated_prefixes(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each symbol, the length of the longest prefix of its suffix that starts anywhere else in its document."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = np.sort(order[np.repeat(size > 1, size)])
    while len(active):
        after = active + h
        inside = after < end[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        group, sorted_key = rank[active][by], key[by]
        at = np.arange(len(by))
        old = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = rank.copy()
        rank[active[by]] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(by)))
        active = np.sort(active[by][np.repeat(size > 1, size)])
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    i, j = suffixes[:-1], suffixes[1:]
    at = np.flatnonzero(levels[0][i] == levels[0][j])
    i, j = i[at].copy(), j[at].copy()
    shared = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (i < n) & (j < n)
        same[same] = levels[k][i[same]] == levels[k][j[same]]
        shared[same] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, suffixes[:-1][at], shared)
    np.maximum.at(out, suffixes[1:][at], shared)
    return out


def covered(prefixes: np.ndarray, least: int) -> np.ndarray:
    """Marks the symbols inside a repeat of at least `least` symbols."""
    n = len(prefixes)
    starts = np.flatnonzero(prefixes >= least)
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + prefixes[starts], minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _judge(batch: pa.RecordBatch, min_words: int, max_covered: float, max_longest: float) -> pa.RecordBatch:
    column = batch.column("text")
    texts = column.to_pylist()
    codes, counts, _ = words_of(column)
    prefixes = longest_repeated_prefixes(codes, counts)
    edges = np.concatenate([[0], np.cumsum(counts)])

    def by_doc(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[edges])

    n_repeat, n_covered = by_doc(covered(prefixes, 3)), by_doc(covered(prefixes, min_words))
    longest = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        longest[some] = np.maximum.reduceat(prefixes, edges[:-1][some])
    dup = []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        dup.append(len(lines) - len(set(lines)))
    failed = (counts < 50) | (100 * n_repeat > 50 * counts)
    kept = ~failed & (n_covered <= max_covered * counts) & (longest <= max_longest * counts)
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(counts.astype(np.int64)),
        pa.array([len(x) - sum(map(x.count, SPACES)) for x in texts], pa.int64()),
        pa.array([sum(map(x.count, SYMBOLS)) for x in texts], pa.int64()),
        pa.array(dup, pa.int64()), pa.array(n_repeat), pa.array(failed), pa.array(n_covered), pa.array(longest), pa.array(kept),
    ], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_covered_words", "longest_repeat", "kept"])


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """One row per document: the counts of the base rule, the repetition figures and the verdict `kept`."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _judge(batch, min_words, max_covered, max_longest)

    return docs_only(docs).mapInArrow(judge, SCHEMA)


def kept_documents(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """The rows of docs, all columns as they are, that the rules keep; nothing is shuffled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text").fill_null("")
            judged = _judge(pa.RecordBatch.from_arrays([batch.column("doc_id"), text], names=["doc_id", "text"]), min_words, max_covered, max_longest)
            yield batch.filter(judged.column("kept"))

    return docs.mapInArrow(keep, docs.schema)
