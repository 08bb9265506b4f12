"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols, merged as merges.py has it: each sequence's pair
of lowest rank is applied in all sequences at once, until none has a ranked pair, and the surviving symbols are
counted. Arrow cuts texts at single spaces (and at JOIN, put around line ends and before a full stop or comma), so that
the pattern runs over distinct pieces alone; this holds where runs of white space end within a piece, other texts are
matched whole. Counts of pieces seen before are kept in a bounded table.

Handles vocabulary files of kind byte-level BPE without normaliser (byte_bpe_50k.json): special strings inside a text
count as one token each, as by the library's default.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; an empty table gives
an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from prospecta.llm.common import docs_only, slices, strings
from prospecta.llm.merges import MergeTable, merge_all

#: Fixed value: the byte-level pre-token pattern of the vocabulary's kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of the characters in PLAIN, where the standard library's classes agree with those above.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNLIKE_PLAIN = r"[^\x00-\x1b\x20-\x7e\xc0-\xff]"
#: Begins a piece that has no space before it.
JOIN = "\x01"
#: Pieces whose counts a worker keeps.
KEPT = 3 << 18
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str) -> None:
        self.table = MergeTable(path)
        self.special = re.compile("|".join(map(re.escape, sorted(self.table.specials, key=len, reverse=True))) or r"(?!)")
        self.full, self.plain, self.unlike = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall, re.compile(UNLIKE_PLAIN).search
        self.whole = re.compile(r"\s (?:\s|\Z)|<\||\x01").search
        self.known: dict[str, int] = {}

    def _count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece, special strings included."""
        tokens, extra = [], []
        for piece in pieces:
            find = self.full if self.unlike(piece) else self.plain
            parts = self.special.split(piece) if "<|" in piece else [piece]
            extra.append(len(parts) - 1)
            tokens.append(find(piece) if len(parts) == 1 else list(chain.from_iterable(map(find, parts))))
        distinct = list(set().union(*tokens))
        own = dict(zip(distinct, merge_all(self.table, [x.encode() for x in distinct], with_symbols=False)[1].tolist(), strict=True))
        return [n + sum(map(own.__getitem__, x)) for n, x in zip(extra, tokens, strict=True)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        if len(self.known) > KEPT:
            self.known = {}
        whole = [i for i, text in enumerate(strings(texts)) if self.whole(text)]
        rest = np.ones(len(texts), bool)
        rest[whole] = False
        out = np.zeros(len(texts), np.int64)
        out[whole] = self._count(strings(texts.take(pa.array(whole, pa.int64()))))
        texts = pc.replace_substring_regex(texts.filter(pa.array(rest)), r"([a-zA-Zß-öø-ÿ])([.,])([ \n])", rf"\1 {JOIN}\2\3")
        texts = pc.replace_substring_regex(texts, r"([!-~À-ÖØ-öø-ÿ])\n([!-~À-ÖØ-öø-ÿ])", "\\1 " + JOIN + "\n " + JOIN + "\\2")
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        sizes = np.asarray(pc.list_value_length(split)).astype(np.int64)
        pieces = split.flatten()
        first = np.zeros(len(pieces), bool)
        first[np.cumsum(sizes) - sizes] = True
        coded = pieces.dictionary_encode()
        distinct = strings(coded.dictionary)
        new = [x for x in distinct if x not in self.known]
        self.known.update(zip(new, self._count([x[1:] if x.startswith(JOIN) else " " + x for x in new]), strict=True))
        by_piece = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        by_piece[first] = self._count(strings(pieces.filter(pa.array(first))))  # no space before these
        out[rest] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=by_piece, minlength=len(sizes)).astype(np.int64)
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in slices(batches):
            tokens = counter.counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs_only(docs).mapInArrow(count, SCHEMA)
