"""Ids of texts by a lower-casing word-end BPE vocabulary (word_bpe_49k.json), word by word.

White space separates the vocabulary's pre-tokens and is dropped, special strings have none, and normalisation does not
reach across it: a text's ids are those of its white-space words in order. Arrow cuts texts into words and codes them,
each distinct word is encoded once (by merges.py, or by the library if it has characters whose classes or
normalisation might differ) and kept in a bounded table, and numpy gathers the ids of all texts. So that fewer words
are distinct, A-Z are lower-cased first (not where a special string might be meant, whose case counts) and a full stop
or comma after a letter stands apart, as it does in the pattern.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prospecta.llm.common import strings, words_of
from prospecta.llm.merges import MergeTable, merge_all

#: Fixed value: the pre-token pattern of the vocabulary, for the characters that UNLIKE_PLAIN leaves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
UNLIKE_PLAIN = r"[^\x00-\x1b\x20-\x7e\xc0-\xff]|<\|"
#: Words that a worker keeps.
KEPT = 3 << 18


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.table = MergeTable(path)
        self.find, self.unlike = re.compile(PIECES).findall, re.compile(UNLIKE_PLAIN).search
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        odd = [w for w in words if self.unlike(w)]
        plain = [w for w in words if not self.unlike(w)] if odd else words
        coded = [x.ids for x in self.library.encode_batch_fast(odd, add_special_tokens=False)]
        pieces = [self.find(w.lower()) for w in plain]
        ids, by_piece = merge_all(self.table, [x.encode() for own in pieces for x in own])
        edges = np.concatenate([[0], np.cumsum(by_piece)])[np.cumsum([0, *map(len, pieces)])]
        sizes = np.concatenate([np.fromiter(map(len, coded), np.int64, len(coded)), np.diff(edges)])
        at, to, end = len(self.known), len(self.known) + len(words), self.used + int(sizes.sum())
        while to > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts] * 2), np.concatenate([self.lengths] * 2)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids] * 2)
        self.ids[self.used:end] = np.concatenate([np.fromiter(chain.from_iterable(coded), np.int64), ids])
        self.lengths[at:to] = sizes
        self.starts[at:to] = self.used + np.cumsum(sizes) - sizes
        self.used = end
        self.known.update(zip(odd + plain if odd else plain, range(at, to), strict=True))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, as int32 arrays."""
        if len(self.known) > KEPT:
            self._clear()
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        words, counts, distinct = words_of(pc.replace_substring_regex(texts, r"([a-zß-öø-ÿ])([.,])([ \n])", r"\1 \2\3"))
        distinct = strings(distinct)
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words]
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
