"""Byte-pair merging of many short sequences at once.

The symbols of a batch of pre-tokens are one ragged numpy array. In each round every sequence finds its pair of lowest
rank, all sequences apply theirs at once (non-overlapping, from the left), and the array is compressed; a sequence
without a ranked pair is done. As each merge makes a new symbol, a pair that arises later never has a lower rank, so
the result is that of merging one pair at a time.
"""

from __future__ import annotations

import json

import numpy as np


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs, in an open-addressing table of numpy arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = [x["content"] for x in spec["added_tokens"]]
        end = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[x] for x in byte_letters()], np.int64)
        self.last = np.array([vocab[x + end] for x in byte_letters()], np.int64) if end else None
        self.base = max(vocab.values()) + 1
        merges = [tuple(x.split(" ")) if isinstance(x, str) else x for x in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.none, self.made = len(keys), made
        self.bits = max(4, int(np.ceil(np.log2(8 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]], self.ranks[at[free]] = keys[left[free]], left[free]
            stay = self.keys[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], self.none)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            same = found == key[open_]
            out[open_[same]] = self.ranks[at[same]]
            more = ~same & (found >= 0)
            open_, at = open_[more], at[more]
        return out


def merge_all(table: MergeTable, pieces: list[bytes], with_symbols: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(surviving symbols of all byte sequences in order, number by sequence)."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out, done_at, done_symbols = lengths.copy(), [], []
    live = np.arange(len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    symbols = table.first[raw]
    if table.last is not None:
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = table.last[raw[ends]]
    live, lengths = live[lengths > 0], lengths[lengths > 0]
    while len(live):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        ranks = np.full(len(symbols), table.none, np.int64)
        ranks[:-1] = table.pair_ranks(symbols[:-1], symbols[1:])
        ranks[ends - 1] = table.none
        least = np.minimum.reduceat(ranks, starts)
        done = least == table.none
        if done.any():
            out[live[done]] = lengths[done]
            stay = np.repeat(~done, lengths)
            if with_symbols:
                done_at.append(live[done])
                done_symbols.append(symbols[~stay])
            symbols, ranks = symbols[stay], ranks[stay]
            live, lengths, least = live[~done], lengths[~done], least[~done]
            if not len(live):
                break
        at = np.flatnonzero(ranks == np.repeat(least, lengths))
        run = np.concatenate([[True], np.diff(at) > 1])
        first = np.maximum.accumulate(np.where(run, at, 0))
        at = at[(at - first) % 2 == 0]
        symbols[at] = table.made[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        of = np.repeat(np.arange(len(live)), lengths)
        symbols = symbols[keep]
        lengths = np.bincount(of[keep], minlength=len(live))
    if not with_symbols or not done_at:
        return np.zeros(0, np.int64), out
    starts = np.cumsum(out) - out
    flat = np.empty(int(out.sum()), np.int64)
    for who, own in zip(done_at, done_symbols, strict=True):
        sizes = out[who]
        shift = np.cumsum(sizes) - sizes
        flat[np.repeat(starts[who] - shift, sizes) + np.arange(len(own))] = own
    return flat, out
