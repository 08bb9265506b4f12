"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

The strings are byte contexts. Their symbols are blocks of BLOCK bytes at every position, so a context is BLOCK phase
strings and a common prefix of DEPTH symbols is a common string of BLOCK * DEPTH bytes. A shard has its suffixes in
order and its transform (each suffix's preceding symbol). Two shards are merged by refining their interleave: in the
order by d symbols, the suffixes' preceding symbols, sorted stably, give the order by d + 1 symbols; only which shard
comes next is moved, neither shard is sorted again. A place where the symbol, or the interval in the round before,
changes is where a common prefix ends; after DEPTH rounds the intervals without such a place are the repeats.
"""

from __future__ import annotations

import numpy as np

BLOCK, DEPTH = 50, 4


def rolling(raw: np.ndarray, span: int) -> np.ndarray:
    """A 64-bit hash of the `span` bytes from each position on (meaningless where fewer are left)."""
    factor, power, done, out = 0x9E3779B97F4A7C15, 1, 0, None
    h = raw.astype(np.uint64) + np.uint64(1)
    while power <= span:
        if span & power:
            if out is None:
                out = h.copy()
            else:
                out[:len(out) - done] = out[:len(out) - done] * np.uint64(pow(factor, power, 1 << 64)) + h[done:]
            done += power
        h[:-power] = h[:-power] * np.uint64(pow(factor, power, 1 << 64)) + h[power:] if len(h) > power else h[:-power]
        power *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def stable_order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of non-negative integers, 16 bits at a time, as numpy sorts those by counting."""
    order, most = None, int(values.max(initial=0))
    while order is None or most:
        part = values.astype(np.uint16) if order is None else values[order].astype(np.uint16)
        by = np.argsort(part, kind="stable")
        order = by if order is None else order[by]
        values, most = values >> values.dtype.type(16), most >> 16
    return order


def symbols_of(hashes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Symbols from 1 for hashes that occur more than once; 0 for the others, which no repeat can hold."""
    at = np.flatnonzero(valid)
    order = at[stable_order(hashes[at])]
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    out = np.zeros(len(hashes), np.uint32)
    out[order] = np.repeat(np.where(sizes > 1, np.cumsum(sizes > 1), 0), sizes)
    return out


def runs(symbols: np.ndarray) -> np.ndarray:
    """How many symbols, up to DEPTH, follow each other from each position on before one is 0."""
    out = (symbols > 0).astype(np.uint8)
    some = out.copy()
    for _ in range(DEPTH - 1):
        out[:-BLOCK] = some[:-BLOCK] * (1 + out[BLOCK:])
    return np.minimum(out, DEPTH)


def needed(run: np.ndarray) -> np.ndarray:
    """Marks the suffixes that a string of DEPTH symbols goes through, its end included; no other can be in a repeat."""
    whole = run >= DEPTH
    out = whole.copy()
    for step in range(BLOCK, BLOCK * DEPTH + 1, BLOCK):
        out[step:] |= whole[:-step] if step < len(whole) else False
    return out


class Shard:
    """Suffixes of some contexts, in the order of their first DEPTH symbols; those without a symbol come first."""

    def __init__(self, symbols: np.ndarray, run: np.ndarray, suffixes: np.ndarray) -> None:
        """symbols: of every position, as symbols_of() has them; a suffix is read up to its first 0 (run: its length)."""
        order, own = np.arange(len(suffixes)), run[suffixes]
        for step in range(DEPTH - 1, -1, -1):  # from the last symbol to the first, stably
            at = np.where(own > step, suffixes + step * BLOCK, 0)
            values = np.where(own > step, symbols[at], 0)
            order = order[stable_order(values[order])]
        self.suffixes = suffixes[order]
        self.empty = int((symbols[self.suffixes] == 0).sum())


def merge(symbols: np.ndarray, starts: np.ndarray, left: Shard, right: Shard) -> tuple[Shard, np.ndarray]:
    """(the shards as one, the interval number of each of its suffixes). starts: where each position's context begins."""
    n = len(left.suffixes) + len(right.suffixes)
    which = np.zeros(n, bool)
    which[len(left.suffixes):] = True
    interval = np.zeros(n, np.int64)
    suffixes = np.empty(n, np.int64)
    head = np.concatenate([np.zeros(left.empty, bool), np.ones(right.empty, bool)])
    for _ in range(DEPTH):
        suffixes[~which], suffixes[which] = left.suffixes, right.suffixes
        before = suffixes - BLOCK
        has = np.flatnonzero(before >= starts[suffixes])
        preceding = symbols[before[has]]
        has, preceding = has[preceding > 0], preceding[preceding > 0]
        order = stable_order(preceding)
        preceding, own = preceding[order], interval[has][order]
        new = np.ones(len(order), bool)
        new[1:] = (preceding[1:] != preceding[:-1]) | (own[1:] != own[:-1])
        which = np.concatenate([head, which[has][order]])
        interval = np.concatenate([np.zeros(len(head), np.int64), np.cumsum(new)])
    suffixes[~which], suffixes[which] = left.suffixes, right.suffixes
    out = object.__new__(Shard)
    out.suffixes, out.empty = suffixes, left.empty + right.empty
    return out, interval


def repeats(contexts: list[bytes], keys: np.ndarray, shards: np.ndarray) -> list[np.ndarray]:
    """For each context, the positions in it from which BLOCK * DEPTH bytes also start at a place of another key.

    keys: for each context, the key of its first byte; the key of a later byte is as much larger. shards: for each
    context, the shard that it comes from (0 or more); shards are sorted each and merged one after another.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1  # the end is a suffix too
    first = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    starts, of = np.repeat(first, sizes), np.repeat(np.arange(len(contexts)), sizes)
    left = np.repeat(first + sizes - 1, sizes) - np.arange(len(raw))
    symbols = symbols_of(rolling(raw, BLOCK), left >= BLOCK)
    run = runs(symbols)
    suffixes = np.flatnonzero(needed(run))
    if not len(suffixes):
        return [np.zeros(0, np.int64)] * len(contexts)
    merged, interval, shard_of = None, None, shards[of[suffixes]]
    for shard in np.unique(shard_of):
        own = Shard(symbols, run, suffixes[shard_of == shard])
        if merged is None:
            merged, interval = own, None
        else:
            merged, interval = merge(symbols, starts, merged, own)
    if interval is None:  # one shard: an empty one beside it gives the intervals
        merged, interval = merge(symbols, starts, merged, Shard(symbols, run, np.zeros(0, np.int64)))
    places = keys[of[merged.suffixes]] + merged.suffixes - starts[merged.suffixes]
    bounds = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    lengths = np.diff(np.append(bounds, len(interval)))
    several = np.repeat(np.minimum.reduceat(places, bounds) != np.maximum.reduceat(places, bounds), lengths)
    hits = merged.suffixes[several & (run[merged.suffixes] >= DEPTH)]
    hits = np.sort(hits)
    return [x - at for x, at in zip(np.split(hits, np.searchsorted(hits, first[1:])), first, strict=True)]
