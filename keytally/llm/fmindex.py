"""An FM-index over word numbers, in numpy: wavelet-tree ranks and sampled positions.

The sequence holds symbols from 1 up and 0 between stretches; no phrase holds a 0. Suffixes are
sorted by their symbols up to the next 0, equal ones by place, which is all that backward search and walking
back within a stretch need.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(seq: np.ndarray, symbols: int) -> np.ndarray:
    """The places of ``seq`` (which ends in 0) in the order of their suffixes.

    The first key packs as many symbols as fit; then keys are doubled for places that still tie.
    """
    n = len(seq)
    width = max(1, int(symbols - 1).bit_length())
    depth = max(1, min(62 // width, n))
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)  # no 0 so far
    for k in range(depth):
        part = np.zeros(n, np.int64)
        part[: n - k] = seq[k:]
        part[~open_] = 0
        key = (key << width) | part
        open_ &= part != 0
    order = np.argsort(key, kind="stable")
    sorted_key, tied = key[order], open_[order]
    # places with a 0 in their key are settled by place; the others may share a rank
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~tied[1:]
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    sizes = np.diff(np.append(starts, n))
    groups = sizes > 1
    while groups.any():
        lo, count = starts[groups], sizes[groups]
        rows = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        places = order[rows]
        group = np.repeat(lo, count)
        # a tied suffix has no 0 within the depth, so the place after it is within the sequence
        after = rank[places + depth]
        by = np.lexsort((places, after, group))
        places, after, group = places[by], after[by], group[by]
        order[rows] = places
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        heads = np.flatnonzero(fresh)
        starts = rows[heads]
        sizes = np.diff(np.append(heads, len(rows)))
        rank[places] = np.repeat(starts, sizes)
        groups = sizes > 1
        depth *= 2
    return order


class WaveletTree:
    """Access and rank over numbers below ``symbols``, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.width = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for bit in range(self.width - 1, -1, -1):
            ones = ((values >> bit) & 1).astype(np.int32)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append(before)
            self.zeros.append(len(values) - int(before[-1]))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol stands before ``at``; ``start`` is ``starts`` of the symbol."""
        for level, (before, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.width - 1 - level)) & 1
            ones = before[at]
            at = np.where(one == 1, zeros + ones, at - ones)
        return at - start

    def starts(self, symbols: int) -> np.ndarray:
        """Where each symbol's run begins on the last level."""
        symbol, at = np.arange(symbols), np.zeros(symbols, np.int64)
        return self.rank(symbol, at, np.zeros(symbols, np.int64))

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and where the places lead on the last level."""
        symbol = np.zeros(len(at), np.int64)
        for before, zeros in zip(self.levels, self.zeros):
            ones = before[at]
            one = before[at + 1] - ones
            symbol = symbol * 2 + one
            at = np.where(one == 1, zeros + ones, at - ones)
        return symbol, at


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        order = suffix_order(seq, symbols)
        self.n = len(seq)
        last = seq[order - 1]
        last[order == 0] = 0
        self.tree = WaveletTree(last, symbols)
        self.runs = self.tree.starts(symbols)
        counts = np.bincount(seq, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        # every SAMPLE-th place and the first of each stretch, which a walk back never leaves
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = np.zeros(self.n + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.places = order[kept]

    def ranges(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase (rows of symbols, right-aligned)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.flatnonzero((sizes > step) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, width - 1 - step]
            run = self.runs[c]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live], run)
            hi[live] = self.first[c] + self.tree.rank(c, hi[live], run)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes in ``rows``, walking back to the next sampled one."""
        out, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, live = rows.copy(), np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.kept[here + 1] > self.kept[here]
            stop = live[done]
            out[stop] = self.places[self.kept[at[stop]]] + walked[stop]
            live = live[~done]
            symbol, to = self.tree.access(at[live])
            at[live] = self.first[symbol] + to - self.runs[symbol]
            walked[live] += 1
        return out
