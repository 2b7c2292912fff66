"""A double-array trie over number sequences, and all text positions advanced in it at once.

A word number is written in ``symbols`` digits of six bits, so a node has at most 64 children. Node ``s`` is a slot; its child by
digit d is slot ``base[s] + d`` if ``check`` of that slot is ``s``. Nodes of many children get 64 slots of their
own; those of few are thrown at random into a shared area, all at once, and those that met try again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIGIT_BITS = 6
FAN = 1 << DIGIT_BITS
#: From this many children on a node has its own slots.
CROWDED = 16
#: Share of the common area that is filled.
LOAD = 0.6


@dataclass
class Trie:
    base: np.ndarray
    check: np.ndarray
    #: number of the phrase that ends at a slot, or -1
    phrase: np.ndarray
    symbols: int

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, state): the positions that go on by their codes, and the states they reach."""
        which = np.arange(len(state))
        for j in reversed(range(self.symbols)):
            to = self.base[state] + ((code >> (DIGIT_BITS * j)) & (FAN - 1))
            on = self.check[to] == state
            which, state, code = which[on], to[on], code[on]
        return which, state


def _nodes(codes: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, digit) of the nodes 1, 2 .. and the node that each row ends at; 0 is the root.

    ``codes`` has a row per phrase in lexicographic order, 0 after its end.
    """
    rows, width = codes.shape
    digits = np.empty((rows, width * symbols), np.int8)
    for w in range(width):
        for j in range(symbols):
            digit = (codes[:, w] >> (DIGIT_BITS * (symbols - 1 - j))) & (FAN - 1)
            digits[:, w * symbols + j] = np.where(codes[:, w] > 0, digit, -1)
    length = (codes > 0).sum(axis=1) * symbols
    same = np.zeros(rows, np.int64)  # leading digits shared with the row before
    if rows > 1:
        differs = digits[1:] != digits[:-1]
        same[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width * symbols)
    end = np.zeros(rows, np.int64)
    above = np.zeros(rows, np.int64)
    parents, symbols_in, made = [], [], 1
    for depth in range(1, width * symbols + 1):
        alive = length >= depth
        new = alive & (same < depth)
        here = made - 1 + np.cumsum(new)
        parents.append(above[new].astype(np.int32))
        symbols_in.append(digits[new, depth - 1])
        above = np.where(alive, here, above)
        end = np.where(length == depth, here, end)
        made += int(new.sum())
    return np.concatenate(parents), np.concatenate(symbols_in), end


def _place(count: np.ndarray, start: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, int]:
    """The base of each parent, whose children are ``digit[start : start + count]``, and the slots there are."""
    base = np.zeros(len(count), np.int64)
    crowded = count >= CROWDED
    n = int(crowded.sum())
    base[crowded] = FAN * (1 + np.arange(n))
    low = FAN * (1 + n)
    size = int(count[~crowded].sum() / LOAD) + 4 * FAN
    random = np.random.default_rng(1)
    used = np.zeros(size + FAN, bool)
    claim = np.zeros(size + FAN, np.int64)
    for c in range(CROWDED - 1, 0, -1):
        left = np.flatnonzero(count == c)
        while len(left):
            at = random.integers(0, size, len(left))
            slots = at[:, None] + digit[start[left][:, None] + np.arange(c)]
            free = ~used[slots].any(axis=1)
            claim[slots[free]] = left[free][:, None]
            won = free & (claim[slots] == left[:, None]).all(axis=1)
            used[slots[won]] = True
            base[left[won]] = low + at[won]
            left = left[~won]
    return base.astype(np.int32), low + size + FAN


def build(codes: np.ndarray, symbols: int) -> Trie:
    """The trie of the rows of ``codes`` (numbers from 1 on, 0 after a row's end), in lexicographic order."""
    parent, digit, end = _nodes(codes, symbols)
    first = np.flatnonzero(np.diff(parent, prepend=-1))
    count = np.diff(np.append(first, len(parent)))
    bases, slots = _place(count, first, digit)
    place = np.zeros(len(parent) + 1, np.int32)  # slot of each node; the root is slot 0
    place[1:] = np.repeat(bases, count) + digit
    base, check = np.zeros(slots, np.int32), np.full(slots, -1, np.int32)
    base[place[parent[first]]] = bases
    check[place[1:]] = place[parent]
    phrase = np.full(slots, -1, np.int32)
    phrase[place[end]] = np.arange(len(codes))
    return Trie(base, check, phrase, symbols)


def digits_for(numbers: int) -> int:
    """Digits that hold the numbers up to ``numbers``."""
    return max(1, -(-int(numbers).bit_length() // DIGIT_BITS))
