"""Bounded counter summaries that run inside a task.

Each takes batches of distinct keys with their summed weights and keeps at most ``m``
counters, as NumPy arrays. Spark decides which rows meet in which task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd

_SHORT_RUN = 32


def checked(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive weights only; zero weights are dropped, negative ones are refused."""
    if len(weights) and weights.min() < 0:
        raise ValueError("weights must not be negative")
    keep = weights > 0
    return (keys, weights) if keep.all() else (keys[keep], weights[keep])


class Counters:
    """Tracked keys, their counts and errors, the weight seen (``n``) and ``floor``: the most
    weight an untracked key can have."""

    def __init__(self, m: int) -> None:
        if m < 1:
            raise ValueError("a summary needs at least one counter")
        self.m = m
        self.keys: np.ndarray | None = None
        self.cnt = np.empty(0, dtype=np.int64)
        self.err = np.empty(0, dtype=np.int64)
        self.n = 0
        self.floor = 0

    def load(self, keys, cnt, err, n: int, floor: int) -> "Counters":
        """Starts from counters of any number: those of one key are added up, and the least of too
        many are cut as the kind of summary does it."""
        codes, unique = pd.factorize(keys)
        self.keys = unique
        self.cnt, self.err = (np.zeros(len(unique), dtype=np.int64) for _ in range(2))
        np.add.at(self.cnt, codes, np.asarray(cnt, dtype=np.int64))
        np.add.at(self.err, codes, np.asarray(err, dtype=np.int64))
        self.n, self.floor = n, floor
        if len(self) > self.m:
            self._reduce()
        return self

    def _reduce(self) -> None:
        raise NotImplementedError

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        keys, weights = checked(keys, weights)
        if not len(keys):
            return
        if self.keys is None:
            self.keys = keys[:0]
        self.n += int(weights.sum())
        at = pd.Index(self.keys).get_indexer(pd.Index(keys))
        known = at >= 0
        self.cnt[at[known]] += weights[known]
        self._tracked(at[known], weights[known])
        if not known.all():
            order = np.argsort(weights[~known], kind="stable")
            self._insert(keys[~known][order], weights[~known][order])

    def __len__(self) -> int:
        return len(self.cnt)

    def rows(self) -> tuple[list, list, list]:
        """Keys, counts and errors as lists."""
        keys = [] if self.keys is None else self.keys.tolist()
        return keys, self.cnt.tolist(), self.err.tolist()

    def _tracked(self, at: np.ndarray, weights: np.ndarray) -> None:
        """Called with the counters that have just grown."""

    def _insert(self, keys: np.ndarray, weights: np.ndarray) -> None:
        raise NotImplementedError

    def _append(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.keys = np.concatenate([self.keys, keys])
        self.cnt = np.concatenate([self.cnt, weights])
        self.err = np.concatenate([self.err, np.zeros(len(keys), dtype=np.int64)])


class SpaceSaving(Counters):
    """A new key takes over the least counter and its count: counts never fall short, and
    they add up to the weight seen, unless it starts from summaries that were cut or merged."""

    def _reduce(self) -> None:
        order = np.argsort(-self.cnt, kind="stable")
        self.floor = max(self.floor, int(self.cnt[order[self.m]]))
        keep = np.sort(order[: self.m])
        self.keys, self.cnt, self.err = self.keys[keep], self.cnt[keep], self.err[keep]

    def _insert(self, keys: np.ndarray, weights: np.ndarray) -> None:
        # Keys come lightest first; the heaviest get the free counters. What such a key may have had
        # before is the floor, which is 0 but for a summary that was loaded.
        free = min(self.m - len(self), len(keys))
        if free:
            at = len(self)
            self._append(keys[-free:], weights[-free:] + self.floor)
            self.err[at:] = self.floor
            keys, weights = keys[:-free], weights[:-free]
        done = 0
        while done < len(keys):
            order = np.argsort(self.cnt, kind="stable")
            least = self.cnt[order]
            # While the counters taken so far end above the next least one, the next new key
            # takes that one: a whole run is replaced at once.
            run = int(np.searchsorted(least, least[0] + weights[done], side="right"))
            run = min(run, len(keys) - done)
            if run < min(_SHORT_RUN, len(keys) - done):
                self._one_by_one(keys[done:], weights[done:])
                break
            at, took = order[:run], slice(done, done + run)
            self.keys[at], self.err[at] = keys[took], least[:run]
            self.cnt[at] = least[:run] + weights[took]
            done += run
        if len(self) == self.m:
            self.floor = max(self.floor, int(self.cnt.min()))

    def _one_by_one(self, keys: np.ndarray, weights: np.ndarray) -> None:
        heap = list(zip(self.cnt.tolist(), range(len(self.cnt))))
        heapq.heapify(heap)
        for key, weight in zip(keys, weights.tolist()):
            least, at = heap[0]
            self.keys[at], self.err[at], self.cnt[at] = key, least, least + weight
            heapq.heapreplace(heap, (least + weight, at))

    def _tracked(self, at: np.ndarray, weights: np.ndarray) -> None:
        if len(self) == self.m:
            self.floor = max(self.floor, int(self.cnt.min()))


class WeightedFrequent(Counters):
    """All counters are lowered together when they are too many: counts never exceed the
    truth and fall short by at most ``floor``."""

    def _insert(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self._append(keys, weights)
        if len(self) > self.m:
            self._reduce()

    def _reduce(self) -> None:
        self._lower(int(np.partition(self.cnt, len(self.cnt) - self.m - 1)[-self.m - 1]))

    def _lower(self, cut: int) -> np.ndarray:
        keep = self.cnt > cut
        self.keys, self.cnt, self.err = self.keys[keep], self.cnt[keep] - cut, self.err[keep]
        self.floor += cut
        return keep


class MedianPurge(WeightedFrequent):
    """As above, lowering by the median counter, which frees half the counters at a time."""

    def _reduce(self) -> None:
        while len(self) > self.m:
            self._lower(int(np.partition(self.cnt, len(self.cnt) // 2)[len(self.cnt) // 2]))


class DeltaSender(WeightedFrequent):
    """A weighted-frequent summary that reports increments of a key once they reach a share
    ``beta`` of the weight seen. What is still unsent when a key is dropped is sent then."""

    def __init__(self, m: int, beta: float) -> None:
        super().__init__(m)
        self.beta = beta
        self.unsent = np.empty(0, dtype=np.int64)
        self.settled = 0
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        super().add(keys, weights)
        self._send(self.unsent >= max(1, self.beta * self.n))

    def _tracked(self, at: np.ndarray, weights: np.ndarray) -> None:
        self.unsent[at] += weights

    def _append(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.settled = len(self)
        super()._append(keys, weights)
        self.unsent = np.concatenate([self.unsent, weights])

    def _lower(self, cut: int) -> np.ndarray:
        # A key that is new and dropped at once is part of the floor; it sends nothing.
        lost = (self.cnt <= cut) & (np.arange(len(self)) < self.settled)
        self._send(lost)
        keep = super()._lower(cut)
        self.unsent = self.unsent[keep]
        return keep

    def _send(self, which: np.ndarray) -> None:
        which = which & (self.unsent > 0)
        if which.any():
            self.out.append((self.keys[which], self.unsent[which]))
            self.unsent[which] = 0

    def flush(self) -> None:
        self._send(self.unsent > 0)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The increments reported since the last call."""
        if not self.out:
            return np.empty(0, dtype=object), np.empty(0, dtype=np.int64)
        keys, amounts = (np.concatenate(part) for part in zip(*self.out))
        self.out = []
        return keys, amounts


class VoteRow:
    """One row of a majority sketch: a candidate and its score per bucket, 0 where empty."""

    def __init__(self, buckets: int) -> None:
        self.cand: np.ndarray | None = None
        self.score = np.zeros(buckets, dtype=np.int64)

    def add(self, keys: np.ndarray, buckets: np.ndarray, weights: np.ndarray) -> None:
        """A run of distinct keys: each bucket's leading key, with what it has over all others,
        backs the standing candidate or is set against it."""
        if self.cand is None:
            self.cand = np.zeros(len(self.score), dtype=keys.dtype)
        order = np.lexsort((weights, buckets))
        first = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0])
        lead = order[np.r_[first[1:], len(order)] - 1]
        gain = 2 * weights[lead] - np.add.reduceat(weights[order], first)
        lead, gain = lead[gain > 0], gain[gain > 0]
        cells = buckets[lead]
        backed = np.asarray(self.cand[cells] == keys[lead], dtype=bool) & (self.score[cells] > 0)
        balance = np.where(backed, self.score[cells] + gain, self.score[cells] - gain)
        lost = balance < 0
        self.cand[cells[lost]] = keys[lead[lost]]
        self.score[cells] = np.abs(balance)


def key_array(keys: pd.Series) -> np.ndarray:
    """Integer keys as they are, all others as objects."""
    values = keys.to_numpy()
    return values if values.dtype.kind in "iu" else keys.to_numpy(dtype=object)


KINDS = {"space_saving": SpaceSaving, "frequent": WeightedFrequent, "items": MedianPurge}
