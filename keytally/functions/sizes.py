"""How many counters a summary needs for a wanted error, from the bounds of the algorithms."""

from __future__ import annotations

import math


def counters_for(eps: float, skew: float = 1.0, shards: int = 1) -> int:
    """Counters of each of ``shards`` Space-Saving summaries with disjoint keys, so that no count is off
    by more than eps * N: the m-th key of a Zipf stream has a share of about m^-skew, and a summary
    of all keys alike (skew up to 1) needs one counter per share of eps."""
    if not 0 < eps < 1 or shards < 1:
        raise ValueError("eps must lie in (0, 1) and shards be positive")
    share = eps * shards
    return 1 + math.floor(share ** (-1.0 / max(1.0, skew)))


def counters_for_deltas(eps: float, beta: float, shards: int) -> int:
    """Counters of ``shards`` first-level summaries and of the one that they send to, where a share
    ``beta`` may be unsent: the error left, eps - beta, is split evenly over all of them."""
    if not 0 <= beta < eps or shards < 1:
        raise ValueError("beta must lie in [0, eps) and shards be positive")
    return 1 + math.floor((shards + 1) / (shards * (eps - beta)))
