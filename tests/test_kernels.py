"""What the counter summaries promise, in any order of input."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keytally.operators.kernels import DeltaSender, MedianPurge, SpaceSaving, VoteRow, WeightedFrequent

ORDERS = {
    "ascending": lambda rows: sorted(rows),
    "descending": lambda rows: sorted(rows, reverse=True),
    "interleaved": lambda rows: rows[::2] + rows[1::2],
}


def feed(summary, rows, batch=50):
    for i in range(0, len(rows), batch):
        sums = Counter()
        for key, weight in rows[i : i + batch]:
            sums[key] += weight
        summary.add(np.array(list(sums), dtype=np.int64), np.array(list(sums.values()), dtype=np.int64))
    return summary


def truth(rows):
    sums = Counter()
    for key, weight in rows:
        sums[key] += weight
    return sums


STREAMS = {
    "all_distinct": [(k, 1) for k in range(1000)],
    "single_key": [(7, 1)] * 1000,
    "zipf": [(k, 1) for k in range(1, 200) for _ in range(2000 // k)],
    "weighted": [(k % 37, k % 11) for k in range(2000)],
}


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("name", STREAMS)
@pytest.mark.parametrize("m", [1, 10, 64, 5000])
@pytest.mark.parametrize("batch", [1, 50, 5000])
def test_space_saving(name, order, m, batch):
    rows = ORDERS[order](STREAMS[name])
    if batch == 1:
        rows = rows[:1500]
    s, f = feed(SpaceSaving(m), rows, batch), truth(rows)
    n = sum(f.values())
    assert s.n == n == s.cnt.sum()
    assert len(s) <= m and len(set(s.keys.tolist())) == len(s)
    for key, cnt, err in zip(*s.rows()):
        assert cnt - err <= f[key] <= cnt
        assert err <= n / m
    tracked = set(s.keys.tolist())
    assert all(v <= s.floor for k, v in f.items() if k not in tracked)
    if m >= len(f):
        assert dict(zip(s.keys.tolist(), s.cnt.tolist())) == {k: v for k, v in f.items() if v}


@given(
    st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), max_size=300),
    st.integers(1, 12),
    st.integers(1, 60),
)
@settings(max_examples=150, deadline=None)
def test_bounds_hold(rows, m, batch):
    f = truth(rows)
    n = sum(f.values())
    upper = feed(SpaceSaving(m), rows, batch)
    assert upper.cnt.sum() == n
    for key, cnt, err in zip(*upper.rows()):
        assert cnt - err <= f[key] <= cnt
    for cls in (WeightedFrequent, MedianPurge):
        s = feed(cls(m), rows, batch)
        known = dict(zip(s.rows()[0], s.rows()[1]))
        assert len(s) <= m
        for key, v in f.items():
            assert known.get(key, 0) <= v <= known.get(key, 0) + s.floor
    lower = feed(WeightedFrequent(m), rows, batch)
    assert lower.floor <= n / (m + 1)


@given(
    st.lists(st.tuples(st.integers(0, 30), st.integers(1, 5)), min_size=1, max_size=300),
    st.integers(1, 12),
    st.sampled_from([0.0, 0.01, 0.2]),
    st.booleans(),
)
@settings(max_examples=100, deadline=None)
def test_delta_sender(rows, m, beta, flush):
    f = truth(rows)
    n = sum(f.values())
    s = feed(DeltaSender(m, beta), rows, 20)
    if flush:
        s.flush()
    keys, amounts = s.take()
    sent = Counter()
    for key, amount in zip(keys.tolist(), amounts.tolist()):
        sent[key] += amount
    for key, v in f.items():
        assert v - s.floor - (0 if flush else max(1, beta * n)) <= sent[key] <= v


@given(
    st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=200),
    st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=200),
    st.integers(1, 40),
    st.integers(1, 40),
    st.sampled_from([SpaceSaving, WeightedFrequent, MedianPurge]),
)
@settings(max_examples=200, deadline=None)
def test_summaries_of_any_size_can_be_loaded(before, after, m, warm_m, kind):
    """A summary of ``warm_m`` counters goes on as one of ``m``."""
    warm = feed(kind(warm_m), before, 20)
    s = kind(m).load(warm.keys if warm.keys is not None else np.empty(0, np.int64), warm.cnt, warm.err, warm.n, warm.floor)
    assert len(s) <= m
    feed(s, after, 20)
    f = truth(before + after)
    assert len(s) <= m and s.n == sum(f.values())
    tracked = dict(zip(s.keys.tolist(), zip(s.cnt.tolist(), s.err.tolist()))) if s.keys is not None else {}
    for key, (cnt, err) in tracked.items():
        if kind is SpaceSaving:
            assert cnt - err <= f[key] <= cnt
        else:
            assert cnt <= f[key] <= cnt + s.floor
    assert all(v <= s.floor for k, v in f.items() if k not in tracked)


def test_equal_keys_are_added_up_on_load():
    s = SpaceSaving(2).load(np.array([1, 2, 1, 3]), [5, 4, 3, 1], [0, 1, 0, 0], 13, 0)
    assert dict(zip(s.keys.tolist(), s.cnt.tolist())) == {1: 8, 2: 4} and s.floor == 1


def test_weights():
    s = SpaceSaving(4)
    s.add(np.array([1, 2]), np.array([0, 3]))
    assert s.rows()[0] == [2] and s.n == 3
    with pytest.raises(ValueError):
        s.add(np.array([1]), np.array([-1]))
    with pytest.raises(ValueError):
        SpaceSaving(0)


def test_string_keys():
    s = SpaceSaving(2)
    for batch in (["a", "b"], ["c"], ["a"]):
        s.add(np.array(batch, dtype=object), np.ones(len(batch), dtype=np.int64))
    assert s.cnt.sum() == 4 and len(s) == 2


@given(
    st.lists(st.tuples(st.integers(0, 12), st.integers(1, 9)), min_size=1, max_size=200),
    st.integers(1, 5),
    st.integers(1, 30),
)
@settings(max_examples=150, deadline=None)
def test_votes(rows, buckets, batch):
    votes = VoteRow(buckets)
    for i in range(0, len(rows), batch):
        sums = truth(rows[i : i + batch])
        keys = np.array(list(sums), dtype=np.int64)
        votes.add(keys, keys % buckets, np.array(list(sums.values()), dtype=np.int64))
    f = truth(rows)
    total = Counter()
    for key, v in f.items():
        total[key % buckets] += v
    for b in range(buckets):
        score = int(votes.score[b])
        assert score == 0 or score <= f[int(votes.cand[b])]
        for key, v in f.items():
            if key % buckets == b and 2 * v > total[b]:
                assert votes.cand[b] == key and score >= 2 * v - total[b]


def test_sums_in_a_task_stay_small():
    """However many distinct keys a task sees, it holds a bounded number of them."""
    import pyarrow as pa

    from keytally.operators.summaries import compacted

    def batches():
        for i in range(60):
            keys = [f"word{k}" for k in range(10_000 * i, 10_000 * (i + 1))]
            yield pa.record_batch({"key": pa.array(keys), "weight": pa.array([1] * len(keys))})

    sizes = [len(frame) for frame in compacted(batches(), ["key"])]
    assert sum(sizes) == 600_000 and max(sizes) < 1 << 18
