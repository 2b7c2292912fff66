"""Running bounded summaries over partitions, shards and groups, and merging them.

A summary table has one row per counter and one head row per summary:

    by..., shard, key, cnt, err, floor, n

Rows of the stream without a key are left out. Head rows have a null key and carry the weight seen (``n``) and the most weight an untracked
key can have (``floor``). Counter rows have n = 0 and repeat the floor of their summary.
Only summaries are shuffled: at most (m + 1) rows per task and group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keytally.operators.kernels import KINDS, Counters, DeltaSender, VoteRow, key_array

BATCH_ROWS = 1 << 16
BATCH_BYTES = 1 << 24
MAX_DISTINCT = 1 << 17
FAN_IN = 16


def compacted(
    batches: Iterator[pa.RecordBatch], ids: list[str], carried: tuple[str, ...] = ()
) -> Iterator[pd.DataFrame]:
    """The tables of ``compacted_tables`` as pandas has them; ids without nulls only, which it would change."""
    for table in compacted_tables(batches, ids, carried):
        yield table.to_pandas()


def compacted_tables(
    batches: Iterator[pa.RecordBatch], ids: list[str], carried: tuple[str, ...] = ()
) -> Iterator[pa.Table]:
    """The weights of equal ids summed up, for as many rows as have MAX_DISTINCT distinct ids.

    Rows are folded into the sums every BATCH_ROWS rows (or as many as there are sums, to fold
    in linear time) or BATCH_BYTES bytes, which bounds what a task holds: no table has twice MAX_DISTINCT rows. ``carried`` columns
    depend on the ids alone.
    """
    sums: pa.Table | None = None
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        due = BATCH_ROWS if sums is None else max(BATCH_ROWS, sums.num_rows)
        if rows >= due or size >= BATCH_BYTES:
            sums = _summed(sums, held, ids, carried)
            held, rows, size = [], 0, 0
            if sums.num_rows >= MAX_DISTINCT:
                yield sums
                sums = None
    if rows:
        sums = _summed(sums, held, ids, carried)
    if sums is not None:
        yield sums


def _summed(
    sums: pa.Table | None, held: list[pa.RecordBatch], ids: list[str], carried: tuple[str, ...]
) -> pa.Table:
    table = pa.Table.from_batches(held)
    low = pc.min(table["weight"]).as_py()
    if low is not None and low < 0:
        raise ValueError("weights must not be negative")
    if sums is not None:
        table = pa.concat_tables([sums, table.select(sums.column_names)], promote_options="default")
    wanted = [("weight", "sum"), *((c, "min") for c in carried)]
    totals = table.group_by(ids).aggregate(wanted)
    order = [*ids, "weight_sum", *(f"{c}_min" for c in carried)]
    return totals.select(order).rename_columns([*ids, "weight", *carried])


def _schema(stream: DataFrame, by: tuple[str, ...], counters: tuple[str, ...]) -> StructType:
    fields = {f.name: f.dataType for f in stream.schema.fields}
    return StructType(
        [StructField(b, fields[b]) for b in by]
        + [StructField("shard", LongType()), StructField("key", fields["key"])]
        + [StructField(c, LongType()) for c in counters]
    )


COUNTER_COLUMNS = ("cnt", "err", "floor", "n")


def _table(by: list[str], group: tuple, shard: int, s: Counters, schema: pa.Schema) -> pa.RecordBatch:
    keys, cnt, err = s.rows()
    size = len(keys) + 1
    columns: dict[str, list] = {b: [v] * size for b, v in zip(by, group)}
    columns |= {
        "shard": [shard] * size,
        "key": [None, *keys],
        "cnt": [0, *cnt],
        "err": [0, *err],
        "floor": [s.floor] * size,
        "n": [s.n] + [0] * (size - 1),
    }
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _runner(
    make: Callable[[], Counters], shard_column: str | None, schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A summary per task or, with a ``shard_column``, per value of it; a task has few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        split = [shard_column] if shard_column else []
        live: dict[int, Counters] = {}
        for frame in compacted(batches, [*split, "key"]):
            groups = frame.groupby(shard_column, sort=False) if split else [(task, frame)]
            for shard, rows in groups:
                summary = live.get(shard)
                if summary is None:
                    summary = live[shard] = make()
                summary.add(key_array(rows["key"]), rows["weight"].to_numpy("int64"))
        for shard, summary in live.items():
            yield _table([], (), shard, summary, schema)

    return run


class GroupedCounters:
    """Counters of many groups in shared arrays, with no object per group.

    Rows come ordered by group, so that all groups of a block but the last are complete; that one is carried
    over to the next block with at most m counters. What a group may have to its (m + 1)-th counter is cut at once:
    the same bounds as those of the kernels, counter by counter.
    """

    def __init__(self, kind: str, m: int, by: list[str], schema: pa.Schema) -> None:
        if m < 1:
            raise ValueError("a summary needs at least one counter")
        self.kind, self.m, self.by, self.schema = kind, m, by, schema
        self.open: tuple[tuple, pd.DataFrame, int, int] | None = None

    def add(self, rows: pa.Table, last: tuple) -> list[pa.RecordBatch]:
        """Takes a block of (by..., key, weight) sums whose last group is ``last``; gives out the others."""
        sums = rows.group_by([*self.by, "key"]).aggregate([("weight", "sum")])
        codes, groups = _group_codes(sums, self.by)
        weights = sums["weight_sum"].to_numpy()
        n, floor = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)
        np.add.at(n, codes, weights)
        frame = pd.DataFrame({"g": codes, "key": sums["key"].to_pandas(), "cnt": weights, "err": 0})
        closed = None
        if self.open is not None:
            before, held, seen, missed = self.open
            at = groups.get(before)
            if at is None:
                closed = self._out([before], held.assign(g=0), np.array([seen]), np.array([missed]))
            else:
                frame = self._carried(frame, held, at, missed)
                n[at] += seen
                floor[at] = missed
        frame, floor = self._cut(frame, floor)
        here = groups[last]
        mine = frame["g"].to_numpy() == here
        self.open = (last, frame[mine], int(n[here]), int(floor[here]))
        names = list(groups)
        rest = self._out(names, frame[~mine], n, floor, leave=here)
        return [b for b in (closed, rest) if b is not None]

    def finish(self) -> list[pa.RecordBatch]:
        if self.open is None:
            return []
        group, held, seen, missed = self.open
        return [self._out([group], held.assign(g=0), np.array([seen]), np.array([missed]))]

    def _carried(self, frame: pd.DataFrame, held: pd.DataFrame, at: int, missed: int) -> pd.DataFrame:
        """The open group's counters joined with its new sums."""
        mine = frame["g"].to_numpy() == at
        new = frame[mine]
        if self.kind == "space_saving" and missed:
            # a key that is not tracked may have had up to the floor before
            unknown = ~new["key"].isin(held["key"])
            new = new.assign(cnt=new["cnt"] + missed * unknown, err=new["err"] + missed * unknown)
        both = pd.concat([held.assign(g=at), new]).groupby("key", as_index=False, sort=False)
        joined = both.agg({"g": "first", "cnt": "sum", "err": "sum"})
        return pd.concat([frame[~mine], joined[["g", "key", "cnt", "err"]]])

    def _cut(self, frame: pd.DataFrame, floor: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        while True:
            order = np.lexsort((-frame["cnt"].to_numpy(), frame["g"].to_numpy()))
            frame = frame.iloc[order]
            g, cnt = frame["g"].to_numpy(), frame["cnt"].to_numpy()
            start = np.flatnonzero(np.diff(g, prepend=-1))
            size = np.diff(np.append(start, len(g)))
            rank = np.arange(len(g)) - np.repeat(start, size)
            over = size > self.m
            if not over.any():
                return frame, floor
            # of a group in falling order: the first counter too many, or the median
            least = self.m if self.kind != "items" else size - 1 - size // 2
            at = start + np.where(over, least, 0)
            cut = np.where(over, cnt[at], 0)
            spread_cut = np.repeat(cut, size)
            floor = floor.copy()
            if self.kind == "space_saving":
                floor[g[start]] = np.maximum(floor[g[start]], cut)
                keep = rank < self.m
                frame = frame[keep]
            else:
                floor[g[start]] += cut
                frame = frame.assign(cnt=cnt - spread_cut)[cnt > spread_cut]

    def _out(
        self, names: list[tuple], frame: pd.DataFrame, n: np.ndarray, floor: np.ndarray, leave: int = -1
    ) -> pa.RecordBatch | None:
        heads = np.array([i for i in range(len(names)) if i != leave], np.int64)
        if not len(heads):
            return None
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        g = np.concatenate([heads, frame["g"].to_numpy("int64")])
        counters = len(frame)
        zeros = np.zeros(counters, np.int64)
        columns = {b: [names[i][j] for i in g.tolist()] for j, b in enumerate(self.by)}
        columns |= {
            "shard": np.full(len(g), task, np.int64),
            "key": [None] * len(heads) + frame["key"].tolist(),
            "cnt": np.concatenate([0 * heads, frame["cnt"].to_numpy("int64")]),
            "err": np.concatenate([0 * heads, frame["err"].to_numpy("int64")]),
            "floor": floor[g],
            "n": np.concatenate([n[heads], zeros]),
        }
        arrays = [pa.array(columns[f.name], f.type) for f in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _group_codes(sums: pa.Table, by: list[str]) -> tuple[np.ndarray, dict[tuple, int]]:
    """A number per row for its group, and the groups by their values; null is a value of its own."""
    parts = [sums[b].combine_chunks().dictionary_encode(null_encoding="encode") for b in by]
    table = np.stack([part.indices.to_numpy() for part in parts], axis=1)
    unique, codes = np.unique(table, axis=0, return_inverse=True)
    values = [[_plain(v) for v in part.dictionary.to_pylist()] for part in parts]
    names = [tuple(values[j][i] for j, i in enumerate(row)) for row in unique.tolist()]
    return codes.reshape(-1), {name: i for i, name in enumerate(names)}


NAN = float("nan")


def _plain(value):
    """One object for all NaN, so that they are one group."""
    return NAN if isinstance(value, float) and value != value else value


def _grouped_runner(kind: str, m: int, by: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held, rows = GroupedCounters(kind, m, by, schema), [], 0

        def block() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            return counters.add(table, tuple(_plain(table[b][-1].as_py()) for b in by))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                yield from block()
                held, rows = [], 0
        if rows:
            yield from block()
        yield from counters.finish()

    return run


def spread(stream: DataFrame, tasks: int | None) -> DataFrame:
    """The stream in at most ``tasks`` partitions, joined up without a shuffle. Each gives a summary
    of its own, so a scan of very many splits should be brought down to a few tasks per core."""
    return stream if tasks is None else stream.coalesce(tasks)


def local_summaries(
    stream: DataFrame, kind: str, m: int, by: tuple[str, ...] = (), tasks: int | None = None
) -> DataFrame:
    """A summary per input partition (and group), without any shuffle; see ``spread``.

    With groups, the rows are summed up and sorted by group within their partition, which Spark does on disk if need
    be: a task holds one block of rows and the counters of one group, however many groups there are.
    """
    schema = _schema(stream, by, COUNTER_COLUMNS)
    arrow = _arrow_schema(schema)
    rows = spread(stream.where(F.col("key").isNotNull()).select(*by, "key", "weight"), tasks)
    if by:
        sums = rows.mapInArrow(_compact_only([*by, "key"], _arrow_schema(rows.schema)), rows.schema)
        ordered = sums.where("weight > 0").sortWithinPartitions(*by, "key")
        return ordered.mapInArrow(_grouped_runner(kind, m, list(by), arrow), schema)
    cls = KINDS[kind]
    return rows.mapInArrow(_runner(lambda: cls(m), None, arrow), schema)


def _compact_only(ids: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in compacted_tables(batches, ids):
            yield from table.select(schema.names).cast(schema).to_batches()

    return run


def summed_in_task(stream: DataFrame) -> DataFrame:
    """(key, weight) with equal keys summed within each task, without any shuffle."""
    rows = stream.where(F.col("key").isNotNull()).select("key", "weight")
    return rows.mapInArrow(_compact_only(["key"], _arrow_schema(rows.schema)), rows.schema)


def pending_deltas(stream: DataFrame, owner: Column) -> DataFrame:
    """(owner, key, weight): what crosses the shuffle. A hot key is one row per run of rows, so no
    owner is flooded by it."""
    return summed_in_task(stream).select(owner.cast("long").alias("owner"), "key", "weight")


def owners_for(stream: DataFrame, partitions_per_owner: int = FAN_IN, least: int = 4) -> int:
    """How many owners a stream is dealt to, from the size of its scan: one per so many input partitions."""
    return max(least, -(-stream.rdd.getNumPartitions() // partitions_per_owner))


def sharded_summaries(
    stream: DataFrame, kind: str, m: int, shards: int, owner: Column
) -> DataFrame:
    """One summary per owner shard; keys are disjoint between shards, so nothing is merged.

    An owner takes its rows in the order of their keys, so a task that is run again gives the same counters.
    """
    deltas = pending_deltas(stream, owner)
    placed = deltas.repartitionById(shards, F.col("owner").cast("int"))
    placed = placed.sortWithinPartitions("owner", "key", "weight")
    schema = _schema(stream, (), COUNTER_COLUMNS)
    cls = KINDS[kind]
    run = _runner(lambda: cls(m), "owner", _arrow_schema(schema))
    return placed.mapInArrow(run, schema)


def merge_tree(summary: DataFrame, kind: str, m: int, fan_in: int = FAN_IN) -> DataFrame:
    """One summary of m counters from the summaries of all shards, ``fan_in`` at a time.

    Every node of the tree adds up its children's counters, those that a child does not track by the child's floor, and
    keeps m of them; so no task sees more than ``fan_in`` x m counters. Floors add up, and what a node drops
    raises its floor.
    """
    if fan_in < 2:
        raise ValueError("a node merges at least two summaries")
    schema = _schema(summary, (), COUNTER_COLUMNS)
    arrow, cls, most = _arrow_schema(schema), KINDS[kind], m
    # by remainders of a count found from the largest number, no node gets more than fan_in shards
    top = heads_of(summary).agg(F.max("shard").alias("top")).first().top
    count = 1 + (top or 0)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        node = int(key[0].as_py())
        heads = rows.filter(pc.is_null(rows["key"]))
        own = rows.filter(pc.is_valid(rows["key"])).to_pandas()
        floor, n = pc.sum(heads["floor"]).as_py() or 0, pc.sum(heads["n"]).as_py() or 0
        merged = cls(most)
        if len(own):
            sums = own.groupby("key", as_index=False)[["cnt", "err", "floor"]].sum()
            missed = floor - sums["floor"].to_numpy("int64") if kind == "space_saving" else 0
            merged.load(
                key_array(sums["key"]),
                sums["cnt"].to_numpy("int64") + missed,
                sums["err"].to_numpy("int64") + missed,
                n,
                floor,
            )
        else:
            merged.n, merged.floor = n, floor
        return pa.Table.from_batches([_table([], (), node, merged, arrow)])

    nodes = summary.select("shard", "key", *COUNTER_COLUMNS)
    while True:
        count = -(-count // fan_in)
        parent = F.pmod(F.col("shard"), F.lit(count)) if count > 1 else F.lit(0)
        nodes = nodes.withColumn("_node", parent.cast("long")).groupBy("_node").applyInArrow(merge, schema)
        if count == 1:
            return nodes


def counters_of(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("key").isNotNull())


def heads_of(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("key").isNull())


def total_of(summary: DataFrame, column: str) -> Column:
    """The sum of ``n`` or ``floor`` over all summaries, as a one-value subquery."""
    return heads_of(summary).agg(F.coalesce(F.sum(column), F.lit(0)).alias(column)).scalar()


def _merged_sums(summary: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return counters_of(summary).groupBy(*by, "key").agg(
        F.sum("cnt").alias("cnt"), F.sum("err").alias("err"), F.sum("floor").alias("own")
    )


def _with_floor(summary: DataFrame, merged: DataFrame, by: tuple[str, ...]) -> DataFrame:
    if not by:
        return merged.withColumn("floor", total_of(summary, "floor"))
    floors = heads_of(summary).groupBy(*by).agg(F.sum("floor").alias("floor"))
    return merged.join(floors, [*by])


def merge_upper(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, est, lower, upper) of merged Space-Saving summaries with common keys: a
    summary that does not track a key may have missed up to its floor."""
    merged = _with_floor(summary, _merged_sums(summary, by), by)
    est = F.col("cnt") + F.col("floor") - F.col("own")
    return merged.select(
        *by,
        "key",
        est.alias("est"),
        (F.col("cnt") - F.col("err")).alias("lower"),
        est.alias("upper"),
    )


def merge_lower(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, est, lower, upper) of merged summaries that under-count."""
    merged = _with_floor(summary, _merged_sums(summary, by), by)
    return merged.select(
        *by,
        "key",
        F.col("cnt").alias("est"),
        F.col("cnt").alias("lower"),
        (F.col("cnt") + F.col("floor")).alias("upper"),
    )


def delta_rows(
    stream: DataFrame, m: int, beta: float, flush: bool = True, tasks: int | None = None
) -> DataFrame:
    """(shard, key, delta, n) rows a task sends on; head rows (null key) carry the weight seen.

    ``flush`` sends the rest at the end of the input; without it up to a share ``beta`` of
    a task's weight may stay unsent per key.
    """
    schema = _schema(stream, (), ("delta", "n"))
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sender = DeltaSender(m, beta)

        def rows(keys: list, amounts: list, n: int) -> pa.RecordBatch:
            size = len(keys)
            columns = {"shard": [task] * size, "key": keys, "delta": amounts, "n": [n] * size}
            return pa.RecordBatch.from_pydict(columns, schema=arrow)

        for frame in compacted(batches, ["key"]):
            sender.add(key_array(frame["key"]), frame["weight"].to_numpy("int64"))
            keys, amounts = sender.take()
            yield rows(keys.tolist(), amounts.tolist(), 0)
        if flush:
            sender.flush()
            keys, amounts = sender.take()
            yield rows(keys.tolist(), amounts.tolist(), 0)
        yield rows([None], [0], sender.n)

    rows = stream.where(F.col("key").isNotNull()).select("key", "weight")
    return spread(rows, tasks).mapInArrow(run, schema)


def cut_value(merged: DataFrame, m: int, value: str) -> Column:
    """The (m+1)-th largest value, or 0 where there are no more than m."""
    top = merged.orderBy(F.desc(value)).limit(m + 1)
    largest = F.when(F.count(F.lit(1)) > m, F.min(value)).otherwise(F.lit(0))
    return top.agg(largest.alias("cut")).scalar()


def cut_to(merged: DataFrame, m: int, value: str = "cnt") -> DataFrame:
    """At most m counters: all are lowered by the (m+1)-th largest."""
    return (
        merged.withColumn("_cut", cut_value(merged, m, value))
        .where(F.col(value) > F.col("_cut"))
        .withColumn(value, F.col(value) - F.col("_cut"))
        .drop("_cut")
    )


def vote_runner(depth: int, buckets: int, schema: pa.Schema):
    """Casts the votes of a partition; rows come with their bucket in every sketch row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        votes = [VoteRow(buckets) for _ in range(depth)]
        names = tuple(f"_b{row}" for row in range(depth))
        for frame in compacted(batches, ["key"], names):
            frame = frame[frame["weight"] > 0]
            if frame.empty:
                continue
            keys, weights = key_array(frame["key"]), frame["weight"].to_numpy("int64")
            for row, name in zip(votes, names):
                row.add(keys, frame[name].to_numpy("int64"), weights)
        for number, row in enumerate(votes):
            cells = row.score.nonzero()[0]
            if len(cells):
                columns = {
                    "part": [task] * len(cells),
                    "row": [number] * len(cells),
                    "bucket": cells.tolist(),
                    "cand": row.cand[cells].tolist(),
                    "cnt": row.score[cells].tolist(),
                }
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run
