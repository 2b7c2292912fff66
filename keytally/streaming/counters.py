"""Counter summaries kept up over a stream.

The state of a shard is one bounded summary. Keys are summed up within each task before they
go to their owner, so a hot key is a few rows per micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from keytally.operators import frequent
from keytally.operators.kernels import DeltaSender, SpaceSaving, key_array
from keytally.operators.summaries import COUNTER_COLUMNS, counters_of, cut_to, heads_of, pending_deltas
from keytally.sinks.sketch_store import stored
from keytally.streaming.runner import batch_writer, batches, newest, one_batch, run


def summary_schema(key_type) -> StructType:
    return StructType(
        [StructField("shard", LongType()), StructField("key", key_type)]
        + [StructField(c, LongType()) for c in COUNTER_COLUMNS]
    )


def _state_schema(key_type, extra: tuple[str, ...] = ()) -> StructType:
    longs = ArrayType(LongType())
    return StructType(
        [StructField("keys", ArrayType(key_type))]
        + [StructField(c, longs) for c in ("cnt", "err", *extra)]
        + [StructField("n", LongType()), StructField("floor", LongType())]
    )


def _keys(values, key_type) -> np.ndarray:
    return np.array(values, dtype=object if isinstance(key_type, StringType) else np.int64)


class SummaryProcessor(StatefulProcessor):
    """One Space-Saving summary per owner; every micro-batch gives out the owner's snapshot."""

    def __init__(self, m: int, key_type) -> None:
        self.m = m
        self.key_type = key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("summary", _state_schema(self.key_type))
        self.started: tuple[int, list[pd.DataFrame]] | None = None

    def _load(self) -> SpaceSaving:
        summary = SpaceSaving(self.m)
        if self.state.exists():
            keys, cnt, err, n, floor = self.state.get()
            summary.load(_keys(keys, self.key_type), cnt, err, int(n), int(floor))
        return summary

    def _store(self, s: SpaceSaving) -> None:
        self.state.update((*s.rows(), s.n, s.floor))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.started = None
        summary = self._load()
        for frame in rows:
            sums = frame.groupby("key", sort=False, as_index=False)["weight"].sum()
            summary.add(key_array(sums["key"]), sums["weight"].to_numpy("int64"))
        self._store(summary)
        yield _snapshot(key[0], summary)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # An owner's rows come in several frames, one after the other; the last time all are there.
        if self.started is None or self.started[0] != key[0]:
            self.started = (key[0], [])
        self.started[1].append(initialState)
        start = pd.concat(self.started[1])
        heads, rows = start[start["head"]], start[~start["head"]]
        # Several summaries of an owner: those that do not track a key may have missed their floor.
        floor = int(heads["floor"].sum())
        sums = rows.groupby("key", sort=False, as_index=False)[["cnt", "err", "floor"]].sum()
        missed = floor - sums["floor"].to_numpy("int64")
        summary = SpaceSaving(self.m).load(
            _keys(sums["key"].tolist(), self.key_type),
            sums["cnt"].to_numpy("int64") + missed,
            sums["err"].to_numpy("int64") + missed,
            int(heads["n"].sum()),
            floor,
        )
        self._store(summary)

    def close(self) -> None:
        pass


def _snapshot(owner: int, s) -> pd.DataFrame:
    keys, cnt, err = s.rows()
    size = len(keys) + 1
    return pd.DataFrame(
        {
            "shard": [int(owner)] * size,
            "key": pd.Series([None, *keys], dtype=object),
            "cnt": [0, *cnt],
            "err": [0, *err],
            "floor": [s.floor] * size,
            "n": [s.n] + [0] * (size - 1),
        }
    )


def stream_space_saving(
    stream: DataFrame, m: int, owner: Column, warm: DataFrame | None = None
) -> DataFrame:
    """The owners' snapshots, per micro-batch, as a streaming summary table.

    ``warm`` is a summary table (of the same owners) to start from.
    """
    key_type = stream.schema["key"].dataType
    deltas = pending_deltas(stream, owner).groupBy("owner")
    start = None
    if warm is not None:
        # a null key would make pandas turn whole numbers into floating ones
        key = F.coalesce("key", F.lit(0).cast(key_type))
        start = warm.withColumn("owner", F.col("shard")).withColumn("head", F.col("key").isNull())
        start = start.withColumn("key", key).groupBy("owner")
    return deltas.transformWithStateInPandas(
        statefulProcessor=SummaryProcessor(m, key_type),
        outputStructType=summary_schema(key_type),
        outputMode="Update",
        timeMode="None",
        initialState=start,
    )


def run_space_saving(
    stream: DataFrame,
    m: int,
    owner: Column,
    folder: str,
    warm: DataFrame | None = None,
    phi: float | None = None,
    every: int = 1,
    partitions: int | None = None,
    drain: bool = False,
) -> list:
    """Keeps a whole snapshot per micro-batch under ``folder``: the owners that changed, and the
    others as they were. With ``phi``, also answers the frequent-elements question after every
    ``every``-th micro-batch; questions between rows are in ``marks``."""
    schema = summary_schema(stream.schema["key"].dataType)
    if warm is not None:
        # the state and the first snapshot have to start from the same counters
        warm = stored(warm, "warm")
    changes, snapshots = f"{folder}/changes", f"{folder}/snapshots"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch_writer(changes)(batch, batch_id)
        now = one_batch(spark, changes, schema, batch_id)
        before = one_batch(spark, snapshots, schema, batch_id - 1) if batch_id > 0 else warm
        if before is not None:
            kept = before.join(now.select("shard").distinct(), "shard", "left_anti")
            now = now.unionByName(kept.select(now.columns))
        batch_writer(snapshots)(now, batch_id)
        if phi is not None and (batch_id + 1) % every == 0:
            answer = frequent.frequent_elements_global(
                one_batch(spark, snapshots, schema, batch_id), phi
            )
            batch_writer(f"{folder}/answers")(answer, batch_id)

    summaries = stream_space_saving(stream, m, owner, warm)
    return run(summaries, each, f"{folder}/checkpoint", "update", partitions, drain)


def snapshot(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The newest snapshot: the counters of all owners and the weights they had seen by then."""
    return newest(spark, f"{folder}/snapshots", schema)


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """The summary table of a stopped stream's owners, read from the state in its checkpoint."""
    state = (
        spark.read.format("statestore")
        .option("stateVarName", "summary")
        .load(f"{folder}/checkpoint")
        .select(F.col("key.owner").alias("shard"), "value.*")
    )
    zero = F.lit(0).cast("long")
    counters = state.select(
        "shard", "floor", F.explode(F.arrays_zip("keys", "cnt", "err")).alias("c")
    ).select("shard", F.col("c.keys").alias("key"), "c.cnt", "c.err", "floor", zero.alias("n"))
    none = F.lit(None).cast(counters.schema["key"].dataType).alias("key")
    heads = state.select("shard", none, zero.alias("cnt"), zero.alias("err"), "floor", "n")
    return counters.unionByName(heads)


def dealt_anew(summary: DataFrame, owner: Column, owners: int) -> DataFrame:
    """The summary table of owner shards with disjoint keys, dealt to other owners.

    A key that no one tracked may come to any owner, so each starts from the largest floor. The weight
    seen is split as the counters are; what they do not account for stays with owner 0.
    """
    zero = F.lit(0).cast("long")
    floor = heads_of(summary).agg(F.coalesce(F.max("floor"), zero).alias("floor")).scalar()
    rows = counters_of(summary).select(
        owner.cast("long").alias("shard"), "key", "cnt", "err", floor.alias("floor"), zero.alias("n")
    )
    seen = heads_of(summary).agg(F.coalesce(F.sum("n"), zero).alias("n")).scalar()
    counted = counters_of(summary).agg(F.coalesce(F.sum("cnt"), zero).alias("n")).scalar()
    spark = summary.sparkSession
    sums = rows.groupBy("shard").agg(F.sum("cnt").alias("n"))
    own = F.coalesce("n", zero) + F.when(F.col("id") == 0, seen - counted).otherwise(zero)
    heads = (
        spark.range(owners)
        .join(sums, F.col("id") == F.col("shard"), "left")
        .select(
            F.col("id").alias("shard"),
            F.lit(None).cast(summary.schema["key"].dataType).alias("key"),
            zero.alias("cnt"),
            zero.alias("err"),
            floor.alias("floor"),
            own.alias("n"),
        )
    )
    return rows.unionByName(heads)


def answers(spark: SparkSession, folder: str, key_type) -> DataFrame:
    """(batch, shard, key, est, lower, upper) of all answers given so far."""
    schema = StructType(
        [StructField("shard", LongType()), StructField("key", key_type)]
        + [StructField(c, LongType()) for c in ("est", "lower", "upper")]
    )
    return batches(spark, f"{folder}/answers", schema)


def visible_weight(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """(batch, visible): the weight each snapshot has seen. What is missing from it is at most
    the micro-batches since: their size is the flush policy."""
    heads = batches(spark, f"{folder}/snapshots", schema).where(F.col("key").isNull())
    return heads.groupBy("batch").agg(F.sum("n").alias("visible"))


class DeltaProcessor(StatefulProcessor):
    """One weighted-frequent summary per shard that sends on increments as they grow. A row marked as
    ``last`` is no increment: all that is still unsent is sent then."""

    def __init__(self, m: int, beta: float, key_type) -> None:
        self.m = m
        self.beta = beta
        self.key_type = key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sender", _state_schema(self.key_type, ("unsent",)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sender, ended = DeltaSender(self.m, self.beta), False
        if self.state.exists():
            keys, cnt, err, unsent, n, floor = self.state.get()
            sender.load(_keys(keys, self.key_type), cnt, err, int(n), int(floor))
            sender.unsent = np.array(unsent, dtype=np.int64)
        for frame in rows:
            ended = ended or bool(frame["last"].any())
            inserts = frame[~frame["last"]]
            if len(inserts):
                sums = inserts.groupby("key", sort=False, as_index=False)["weight"].sum()
                sender.add(key_array(sums["key"]), sums["weight"].to_numpy("int64"))
        if ended:
            sender.flush()
        self.state.update((*sender.rows(), sender.unsent.tolist(), sender.n, sender.floor))
        keys, amounts = sender.take()
        size = len(keys) + 1
        yield pd.DataFrame(
            {
                "shard": [int(key[0])] * size,
                "key": pd.Series([None, *keys.tolist()], dtype=object),
                "delta": [0, *amounts.tolist()],
                "n": [sender.n] + [0] * (size - 1),
            }
        )

    def close(self) -> None:
        pass


SEEN = "shard long, n long"
ENDS = "at timestamp"


def _delta_schema(key_type) -> StructType:
    return StructType(
        [StructField("shard", LongType()), StructField("key", key_type)]
        + [StructField(c, LongType()) for c in ("delta", "n")]
    )


def stream_deltas(
    stream: DataFrame, m: int, beta: float, shard: Column, ends: DataFrame | None = None
) -> DataFrame:
    """(shard, key, delta, n) rows as they are sent on; head rows carry the weight seen so far.

    ``ends`` is a stream with a row (owner) for every shard that is to send what it still holds.
    """
    key_type = stream.schema["key"].dataType
    rows = pending_deltas(stream, shard).withColumn("last", F.lit(False))
    if ends is not None:
        # a null key would make pandas turn whole numbers into floating ones
        zero = [F.lit(0).cast(key_type).alias("key"), F.lit(0).cast("long").alias("weight")]
        rows = rows.unionByName(ends.select("owner", *zero, F.lit(True).alias("last")))
    return rows.groupBy("owner").transformWithStateInPandas(
        statefulProcessor=DeltaProcessor(m, beta, key_type),
        outputStructType=_delta_schema(key_type),
        outputMode="Update",
        timeMode="None",
    )


def request_flush(spark: SparkSession, folder: str) -> None:
    """Asks the delta stream of ``folder``, running or not, to send on all that its shards hold."""
    row = spark.range(1).select(F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{folder}/ends")


def _ends(spark: SparkSession, folder: str, shards: int) -> DataFrame:
    """A stream of flush requests, a row for each shard."""
    spark.createDataFrame([], ENDS).write.mode("append").parquet(f"{folder}/ends")
    numbers = F.array(*[F.lit(i).cast("long") for i in range(shards)])
    return spark.readStream.schema(ENDS).parquet(f"{folder}/ends").select(F.explode(numbers).alias("owner"))


def run_deltas(
    stream: DataFrame,
    m: int,
    beta: float,
    shard: Column,
    folder: str,
    partitions: int | None = None,
    shards: int | None = None,
    flush: bool = False,
) -> list:
    """Sends increments on and merges them, micro-batch by micro-batch, into a second-level
    summary of m counters under ``folder``.

    With the number of ``shards``, the stream takes flush requests; ``flush`` makes one once all that is there
    has been read, and waits until it is served. The stream may go on after that.
    """
    key_type = stream.schema["key"].dataType
    merged_schema = StructType([StructField("key", key_type), StructField("cnt", LongType())])
    if flush and shards is None:
        raise ValueError("a flush goes to every shard, so their number has to be given")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch_writer(f"{folder}/deltas", keep=2)(batch, batch_id)
        sent = one_batch(spark, f"{folder}/deltas", _delta_schema(key_type), batch_id)
        sums = sent.where("key IS NOT NULL").groupBy("key").agg(F.sum("delta").alias("cnt"))
        seen = sent.where("key IS NULL").groupBy("shard").agg(F.max("n").alias("n"))
        if batch_id > 0:
            before = one_batch(spark, f"{folder}/merged", merged_schema, batch_id - 1)
            sums = sums.unionByName(before).groupBy("key").agg(F.sum("cnt").alias("cnt"))
            old = one_batch(spark, f"{folder}/seen", SEEN, batch_id - 1)
            seen = seen.unionByName(old).groupBy("shard").agg(F.max("n").alias("n"))
        batch_writer(f"{folder}/merged", keep=2)(cut_to(sums, m), batch_id)
        batch_writer(f"{folder}/seen", keep=2)(seen, batch_id)

    ends = None if shards is None else _ends(stream.sparkSession, folder, shards)
    sent = stream_deltas(stream, m, beta, shard, ends)
    progress = run(sent, each, f"{folder}/checkpoint", "update", partitions)
    if flush:
        request_flush(stream.sparkSession, folder)
        progress += run(sent, each, f"{folder}/checkpoint", "update", partitions)
    return progress


def merged_deltas(spark: SparkSession, folder: str, key_type) -> DataFrame:
    """(key, est, n): the newest second-level summary and the weight the shards had seen."""
    schema = StructType([StructField("key", key_type), StructField("cnt", LongType())])
    rows = newest(spark, f"{folder}/merged", schema)
    seen = newest(spark, f"{folder}/seen", SEEN).agg(F.sum("n").alias("n")).scalar()
    return rows.select("key", F.col("cnt").alias("est"), seen.alias("n"))
