"""Running a streaming plan and keeping its snapshots.

Every micro-batch writes its own ``batch=<id>`` folder, overwritten if the batch is run again
after a failure, so results are exactly-once. Where the folder holds a whole snapshot, only the
newest one is read back, and a writer told how many to ``keep`` removes those before.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from keytally.session import ROCKSDB_PROVIDER
from keytally.sinks.folders import names, remove

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """State is kept in RocksDB, on disk and checkpointed, in ``partitions`` partitions (the
    session's shuffle partitions where omitted). A query takes the settings when it starts; the
    number of partitions stays with its checkpoint."""
    wanted = {PROVIDER: ROCKSDB_PROVIDER}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the query; by default it ends once everything that is there has been read."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each_batch)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class ProgressListener(StreamingQueryListener):
    """Keeps the progress of every micro-batch of one query, however many there are."""

    def __init__(self) -> None:
        self.rows: dict[int, object] = {}
        self.run_id: str | None = None
        self.early: list[object] = []
        self.ended = threading.Event()

    def follow(self, query: StreamingQuery) -> None:
        """From now on only events of this query count; those that came before are looked through."""
        self.run_id = str(query.runId)
        for event in self.early:
            self._take(event)

    def _take(self, event) -> None:
        progress = getattr(event, "progress", None)
        if str((progress or event).runId) != self.run_id:
            return
        if progress is None:
            self.ended.set()
        else:
            self.rows[progress.batchId] = progress

    def _seen(self, event) -> None:
        if self.run_id is None:
            self.early.append(event)
        else:
            self._take(event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._seen(event)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._seen(event)


def run(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    partitions: int | None = None,
    drain: bool = False,
) -> list:
    """Reads all that is there, in as many micro-batches as the source makes, and returns the
    progress of each, as the query's own events report it.

    ``drain`` is for sources that limit a micro-batch by themselves, such as ``key_text``: Spark would give
    such a source one micro-batch only when it is asked for what is available now.
    """
    spark = stream.sparkSession
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        with state_settings(spark, partitions):
            trigger = {"processingTime": "0 seconds"} if drain else None
            query = start(stream, each_batch, checkpoint, mode, trigger)
            listener.follow(query)
            if drain:
                try:
                    query.processAllAvailable()
                finally:
                    query.stop()
            else:
                query.awaitTermination()
        # events come after the query, on a thread of their own
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    return [listener.rows[number] for number in sorted(listener.rows)]


QUERIES = "queries"


def progress_table(spark: SparkSession, progress: list) -> DataFrame:
    """(batch, operations, queries, ms) per micro-batch, as the throughput reports take it.

    Queries are those that the stream counts by ``observe(QUERIES, ... .alias("n"))``; see ``marks``.
    """
    rows = []
    for p in progress:
        seen = p.observedMetrics.get(QUERIES)
        asked = int(seen["n"] or 0) if seen is not None else 0
        rows.append((p.batchId, p.numInputRows, asked, p.durationMs.get("triggerExecution", 0)))
    return spark.createDataFrame(rows, "batch long, operations long, queries long, ms long")


def batch_writer(path: str, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch; with ``keep``, the one that falls out of the last so many is removed.

    A micro-batch may be run again, and reads the one before it, so at least two are kept.
    """
    if keep is not None and keep < 2:
        raise ValueError("at least two micro-batches have to be kept")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if keep is not None and batch_id >= keep:
            remove(batch.sparkSession, f"{path}/batch={batch_id - keep}")

    return write


def batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All written rows with their ``batch``."""
    return spark.read.schema(_with_batch(schema)).option("basePath", path).parquet(path)


def _with_batch(schema: StructType | str) -> StructType:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return StructType(schema.fields).add("batch", "long")


def one_batch(spark: SparkSession, path: str, schema: StructType | str, batch_id: int) -> DataFrame:
    """What one micro-batch wrote."""
    return spark.read.schema(schema).parquet(f"{path}/batch={batch_id}")


def newest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the newest micro-batch that was written to its end; only folder names are looked at."""
    numbers = sorted(int(n.split("=")[1]) for n in names(spark, path) if n.startswith("batch="))
    for number in reversed(numbers):
        if "_SUCCESS" in names(spark, f"{path}/batch={number}"):
            return one_batch(spark, path, schema, number)
    return spark.createDataFrame([], StructType.fromDDL(schema) if isinstance(schema, str) else schema)
