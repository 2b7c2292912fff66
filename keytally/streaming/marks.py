"""Questions asked while a stream is counted: a mark per so many inserted rows, answered as of that row.

The rows carry their position in the stream. A mark goes to every owner; an owner counts the rows before a
mark, answers it from its counters and goes on. Rows between two marks are summed per key within the tasks
first, so a hot key is a few rows per mark. An answer has the counters that may reach the share asked for, the weight
that the owner has seen by then, and how long the owner took and the mark had been waiting.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keytally.operators.kernels import key_array
from keytally.operators.summaries import compacted_tables
from keytally.streaming.counters import SummaryProcessor
from keytally.streaming.runner import QUERIES, batch_writer, batches, run

MILLION = 1_000_000


def rows_per_mark(rate: int) -> int:
    """Rows between two marks at ``rate`` questions per million rows."""
    if not 0 < rate <= MILLION:
        raise ValueError("a rate lies between 1 and a million questions per million rows")
    return MILLION // rate


def with_marks(stream: DataFrame, order: str, rate: int, owner: Column, owners: int) -> DataFrame:
    """(owner, step, key, weight, asked): the rows, and behind every last row of a step a mark for each owner.

    ``stream`` has key, weight and ``order``, the row's position from 0 on; a row without a key counts as a
    position only. Marks have ``asked``, the time (in microseconds) their micro-batch began, and no meaning in
    their key, which is not null so that pandas keeps whole numbers whole.
    """
    every = rows_per_mark(rate)
    step = F.floor(F.col(order) / F.lit(every)).cast("long")
    none = F.lit(None).cast("long")
    insert = F.struct(
        owner.cast("long").alias("owner"), step.alias("step"), "key", "weight", none.alias("asked")
    )
    key_type = stream.schema["key"].dataType

    def mark(o: Column) -> Column:
        return F.struct(
            o.alias("owner"),
            step.alias("step"),
            F.lit(0).cast(key_type).alias("key"),
            F.lit(0).cast("long").alias("weight"),
            F.unix_micros(F.current_timestamp()).alias("asked"),
        )

    numbers = F.array(*[F.lit(i).cast("long") for i in range(owners)])
    last = (F.col(order) + 1) % every == 0
    both = F.when(last, F.concat(F.array(insert), F.transform(numbers, mark))).otherwise(F.array(insert))
    counted = stream.observe(QUERIES, F.count_if(last).alias("n"))
    rows = counted.select(F.explode(both).alias("_r")).select("_r.*")
    return rows.where("key IS NOT NULL")


def _summed(rows: DataFrame) -> DataFrame:
    schema = rows.select("owner", "step", "key", "weight", "asked").schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for table in compacted_tables(batches, ["owner", "step", "key", "asked"]):
            yield from table.select(arrow.names).cast(arrow).to_batches()

    return rows.mapInArrow(add, schema)


def answer_schema(key_type) -> StructType:
    longs = ("mark", "owner", "est", "lower", "upper", "n", "latency_us", "waited_us")
    fields = [StructField(c, LongType()) for c in longs]
    return StructType([*fields[:2], StructField("key", key_type), *fields[2:]])


class MarkProcessor(SummaryProcessor):
    """An owner's summary, which answers the marks among its rows. Rows of one micro-batch are held in sums."""

    def __init__(self, m: int, key_type, phi: float) -> None:
        super().__init__(m, key_type)
        self.phi = phi

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        summary = self._load()
        for step, part in pd.concat(list(rows)).groupby("step", sort=True):
            inserts = part[part["asked"].isna()]
            if len(inserts):
                sums = inserts.groupby("key", as_index=False)["weight"].sum()
                summary.add(key_array(sums["key"]), sums["weight"].to_numpy("int64"))
            marks = part[part["asked"].notna()]
            if len(marks):
                yield self._answer(int(key[0]), int(step) + 1, summary, int(marks["asked"].min()))
        self._store(summary)

    def _answer(self, owner: int, mark: int, summary, asked: int) -> pd.DataFrame:
        began = time.perf_counter_ns()
        keys, cnt, err = summary.rows()
        # an owner sees a part of the stream, so its own threshold is below that of the whole
        found = [i for i, c in enumerate(cnt) if c >= self.phi * summary.n]
        rows = {
            "mark": mark,
            "owner": owner,
            "key": pd.Series([None, *[keys[i] for i in found]], dtype=object),
            "est": [0, *[cnt[i] for i in found]],
            "lower": [0, *[cnt[i] - err[i] for i in found]],
            "upper": [0, *[cnt[i] for i in found]],
            "n": [summary.n] + [0] * len(found),
        }
        frame = pd.DataFrame(rows)
        frame["latency_us"] = max(1, (time.perf_counter_ns() - began) // 1000)
        frame["waited_us"] = max(0, time.time_ns() // 1000 - asked)
        return frame


def run_marks(
    stream: DataFrame,
    m: int,
    phi: float,
    order: str,
    rate: int,
    owner: Column,
    owners: int,
    folder: str,
    partitions: int | None = None,
) -> list:
    """Counts the stream with ``m`` counters per owner and answers its marks under ``folder``."""
    key_type = stream.schema["key"].dataType
    answers = (
        _summed(with_marks(stream, order, rate, owner, owners))
        .groupBy("owner")
        .transformWithStateInPandas(
            statefulProcessor=MarkProcessor(m, key_type, phi),
            outputStructType=answer_schema(key_type),
            outputMode="Update",
            timeMode="None",
        )
    )
    write = batch_writer(f"{folder}/answers")
    return run(answers, write, f"{folder}/checkpoint", "update", partitions)


def _answers(spark: SparkSession, folder: str, key_type) -> DataFrame:
    return batches(spark, f"{folder}/answers", answer_schema(key_type))


def marks_seen(spark: SparkSession, folder: str, key_type) -> DataFrame:
    """(mark, owners, n, latency_us, waited_us): who answered, the weight by then, the slowest owner's times."""
    heads = _answers(spark, folder, key_type).where(F.col("key").isNull())
    return heads.groupBy("mark").agg(
        F.count(F.lit(1)).alias("owners"),
        F.sum("n").alias("n"),
        F.max("latency_us").alias("latency_us"),
        F.max("waited_us").alias("waited_us"),
    )


def frequent_at_marks(spark: SparkSession, folder: str, key_type, phi: float, owners: int) -> DataFrame:
    """(mark, key, est, lower, upper, n, latency_us): the answer to each mark that all owners have answered."""
    rows = _answers(spark, folder, key_type).where(F.col("key").isNotNull())
    whole = marks_seen(spark, folder, key_type).where(F.col("owners") == owners)
    met = rows.select("mark", "key", "est", "lower", "upper").join(
        whole.select("mark", "n", "latency_us"), "mark"
    )
    return met.where(F.col("est") >= F.lit(phi) * F.col("n"))


def average_latency(spark: SparkSession, folder: str, key_type) -> DataFrame:
    """One row: the questions asked and the mean time in microseconds to answer one."""
    return marks_seen(spark, folder, key_type).agg(
        F.count(F.lit(1)).alias("queries"), F.avg("latency_us").alias("latency_us")
    )


def counts_up_to(counts: DataFrame, found: DataFrame, last: Column) -> DataFrame:
    """(key, mark, until, cnt, est, lower, upper): the weight of a key at the marks from ``mark`` to ``until``.

    ``counts`` has (step, key, cnt), ``found`` the answers, which also begin such a run, so an answer's row has the true
    weight at its mark. There are as many rows as in both tables: a weight that stays is not repeated per mark.
    """
    none = [F.lit(None).cast("long").alias(c) for c in ("est", "lower", "upper")]
    grown = counts.where(F.col("step") < last).select((F.col("step") + 1).alias("mark"), "key", "cnt", *none)
    asked = found.select("mark", "key", F.lit(0).cast("long").alias("cnt"), "est", "lower", "upper")
    along = Window.partitionBy("key").orderBy("mark")
    return grown.unionByName(asked).select(
        "key",
        "mark",
        (F.coalesce(F.lead("mark").over(along), last + 1) - 1).alias("until"),
        F.sum("cnt").over(along).alias("cnt"),
        *("est", "lower", "upper"),
    )


def frequent_up_to(runs: DataFrame, phi: float, every: int) -> DataFrame:
    """(mark, key) of the keys of ``counts_up_to`` that have the share ``phi`` of the rows up to a mark: no more than
    1 / phi of them per mark. A run of equal weight reaches the share up to some mark of its own."""
    reached = F.ceil(F.col("cnt") / F.lit(phi * every)).cast("long")
    end = F.least("until", reached)
    marks = F.when(end >= F.col("mark"), F.sequence("mark", end))
    rows = runs.select("key", "cnt", F.explode(marks).alias("mark"))
    return rows.where(F.col("cnt") >= F.lit(phi) * every * F.col("mark")).select("mark", "key")


def faults_at_marks(
    counts: DataFrame, found: DataFrame, seen: DataFrame, phi: float, every: int
) -> DataFrame:
    """(mark, faults) where there are any: the answers at a mark whose bounds do not hold for the rows up to it, and
    the keys that reach the share without an answer.

    The rows worked on grow with the rows of the stream and with marks / phi, not with keys x marks.
    """
    last = seen.agg(F.max("mark").alias("last")).scalar()
    runs = counts_up_to(counts, found, last)
    wrong = runs.where((F.col("lower") > F.col("cnt")) | (F.col("upper") < F.col("cnt"))).select("mark")
    missed = frequent_up_to(runs, phi, every).join(found.select("mark", "key"), ["mark", "key"], "left_anti")
    return wrong.union(missed.select("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("faults"))
