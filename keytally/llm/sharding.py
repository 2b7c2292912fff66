"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions.

The shard of a row follows from its key and the number of shards alone: there is no ring table, no
shuffle is needed to find it, and with one shard more a row stays or moves to the new shard.

Slots number the rows of a shard without gaps. Rows are numbered within the part of the input
that a task reads, and only the counts of (shard, part) are added up across parts, so that no task
ever holds a whole shard.

Defined results: a null key is the key of a text that no number has; a null text has 0 bytes and CRC 0;
repeated rows share a shard and get slots of their own; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytally.sinks.sketch_store import stored

SHARDS = 40
ROW_BYTES = 16
#: Fixed values of the published algorithm: the multiplier of its generator, in 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def key_halves(key: Column) -> Column:
    """A 64-bit hash of a key as two numbers of 32 bits, equal on every engine with MD5."""
    text = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    return F.struct(half(1).alias("hi"), half(9).alias("lo"))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state modulo 2^64. Products are of 16 by 32 bits, so none overflows."""
    mask, low16 = F.lit(MASK), F.lit(0xFFFF)
    p = lo.bitwiseAND(low16) * LOW + 1
    q = F.shiftrightunsigned(lo, 16) * LOW
    bottom = p + F.shiftleft(q.bitwiseAND(low16), 16)
    carry = F.shiftrightunsigned(bottom, 32) + F.shiftrightunsigned(q, 16)

    def times(x: Column, y: int) -> Column:
        top = (F.shiftrightunsigned(x, 16) * y).bitwiseAND(low16)
        return (x.bitwiseAND(low16) * y + F.shiftleft(top, 16)).bitwiseAND(mask)

    return (carry + times(hi, LOW) + times(lo, HIGH)).bitwiseAND(mask), bottom.bitwiseAND(mask)


def _jumps(state: Column, shards: int, steps: int) -> Column:
    """``state`` after at most ``steps`` jumps; a state past the last shard stays as it is."""

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next(s.hi, s.lo)
        gap = F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")
        to = F.floor((s.j + 1).cast("double") * gap)
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s.j.alias("b"), to.alias("j"))
        return F.when(s.j < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, jump)


def jump_shard(halves: Column, shards: int) -> Column:
    """The shard of a key.

    ``ln(shards)`` jumps are expected; the rare key that needs more than ``shorter`` goes on to the
    most there can be, one jump per shard.
    """
    start = F.struct(
        halves.hi.alias("hi"),
        halves.lo.alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    shorter = min(shards, 4 * shards.bit_length())
    state = _jumps(start, shards, shorter)
    if shorter < shards:
        state = F.aggregate(
            F.array(state),
            start,
            lambda _, s: F.when(s.j < shards, _jumps(s, shards, shards)).otherwise(s),
        )
    return state.b.cast("int")


def with_slots(rows: DataFrame, shard: str, part: str, row: str) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 .. within each shard, by input part and then by ``row``."""
    counts = rows.groupBy(shard, part).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy(shard, part).orderBy(row)
    return (
        rows.withColumn("nth", F.row_number().over(within))
        .join(offsets, [shard, part])
        .withColumn("slot", F.col("before") + F.col("nth") - 1)
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    number = F.monotonically_increasing_id()
    halves = F.col("halves")
    sized = docs.select(
        "doc_id",
        (F.length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftright(number, 33).alias("part"),
        number.alias("row"),
        key_halves(F.col("doc_id")).alias("halves"),
    )
    rows = stored(
        sized.select(
            "doc_id", "size", "text_crc32", "part", "row",
            jump_shard(halves, shards).alias("shard"),
            jump_shard(halves, shards + 1).alias("grown_shard"),
        ),
        "shards",
    )
    return with_slots(rows, "shard", "part", "row").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
