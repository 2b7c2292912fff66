"""Counter summaries as bytes: one binary value per shard, for exchange with other stores and programs.

Layout, little-endian: the four letters ``KTCS``, version, kind of key (0: 64-bit integers, 1: UTF-8), two zero bytes;
then as 64-bit integers the shard, the weight seen, the floor and the number of counters; then the keys (integers, or
all lengths as 32-bit integers and then all texts), the counts and the errors; last the CRC-32 of all that. A summary that
has seen nothing has no counters.

Every reader checks letters, version, kind, zero bytes, size, checksum and that an empty one is empty, and refuses
anything else.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from keytally.operators.summaries import COUNTER_COLUMNS

# Fixed values of the format.
LETTERS = b"KTCS"
VERSION = 1
HEAD = struct.Struct("<4sBBxxqqqq")
INTEGERS, TEXTS = 0, 1


def pack(shard: int, n: int, floor: int, keys: pa.Array, cnt: np.ndarray, err: np.ndarray) -> bytes:
    text = pa.types.is_string(keys.type)
    parts = [HEAD.pack(LETTERS, VERSION, TEXTS if text else INTEGERS, shard, n, floor, len(keys))]
    if text:
        raw = [k.encode() for k in keys.to_pylist()]
        parts += [np.array([len(r) for r in raw], "<u4").tobytes(), *raw]
    else:
        parts.append(keys.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
    parts += [cnt.astype("<i8").tobytes(), err.astype("<i8").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes) -> tuple[int, int, int, list, np.ndarray, np.ndarray]:
    """(shard, n, floor, keys, counts, errors); raises ValueError for anything that ``pack`` does not give."""
    if data is None or len(data) < HEAD.size + 4:
        raise ValueError("too short for a summary")
    if data[:4] != LETTERS:
        raise ValueError("not a counter summary")
    if data[4] != VERSION:
        raise ValueError(f"format {data[4]} is not known, only {VERSION}")
    _, _, kind, shard, n, floor, count = HEAD.unpack_from(data)
    if kind not in (INTEGERS, TEXTS) or data[6:8] != b"\0\0":
        raise ValueError("unknown kind of key")
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the checksum does not match")
    if min(n, floor, count) < 0 or (n == 0 and count > 0):
        raise ValueError("an empty summary has counters, or a number is negative")
    at, end = HEAD.size, len(data) - 4
    if kind == INTEGERS:
        sizes, keys_bytes = None, 8 * count
    else:
        if at + 4 * count > end:
            raise ValueError("the size does not match the header")
        sizes = np.frombuffer(data, "<u4", count, at).astype(np.int64)
        at, keys_bytes = at + 4 * count, int(sizes.sum())
    if at + keys_bytes + 16 * count != end:
        raise ValueError("the size does not match the header")
    if sizes is None:
        keys = np.frombuffer(data, "<i8", count, at).tolist()
    else:
        ends = at + np.cumsum(sizes)
        keys = [data[e - s : e].decode() for s, e in zip(sizes.tolist(), ends.tolist())]
    at += keys_bytes
    cnt = np.frombuffer(data, "<i8", count, at)
    return shard, n, floor, keys, cnt, np.frombuffer(data, "<i8", count, at + 8 * count)


def to_bytes(summary: DataFrame) -> DataFrame:
    """(shard, data): the summary of each shard as bytes; a task holds the counters of one shard."""
    kind = summary.schema["key"].dataType
    if not isinstance(kind, (LongType, StringType)):
        raise ValueError("keys are 64-bit integers or texts")

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        heads = rows.filter(pc.is_null(rows["key"]))
        own = rows.filter(pc.is_valid(rows["key"])).sort_by([("cnt", "descending"), ("key", "ascending")])
        n, floor = (pc.sum(heads[c]).as_py() or 0 for c in ("n", "floor"))
        keys = own["key"].combine_chunks()
        data = pack(key[0].as_py(), n, floor, keys, own["cnt"].to_numpy(), own["err"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    return summary.groupBy("shard").applyInArrow(write, "shard long, data binary")


def from_bytes(packed: DataFrame, kind=LongType(), column: str = "data") -> DataFrame:
    """The summary table of the values in ``column``, whose keys are of the given kind."""
    schema = StructType(
        [StructField("shard", LongType()), StructField("key", kind)]
        + [StructField(c, LongType()) for c in COUNTER_COLUMNS]
    )
    key_type = pa.string() if isinstance(kind, StringType) else pa.int64()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                shard, n, floor, keys, cnt, err = unpack(data)
                if keys and isinstance(keys[0], str) != (key_type == pa.string()):
                    raise ValueError("the keys are of another kind")
                size = len(keys) + 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard] * size, pa.int64()),
                        "key": pa.array([None, *keys], key_type),
                        "cnt": pa.array([0, *cnt.tolist()], pa.int64()),
                        "err": pa.array([0, *err.tolist()], pa.int64()),
                        "floor": pa.array([floor] * size, pa.int64()),
                        "n": pa.array([n] + [0] * len(keys), pa.int64()),
                    }
                )

    return packed.select(F.col(column)).mapInArrow(read, schema)
