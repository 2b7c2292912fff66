"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

Fingerprints are made in tasks from 3-word shingles (XXH64, seed 42) and stored; from then on only
distinct fingerprints are compared.

Pigeonring (Qin and Xiao, 2018) with ``SEGMENTS`` segments and a budget of ``DISTANCE`` bits: on the
ring of segments there is a start from which every chain of l segments differs in at most
l * DISTANCE / SEGMENTS bits. With 5 segments and 2 bits the first two segments are equal, which gives 26 bits or
25 to meet on; the other bits are cut up anew by the same rule, so that fingerprints meet on 41 bits or so. The longer
chains prune the pairs that met before the full distance is taken. No pair within the distance is lost.

Defined results: a null text has no words; fewer than three words are one shingle; no words give
fingerprint 0, linked like any other. Long texts are read whole, their shingles in blocks. Copies share a
fingerprint and so a component; ties are none, as links are yes or no. Rows with equal ids are rows of their own; null ids do not
count for ``component_id``, which is null if a component has no other. An empty table gives no rows.
Other columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.components import components
from keytally.llm.files import pieces, unused
from keytally.sinks.sketch_store import stored

BITS = 64
DISTANCE = 2
SEGMENTS = 5
SHINGLE = 3
SEED = 42
BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """The hashes of the ``size``-word shingles of a text, in blocks; none without words."""
    words = (text or "").encode().lower().split()  # A-Z and the ASCII spaces only, on bytes
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        starts, ends = [0], [len(joined)]
    else:
        starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
        ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = [
            digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])
        ]
        yield np.array(hashes, np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, SHINGLE):
        n += len(hashes)
        raw = hashes.view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)) if n else 0


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long in the column ``name``."""
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            values = [_signed(fingerprint(t)) for t in part.column(at).to_pylist()]
            columns = [*part.columns, pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(add, schema)


def _segments(bits: list[int]) -> list[list[int]]:
    """Bit numbers cut into ``SEGMENTS`` runs as equal as can be."""
    size, more = divmod(len(bits), SEGMENTS)
    out, at = [], 0
    for i in range(SEGMENTS):
        end = at + size + (i < more)
        out.append(bits[at:end])
        at = end
    return out


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _chain(segments: list[list[int]], start: int, length: int) -> list[int]:
    return [b for i in range(length) for b in segments[(start + i) % SEGMENTS]]


#: The number of leading segments of a chain that have to be equal.
EQUAL = next(n for n in range(1, SEGMENTS + 1) if (n + 1) * DISTANCE >= SEGMENTS)


def _keys(bits: list[int]) -> list[tuple[int, list[int]]]:
    """For each start on the ring: its number and the bits that have to be equal."""
    segments = _segments(bits)
    return [(i, _chain(segments, i, EQUAL)) for i in range(SEGMENTS)]


def _within(a: Column, b: Column, bits: list[int], start: int) -> Column:
    """Whether each chain from ``start`` keeps within its part of the budget."""
    segments = _segments(bits)
    ok = F.lit(True)
    for length in range(EQUAL + 1, SEGMENTS + 1):
        mask = _mask(_chain(segments, start, length))
        ok = ok & (
            F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask))) <= length * DISTANCE // SEGMENTS
        )
    return ok


def _met(left: DataFrame, on: list[str], checks: Column) -> DataFrame:
    """Pairs a < b of the rows that meet on ``on`` and pass the checks.

    Never a broadcast join: Spark takes the size of exploded rows from the file below them, which is far too low.
    """
    a = left.withColumnRenamed("fp", "a")
    b = left.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return a.join(b.hint("merge"), on).filter((F.col("a") < F.col("b")) & checks & near).select("a", "b")


def links(fps: DataFrame) -> DataFrame:
    """All pairs a < b of the distinct ``fp`` that differ in at most ``DISTANCE`` bits.

    A fingerprint is one row for each start on the ring and, within it, each start on the ring of the bits
    that the first one leaves open.
    """
    every = list(range(BITS))
    fp, meets, checks = F.col("fp"), [], []
    for start, known in _keys(every):
        rest = [b for b in every if b not in set(known)]
        for _, more in _keys(rest):
            key = fp.bitwiseAND(F.lit(_mask(known + more)))
            meets.append(F.struct(F.lit(len(meets)).alias("ring"), key.alias("key")))
            checks.append(start)
    rows = fps.select("fp", F.explode(F.array(*meets)).alias("m")).select("fp", "m.ring", "m.key")
    a, b, ring = F.col("a"), F.col("b"), F.col("ring")
    chains = F.lit(False)
    for start in range(SEGMENTS):
        own = [i for i, s in enumerate(checks) if s == start]
        chains = F.when(ring.isin(own), _within(a, b, every, start)).otherwise(chains)
    return _met(rows, ["ring", "key"], chains).distinct()


def fingerprint_components(rows: DataFrame, order: Column) -> DataFrame:
    """(fp, root, first): the component of each distinct ``fp`` of ``rows``, and the least ``order`` in it."""
    own = stored(rows.groupBy("fp").agg(F.min(order).alias("own")), "fingerprints")
    linked = components(links(own.select("fp")), "fingerprint-links")
    rooted = own.join(linked, own.fp == linked.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "own"
    )
    rooted = stored(rooted, "fingerprint-roots")
    first = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return stored(rooted.join(first, "root").select("fp", "root", "first"), "fingerprint-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp")
    rows = stored(rows, "document-fingerprints")
    parts = fingerprint_components(rows, F.col("doc_id"))
    return rows.join(parts, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id, nulls last.

    Of several rows with that doc_id one stays.
    """
    fp, row = unused(docs, "fp"), unused(docs, "row")
    numbered = with_fingerprints(docs, name=fp).withColumn(row, F.monotonically_increasing_id())
    numbered = stored(numbered, "numbered-documents")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    rows = numbered.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    parts = fingerprint_components(rows, order)
    keepers = parts.select(F.col("first.row").alias(row)).distinct()
    return numbered.join(keepers, row, "left_semi").select(*docs.columns)
