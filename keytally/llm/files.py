"""Files that tasks write to and read from the shared folder.

A task writes under a name of its own and reports it in its result rows. Only files that a stored
table of such rows (the manifest) names belong to the output, so a task that ran twice, or a
lost executor, leaves at most an unnamed file behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame


def open_fs(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder given as a path or as a URI."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in short pieces, so that few texts at a time become Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, rows)


def by_bytes(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column has about ``most`` bytes in each, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
