"""Text files of whitespace-separated integers as a Python data source, for batches and streams.

    register(spark)
    spark.read.format("key_text").load(folder)
    spark.readStream.format("key_text").option("triggerBytes", 1 << 30).load(folder)

Files are read by byte ranges: a range has the numbers whose first character lies in it, so a file of any size is
spread over tasks. Files (of any depth; names with a leading ``_`` or ``.`` are left out) count in the order of
their paths, and may only be added behind the last one. A stream's offset is a file and a byte of it: all before that is
read. Only the last file may still grow; what follows its last white space is waited for, until the file has a
successor or the option ``closed`` says that it is complete.

Options: ``splitBytes`` (size of a range), ``triggerBytes`` (most bytes per micro-batch; the first one after a restart takes what
is there, as Spark does not tell a Python source where it is before), ``start`` (an offset as JSON, such as the ``endOffset``
of another query's progress, to go on from), ``closed``.

Words that are no 64-bit integers are dropped; a file or folder without any gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

SCHEMA = "key long, weight long"
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
SPACES = b" \t\n\r\x0b\x0c"


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def list_files(folder: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of its files, in the order in which they count."""
    system, root = _open(folder)
    root = root.rstrip("/")
    if system.get_file_info(root).type == fs.FileType.File:
        return [("", system.get_file_info(root).size)]
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = info.path[len(root) + 1 :]
        if info.type == fs.FileType.File and not any(p[0] in "_." for p in name.split("/")):
            found.append((name, info.size))
    return sorted(found)


def _input(folder: str, name: str):
    system, root = _open(folder)
    return system.open_input_file(f"{root.rstrip('/')}/{name}" if name else root)


def _is_space(data: bytes) -> np.ndarray:
    return np.isin(np.frombuffer(data, np.uint8), np.frombuffer(SPACES, np.uint8))


def complete_bytes(folder: str, name: str, size: int) -> int:
    """The end of the last white space among the first ``size`` bytes of a file."""
    end = size
    with _input(folder, name) as file:
        while end > 0:
            start = max(0, end - 4096)
            spaces = np.flatnonzero(_is_space(file.read_at(end - start, start)))
            if len(spaces):
                return start + int(spaces[-1]) + 1
            end = start
    return 0


def parse_numbers(data: bytes) -> pa.Array:
    """The 64-bit integers among the words of ``data``."""
    words = pa.array(data.split(), pa.binary())
    text = words.filter(pc.match_substring_regex(words, r"^[+-]?[0-9]{1,18}$")).cast(pa.string())
    short = pc.replace_substring_regex(text, r"^\+", "").cast(pa.int64())
    if len(text) == len(words):
        return short
    others = words.filter(pc.match_substring_regex(words, r"^[+-]?[0-9]{19,}$")).to_pylist()
    long = [n for n in map(int, others) if -(1 << 63) <= n < 1 << 63]
    return pa.concat_arrays([short, pa.array(long, pa.int64())])


def read_range(folder: str, part: ByteRange) -> Iterator[pa.RecordBatch]:
    """The numbers that begin in a range, a block of bytes at a time."""
    with _input(folder, part.path) as file:
        at, held = part.start, b""
        # a number that began before the range belongs to the range before
        skipping = part.start > 0 and not _is_space(file.read_at(1, part.start - 1))[0]
        while True:
            block = file.read_at(min(BLOCK_BYTES, max(part.end - at, 4096)), at)
            if skipping:
                spaces = np.flatnonzero(_is_space(block))
                first = int(spaces[0]) if len(spaces) else len(block)
                if at + first >= part.end:
                    return
                skipping = not len(spaces)
                at, block = at + first, block[first:]
                if skipping and block == b"" and first:
                    continue
            over = at + len(block) - part.end
            if over >= 0 or not block:
                # beyond the end only the rest of the last number counts
                cut = max(0, len(block) - max(over, 0))
                inside, tail = held + block[:cut], block[cut:]
                if inside and not _is_space(inside[-1:])[0]:
                    inside += _rest(file, part.end, tail) if over >= 0 else b""
                yield _batch(inside)
                return
            at += len(block)
            spaces = np.flatnonzero(_is_space(block))
            if not len(spaces):
                held += block
                continue
            cut = int(spaces[-1]) + 1
            yield _batch(held + block[:cut])
            held = block[cut:]


def _rest(file, at: int, have: bytes) -> bytes:
    """What is left of the number that goes on at byte ``at``, of which ``have`` is read already."""
    out = b""
    while True:
        block = have or file.read_at(4096, at)
        if not block:
            return out
        spaces = np.flatnonzero(_is_space(block))
        if len(spaces):
            return out + block[: int(spaces[0])]
        out, at, have = out + block, at + len(block), b""


def _batch(data: bytes) -> pa.RecordBatch:
    keys = parse_numbers(data)
    ones = pa.array(np.ones(len(keys), np.int64))
    return pa.RecordBatch.from_arrays([keys, ones], names=["key", "weight"])


class KeyTextSource(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return "key_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "KeyTextReader":
        return KeyTextReader(self.options)

    def streamReader(self, schema) -> "KeyTextStreamReader":
        return KeyTextStreamReader(self.options)


class _Ranges:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("splitBytes must be positive")

    def ranges(self, name: str, start: int, end: int) -> list[ByteRange]:
        cuts = [*range(start, end, self.split), end]
        return [ByteRange(name, a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(self.folder, partition)


class KeyTextReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        found = [r for name, size in list_files(self.folder) for r in self.ranges(name, 0, size)]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.end == 0 else super().read(partition)


class KeyTextStreamReader(_Ranges, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.most = int(options.get("triggerBytes", 0))
        self.closed = options.get("closed", "false").lower() == "true"
        self.start = json.loads(options["start"]) if "start" in options else {"file": "", "at": 0}
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        self.known = self.start
        return self.start

    def latestOffset(self) -> dict:
        files = list_files(self.folder)
        if not files:
            return self.known or self.start
        name, size = files[-1]
        end = {"file": name, "at": size if self.closed else complete_bytes(self.folder, name, size)}
        if self.most and self.known is not None:
            end = self._limited(files, end)
        return end

    def _limited(self, files: list[tuple[str, int]], end: dict) -> dict:
        left, at = self.most, self.known
        for name, size in files:
            if name < at["file"]:
                continue
            begin = at["at"] if name == at["file"] else 0
            last = end["at"] if name == end["file"] else size
            if last - begin > left:
                return {"file": name, "at": begin + left}
            left -= max(0, last - begin)
        return end

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self.known = end
        found = []
        for name, size in list_files(self.folder):
            if start["file"] <= name <= end["file"]:
                begin = start["at"] if name == start["file"] else 0
                last = end["at"] if name == end["file"] else size
                found += self.ranges(name, begin, last)
        return found

    def commit(self, end: dict) -> None:
        self.known = end


def register(spark: SparkSession) -> None:
    """Makes the format ``key_text`` known to the session."""
    spark.dataSource.register(KeyTextSource)
