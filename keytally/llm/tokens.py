"""Token ids in binary files: each document a zstandard frame of its own, with a shared dictionary.

Documents are range-partitioned by id, so that the files in task order hold them in ascending order. A
file is::

    MAGIC, id width in bytes (1 byte), SHA-256 of the dictionary (32 bytes)
    one zstandard frame per document
    index: per document offset, frame bytes, ids as three 64-bit numbers, then the key
           (8-byte id and a byte that is 1 for a null id)
    number of documents and offset of the index as two 64-bit numbers

all little-endian. The index makes any document a single short read. The dictionary is a file beside
them, trained on the id arrays of a bounded sample; a reader refuses files made with another one.

Texts whose only white space is single spaces and line ends between other characters are cut there, and
words before the marks at their end: the byte-level tokenizer always starts a new word at these places.
A word that is remembered is not encoded again. Other texts are encoded whole. Either way the ids are
those of the whole text.

Defined results: a null or empty text has the end id only; null ids come first; rows of one id follow
each other in the order of a hash of their texts, and share no file range by force; an empty table
gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytally.llm.files import by_bytes, open_fs
from keytally.session import work_path
from keytally.sinks.sketch_store import stored

MAGIC = b"KTID1"
END_ID = 2
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
#: The dictionary is trained on about so many documents (twice as many at most) of at most so many
#: characters, chosen by a hash.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
#: Words that a worker remembers.
CACHE_WORDS = 1_000_000
#: Words that are encoded as one text.
JOINED = 32
MANIFEST = "part int, seq int, file string, documents long, ids long"
_HEAD = struct.Struct(f"<{len(MAGIC)}sB32s")
_ENTRY = struct.Struct("<QQQqB")
_TAIL = struct.Struct("<QQ")
#: Marks and letters between which the tokenizer always starts a new word.
_MARKS = ".,!?;:%$&#*|"
_LETTERS = "A-Za-z0-9ÄÖÜäöüßàâçèéêëîïôùûáíñóú"


def _other_spaces() -> str:
    """A character class of all white space but the space and the line end."""
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and chr(c) not in " \n"]
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in spaces) + "]"


#: A text that is not words with single spaces and line ends between them.
_IRREGULAR = rf"^[ \n]|[ \n]\z|[ \n][ \n]|^\z|{_other_spaces()}"


#: A word that ends in marks; they become a word of their own that begins with ``\r``.
_MARKED = f"([{_LETTERS}])([{_MARKS}]+)\\z"


class _Table:
    """Runs of ids, one per word, one after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The runs of ``rows``, joined."""
        size = self.sizes[rows]
        ends = np.cumsum(size)
        if not len(ends):
            return self.ids[:0]
        return self.ids[np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + size, size)]

    def joined(self, other: _Table) -> _Table:
        return _Table(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))


class Encoder:
    """Ids of texts, remembering the words it has seen of late.

    A word is written with the line end before it, with ``\r`` before it where nothing is, or as it
    is where a space is.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.words = pa.array([], pa.string())
        self.table = _Table(np.zeros(0, self.kind), np.zeros(0, np.int64))

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The one encoder of this process for a tokenizer file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encoded(self, words: pa.Array) -> _Table:
        """Encodes words as lines of joined texts: a line end between lines is an id of its own."""
        names = words.to_pylist()
        lines = [w[1:] if w[0] in "\n\r" else " " + w for w in names]
        texts = ["\n".join(lines[at : at + JOINED]) for at in range(0, len(lines), JOINED)]
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        end = [self.newline]
        flat = np.array([i for one in got for i in (*one.ids, *end)], self.kind)
        ends = np.flatnonzero(flat == self.newline)
        if len(ends) != len(names):
            raise ValueError("the tokenizer does not keep line ends apart")
        # the line end after each word goes, the one that a word begins with comes before it
        sizes = np.diff(ends, prepend=-1) - 1
        after_line = np.fromiter((w[0] == "\n" for w in names), bool, len(names))
        kept = np.delete(flat, ends)
        starts = (np.cumsum(sizes) - sizes)[after_line]
        return _Table(np.insert(kept, starts, self.newline), sizes + after_line)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """The rows of ``table`` that hold the ids of different words, after learning new ones."""
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(found))
        if len(self.words) + len(new) > CACHE_WORDS:
            self.table = _Table(self.table.ids[:0], self.table.sizes[:0])
            self.words, new = self.words.slice(0, 0), words
        if len(new):
            self.table = self.table.joined(self._encoded(new))
            self.words = pa.concat_arrays([self.words, new])
            found = pc.index_in(words, value_set=self.words)
        return found.to_numpy()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        regular = texts.filter(pa.array(~odd))
        # every word of a regular text after a line end, the first one included, begins with it
        spread = pc.replace_substring(
            pc.binary_join_element_wise("", regular, "\n"), "\n", " \n"
        )
        words = pc.split_pattern(pc.utf8_slice_codeunits(spread, 1), " ")
        coded = words.values.dictionary_encode()
        index, offsets = coded.indices.to_numpy(), words.offsets.to_numpy()
        parts = pc.split_pattern(
            pc.replace_substring_regex(coded.dictionary, _MARKED, "\\1 \r\\2"), " "
        )
        units = parts.values.dictionary_encode()
        rows = self._rows(units.dictionary)[units.indices.to_numpy()]
        sizes = np.concatenate([[0], np.cumsum(self.table.sizes[rows])])[parts.offsets.to_numpy()]
        table = _Table(self.table.take(rows), np.diff(sizes))
        nth = 0
        for i in range(len(texts)):
            if odd[i]:
                got = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                yield np.array(got, self.kind)
                continue
            mine = index[offsets[nth] : offsets[nth + 1]]
            nth += 1
            yield table.take(mine)[1:]  # without the line end set before the text


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary from the ids of a bounded sample; empty if the sample is too small to train on."""
    short = docs.filter(F.length("text") <= SAMPLE_CHARS)
    share = SAMPLE_DOCS / max(1, short.count())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / (1 << 32)
    sample = short.filter(place < share).limit(2 * SAMPLE_DOCS)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for part in by_bytes(batches, "text"):
            got = [ids.tobytes() for ids in encoder.encode(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["ids"])

    arrays = [bytes(r.ids) for r in sample.select("text").mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _with(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class _Writer:
    """One file, written document by document."""

    def __init__(self, system, path: str, width: int, dictionary: bytes) -> None:
        self.out, self.path, self.offset = system.open_output_stream(path), path, _HEAD.size
        self.out.write(_HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True, **_with(dictionary))
        self.index, self.documents, self.ids, self.width = bytearray(), 0, 0, width

    def add(self, key: int | None, ids: bytes) -> None:
        frame, n = self.pack.compress(ids), len(ids) // self.width
        self.out.write(frame)
        self.index += _ENTRY.pack(self.offset, len(frame), n, key or 0, key is None)
        self.offset += len(frame)
        self.documents += 1
        self.ids += n

    def close(self) -> None:
        self.out.write(bytes(self.index))
        self.out.write(_TAIL.pack(self.documents, self.offset))
        self.out.close()


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None
) -> tuple[DataFrame, str]:
    """Writes the ids of all documents; returns the stored manifest and the dictionary's path."""
    spark = docs.sparkSession
    folder = folder or work_path(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(rows, tokenizer)
    system, root = open_fs(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string())]
        + [("documents", pa.int64()), ("ids", pa.int64())]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        encoder, files, out = Encoder.at(tokenizer), [], None
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        for rows in by_bytes(batches, "text"):
            keys = rows.column(0).to_pylist()
            for key, ids in zip(keys, encoder.encode(rows.column(1))):
                if out is None:
                    name = f"{root}/{part:08d}-{len(files):04d}-{uuid.uuid4().hex}.ids"
                    out = _Writer(system, name, encoder.width, dictionary)
                    files.append(out)
                out.add(key, ids.tobytes() + end)
                if out.offset >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(
            [
                {"part": part, "seq": i, "file": f"{folder}/{os.path.basename(f.path)}", "documents": f.documents, "ids": f.ids}
                for i, f in enumerate(files)
            ],
            schema,
        )

    # the last two columns only spread the rows of one id over tasks
    order = ["doc_id", "order", "row"]
    dealt = (
        rows.withColumn("order", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return stored(dealt.mapInArrow(write, MANIFEST), "token-manifest"), f"{folder}/dictionary"


def _open_index(stream, size: int, dictionary: bytes) -> tuple[int, int, int]:
    """The id width, the number of documents and the place of the index, from a checked file."""
    magic, width, made_with = _HEAD.unpack(stream.read_at(_HEAD.size, 0))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    if made_with != hashlib.sha256(dictionary).digest():
        raise ValueError("the file was made with another dictionary")
    return width, *_TAIL.unpack(stream.read_at(_TAIL.size, size - _TAIL.size))


def _documents(file: str, dictionary: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of every document of a file, in order, from reads of bounded size."""
    system, path = open_fs(file)
    size = system.get_file_info(path).size
    unpack = zstandard.ZstdDecompressor(**_with(dictionary))
    with system.open_input_file(path) as stream:
        width, documents, place = _open_index(stream, size, dictionary)
        step, at = READ_BYTES // _ENTRY.size, 0
        while at < documents:
            many = min(step, documents - at)
            raw = stream.read_at(many * _ENTRY.size, place + at * _ENTRY.size)
            at += many
            entries = list(_ENTRY.iter_unpack(raw))
            i = 0
            while i < len(entries):
                first, j = entries[i][0], i + 1
                while j < len(entries) and entries[j][0] + entries[j][1] - first <= READ_BYTES:
                    j += 1
                block = memoryview(stream.read_at(entries[j - 1][0] + entries[j - 1][1] - first, first))
                for offset, length, n, key, null in entries[i:j]:
                    frame = block[offset - first : offset - first + length]
                    ids = np.frombuffer(unpack.decompress(frame), f"<u{width}")
                    if len(ids) != n:
                        raise ValueError(f"{file}: a document does not have the ids its index says")
                    yield None if null else key, ids
                i = j


def read_document(file: str, dictionary_path: str, nth: int) -> np.ndarray:
    """The ids of one document of a file, by two short reads."""
    system, path = open_fs(dictionary_path)
    with system.open_input_stream(path) as stream:
        dictionary = stream.read()
    system, path = open_fs(file)
    size = system.get_file_info(path).size
    with system.open_input_file(path) as stream:
        width, _, place = _open_index(stream, size, dictionary)
        offset, length, *_ = _ENTRY.unpack(stream.read_at(_ENTRY.size, place + nth * _ENTRY.size))
        frame = stream.read_at(length, offset)
    return np.frombuffer(zstandard.ZstdDecompressor(**_with(dictionary)).decompress(frame), f"<u{width}")


def read_token_files(manifest: DataFrame, dictionary_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, a file to a task at a time."""
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(
        manifest.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("start")),
        "token-files",
    )
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if with_ids:
        fields, kinds = [*fields, ("ids", pa.list_(pa.int32()))], f"{kinds}, ids array<int>"
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(dictionary_path)
        with system.open_input_stream(path) as stream:
            dictionary = stream.read()
        for batch in batches:
            for file, start in zip(*[c.to_pylist() for c in batch.columns]):
                rows: list[dict] = []
                for key, ids in _documents(file, dictionary):
                    wide = ids.astype("<u4")
                    row = {
                        "doc_id": key,
                        "start": start,
                        "n_tokens": len(ids),
                        "ids_crc32": zlib.crc32(wide.tobytes()),
                    }
                    rows.append(row | {"ids": wide.astype(np.int32)} if with_ids else row)
                    start += len(ids)
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return placed.repartition(max(1, placed.count())).mapInArrow(read, kinds)
