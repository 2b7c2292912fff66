"""WARC archives written by tasks and read back as a chunked record table.

``write_archives`` streams every record into gzip members of bounded archives;
``read_chunks`` turns archives into rows (record_id, chunk_no, data) of at most ``chunk_bytes``,
each carrying the digest and length of the payload up to its end. No reader holds a whole record:
archives are read, unpacked and hashed piece by piece.

Defined results: a null payload is empty; a null id is written as ``null`` and read as null; of equal
payloads of at least ``min_bytes`` the rows with the smallest id are responses (all of them, if
that id is repeated) and the others revisits; a group whose ids are all null has responses only; an
empty table gives no archive and no chunk. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytally.llm.files import open_fs, pieces
from keytally.session import work_path
from keytally.sinks.sketch_store import stored

ARCHIVE_BYTES = 256 << 20
CHUNK_BYTES = 1 << 20
READ_BYTES = 1 << 18
ID_PREFIX = "urn:page:"
MANIFEST = "archive string, records long, bytes long"
CHUNKS = (
    "archive string, record_id string, page_id long, url string, record_type string, "
    "refers_to long, declared_digest string, payload_bytes long, payload_digest string, "
    "chunk_no long, data binary, is_last boolean"
)


def with_revisits(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, first): first is the id of the response that the row revisits, or null.

    Payloads are compared by SHA-1 and length. Only groups of two rows or more are stored and
    joined, so that payloads move between tasks only if those groups are many.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.encode(payload, "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.length("payload").alias("n"))
    groups = (
        rows.filter(F.col("n") >= min_bytes)
        .groupBy("sha1", "n")
        .agg(F.min("id").alias("first"), F.count("*").alias("rows"))
        .filter("rows > 1")
        .drop("rows")
    )
    joined = rows.join(stored(groups, "payload-groups"), ["sha1", "n"], "left")
    first = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("id", "url", "payload", "sha1", first.alias("first"))


def _field(text: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in text or "")


def _write_record(out, row: dict, page: bytes) -> int:
    """One record as a gzip member of its own, the payload in pieces; the bytes written."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(page)}\r\n\r\n"
    ).encode()
    revisit = row["first"] is not None
    name = "null" if row["id"] is None else row["id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID_PREFIX}{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_field(row['url'])}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(page))}",
    ]
    if revisit:
        lines += [
            f"WARC-Refers-To: <{ID_PREFIX}{row['first']}>",
            "WARC-Profile: "
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    size = out.write(pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + http)) or 0
    if not revisit:
        view = memoryview(page)
        for at in range(0, len(page), READ_BYTES):
            size += out.write(pack.compress(view[at : at + READ_BYTES])) or 0
    return size + (out.write(pack.compress(b"\r\n\r\n") + pack.flush()) or 0)


def write_archives(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Writes all rows to archives under ``folder``; returns the stored manifest of the archives."""
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        out, name, done, records, size = None, "", [], 0, 0
        for part in pieces(batches, 64):
            for row in part.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, size = system.open_output_stream(f"{root}/{name}"), 0, 0
                size += _write_record(out, row, row["payload"])
                records += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{n}" for n in names], pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(sizes, pa.int64()),
            ],
            names=["archive", "records", "bytes"],
        )

    rows = with_revisits(pages, key, url, payload, min_bytes)
    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class _Archive:
    """Unpacked bytes of an archive, taken in order; holds little more than a read block."""

    def __init__(self, stream) -> None:
        self.stream, self.rest, self.packed = stream, bytearray(), b""
        self.unpack = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.stream.read(READ_BYTES)
                if not self.packed:
                    return False
            got = self.unpack.decompress(self.packed, READ_BYTES)
            self.packed = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.packed = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if got:
                self.rest += got
                return True

    def head(self) -> list[str] | None:
        """The lines up to an empty one, or None at the end of the archive."""
        while (end := self.rest.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.rest.strip():
                    raise ValueError("the archive ends within a header")
                return None
        lines = bytes(self.rest[:end]).decode().split("\r\n")
        del self.rest[: end + 4]
        return lines

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one."""
        while len(self.rest) < most and self.more():
            pass
        got = bytes(self.rest[:most])
        if not got:
            raise ValueError("the archive ends within a record")
        del self.rest[:most]
        return got


def _number(name: str | None) -> int | None:
    tail = (name or "").strip("<>").removeprefix(ID_PREFIX)
    return None if tail in ("", "null") else int(tail)


def _records(archive: str, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of one archive, in order."""
    system, path = open_fs(archive)
    with system.open_input_stream(path) as stream:
        source = _Archive(stream)
        while (head := source.head()) is not None:
            if head[0] != "WARC/1.1":
                raise ValueError(f"{archive}: no record where one should start")
            fields = dict(line.split(": ", 1) for line in head[1:])
            http = source.head() or []
            block = int(fields["Content-Length"]) - sum(len(x.encode()) + 2 for x in http) - 2
            size = next(int(x.split(": ")[1]) for x in http if x.startswith("Content-Length: "))
            row = {
                "archive": archive,
                "record_id": fields["WARC-Record-ID"].strip("<>"),
                "page_id": _number(fields["WARC-Record-ID"]),
                "url": fields.get("WARC-Target-URI"),
                "record_type": fields["WARC-Type"],
                "refers_to": _number(fields.get("WARC-Refers-To")),
                "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            }
            if row["record_type"] == "revisit":
                yield row | {
                    "payload_bytes": size,
                    "payload_digest": row["declared_digest"],
                    "chunk_no": 0,
                    "data": None,
                    "is_last": True,
                }
            else:
                running, done, number = hashlib.sha1(), 0, 0
                while True:
                    data = source.take(min(chunk_bytes, block - done)) if done < block else b""
                    running.update(data)
                    done += len(data)
                    yield row | {
                        "payload_bytes": done,
                        "payload_digest": base64.b32encode(running.digest()).decode(),
                        "chunk_no": number,
                        "data": data,
                        "is_last": done == block,
                    }
                    number += 1
                    if done == block:
                        break
                digest = base64.b32encode(running.digest()).decode()
                if (done, digest) != (size, row["declared_digest"]):
                    raise ValueError(f"{archive}: {row['record_id']} is damaged")
            if source.take(4) != b"\r\n\r\n":
                raise ValueError(f"{archive}: {row['record_id']} does not end where it should")


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of all archives of a manifest, an archive to a task at a time.

    ``payload_bytes`` and ``payload_digest`` run along: on the row with ``is_last`` they are those of
    the whole payload. A revisit has one row without data, with what its header says.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in ("archive", "record_id")]
            + [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string())]
            + [("refers_to", pa.int64()), ("declared_digest", pa.string())]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
            + [("chunk_no", pa.int64()), ("data", pa.binary()), ("is_last", pa.bool_())]
        )
        rows, size = [], 0
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                for row in _records(archive, chunk_bytes):
                    rows.append(row)
                    size += len(row["data"] or b"") + 512
                    if size >= 4 * chunk_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    archives = max(1, manifest.count())
    return manifest.select("archive").repartition(archives).mapInArrow(read, CHUNKS)


def whole_records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the totals that its last chunk carries."""
    return chunks.filter("is_last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url",
        (F.col("chunk_no") + 1).alias("n_chunks"),
    )


#: DuckDB SQL of the records that ``pages`` gives: SHA-1 in base 32 from four groups of 40 bits.
RECORDS_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INTEGER), 10) AS BIGINT)
        >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS f FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f IS NULL OR page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM firsts"""
