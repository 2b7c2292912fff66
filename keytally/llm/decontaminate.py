"""Benchmark decontamination: an FM-index per shard of documents, searched for all test phrases.

Words are numbered by the benchmark's vocabulary; a document's other words can be in no phrase and
stand as a break between stretches. A task indexes its documents shard by shard (about ``SHARD_WORDS``
numbered words or one document), searches all windows of the benchmark backwards at once, locates their
occurrences and merges them into spans per document.

The benchmark goes to the tasks in blocks of about ``BLOCK_BYTES`` of text, a pass over the
documents for each, so that neither the driver nor a task ever holds more than one block (some 150 MB on the driver and
30 MB for a task); spans and items of the passes are merged. ``remove_contamination`` cuts the spans out of the texts,
``drop_contaminated`` leaves out whole documents.

Defined results: a null text has no words and no hits; an item of fewer words than a window is one window,
one without words is none; items that share a window are all found by it; a null item id counts
as ``null``; a very long document is an index of its own; equal phrases share their hits; repeated rows are rows of their own; without items nothing is hit. Other columns are ignored,
or kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytally.llm.files import pieces, unused
from keytally.llm.fmindex import FMIndex
from keytally.sinks.sketch_store import stored

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 2 << 20
#: Bytes that are words go over in lower case, all others become spaces.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The windows of a block of items as rows of word numbers, each with the items it is from."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for at in range(max(len(ids) - window, 0) + 1 if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.sizes = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)
        for i, p in enumerate(owners):
            self.rows[i, window - len(p) :] = p
        self.names = sorted({x for s in owners.values() for x in s})
        index = {x: i for i, x in enumerate(self.names)}
        self.owner = np.array([index[x] for s in owners.values() for x in sorted(s)], np.int64)
        self.owner_at = np.concatenate(([0], np.cumsum([len(s) for s in owners.values()]))).astype(int)

    def search(self, texts: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """Merged spans of word places, and item names, of each text (as word numbers, 0 unknown)."""
        total = sum(map(len, texts)) + len(texts)
        seq, starts, at = np.zeros(total + 1, np.int64), [], 0
        for ids in texts:
            starts.append(at)
            seq[at : at + len(ids)] = ids
            at += len(ids) + 1
        keep = seq != 0
        keep[1:] |= seq[:-1] != 0  # one break after each stretch
        keep[-1] = True
        place = np.flatnonzero(keep)
        result: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in texts]
        if not len(self.rows) or len(place) < 2:
            return result
        index = FMIndex(seq[place], len(self.number) + 1)
        lo, hi = index.ranges(self.rows, self.sizes)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return result
        many = (hi - lo)[found]
        rows = np.repeat(lo[found] - np.cumsum(many) + many, many) + np.arange(many.sum())
        phrase = np.repeat(found, many)
        spot = place[index.locate(rows)]
        text = np.searchsorted(np.array(starts), spot, side="right") - 1
        # spans: where the number of windows over a word turns from or to 0
        over = np.zeros(total + 2, np.int64)
        np.add.at(over, spot, 1)
        np.add.at(over, spot + self.sizes[phrase], -1)
        hit = np.cumsum(over) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit)).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            i = int(np.searchsorted(starts, s, side="right")) - 1
            result[i][0].append((s - starts[i], e - starts[i]))
        pairs = np.unique(text * len(self.rows) + phrase)
        names: dict[int, set[str]] = {}
        for p in pairs.tolist():
            i, w = divmod(p, len(self.rows))
            own = self.owner[self.owner_at[w] : self.owner_at[w + 1]]
            names.setdefault(i, set()).update(self.names[o] for o in own)
        for i, own in names.items():
            result[i][1].extend(sorted(own))
        return result


def _merged(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(one + two):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int, text: str) -> DataFrame:
    """One block of items searched in all documents; adds to what the last column holds."""
    text_at, found_at = docs.columns.index(text), len(docs.columns) - 1
    schema = docs.schema
    phrases = Phrases(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        numbered = 0
        get = phrases.number.get

        def flush() -> Iterator[pa.RecordBatch]:
            results = iter(phrases.search(ids))
            lengths = iter([len(x) for x in ids])
            for part in held:
                rows = []
                for old in part.column(found_at).to_pylist():
                    spans, names = next(results)
                    before = [(s["start"], s["end"]) for s in old["spans"]]
                    rows.append(
                        {
                            "n_words": next(lengths),
                            "spans": [{"start": s, "end": e} for s, e in _merged(before, spans)],
                            "items": sorted({*old["items"], *names}),
                        }
                    )
                columns = list(part.columns)
                columns[found_at] = pa.array(rows, part.schema.field(found_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

        for part in pieces(batches):
            held.append(part)
            for t in part.column(text_at).to_pylist():
                w = words(t)
                ids.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
                numbered += int(np.count_nonzero(ids[-1]))
            if numbered >= SHARD_WORDS:
                yield from flush()
                held, ids, numbered = [], [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text"
    )
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item, row.text))
        size += len(row.text or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` and a last column: number of words, merged hit spans (word places), item ids.

    The column is ``found``, or the next name with underscores that is free.
    """
    empty = F.expr(
        "named_struct('n_words', 0L, 'spans', "
        "cast(array() as array<struct<start:bigint,end:bigint>>), "
        "'items', cast(array() as array<string>))"
    )
    out, first = docs.withColumn(unused(docs, "found"), empty), True
    for block in _blocks(items, block_bytes):
        out = _pass(out if first else stored(out, "overlaps"), block, window, text)
        first = False
    return _pass(out, [], window, text) if first else out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every row."""
    found = find_overlaps(docs.select("doc_id", "text"), items, window=window)
    spans = F.col("found.spans")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        spans.alias("spans"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows in which no window occurs, with all their columns."""
    found = find_overlaps(docs, items, window=window)
    return found.filter(F.size(F.col(found.columns[-1]).spans) == 0).select(*docs.columns)


#: The words of a text that is not in lower case yet.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of some merged spans of word places, and without what lies between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows, with the hit spans cut out of their texts; the other columns stay as they are."""
    found = find_overlaps(docs, items, window=window)
    names, schema = docs.columns, docs.schema
    text_at, found_at = names.index("text"), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            texts = part.column(text_at).to_pylist()
            for i, row in enumerate(part.column(found_at).to_pylist()):
                if row["spans"]:
                    texts[i] = without_words(texts[i], [(s["start"], s["end"]) for s in row["spans"]])
            columns = list(part.columns)[:found_at]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(cut, schema)


OVERLAP_SQL = f"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), places AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i
  FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + {WINDOW} - 1), ' ') AS phrase,
    least(len(w), {WINDOW}) AS size
  FROM places
), doc_words AS (
  SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), sizes AS (
  SELECT DISTINCT size FROM windows
), doc_places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes
), found AS (
  SELECT doc_id, item, i, d.size FROM doc_places d JOIN windows v
  ON d.size = v.size AND array_to_string(list_slice(w, i, i + d.size - 1), ' ') = phrase
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""
