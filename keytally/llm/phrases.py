"""Phrase collocation mining by broadcast double-array tries.

Texts are read in blocks of bytes; numpy finds the words of a block and gives each a 64-bit hash. Three steps, each of
passes over all texts whose partial counts Spark sums:

1. Words are counted per language. No two words may share a hash; if two do, the seed is changed and the
   step done again, so hashes stand for words from then on.
2. For 2 and then 3 words: the phrases whose parts are frequent, seen often enough in counts that stop at the
   threshold, are the Apriori-safe candidates. Which parts are frequent is told by a bit map of ``MAP_BITS`` bits (8 MB)
   whatever the number of phrases; a wrong yes only lets more through.
3. Blocks of about ``BLOCK_PHRASES`` candidates and frequent words, dealt by a hash of their first two words, become
   double-array tries. Up to ``TRIES`` of them are broadcast and counted in one pass: all positions of a text block enter
   at their language's node and go on word by word, all at once; where a state accepts, its phrase is counted by bincount,
   and the counts of all tasks are summed. These are the counts given out.

A trie has at most 12 nodes per phrase of its block, so what is broadcast and what the driver holds is bounded
by ``BLOCK_PHRASES`` and ``TRIES``. More candidates mean more broadcasts, but not more passes over the texts: if there are more than
``TRIES`` blocks, one pass writes what enters the tries, the longest run of words from a position on that the bit maps let
through and how often it occurs, dealt like the phrases, and each trie takes its own block of them.

Defined results: a null text has no words, a null language is ``und``; texts of any length are read whole, in blocks that
overlap by two words; a text without letters gives no rows; copies and repeated rows count as often as they occur; ties in
the score go by count and then by phrase; equal ids and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytally.llm import trie
from keytally.sinks.sketch_store import stored

LONGEST = 3
LEAST_COUNT = 10
TOP = 2000
ABSORB_PERCENT = 50
MILLION = 1_000_000

BLOCK_BYTES = 1 << 18
BATCH_BYTES = 1 << 21
FLUSH_ROWS = 1 << 18
MAP_BITS = 26
BLOCK_PHRASES = 1 << 20
TRIES = 2
BLOCK_PARTS = 8
SEEDS = 16
#: Characters between words and characters that end a piece.
SPACES, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"

_kind = np.full(256, 2, np.uint8)
_kind[list(SPACES)], _kind[list(STOPS)] = 0, 1
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


@dataclass
class Hasher:
    """Hashes of byte ranges: sums of a number per byte times a power of an odd number, modulo 2^64."""

    seed: int

    def __post_init__(self) -> None:
        random = np.random.default_rng(self.seed)
        self.table = random.integers(1, 1 << 63, 256, np.uint64)[_lower]
        self.factor = int(random.integers(1, 1 << 62)) * 2 + 1
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        def powers(factor: int) -> np.ndarray:
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            return np.multiply.accumulate(row)

        self.up = powers(self.factor)
        self.down = powers(pow(self.factor, -1, 1 << 64))

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        found = (sums[end] - sums[start]) * self.down[start]
        found ^= found >> np.uint64(32)
        return np.where(found == 0, np.uint64(1), found)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    h = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = ((h ^ (h >> np.uint64(31))) + b) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of a text block; ``follows``: the next word is in the same piece; ``own``: counted here."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    follows: np.ndarray
    own: np.ndarray

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at some positions, in lower case."""
        size = self.end[at] - self.start[at]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        data = _lower[self.data[where]].tobytes()
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))

    def starts_of(self, size: int) -> np.ndarray:
        """The positions at which a phrase of so many words begins."""
        ok = self.own.copy()
        for i in range(size - 1):
            ok[: len(ok) - i] &= self.follows[i:]
            ok[len(ok) - i :] = False
        return np.flatnonzero(ok)


def find_words(data: np.ndarray, offsets: np.ndarray, own: int, hasher: Hasher) -> Words:
    """The words of the rows ``data[offsets[i] : offsets[i + 1]]``; those from byte ``own`` on are only read ahead."""
    kind = _kind[data]
    letter = kind == 2
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = letter[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    start = np.flatnonzero(letter & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = letter[1:]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(letter & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    stops = np.cumsum(kind == 1, dtype=np.int32)[start]
    follows = np.zeros(len(start), bool)
    follows[:-1] = (stops[1:] == stops[:-1]) & (row[1:] == row[:-1])
    return Words(data, start, end, hasher.ranges(data, start, end), row, follows, start < own)


def _read_ahead(data: np.ndarray, at: int, words: int) -> int:
    """The end of so many words from ``at`` on, or of their piece."""
    step = 4096
    while at < len(data):
        kind = _kind[data[at : at + step]]
        letter = kind == 2
        ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        stop = np.flatnonzero(kind == 1)
        if len(stop) and (len(ends) < words or stop[0] <= ends[words - 1]):
            return at + int(stop[0])
        if len(ends) >= words:
            return at + int(ends[words - 1])
        if at + step >= len(data):
            break
        step *= 4
    return len(data)


def text_blocks(
    batches: Iterator[pa.RecordBatch], hasher: Hasher
) -> Iterator[tuple[list[str], Words]]:
    """(languages of the rows, words) of about ``BLOCK_BYTES`` bytes of (lang, text) rows at a time."""
    for batch in batches:
        langs = pc.fill_null(batch.column(0), "und")
        texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), len(texts))
            rows = langs.slice(at, to - at).to_pylist()
            part = data[offsets[at] : offsets[to]]
            if to > at + 1 or len(part) <= BLOCK_BYTES:
                yield rows, find_words(part, offsets[at : to + 1] - offsets[at], len(part), hasher)
            else:
                yield from ((rows, words) for words in _long_text(part, hasher))
            at = to


def _long_text(data: np.ndarray, hasher: Hasher) -> Iterator[Words]:
    at = 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        # up to the end of the word it falls into
        while end < len(data) and _kind[data[end]] == 2:
            end += 1
        ahead = _read_ahead(data, end, LONGEST - 1)
        yield find_words(data[at:ahead], np.array([0, ahead - at]), end - at, hasher)
        at = end


class Languages:
    """The languages a task has met, as numbers and as hashes."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def of_rows(self, langs: list[str]) -> np.ndarray:
        for lang in dict.fromkeys(langs):
            if lang not in self.number:
                self.number[lang] = len(self.number)
                raw = np.frombuffer(lang.encode() + b"\0", np.uint8)
                own = Hasher(0).ranges(raw, np.array([0]), np.array([len(raw)]))
                self.hashes = np.concatenate([self.hashes, own])
        return np.array([self.number[lang] for lang in langs], np.int32)

    def column(self, numbers: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(numbers, list(self.number)).cast(pa.string())


def _keys(words: Words, lang: np.ndarray, size: int) -> np.ndarray:
    """The hash of (language, ``size`` words) from each position on; only valid where a phrase begins."""
    key = joined(lang, words.hash)
    for i in range(1, size):
        rest = np.zeros_like(key)
        rest[: len(rest) - i] = words.hash[i:]
        key = joined(key, rest)
    return key


def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - MAP_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _safe_starts(words: Words, lang: np.ndarray, maps: list[np.ndarray], size: int) -> np.ndarray:
    """Positions of phrases of ``size`` words whose shorter parts are all in the ``maps``."""
    at = words.starts_of(size)
    for part in range(1, min(size, len(maps) + 1)):
        keys = _keys(words, lang, part)
        for i in range(size - part + 1):
            at = at[_in_map(maps[part - 1], keys[at + i])]
    return at


# --- the passes


@contextmanager
def small_batches(spark: SparkSession):
    """Texts go to the tasks ``BATCH_BYTES`` at a time, or a row, and not 10 000 rows: a batch is held outside the heap
    of an executor and again by the Python worker. A job takes the setting when it starts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, f) of all words; blocks are summed in the tasks before Spark's partial sums."""
    names = ["lang", "h", "word"]

    def flush(waiting: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        sums = pa.concat_tables(waiting).group_by(names).aggregate([("f", "sum")])
        yield from sums.select([*names, "f_sum"]).rename_columns([*names, "f"]).to_batches(1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, waiting, rows = Languages(), [], 0
        for langs, words in text_blocks(batches, Hasher(seed)):
            lang = met.of_rows(langs)[words.row]
            at = words.starts_of(1)
            key = joined(met.hashes[lang], words.hash)[at]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            first = at[first]
            columns = [met.column(lang[first]), _signed(words.hash[first]), words.texts(first).cast(pa.string()), pa.array(n)]
            waiting.append(pa.table(columns, names=[*names, "f"]))
            rows += len(first)
            if rows >= FLUSH_ROWS:
                yield from flush(waiting)
                waiting, rows = [], 0
        if rows:
            yield from flush(waiting)

    rows = docs.mapInArrow(count, "lang string, h long, word string, f long")
    return rows.groupBy(*names).agg(F.sum("f").alias("f"))


def _distinct_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The counted words under the first seed by which no two of them share a hash, and the seed."""
    for seed in range(1, SEEDS + 1):
        words = stored(count_words(docs, seed), "phrase-words")
        shared = words.groupBy("lang", "h").agg(F.count("*").alias("n")).filter("n > 1")
        if shared.isEmpty():
            return words, seed
    raise ValueError(f"words of equal hash under each of {SEEDS} seeds")


def bit_map(phrases: DataFrame, size: int) -> np.ndarray:
    """The bit map of (lang, h1 ..) rows of ``size`` words: ``MAP_BITS`` leading bits of a phrase's key name its bit."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Languages()
        for batch in batches:
            lang = met.of_rows(batch.column(0).to_pylist())
            key = met.hashes[lang]
            for i in range(size):
                key = joined(key, batch.column(i + 1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([_signed(key)], names=["key"])

    ids = [f"h{i + 1}" for i in range(size)]
    rows = phrases.select("lang", *ids).mapInArrow(keys, "key long")
    place = F.shiftrightunsigned("key", 64 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = rows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def find_candidates(docs: DataFrame, seed: int, maps: list[np.ndarray], size: int, least: int) -> DataFrame:
    """(lang, h1 ..) of the phrases of ``size`` words that are seen ``least`` times, with all shorter parts in the ``maps``.

    Counts stop at ``least``: they tell that a phrase is frequent, not how frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    ids = [f"h{i + 1}" for i in range(size)]

    def flush(waiting: list[tuple], met: Languages) -> Iterator[pa.RecordBatch]:
        key, lang, *hashes = [np.concatenate(part) for part in zip(*waiting)]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        for part in np.array_split(np.arange(len(first)), 1 + len(first) // 65536):
            at = first[part]
            columns = [met.column(lang[at]), *[_signed(h[at]) for h in hashes]]
            columns.append(pa.array(np.minimum(n[part], least)))
            yield pa.RecordBatch.from_arrays(columns, names=["lang", *ids, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, waiting, rows = Languages(), [], 0
        for langs, words in text_blocks(batches, Hasher(seed)):
            lang = met.of_rows(langs)[words.row]
            own = met.hashes[lang]
            at = _safe_starts(words, own, shared.value, size)
            key = _keys(words, own, size)[at]
            waiting.append((key, lang[at], *[words.hash[at + i] for i in range(size)]))
            rows += len(at)
            if rows >= FLUSH_ROWS:
                yield from flush(waiting, met)
                waiting, rows = [], 0
        if rows:
            yield from flush(waiting, met)

    schema = f"lang string, {', '.join(f'{h} long' for h in ids)}, n long"
    sums = docs.mapInArrow(count, schema).groupBy("lang", *ids).agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= least).drop("n")


def find_windows(docs: DataFrame, seed: int, maps: list[np.ndarray]) -> DataFrame:
    """(lang, h1, h2, h3, n), 0 behind the last word: all that is to enter the tries, with the number of positions it begins at.

    Each frequent word by itself; and from each position the longest phrase in the ``maps``, if that has two words or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    ids = [f"h{i + 1}" for i in range(LONGEST)]

    def flush(waiting: list[tuple], met: Languages) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(part) for part in zip(*waiting)]
        rows = pa.table([pa.array(columns[0]), *map(_signed, columns[1:])], names=["lang", *ids])
        sums = rows.group_by(["lang", *ids]).aggregate([([], "count_all")])
        for part in sums.select(["lang", *ids, "count_all"]).to_batches(1 << 16):
            lang = met.column(part.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([lang, *part.columns[1:]], names=["lang", *ids, "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, waiting, rows = Languages(), [], 0
        for langs, words in text_blocks(batches, Hasher(seed)):
            lang = met.of_rows(langs)[words.row]
            own = met.hashes[lang]
            longest = np.zeros(len(own), np.int8)
            for size in range(1, LONGEST + 1):
                at = words.starts_of(size)
                at = at[longest[at] == size - 1]
                longest[at[_in_map(shared.value[size - 1], _keys(words, own, size)[at])]] = size
            for least in (1, 2):
                at = np.flatnonzero(longest >= least)
                hashes = [words.hash[at]]
                for i in range(1, LONGEST):
                    there = (longest[at] > i) & (least > 1)
                    hashes.append(np.where(there, words.hash[np.minimum(at + i, len(own) - 1)], np.uint64(0)))
                waiting.append((lang[at], *hashes))
                rows += len(at)
            if rows >= FLUSH_ROWS:
                yield from flush(waiting, met)
                waiting, rows = [], 0
        if rows:
            yield from flush(waiting, met)

    schema = f"lang string, {', '.join(f'{h} long' for h in ids)}, n long"
    return docs.mapInArrow(count, schema).groupBy("lang", *ids).agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers from 1 on for sorted hashes, looked up by their leading bits; 0 for others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length()))
        leading = hashes >> self.shift
        parts = 1 << (64 - int(self.shift))
        self.start = np.searchsorted(leading, np.arange(parts + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.start).max(initial=0))

    def numbers(self, asked: np.ndarray) -> np.ndarray:
        part = asked >> self.shift
        place, end = self.start[part], self.start[part + np.uint64(1)]
        out = np.zeros(len(asked), np.int64)
        left = np.flatnonzero(place < end)
        place, end = place[left], end[left]
        for _ in range(self.most):
            if not len(left):
                break
            met = self.hashes[place] == asked[left]
            out[left[met]] = place[met] + 1
            place = place + 1
            on = ~met & (place < end)
            left, place, end = left[on], place[on], end[on]
        return out


@dataclass
class Block:
    """The trie of a block of phrases, what its numbers stand for, its state after each language's number, and the ids of
    its phrases in their order."""

    automaton: trie.Trie
    langs: dict[str, int]
    vocabulary: Vocabulary
    entry: np.ndarray
    ids: np.ndarray

    def occurrences(self, rows: list[str], words: Words) -> np.ndarray:
        """The places in ``ids`` of the phrases that occur in a text block, each as often as it does."""
        code = self.vocabulary.numbers(words.hash)
        lang = np.array([self.langs.get(r, 0) for r in rows], np.int64)[words.row]
        at = words.starts_of(1)
        at = at[(lang[at] > 0) & (code[at] > 0)]
        state, accepted = self.entry[lang[at]], []
        for word in range(LONGEST):
            if word:
                goes_on = words.follows[at]
                at, state = at[goes_on] + 1, state[goes_on]
                known = code[at] > 0
                at, state = at[known], state[known]
            on, state = self.automaton.step(state, code[at])
            at = at[on]
            ends = self.automaton.phrase[state]
            accepted.append(ends[ends >= 0])
        return np.concatenate(accepted)

    def add_windows(self, found: np.ndarray, rows: list[str], hashes: list[np.ndarray], n: np.ndarray) -> None:
        """Adds, for each place in ``ids``, how often its phrase begins a window of (language, hashes, number). A word by
        itself has windows of its own, so longer ones count for phrases of two words or more."""
        lang = np.array([self.langs.get(r, 0) for r in rows], np.int64)
        at = np.flatnonzero(lang)
        state = self.entry[lang[at]]
        for i, word in enumerate(hashes):
            code = self.vocabulary.numbers(word[at])
            known = code > 0
            on, state = self.automaton.step(state[known], code[known])
            at = at[known][on]
            ends = self.automaton.phrase[state]
            counts = (ends >= 0) if i else (ends >= 0) & (hashes[1][at] == 0)
            np.add.at(found, ends[counts], n[at[counts]])


def make_block(rows: pa.Table) -> Block:
    """The block of (id, lang, h1, h2, h3) rows."""
    met = rows.column("lang").combine_chunks().dictionary_encode()
    langs = {lang: i + 1 for i, lang in enumerate(sorted(met.dictionary.to_pylist()))}
    hashes = [rows.column(f"h{i}").combine_chunks() for i in (1, 2, 3)]
    there = [h.is_valid().to_numpy(zero_copy_only=False) for h in hashes]
    values = [pc.fill_null(h, 0).to_numpy().view(np.uint64) for h in hashes]
    vocabulary = np.unique(np.concatenate([v[t] for v, t in zip(values, there)]))
    codes = [np.array([langs[x] for x in met.dictionary.to_pylist()], np.int64)[met.indices.to_numpy()]]
    codes += [np.where(t, np.searchsorted(vocabulary, v) + 1, 0) for v, t in zip(values, there)]
    order = np.lexsort(codes[::-1])
    symbols = trie.digits_for(max(len(vocabulary), len(langs)))
    made = trie.build(np.stack(codes, axis=1)[order], symbols)
    entry = np.zeros(len(langs) + 1, np.int32)
    # every language has a phrase here, so all of them go on from the root
    entry[1:] = made.step(entry[1:], np.arange(1, len(langs) + 1))[1]
    return Block(made, langs, Vocabulary(vocabulary), entry, rows.column("id").to_numpy()[order])


def dealt(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(lang, h1, h2, h3 ..) rows with their ``block``, stored by it. Rows that share the first two words share a block."""
    block = F.pmod(F.xxhash64("lang", "h1", F.coalesce("h2", F.lit(0).cast("long"))), F.lit(blocks)).cast("int")
    # several tasks write a block
    salt = F.pmod(F.xxhash64(*PHRASE), F.lit(BLOCK_PARTS))
    return stored(rows.withColumn("block", block).repartition(blocks * BLOCK_PARTS, "block", salt), name, "block")


def shared_block(safe: DataFrame, block: int) -> Broadcast | None:
    """The broadcast trie of a block of the phrases. The driver keeps neither the block nor the trie,
    so it holds one of them at a time, however many are broadcast."""
    own = safe.filter(F.col("block") == block).drop("block").toArrow()
    made = safe.sparkSession.sparkContext.broadcast(make_block(own)) if own.num_rows else None
    del own
    _give_back()
    return made


def _give_back() -> None:
    """Freed memory goes back to the system; Arrow and malloc would keep it."""
    pa.default_memory_pool().release_unused()
    # not every C library has it
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _counts(block: Block, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    there = np.flatnonzero(found)
    for part in np.array_split(there, 1 + len(there) // 65536):
        columns = [pa.array(block.ids[part]), pa.array(found[part])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "f"])


def count_blocks(docs: DataFrame, seed: int, shared: list[Broadcast]) -> DataFrame:
    """(id, f) of the phrases of some broadcast blocks, by one pass over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [block.value for block in shared]
        found = [np.zeros(len(block.ids), np.int64) for block in blocks]
        waiting = [[] for _ in blocks]

        def flush(least: int) -> None:
            for own, met in zip(found, waiting):
                if sum(map(len, met)) >= least:
                    own += np.bincount(np.concatenate(met), minlength=len(own))
                    met[:] = []

        for rows, words in text_blocks(batches, Hasher(seed)):
            for block, met in zip(blocks, waiting):
                met.append(block.occurrences(rows, words))
            flush(FLUSH_ROWS)
        flush(1)
        for block, own in zip(blocks, found):
            yield from _counts(block, own)

    rows = docs.mapInArrow(count, "id long, f long")
    return rows.groupBy("id").agg(F.sum("f").alias("f"))


def count_windows(windows: DataFrame, shared: dict[int, Broadcast]) -> DataFrame:
    """(id, f) of the phrases of some broadcast blocks, by number, from the windows dealt to each of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for number in pc.unique(batch.column("block")).to_pylist():
                own = batch.filter(pc.equal(batch.column("block"), number))
                *hashes, n = [c.to_numpy() for c in own.columns[1:-1]]
                block = shared[number].value
                met = found.setdefault(number, np.zeros(len(block.ids), np.int64))
                block.add_windows(met, own.column(0).to_pylist(), [h.view(np.uint64) for h in hashes], n)
        for number, met in found.items():
            yield from _counts(shared[number].value, met)

    rows = windows.filter(F.col("block").isin(*shared)).mapInArrow(count, "id long, f long")
    return rows.groupBy("id").agg(F.sum("f").alias("f"))


PHRASE = ["lang", "h1", "h2", "h3"]


def count_phrases(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, h1, h2, h3, f) of all phrases of 1 to 3 words that occur ``least`` times, (lang, h1, word), (lang, n)."""
    docs = docs.select("lang", "text")
    with small_batches(docs.sparkSession):
        return _count_phrases(docs, least)


def _count_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    words, seed = _distinct_words(docs)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least).select("lang", F.col("h").alias("h1"), "word")
    maps, parts = [bit_map(frequent, 1)], [frequent.drop("word")]
    for size in range(2, LONGEST + 1):
        parts.append(stored(find_candidates(docs, seed, maps, size, least), "phrase-candidates"))
        if size < LONGEST:
            maps = [*maps, bit_map(parts[-1], size)]
    safe = parts[0]
    for part in parts[1:]:
        safe = safe.unionByName(part, allowMissingColumns=True)
    blocks = 1 + safe.count() // BLOCK_PHRASES
    # the ids stay as they are once the table is written
    safe = dealt(safe.select(F.monotonically_increasing_id().alias("id"), *PHRASE), blocks, "phrases")
    windows = None
    if blocks > TRIES:
        maps = [*maps, bit_map(parts[-1], LONGEST)]
        windows = dealt(find_windows(docs, seed, maps), blocks, "phrase-windows")
    counts = None
    for first in range(0, blocks, TRIES):
        parts_here = range(first, min(first + TRIES, blocks))
        shared = {block: made for block in parts_here if (made := shared_block(safe, block)) is not None}
        if not shared:
            continue
        if windows is None:
            found = count_blocks(docs, seed, list(shared.values()))
        else:
            found = count_windows(windows, shared)
        found = stored(found, "phrase-counts")
        for block in shared.values():
            block.destroy()
        counts = found if counts is None else counts.union(found)
    if counts is None:
        return safe.drop("id", "block").withColumn("f", F.lit(None).cast("long")), frequent, totals
    known = safe.join(counts, "id").filter(F.col("f") >= least).drop("id", "block")
    return stored(known, "phrase-counts"), frequent, totals


# --- scores


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left * right)), exact up to counts of 10^16."""
    many = lambda c: c.cast("decimal(18,0)")
    top = many(a) * many(a) * F.lit(MILLION).cast("decimal(7,0)")
    return F.call_function("div", top, many(left) * many(right))


def _top(rows: DataFrame, group: list[str], order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each group; many share the sorting, so that none sorts a whole group."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(256))
    for parts in (256, 16):
        window = Window.partitionBy(*group, F.pmod(salt, F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)
    window = Window.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(window).cast("long"))
    return rows.filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    least: int = LEAST_COUNT,
    top: int = TOP,
    absorb_percent: int = ABSORB_PERCENT,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases of 2 to 3 words."""
    known, words, totals = count_phrases(docs, least)
    single = known.filter("h2 IS NULL").join(words, ["lang", "h1"])
    double = known.filter("h2 IS NOT NULL AND h3 IS NULL")

    def word(at: int, count: str) -> DataFrame:
        return single.select("lang", F.col("h1").alias(f"h{at}"), F.col("f").alias(count), F.col("word").alias(f"w{at}"))

    def pair(a: int, b: int, count: str) -> DataFrame:
        return double.select("lang", F.col("h1").alias(f"h{a}"), F.col("h2").alias(f"h{b}"), F.col("f").alias(count))

    pairs = double.select("lang", "h1", "h2", F.col("f").alias("a"))
    triples = known.filter("h3 IS NOT NULL").select("lang", "h1", "h2", "h3", F.col("f").alias("a"))
    inside = F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))
    longer = triples.select("lang", "a", F.explode(inside).alias("p"))
    longer = longer.groupBy("lang", "p.h1", "p.h2").agg(F.max("a").alias("within"))
    pairs = pairs.join(longer, ["lang", "h1", "h2"], "left").filter(
        F.coalesce(F.col("within") * 100 < F.col("a") * absorb_percent, F.lit(True))
    )
    pairs = pairs.join(word(1, "l"), ["lang", "h1"]).join(word(2, "r"), ["lang", "h2"])
    pairs = pairs.select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r",
        _score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
    )
    cuts = (
        triples.join(pair(1, 2, "l2"), ["lang", "h1", "h2"])
        .join(pair(2, 3, "r1"), ["lang", "h2", "h3"])
        .join(word(1, "l1"), ["lang", "h1"])
        .join(word(2, "f2"), ["lang", "h2"])
        .join(word(3, "r2"), ["lang", "h3"])
        .withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    )
    # the smallest struct: the lowest score, of equal ones the earlier cut
    cut = F.least(
        *[
            F.struct(
                _score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"),
                F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"),
                F.col(f"r{k}").alias("r"),
            )
            for k in (1, 2)
        ]
    )
    triples = cuts.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    scored = pairs.union(triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = _top(scored, ["lang"], order, top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_sql(least: int = LEAST_COUNT, top: int = TOP, absorb_percent: int = ABSORB_PERCENT) -> str:
    """DuckDB SQL of the query over ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), spread AS (
  SELECT lang, piece_no, unnest(w) AS w1, generate_subscripts(w, 1) AS place FROM numbered
), words AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3
  FROM spread WINDOW p AS (PARTITION BY piece_no ORDER BY place)
), totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM words GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM words WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM words WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= {least}),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE f2.f >= {least} AND coalesce((SELECT max(f) FROM f3 WHERE f3.lang = f2.lang AND
    (f3.w1 = f2.w1 AND f3.w2 = f2.w2 OR f3.w2 = f2.w1 AND f3.w3 = f2.w2)), 0) * 100 < f2.f * {absorb_percent}
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1
    JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2
    JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
), scored AS (
  SELECT *, CAST((CAST(a AS HUGEINT) * a * {MILLION}) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), least_cut AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM least_cut JOIN totals USING (lang) QUALIFY rank <= {top}"""
