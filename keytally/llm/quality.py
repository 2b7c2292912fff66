"""Quality rules: line labelling by a conditional random field, and base rules on words and lines.

Every line with a word becomes a row of bins (length, symbols, capitals, digits, ending, repetition,
navigation words); Viterbi decoding marks it as content or boilerplate; a document is kept if at least
``CONTENT_SHARE`` of the characters of such lines are content. The model is trained on the lines of
a bounded sample of labelled documents: at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters. A line
takes the label of its document, and as whole documents of one label would only teach the chain to stay, as many
documents are made up of runs of lines from a good and a bad one in turn, which show it where to switch and leave
each line to its own features. Without labels the first weights hold.

Defined results: a null or empty text has no words and fails the base rules; a text of any length is judged whole, and
ties of two labellings go to content; repeated rows are rows of their
own; a document labelled twice is trained on twice; labels of null are left out; an empty table gives
no rows. Other columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytally.llm.crf import LineModel, train
from keytally.llm.files import pieces, unused

CONTENT_SHARE = 0.5
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
REPEAT_WINDOW = 5
LONGEST_RUN = 6
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

_SPACES = "\x20\t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_NAVIGATION = (
    b"cookie", b"copyright", b"all rights reserved", b"click here", b"log in", b"sign up",
    b"subscribe", b"privacy policy", b"terms of", b"read more", b"javascript", b"share this",
)

#: The first weights by feature and bin, as content over boilerplate.
FIRST_WEIGHTS = {
    "words": [-0.5, 0.0, 0.3, 0.5, 0.5],  # 1, 2-3, 4-7, 8-15, more
    "symbols": [0.3, 0.2, -0.5, -1.5, -2.5],  # of its characters: none, 1 %, 3 %, 8 %, more
    "capitals": [0.2, 0.3, 0.0, -1.0, -2.0],  # of its letters: 2 %, 10 %, 30 %, 70 %, more
    "shouts": [0.2, -0.5, -2.0],  # doubled exclamation marks: none, one, more
    "digits": [0.1, 0.0, -0.5, -1.0],  # of its characters: none, 5 %, 20 %, more
    "ending": [0.3, 0.0, -0.5],  # sentence end, letter or digit, other
    "repeated": [0.2, -0.8],  # equal to an earlier line of the text
    "letters": [-0.5, 0.2, 0.2, 0.0, -0.5],  # bytes per word: 3, 5, 8, 14, more
    "bars": [0.2, -0.5, -2.0],  # bars to words: none, 1 in 10, more
    "navigation": [0.2, -2.0],
}
FIRST_MOVES = [[0.5, 0.0], [0.0, 0.5]]


def first_model() -> LineModel:
    return LineModel([np.array(w) for w in FIRST_WEIGHTS.values()], np.array(FIRST_MOVES))


def _bin(value: float, edges: tuple) -> int:
    for i, edge in enumerate(edges):
        if value <= edge:
            return i
    return len(edges)


def line_bins(line: bytes, n_words: int, repeated: bool) -> tuple[int, ...]:
    """The bins of a line with a word, in the order of ``FIRST_WEIGHTS``."""
    n = len(line)
    symbols = n - len(line.translate(None, _SYMBOLS))
    upper = n - len(line.translate(None, _UPPER))
    lower = n - len(line.translate(None, _LOWER))
    digits = n - len(line.translate(None, _DIGITS))
    end = line.rstrip()[-1]
    low = line.lower()
    return (
        _bin(n_words, (1, 3, 7, 15)),
        _bin(symbols / n, (0, 0.01, 0.03, 0.08)),
        _bin(upper / max(1, upper + lower), (0.02, 0.1, 0.3, 0.7)),
        _bin(line.count(b"!!"), (0, 1)),
        _bin(digits / n, (0, 0.05, 0.2)),
        0 if end in b".?!" else 1 if end >= 128 or chr(end).isalnum() else 2,
        int(repeated),
        _bin(n / n_words, (3, 5, 8, 14)),
        _bin(line.count(b"|") / n_words, (0, 0.1)),
        int(any(cue in low for cue in _NAVIGATION)),
    )


def lines_of(text: str | None) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Bins and lengths of the lines with a word, and how many of them equal an earlier line."""
    bins, sizes, repeats = [], [], 0
    seen: set[bytes] = set()
    for line in (text or "").encode().split(b"\n"):
        n_words = len(line.split())
        if not n_words:
            continue
        repeated = line in seen
        seen.add(line)
        repeats += repeated
        bins.append(line_bins(line, n_words, repeated))
        sizes.append(len(line))
    return bins, sizes, repeats


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """How many words lie in a window of words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # equal hashes only point out the places; the words decide
    places: dict[tuple[bytes, ...], list[int]] = {}
    for at in np.flatnonzero(np.isin(key, twice)).tolist():
        places.setdefault(tuple(words[at : at + window]), []).append(at)
    over = np.zeros(len(words) + 1, np.int64)
    for own_places in places.values():
        if len(own_places) > 1:
            np.add.at(over, own_places, 1)
            np.add.at(over, np.array(own_places) + window, -1)
    return int(np.count_nonzero(np.cumsum(over)))


def base_counts(text: str | None) -> tuple[int, int, int, int]:
    """n_words, word_chars, n_symbols, n_repeat_words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(words), chars, symbols, repeated_words(words)


def mixed(sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences made up of runs of 1 to ``LONGEST_RUN`` lines of good and of bad ones in turn."""
    kinds = [np.concatenate([b for b, y in sequences if y[0] == label] or [[]]) for label in (0, 1)]
    if not all(map(len, kinds)):
        return []
    random, out, at = np.random.default_rng(1), [], [0, 0]
    for i in range(len(sequences)):
        bins, labels = [], []
        for run in range(random.integers(2, 6)):
            label = (i + run) % 2
            size = int(random.integers(1, LONGEST_RUN + 1))
            lines = kinds[label][np.arange(at[label], at[label] + size) % len(kinds[label])]
            at[label] += size
            bins.append(lines)
            labels.append(np.full(size, label))
        out.append((np.concatenate(bins), np.concatenate(labels)))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> LineModel:
    """The model trained on the sample of labelled documents."""
    known = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    pick = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(2 * SAMPLE_DOCS)
    sample = (
        docs.select("doc_id", "text")
        .filter(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(pick), "doc_id")  # at most 2 * SAMPLE_DOCS pairs of numbers
        .orderBy(F.xxhash64("doc_id", "text"))
        .limit(SAMPLE_DOCS)
        .select("text", F.col("quality").cast("int").alias("quality"))
    )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            raw = [
                np.array(lines_of(t)[0], np.uint8).tobytes() for t in part.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw, pa.binary()), part.column(1)], names=["bins", "quality"]
            )

    rows = sample.mapInArrow(lines, "bins binary, quality int").collect()
    features = len(FIRST_WEIGHTS)
    sequences = []
    for row in rows:
        bins = np.frombuffer(bytes(row.bins), np.uint8).reshape(-1, features).astype(np.int64)
        if len(bins):
            sequences.append((bins, np.full(len(bins), row.quality)))
    return train(first_model(), sequences + mixed(sequences))


def with_verdicts(docs: DataFrame, model: LineModel, text: str = "text") -> DataFrame:
    """``docs`` and a last column, ``quality`` if free: counts, content share and verdicts."""
    name = unused(docs, "quality")
    at = docs.columns.index(text)
    kind = (
        "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,"
        "n_repeat_words:long,n_lines:long,n_content_lines:long,content_share:double,"
        "base_failed:boolean,kept:boolean>"
    )
    schema = docs.select("*", F.lit(None).cast(kind).alias(name)).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = None
        for part in pieces(batches):
            texts = part.column(at).to_pylist()
            found = [lines_of(t) for t in texts]
            every = [b for bins, _, _ in found for b in bins]
            scores = model.scores(np.array(every, np.int64)).tolist()
            rows, place = [], 0
            for t, (bins, sizes, repeats) in zip(texts, found):
                content = model.decode(scores[place : place + len(bins)])
                place += len(bins)
                n_words, chars, symbols, again = base_counts(t)
                share = sum(s for s, c in zip(sizes, content) if c) / max(1, sum(sizes))
                failed = n_words < LEAST_WORDS or 100 * again > MOST_REPEATED_PERCENT * n_words
                rows.append(
                    (n_words, chars, symbols, repeats, again, len(bins), sum(content), share)
                    + (failed, not failed and share >= CONTENT_SHARE)
                )
            columns = columns or [f.name for f in schema[name].dataType.fields]
            kinds = [pa.int64()] * 7 + [pa.float64(), pa.bool_(), pa.bool_()]
            own = pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns
            )
            yield pa.RecordBatch.from_arrays([*part.columns, own], names=schema.names)

    return docs.mapInArrow(judge, schema)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and the counts and verdicts of every row."""
    rows = with_verdicts(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", "quality.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns."""
    rows = with_verdicts(docs, fit(docs, labels))
    return rows.filter(F.col(rows.columns[-1]).kept).select(*docs.columns)
