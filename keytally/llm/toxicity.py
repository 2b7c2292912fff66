"""Toxicity: a learned lexicon matched by Levenshtein automata, weighed by the words around each hit.

Terms are words and stems that documents labelled toxic have far more often than others. Each word of a
text is matched against the trie of terms with a few edits; a hit counts as quoted if quotation marks
enclose it within ``QUOTE_SPAN`` words or a reporting word stands shortly before it. A logistic
regression weighs exact, misspelled, stem and quoted hits, hits close together, and hits near a word that
addresses the reader. Labelled texts seldom show misspellings and quotations, so each text of the sample is also
learned from in made forms: a toxic one with its terms misspelled stays toxic, with its terms in quotation marks it
is not, and neither is a clean one into which a quoted term is put.

Only rows whose CRC-32 of the id (as text) is not divisible by ``FOLDS`` are learned from: a sample of about
``SAMPLE_DOCS`` of them at most, one per group of like texts (equal smallest hash of three words), of at most ``SAMPLE_CHARS``
characters. Labels, languages, sources and ids take no part in a score.

Defined results: a null or empty text has no hits and gets the score of a text without any; a null id
is in no fold of its own (not held out) and is not learned from; repeated rows are rows of their own; without labels of both
kinds every score is 0; of terms at equal distance the lexicon's first is the hit; texts of any length are scored whole; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.files import pieces
from keytally.llm.lexicon import Lexicon
from keytally.sinks.sketch_store import stored

FOLDS = 5
SAMPLE_DOCS = 20_000
SAMPLE_CHARS = 20_000
#: A term has this share of the toxic documents at least, and this many of them.
LEAST_SHARE, LEAST_DOCS = 0.01, 5
#: How much likelier it is in them, as a logarithm.
LEAST_ODDS = 3.0
LONGEST_TERM, SHORTEST_TERM = 16, 4
#: A prefix gives way to a longer one that has so much of its documents.
SAME_TERM = 0.9
WINDOW, QUOTE_SPAN, REPORT_SPAN, ADDRESS_SPAN = 25, 12, 4, 5
#: Different words that a worker remembers.
CACHE_WORDS = 500_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_EDGE_JVM = r"[^\p{L}\p{N}]*[\x20\x09-\x0D]+[^\p{L}\p{N}]*|^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_OPEN, _CLOSE = tuple("\"“«„‘'"), tuple("\"”»“’'")
_REPORTING = frozenset(
    "said says called wrote quoted word term phrase dit écrit mot sagte schrieb wort dijo escribió palabra".split()
)
_ADDRESS = frozenset("you your yours you're tu toi vous ton du dich dir dein ihr tú usted vosotros".split())
FEATURES = ("exact", "misspelled", "stem", "quoted", "close", "dense", "addressed")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the documents to learn from, stored."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    pick = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE_DOCS)
    words = F.split("text", r"[\x20\x09-\x0D]+")
    like = F.array_min(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))),
            lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i, F.lit(3)))),
        )
    )
    short = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    rows = short.join(F.broadcast(pick), "doc_id")  # at most SAMPLE_DOCS pairs of numbers
    groups = (
        rows.withColumn("words", words)
        .withColumn("like", like)
        .groupBy("like", "toxic")
        .agg(F.min("text").alias("text"))
    )
    # more groups than labels only where many documents share an id
    groups = stored(groups, "toxic-groups")
    share = SAMPLE_DOCS / max(1, groups.count())
    place = F.pmod(F.xxhash64("like", "toxic"), F.lit(1 << 32)) / (1 << 32)
    return groups.filter(place < share).select("text", "toxic")


def learn_terms(sample: DataFrame) -> list[tuple[str, float, bool]]:
    """(term, weight, is a stem), from counts of documents over the whole sample."""
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    words = F.explode(F.array_distinct(F.split(F.lower("text"), _EDGE_JVM)))
    counts = (
        sample.select("toxic", words.alias("word"))
        .filter(F.length("word").between(SHORTEST_TERM, 40))
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    )
    lengths = F.sequence(F.lit(SHORTEST_TERM), F.least(F.length("word"), F.lit(LONGEST_TERM)))
    prefix = F.explode(F.transform(lengths, lambda n: F.substring(F.col("word"), F.lit(1), n)))
    own = F.when(F.length("word") == F.length("term"), F.col("bad")).otherwise(0)
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    rows = (
        counts.select("*", prefix.alias("term"))
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum(own).alias("own"))
        .withColumn("odds", odds)
        .filter((F.col("bad") >= least) & (F.col("odds") >= LEAST_ODDS))
        .collect()  # each in LEAST_SHARE of the toxic sample, which bounds them by its texts' words
    )
    found = {r.term: r for r in rows}
    longest: dict[str, int] = {}  # the most documents of a term one letter longer
    for term, row in found.items():
        longest[term[:-1]] = max(longest.get(term[:-1], 0), row.bad)
    terms, stems = [], set()
    for term, row in sorted(found.items()):
        if longest.get(term, 0) >= SAME_TERM * row.bad:
            continue
        whole = row.own >= SAME_TERM * row.bad
        if not any(term[:n] in stems for n in range(SHORTEST_TERM, len(term))):
            terms.append((term, float(row.odds), not whole))
            if not whole:
                stems.add(term)
    return terms


class Scorer:
    """Features and scores of texts."""

    def __init__(self, terms: list[tuple[str, float, bool]], weights: np.ndarray | None) -> None:
        self.terms, self.weights, self.lexicon = terms, weights, None
        self.seen: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weights": self.weights, "lexicon": None, "seen": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def _hits(self, words: list[str]) -> list[tuple[int, tuple[int, int]]]:
        if self.lexicon is None:
            self.lexicon = Lexicon(self.terms)
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen, match = self.seen, self.lexicon.match
        for word in {w for w in words if w not in seen}:
            seen[word] = match(_EDGE.sub("", word))
        return [(i, hit) for i, hit in enumerate(map(seen.__getitem__, words)) if hit]

    @staticmethod
    def quoted(words: list[str], at: int) -> bool:
        """Whether the word stands in quotation marks or shortly after a reporting word."""
        if any(_EDGE.sub("", w) in _REPORTING for w in words[max(0, at - REPORT_SPAN) : at]):
            return True
        opened = False
        for i in range(at, max(-1, at - QUOTE_SPAN), -1):
            if i < at and words[i].rstrip(".,;:!?").endswith(_CLOSE):
                break
            if words[i].startswith(_OPEN):
                opened = True
                break
        after = words[at : at + QUOTE_SPAN]
        return opened and any(w.rstrip(".,;:!?").endswith(_CLOSE) for w in after)

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        hits = self._hits(words)
        if not hits:
            return [0.0] * len(FEATURES)
        exact = misspelled = stem = quoted = addressed = 0.0
        open_at = []
        for at, (term, edits) in hits:
            if self.quoted(words, at):
                quoted += 1
                continue
            open_at.append(at)
            is_stem = self.terms[term][2]
            exact += edits == 0 and not is_stem
            misspelled += edits > 0
            stem += is_stem
            near = words[max(0, at - ADDRESS_SPAN) : at + ADDRESS_SPAN + 1]
            addressed += any(_EDGE.sub("", w) in _ADDRESS for w in near)
        close, first = 0, 0
        for i, at in enumerate(open_at):
            while at - open_at[first] > WINDOW:
                first += 1
            close = max(close, i - first + 1)
        counts = [exact, misspelled, stem, quoted, close]
        dense = len(open_at) / len(words) * 100
        return [float(np.log1p(x)) for x in (*counts, dense, addressed)]

    def made_forms(self, text: str | None, toxic: int) -> list[tuple[str, int]]:
        """Made texts and their labels: terms misspelled, terms quoted, or a quoted term put in."""
        words = (text or "").lower().split()
        if not words:
            return []
        if not toxic:
            place = zlib.crc32(text.encode())
            term = self.terms[place % len(self.terms)][0]
            at = place % (len(words) + 1)
            return [(" ".join([*words[:at], f'"{term}"', *words[at:]]), 0)]
        hits = [at for at, _ in self._hits(words) if not self.quoted(words, at)]
        if not hits:
            return []
        wrong, said = list(words), list(words)
        for at in hits:
            word = words[at]
            # a letter is left out, or one is doubled
            middle = len(word) // 2
            cut = word[:middle] + (word[middle + 1 :] if at % 2 else word[middle] + word[middle:])
            wrong[at] = cut
            said[at] = f'"{_EDGE.sub("", word)}"'
        out = [(" ".join(said), 0)]
        return [(" ".join(wrong), 1), *out] if self._hits(wrong) else out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        z = features @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, hold: float = 1.0) -> np.ndarray:
    """Weights (the constant first) of a logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], hold)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    sample = _sample(docs, labels)
    terms = learn_terms(sample)
    if not terms:
        return Scorer([], None)
    scorer = Scorer(terms, None)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            given = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            given += [made for text, toxic in given for made in scorer.made_forms(text, toxic)]
            rows = [scorer.features(text) for text, _ in given]
            labels = pa.array([toxic for _, toxic in given], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), labels], names=["x", "toxic"]
            )

    rows = sample.mapInArrow(measure, "x array<double>, toxic int").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    return Scorer(terms, _regression(x, y))


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            x = np.array([scorer.features(t) for t in part.column(1).to_pylist()])
            score = scorer.scores(x)
            columns = [part.column(0), part.column(2), pa.array(score), pa.array(score >= 0.5, pa.bool_())]
            columns[3] = columns[3].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
