import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
VOICE = "the a of river stone walks and Quiet Lamp über sieht été naïve 12 ,x. y! (z)".split()


def long_text(seed, n=60, vocabulary=VOICE):
    r = random.Random(seed)
    words = [r.choice(vocabulary) + r.choice(["", "", "", str(r.randrange(60))]) for _ in range(n)]
    return "".join(w + r.choice([" ", " ", " ", " ", "\n", "  "]) for w in words)


def odd_texts():
    """Texts with nulls, empties, ties, repeats, marks and one very long one."""
    texts = [None, "", " ", "\n\n", "one", "one two", "One  two\tthree", "!?", " ", "a\x00b"]
    texts += [long_text(i) for i in range(12)] + [long_text(1), long_text(1) + " end"]
    return [*texts, " ".join(long_text(1000 + i, 400) for i in range(40)), texts[1], None]


@pytest.fixture
def make_docs(spark):
    """A documents table from texts, or (doc_id, text) rows, with columns that others use inside."""

    def make(texts, extra=True, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        langs, sources = ["en", "de", None], ["src0", "src0", "src7", "web", None]
        full = [
            (i, t, langs[k % 3], sources[k % 5], len(t or "")) for k, (i, t) in enumerate(rows)
        ]
        df = spark.createDataFrame(full, DOCUMENT).repartition(partitions)
        if extra:
            clashing = "fp row found quality shard slot root tokens leaf budget words start ids key"
            df = df.selectExpr("*", *[f"'x' AS {name}" for name in clashing.split()])
        return df

    return make


@pytest.fixture
def odd_docs(make_docs):
    """The odd texts with ids of which two are null and two equal."""
    texts = odd_texts()
    ids = [None, None, 7, 7, *range(100, 96 + len(texts))]
    return make_docs(list(zip(ids, texts))), list(zip(ids, texts))


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
