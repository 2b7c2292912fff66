"""URL filters, phrase collocations and centroid clusters against plain versions, on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keytally.llm import centroids, phrases, trie, urls

from .conftest import odd_texts


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- URL filters

PAGE = "page_id long, url string, html string, canonical string, possible string, block string, salt string"

URLS = [
    None,
    "",
    "no scheme/at/all",
    "http://",
    "http://x.net",
    "http://x.net/",
    "HTTP://X.NET/a?b#c",
    "https://a.example.net/en/1?x=1",
    "https://a.example.net/eN/1",
    "https://example.net/en/",
    "https://notexample.com/de/2",
    "https://example.com/de/2",
    "https://example.com/de",
    "http://u@e.example.org/fr/3",
    "http://e.example.org:80/fr/3",
    "http://ÄB.org/fr/?q",
    "http://a.b/c://d/e",
    "http://WWW.Bad.org/x/?utm_source=feed&b=2&a=1#top",
    "http://bad.org/x?a=1&b=2",
    "http://bad.org/x?a=1&b=3",
    "http://bad.org:443/y//",
    "http://bad.org/" + "long" * 50_000,
    "http://bad.org/y\nz?ref=1",
    "?//x.net/",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c in urls.UPPER else c for c in host), path


def plain_rule(host, path, rules):
    fits = [
        (len(h + p), v == "block", h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[2:] if fits else (None, None)


def plain_canonical(url):
    if url is None or "://" not in url:
        return None
    host, path = plain_parts(url)
    host = re.sub(r":(80|443)\Z", "", re.sub(r"\Awww\.", "", host))
    query = re.match(r"(?s).*?://[^?#]*\?([^#]*)", url)
    asked = [
        p for p in (query.group(1) if query else "").split("&")
        if p and not re.match("(utm_[^=]*|ref|fbclid|gclid)(=|$)", p)
    ]
    return host + re.sub(r"/+\Z", "", path) + ("?" + "&".join(sorted(asked)) if asked else "")


@pytest.mark.parametrize("blocks", [1, 64])
def test_urls_are_judged_by_rules_and_list(spark, monkeypatch, blocks):
    # one block of 512 bits lets false positives through, which the exact join has to remove
    monkeypatch.setattr(urls, "filter_blocks", lambda n: blocks)
    many = URLS + [f"http://site{i}.org/p{i % 7}" for i in range(300)] + ["http://hot.org/"] * 200
    rows = [(i if i % 9 else None, u, "h", "c", "p", "b", "s") for i, u in enumerate(many)]
    pages = spark.createDataFrame(rows, PAGE).repartition(5)
    listed = [u for u in many if u and "bad.org/x" in u][:1] + ["http://bad.org/y", "https://www.hot.org", None]
    listed += [f"http://site{i}.org/p{i % 7}/?ref=9" for i in range(0, 300, 3)] * 2
    table = spark.createDataFrame([(u,) for u in listed], "url string")
    rules = [*urls.RULES, ("allow", "org", "/fr/"), ("block", "org", "/fr/")]
    got = urls.judge_urls(pages, table, rules).drop("on_list")
    names = {plain_canonical(u) for u in listed} - {None}
    want = []
    for row in rows:
        host, path = plain_parts(row[1])
        rule, verdict = plain_rule(host, path, rules)
        canonical = plain_canonical(row[1])
        verdict = verdict or ("block" if canonical in names else "allow")
        want.append((row[0], host, path, rule, verdict, canonical))
    assert rows_of(got) == sorted(want, key=repr)
    assert {w[4] for w in want if w[3] is None} == {"block", "allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    urls_in = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    blocks = urls.filter_blocks(5000)
    bloom = urls.bloom_filter(urls_in, blocks)
    assert bloom.count() <= blocks <= urls.MOST_BLOCKS and urls.filter_blocks(1 << 60) == urls.MOST_BLOCKS
    assert urls.with_possible(urls_in, bloom, blocks).filter("not possible").count() == 0
    others = urls_in.select(F.concat("canonical", F.lit("x")).alias("canonical"))
    assert urls.with_possible(others, bloom, blocks).filter("possible").count() < 150


def test_empty_tables_of_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "")], "page_id long, url string, html string")
    none = pages.limit(0)
    assert urls.judge_urls(none, pages).count() == 0
    assert [r.verdict for r in urls.judge_urls(pages, none).collect()] == ["allow"]


# --- phrase collocations


def plain_collocations(docs, least, top, percent):
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = [b for q, b in found.items() if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])]
            if any(100 * b >= percent * a for b in inside):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=repr)


def wordy(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "naïve", "new york", "a\x00b", "x,", "y.", "z\n", "\x0b", "été", "#", "q" * 40]
    return " ".join(r.choice(vocabulary) + ("\t" if r.random() < 0.1 else "") for _ in range(n))


@pytest.mark.parametrize("block_phrases", [1 << 20, 40])
def test_collocations_equal_plain_counts(spark, make_docs, monkeypatch, block_phrases):
    """Also with the candidates dealt to many tries."""
    monkeypatch.setattr(phrases, "BLOCK_PHRASES", block_phrases)
    texts = [*odd_texts(), *[wordy(i, 30 + i * 20) for i in range(14)], "  ", ",,,", "w" * 70_000]
    docs = make_docs(texts)
    plain = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = phrases.collocations(docs, least=4, top=25)
    assert rows_of(got) == plain_collocations(plain, 4, 25, 50)
    # a large table of copies, so that every count is a multiple
    assert rows_of(phrases.collocations(docs.union(docs), least=8, top=25)) == [
        (lang, rank, p, 2 * a, 2 * left, 2 * right, 2 * n, score)
        for lang, rank, p, a, left, right, n, score in plain_collocations(plain, 4, 25, 50)
    ]


@pytest.mark.parametrize("size", [1, 5, 17, 64, 4000])
def test_words_of_blocks_of_any_size(size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
    texts = [None, "", *[wordy(i, 60) for i in range(4)], "one", " a  b\t c", "a b c. d e"]
    batch = pa.RecordBatch.from_pydict({"l": pa.array(["en"] * len(texts)), "t": pa.array(texts)})
    got = Counter()
    for _, words in phrases.text_blocks(iter([batch.slice(1), batch.slice(0, 1)]), phrases.Hasher(3)):
        for k in (1, 2, 3):
            at = words.starts_of(k)
            got.update(zip(*[words.texts(at + j).to_pylist() for j in range(k)]))
    want = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == want


def test_equal_hashes_change_the_seed(spark, make_docs, monkeypatch):
    docs = make_docs(["a b a b c", "b a"], extra=False).select("lang", "text")
    real = phrases.count_words

    def crowded(docs, seed):
        return real(docs, seed).withColumn("h", F.when(F.lit(seed < 3), F.lit(1)).otherwise(F.col("h")).cast("long"))

    monkeypatch.setattr(phrases, "count_words", crowded)
    assert phrases._distinct_words(docs)[1] == 3


def test_no_phrases(spark, no_docs, make_docs):
    assert phrases.collocations(no_docs).count() == 0
    assert phrases.collocations(make_docs([None, "", "a b c"])).count() == 0


def test_scores_past_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**11, 4 * 10**11, 5 * 10**11)], "a long, l long, r long")
    got = row.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 10**6 * 9 * 10**22 // (20 * 10**22)


def test_double_array_holds_its_rows_only():
    r = np.random.default_rng(5)
    for numbers, rows in ((3, 20), (70, 3000), (5000, 4000)):
        length = r.integers(1, 4, rows)
        codes = r.integers(1, numbers + 1, (rows, 3)) * (np.arange(3) < length[:, None])
        codes = np.unique(codes, axis=0)
        made = trie.build(codes, trie.digits_for(numbers))
        known = {tuple(x): i for i, x in enumerate(codes.tolist())}
        asked = np.unique(np.concatenate([codes, r.integers(1, numbers + 1, (rows, 3))]), axis=0)
        for row in asked.tolist():
            sequence = [x for x in row if x]
            state = np.zeros(1, np.int32)
            for x in sequence:
                state = made.step(state, np.array([x]))[1]
            got = int(made.phrase[state[0]]) if len(state) else -1
            assert got == known.get(tuple(sequence + [0] * (3 - len(sequence))), -1)


# --- centroid clusters


def plain_clusters(rows, clusters, rounds, dimensions, seed):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            cut = [max(-float(1 << 27), min(float(1 << 27), 1024 * x)) for x in v]
            kept.append((key, [math.floor(x) for x in cut]))
    name = lambda key: f"{seed}:{'null' if key is None else key}"
    order = sorted((hashlib.sha256(name(k).encode()).hexdigest(), v) for k, v in kept)
    middle = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for i, members in groups.items():
            middle[i] = [sum(column) // len(members) for column in zip(*members)]
    placed = [(k, near(v)) for k, v in kept]
    sums = Counter()
    for _, (d, i) in placed:
        sums[i] += d
    small = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(
        [(k, i, d, small(sums[i]), small(sum(sums.values())), digest[i]) for k, (d, i) in placed], key=repr
    )


VECTOR = "vec_id long, embedding array<float>, v string, near string, cluster string"


@pytest.mark.parametrize("dimensions, clusters, rounds", [(1, 3, 4), (4, 8, 10), (4, 50, 2)])
def test_clusters_equal_plain_rounds(spark, dimensions, clusters, rounds):
    r = random.Random(dimensions)
    inf, nan = float("inf"), float("nan")
    vectors = [[r.choice([-1.5, -0.25, 0.0, 0.3, 2.0, r.random()]) for _ in range(dimensions)] for _ in range(40)]
    vectors += [vectors[0]] * 25 + [None, [], [0.5] * (dimensions + 1)]
    vectors += [[*[0.1] * (dimensions - 1), x] for x in (None, nan, inf, -inf, 3e38, -3e38, -0.0)]
    rows = [(i if i % 11 else None, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (3, vectors[4])]
    table = spark.createDataFrame([(*row, "v", "n", "c") for row in rows], VECTOR).repartition(4)
    floats = [(k, v and [x if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    got = centroids.cluster_vectors(table, clusters, rounds, dimensions, seed=5)
    assert rows_of(got.drop("centroid")) == plain_clusters(floats, clusters, rounds, dimensions, 5)


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None, "", "", ""), (2, [1.0], "", "", "")], VECTOR)
    full = centroids.cluster_vectors(table, 2, 1, 1)
    none = centroids.cluster_vectors(table)
    assert none.count() == 0 and none.dtypes == full.dtypes


def test_the_driver_holds_one_trie_at_a_time(spark, monkeypatch):
    """Also where several are counted in one pass over the texts."""
    import weakref

    texts = [f"w{i} x{i % 7} y{i % 5}" for i in range(20) for _ in range(12)]
    docs = spark.createDataFrame([(f"l{i % 2}", t) for i, t in enumerate(texts)], "lang string, text string")
    want = rows_of(phrases.count_phrases(docs, 3)[0])
    met, make = [], phrases.make_block

    def watched(rows):
        assert all(block() is None for block in met)
        block = make(rows)
        met.append(weakref.ref(block))
        return block

    monkeypatch.setattr(phrases, "BLOCK_PHRASES", 16)
    monkeypatch.setattr(phrases, "make_block", watched)
    got = rows_of(phrases.count_phrases(docs, 3)[0])
    assert len(met) >= 4 and got == want


def test_texts_reach_the_tasks_in_small_batches(spark, monkeypatch):
    """In every pass over them; 10 000 rows of a batch would be held by the executor and by its Python worker."""
    docs = spark.range(300).selectExpr("'en' AS lang", "repeat('ab cd ', 5000) AS text").coalesce(1)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, largest = spark.conf.get(setting), {}

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    def watch(name):
        real = getattr(phrases, name)

        def watched(docs, *rest):
            largest[name] = docs.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]
            return real(docs, *rest)

        monkeypatch.setattr(phrases, name, watched)

    for name in ("count_words", "find_candidates", "count_blocks"):
        watch(name)
    known = phrases.count_phrases(docs)[0]
    assert {r.f for r in known.collect()} == {300 * 5000, 300 * 4999}
    assert len(largest) == 3 and max(largest.values()) < 2 * (1 << 21)
    assert spark.conf.get(setting) == before


def test_many_tries_read_the_texts_once(spark, monkeypatch):
    """The passes over the texts do not grow with the number of candidates."""
    texts = [f"w{i} x{i % 7} y{i % 5}, w{i}" for i in range(20) for _ in range(12)]
    docs = spark.createDataFrame([(f"l{i % 2}", t) for i, t in enumerate(texts)], "lang string, text string")
    want = rows_of(phrases.count_phrases(docs, 3)[0])
    passes, real = [], type(docs).mapInArrow

    def watched(self, *rest, **more):
        if self.columns == ["lang", "text"]:
            passes.append(self)
        return real(self, *rest, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    monkeypatch.setattr(phrases, "BLOCK_PHRASES", 8)
    got = rows_of(phrases.count_phrases(docs, 3)[0])
    assert got == want and len(passes) == 4  # words, candidates of two and of three words, windows
