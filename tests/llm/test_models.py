"""Trained operators: what they learn, what they may not look at, and the whole pipeline."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from keytally.llm import crf, lexicon, quality, toxicity

from .conftest import long_text


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_are_edit_distance():
    r = random.Random(3)
    words = {"".join(r.choice("abc") for _ in range(r.randint(2, 10))) for _ in range(15)}
    terms = [(w, 1.0, False) for w in sorted(words)]
    found = lexicon.Lexicon(terms)
    for _ in range(2000):
        word = "".join(r.choice("abcd") for _ in range(r.randint(0, 11)))
        near = [(edit_distance(word, t), i) for i, (t, _, _) in enumerate(terms)]
        near = [(d, i) for d, i in near if d <= lexicon.edits_for(terms[i][0])]
        want = min(near)[::-1] if near and word else None
        assert found.match(word) == want


def test_stems_match_what_begins_with_them():
    found = lexicon.Lexicon([("mean", 1.0, True), ("meanest", 1.0, False)])
    assert found.match("meaning") == (0, 0) and found.match("meanest") in ((0, 0), (1, 0))
    assert found.match("mea") is None and lexicon.Lexicon([]).match("x") is None


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(2)
    for _ in range(50):
        model = crf.LineModel([np.zeros(1)], r.normal(size=(2, 2)))
        scores = r.normal(size=int(r.integers(1, 8))).tolist()

        def value(labels, model=model, scores=scores):
            steps = sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))
            return steps + sum(s for s, x in zip(scores, labels) if x)

        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert [int(x) for x in model.decode(scores)] == list(best)
    assert model.decode([]) == []


def test_training_finds_the_telling_bin():
    first = crf.LineModel([np.zeros(2), np.zeros(2)], np.zeros((2, 2)))
    r = np.random.default_rng(3)
    sequences = []
    for i in range(60):
        label = i % 2
        bins = np.column_stack([np.full(5, label), r.integers(0, 2, 5)])
        sequences.append((bins, np.full(5, label)))
    model = crf.train(first, sequences)
    assert model.weights[0][1] - model.weights[0][0] > 1
    assert abs(model.weights[1][1] - model.weights[1][0]) < 0.5
    assert crf.train(first, []) is first


@pytest.fixture
def corpus(make_docs, labels_of):
    """300 documents: every sixth abusive, every fifth junk, with labels for most."""
    texts, labels, r = [], [], random.Random(9)
    for i in range(300):
        words = long_text(i, 60).split()
        bad, junk = i % 6 == 0, i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["gruntface", "slimeball", "nitwitted"]))
        lines = [" ".join(words[at : at + 10]).capitalize() + "." for at in range(0, len(words), 10)]
        texts.append("\n".join("%%% ".join(x.split()) + "###" for x in lines) if junk else "\n".join(lines))
        if i % 10 != 9:
            labels.append((i, int(not junk), int(bad)))
    labels += [(None, 1, 1), (5000, None, None), labels[0]]
    return make_docs(texts), labels_of(labels), texts


def test_quality_learns_the_junk(corpus):
    docs, labels, texts = corpus
    kept = {x.doc_id: x.kept for x in quality.judge_documents(docs, labels).collect()}
    clean = [i for i in range(300) if i % 5]
    assert np.mean([kept[i] for i in clean]) > 0.97
    assert not any(kept[i] for i in range(0, 300, 5))


def test_mixed_documents_are_labelled_line_by_line(corpus):
    """Half clean, half junk: neither all content nor all boilerplate, and most lines right."""
    docs, labels, texts = corpus
    model = quality.fit(docs, labels)
    shares, right = [], []
    for i in range(1, 200, 5):
        good, bad = texts[i].split("\n"), texts[i - 1].split("\n")
        for lines, truth in ((good + bad, [1] * len(good) + [0] * len(bad)), (bad + good, [0] * len(bad) + [1] * len(good))):
            bins, sizes, _ = quality.lines_of("\n".join(lines))
            got = model.decode(model.scores(np.array(bins)).tolist())
            shares.append(sum(s for s, c in zip(sizes, got) if c) / sum(sizes))
            right += [c == bool(t) for c, t in zip(got, truth)]
    assert np.mean([0 < s < 1 for s in shares]) > 0.9 and np.mean(right) > 0.9
    assert quality.mixed([(np.zeros((2, 3), int), np.ones(2, int))]) == []


def test_kept_is_the_verdict_of_the_best_labelling(spark, corpus, make_docs):
    """The share of content, from all labellings of the lines, and the base rules."""
    docs, labels, texts = corpus
    model = quality.fit(docs, labels)
    mixed = ["\n".join(texts[i].split("\n")[:4] + texts[i + 4].split("\n")[:4]) for i in range(1, 60, 5)]
    cases = [None, "", "a b c", "\n\n", *texts[:20], *mixed, mixed[0], "same words here\n" * 9]
    found = {x.doc_id: x for x in quality.judge_documents(make_docs(cases), labels.filter("false")).collect()}
    first = quality.first_model()
    from . import brute

    for verdicts, own in ((found, first), (None, model)):
        if verdicts is None:
            rows = quality.with_verdicts(make_docs(cases).select("doc_id", "text"), model).select("doc_id", "quality.*")
            verdicts = {x.doc_id: x for x in rows.collect()}
        for i, text in enumerate(cases):
            bins, sizes, _ = quality.lines_of(text)
            scores = own.scores(np.array(bins, int).reshape(len(bins), -1)).tolist() if bins else []

            def value(y, scores=scores, own=own):
                return sum(own.moves[a, b] for a, b in zip(y, y[1:])) + sum(s for s, x in zip(scores, y) if x)

            every = list(itertools.product((1, 0), repeat=len(bins)))
            best = max(every, key=value) if bins else ()
            share = sum(s for s, y in zip(sizes, best) if y) / max(1, sum(sizes))
            failed = brute.quality_base(text)[5]
            assert verdicts[i].content_share == pytest.approx(share)
            assert verdicts[i].kept == (not failed and share >= quality.CONTENT_SHARE)


def test_misspelled_is_abuse_and_quoted_is_not(corpus):
    docs, labels, texts = corpus
    scorer = toxicity.fit(docs, labels)
    weights = dict(zip(toxicity.FEATURES, scorer.weights[1:]))
    assert weights["misspelled"] > 0 and weights["exact"] > 0 > weights["quoted"]
    wrong, quoted = [], []
    for text in texts[:120:6]:
        forms = scorer.made_forms(text, 1)
        wrong += [t for t, y in forms if y]
        quoted += [t for t, y in forms if not y]
    assert len(quoted) == 20 and len(wrong) > 10
    for made, abusive in ((wrong, True), (quoted, False)):
        scores = scorer.scores(np.array([scorer.features(t) for t in made]))
        assert np.mean((scores >= 0.5) == abusive) > 0.9
    assert scorer.made_forms(None, 1) == [] == scorer.made_forms("", 0) == scorer.made_forms("plain words", 1)
    assert [y for _, y in scorer.made_forms("plain words", 0)] == [0]


def test_a_score_follows_from_its_features(corpus):
    """Counts of hits, by plain edit distance, put into the logistic function."""
    docs, labels, texts = corpus
    scorer = toxicity.fit(docs, labels)
    for text in ["you slimebal are gruntface", 'he wrote "gruntface" once', "nitwitted " * 3 + "and words", "plain", None]:
        words = [w.strip('",.') for w in (text or "").lower().split()]
        raw = (text or "").lower().split()
        counts = dict.fromkeys(toxicity.FEATURES, 0.0)
        open_at = []
        for at, word in enumerate(words):
            near = [(edit_distance(word, t), i) for i, (t, _, stem) in enumerate(scorer.terms)
                    if not stem and edit_distance(word, t) <= lexicon.edits_for(t)]
            near += [(0, i) for i, (t, _, stem) in enumerate(scorer.terms) if stem and word.startswith(t)]
            if not near:
                continue
            edits, term = min(near)
            if '"' in raw[at] or {"wrote", "said"} & set(words[max(0, at - 4) : at]):
                counts["quoted"] += 1
                continue
            open_at.append(at)
            stem = scorer.terms[term][2]
            counts["exact"] += edits == 0 and not stem
            counts["misspelled"] += edits > 0
            counts["stem"] += stem
            counts["addressed"] += "you" in words[max(0, at - 5) : at + 6]
        counts["close"] = len(open_at)
        counts["dense"] = 100 * len(open_at) / max(1, len(words))
        x = np.log1p([counts[name] for name in toxicity.FEATURES])
        want = 1 / (1 + np.exp(-(scorer.weights[0] + x @ scorer.weights[1:])))
        assert scorer.scores(np.array([scorer.features(text)]))[0] == pytest.approx(want)


def test_toxicity_learns_terms_and_forgives_spelling(corpus, make_docs, no_docs, spark):
    docs, labels, _ = corpus
    scorer = toxicity.fit(docs, labels)
    assert {t for t, _, _ in scorer.terms} >= {"gruntface", "slimeball"}
    out = {x.doc_id: x for x in toxicity.score_documents(docs, scorer).collect()}
    assert all(out[i].predicted == (i % 6 == 0) for i in range(300))
    assert all(0 <= x.score <= 1 for x in out.values())
    hit = scorer.features("you gruntfase , walks gruntface !")
    named = dict(zip(toxicity.FEATURES, hit))
    assert named["misspelled"] > 0 and named["exact"] > 0 and named["addressed"] > 0
    for quoted in ('he said gruntface', 'the word "gruntface" is rude', "« gruntface »"):
        named = dict(zip(toxicity.FEATURES, scorer.features(quoted)))
        assert named["quoted"] > 0 and named["exact"] == 0
    odd = make_docs([(None, None), (7, ""), (7, ""), (8, "x" * 100_000)])
    assert toxicity.score_documents(odd, scorer).count() == 4
    assert toxicity.score_documents(no_docs, scorer).count() == 0
    blind = toxicity.fit(docs, labels.filter("false"))
    assert {x.score for x in toxicity.score_documents(docs, blind).collect()} == {0.0}


def test_held_out_labels_are_not_learned_from(corpus):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus
    held = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.terms == b.terms and np.allclose(a.weights, b.weights)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, small)
        assert after.count() <= before.count(), name
        if name != "shards":
            assert after.columns == docs.columns
            assert after.exceptAll(before).count() == 0
            before = after
    assert 0 < after.count()


def test_pipeline_on_odd_documents(spark, odd_docs, no_docs, small):
    docs, rows = odd_docs
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, small)
        table.collect()
