"""Operators with one right result, against plain versions, on odd tables."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bench import shuffled_records
from keytally.llm import (
    components,
    decontaminate,
    fmindex,
    licenses,
    mixing,
    pii,
    quality,
    sharding,
    simhash,
    tokens,
    warc,
)

from . import brute
from .conftest import long_text, odd_texts

PAGES = "page_id long, url string, html string, payload string, archive string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- WARC


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_records_survive_the_archives(spark, min_bytes):
    bodies = [*odd_texts(), "four", "four", "WARC/1.1\r\n\r\nx", "\r\n\r\n", "é" * 5000]
    pages = [(i, b) for i, b in enumerate(bodies)] + [(None, "lost"), (None, ""), (3, bodies[3])]
    table = spark.createDataFrame([(i, "http://x\r\ny", b, "p", "a") for i, b in pages], PAGES)
    manifest = warc.write_archives(table.repartition(3), min_bytes=min_bytes, archive_bytes=2000)
    chunks = warc.read_chunks(manifest, chunk_bytes=700)
    got = warc.whole_records(chunks).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert rows_of(got) == brute.records(pages, min_bytes)
    parts = chunks.filter("record_type = 'response' and page_id is not null").collect()
    whole = {}
    for row in sorted(parts, key=lambda r: (r.page_id, r.archive, r.chunk_no)):
        assert len(row.data) <= 700
        whole.setdefault((row.page_id, row.archive), []).append(bytes(row.data))
    for (page, _), data in whole.items():
        assert b"".join(data) == (dict(pages)[page] or "").encode()


def test_damaged_archive_is_refused(spark):
    from keytally.llm.files import open_fs

    table = spark.createDataFrame([(1, "u", "some text", "", "")], PAGES)
    archive = warc.write_archives(table).first().archive
    system, path = open_fs(archive)
    with system.open_input_stream(path) as stream:
        data = stream.read()
    with system.open_output_stream(path) as out:
        out.write(data[:-20])
    with pytest.raises(Exception):
        list(warc._records(archive, 100))


def test_no_pages(spark):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and warc.read_chunks(manifest).count() == 0


# --- mixing


def plain_fill(nodes, budget):
    """Shares of (name, weight, cap) children, taking full ones out until none is over."""
    left, open_, out = budget, [n for n in nodes if n[1]], {n[0]: 0 for n in nodes}
    while open_:
        weight = sum(n[1] for n in open_)
        full = [n for n in open_ if n[2] * weight <= n[1] * left]
        if not full:
            for name, w, _ in open_:
                out[name] = w * left // weight
            break
        for name, _, cap in full:
            out[name] = cap
            left -= cap
        open_ = [n for n in open_ if n not in full]
    return out


def test_budgets_fill_siblings_first(spark):
    r = random.Random(4)
    for _ in range(5):
        nodes = [(f"n{i}", r.choice([0, 1, 2, 7]), r.choice([0, 5, 50, 500])) for i in range(6)]
        table = spark.createDataFrame(nodes, "name string, weight long, cap long")
        table = table.withColumn("root", F.lit(0)).withColumn("parent_budget", F.lit(300).cast("long"))
        got = {x["name"]: x.budget for x in mixing.fill(table, ["root"], "name").collect()}
        assert got == {n: b for n, b in plain_fill(nodes, 300).items() if n in got}
        assert set(got) == {n for n, w, _ in nodes if w}


def test_mix_takes_prefixes_and_whole_epochs(odd_docs):
    docs, rows = odd_docs
    out = mixing.mix(docs, 0.9, 3, weights={("d0",): 9, ("d0", "de"): 0}).collect()
    assert not [x for x in out if x.domain == "d0" and x.lang == "de"]
    leaves = {}
    for x in out:
        leaves.setdefault((x.domain, x.lang, x.source), []).append(x)
    for own in leaves.values():
        own.sort(key=lambda x: (x.start, x.start + x.tokens))
        at = 0
        for x in own:
            assert x.start == at and 0 <= x.take <= x.tokens
            at += x.tokens
        assert all(x.take == x.tokens for x in own[:-1])
    again = mixing.mix(docs.repartition(5), 0.9, 3, weights={("d0",): 9, ("d0", "de"): 0})
    assert rows_of(again) == sorted(map(tuple, out), key=repr)


def test_budget_of_weight_zero_goes_to_siblings(spark):
    rows = [(i, " ".join(["w"] * 10), lang, source, 20) for i, (lang, source) in enumerate(
        [("en", "src0"), ("de", "src0"), ("de", "src0"), ("en", "src1"), ("en", "src1"), ("en", "src1")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(docs, 0.5, 1, weights={("d0",): 1, ("d1",): 1, ("d0", "de"): 0}).collect()
    taken = {d: sum(x.take for x in out if x.domain == d) for d in ("d0", "d1")}
    assert taken == {"d0": 10, "d1": 20}


def test_mix_ranges_agree_with_one_range(odd_docs, monkeypatch):
    docs, _ = odd_docs
    one = rows_of(mixing.mix(docs, 0.7, 2))
    monkeypatch.setattr(mixing, "UNITS_PER_RANGE", 1)
    assert rows_of(mixing.mix(docs, 0.7, 2)) == one


def test_kept_rows_keep_their_columns(odd_docs, no_docs):
    docs, rows = odd_docs
    kept = mixing.keep_mixed(docs, budget_share=1.0, max_epochs=1)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert mixing.mix(no_docs, 0.5, 1).count() == 0
    assert mixing.keep_mixed(no_docs, budget_share=0.5, max_epochs=1).count() == 0


# --- licences


def test_licences(make_docs, no_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software " \
        "and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, " \
        "including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, " \
        "and/or sell copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, " \
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be " \
        "included in all\ncopies or substantial portions of the Software."  # fmt: skip
    texts = {
        None: "", "": "", "no licence here": "", "LICENSED under the  Apache License, Version 2.0.": "Apache-2.0",
        "text !!\nReleased under the MIT License.\nmore": "MIT", mit: "MIT",
        "the mit license of another kind": "", "Licensed under CC BY-NC 4.0. MIT License.": "MIT,CC-BY-NC-4.0",
        ". ".join(["x"] * 3000) + ".\nAll rights reserved.": "reserved",
    }
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General " \
        "Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your " \
        "option) any later version."  # fmt: skip
    texts[gpl] = "GPL-2.0"
    texts[gpl.replace("version 2", "version 3")] = "GPL-3.0"
    texts[gpl.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1")] = "LGPL-2.1"
    texts["// SPDX-License-Identifier: GPL-2.0-or-later"] = "GPL-2.0"
    three = ". ".join(s for s, n in licenses.SENTENCES.items() if n in (40, 41, 42, 43)) + "."
    texts[three] = "BSD-3-Clause"
    texts[three.rsplit(". ", 1)[0] + "."] = "BSD-2-Clause"
    backwards = ". ".join(reversed(three.rstrip(".").split(". "))) + "."
    texts[backwards] = ""
    docs = make_docs(list(texts))
    got = {x.doc_id: x.licenses for x in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert licenses.scan_licenses(no_docs).count() == 0
    assert all(licenses.normalised(s) == s for s in licenses.SENTENCES)


def test_licences_in_narrow_lines(make_docs):
    sentences = {n: s for s, n in licenses.SENTENCES.items()}
    mit = f"{sentences[5]}:\n{sentences[6]}."
    texts = [textwrap.fill(mit, width, initial_indent="# ", subsequent_indent="# ") for width in (20, 60, 72, 90)]
    texts.append("\n".join(mit.replace(":", "").split()))
    got = licenses.scan_licenses(make_docs(texts)).collect()
    assert [(x.sequence, x.licenses) for x in got] == [("#5#6#", "MIT")] * 5


def test_each_known_sentence_is_found_alone(make_docs):
    texts = [t for s in licenses.SENTENCES for t in (s, s.upper().replace(" ", "\n * "))]
    got = {x.doc_id: x.sequence for x in licenses.scan_licenses(make_docs(texts)).collect()}
    for i, number in enumerate(licenses.SENTENCES.values()):
        assert f"#{number}#" in got[2 * i] and f"#{number}#" in got[2 * i + 1]


# --- SimHash


def test_simhash(odd_docs, no_docs):
    docs, rows = odd_docs
    assert rows_of(simhash.near_duplicates(docs)) == brute.simhash(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_lose_no_pair(spark):
    r = random.Random(5)
    base, values = r.getrandbits(64), set()
    for _ in range(150):
        v = base
        for _ in range(r.randint(0, 5)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    values |= {r.getrandbits(64) for _ in range(100)} | {0, 1, 3, 7, 2**64 - 1}
    signed = [simhash._signed(v) for v in values]
    want = {
        (a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2
    }
    got = rows_of(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    assert len(got) == len(want) and set(got) == want


def test_exploded_fingerprints_are_not_broadcast(spark, tmp_path):
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want


def test_one_of_each_component_stays(odd_docs, no_docs):
    docs, rows = odd_docs
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {}
    for doc, _, component in brute.simhash(rows):
        groups.setdefault(component, []).append(doc)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(groups)
    assert simhash.keep_one(no_docs).count() == 0


# --- decontamination


def test_fm_index_finds_and_locates():
    r = np.random.default_rng(1)
    for _ in range(150):
        n, symbols = int(r.integers(1, 80)), int(r.integers(2, 6))
        seq = np.append(r.integers(0, symbols, n), 0).astype(np.int64)
        index = fmindex.FMIndex(seq, symbols)
        for m in (1, 2, 4):
            phrases = r.integers(1, symbols, (4, m))
            lo, hi = index.ranges(phrases, np.full(4, m))
            for p, a, b in zip(phrases, lo, hi):
                want = [i for i in range(len(seq) - m + 1) if (seq[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.mark.parametrize("block_bytes", [32 << 20, 60])
def test_contamination(spark, make_docs, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    passage = long_text(50, 25)
    items = [(1, passage), (2, passage), (10, "tiny Item"), (3, None), (4, ""), (None, long_text(51, 12))]
    texts = [*odd_texts(), f"x {passage} y", f"{passage}{passage}", "a TINY item, tiny-item tiny",
             "tiny", long_text(51, 12), " ".join(passage.split()[:9])]
    docs, table = make_docs(texts), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_overlaps(docs.select("doc_id", "text"), table, block_bytes=block_bytes)
    got = [(x.doc_id, x.found.n_words, sum(s.end - s.start for s in x.found.spans), len(x.found["items"]))
           for x in found.collect()]
    want = brute.overlaps(list(enumerate(texts)), items)
    assert sorted(got) == sorted(w[:4] for w in want)
    if block_bytes > 60:
        assert rows_of(decontaminate.contamination(docs, table).drop("spans")) == want
        kept = decontaminate.drop_contaminated(docs, table)
        assert kept.columns == docs.columns
        assert {x.doc_id for x in kept.collect()} == {w[0] for w in want if not w[5]}


def plain_cut(text, items, window=10):
    """A text without the characters from the first to the last word of each run of hit words."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = [m.span() for m in re.finditer(pattern, brute.lower_ascii(text))]
    w = [brute.lower_ascii(text[a:b]) for a, b in places]
    hit = [False] * len(w)
    for _, phrase in items:
        p = re.findall(pattern, brute.lower_ascii(phrase))
        size = min(window, len(p))
        for a in range(len(p) - size + 1 if p else 0):
            for at in range(len(w) - size + 1):
                if w[at : at + size] == p[a : a + size]:
                    hit[at : at + size] = [True] * size
    out, at = "", 0
    for i, own in enumerate(hit):
        if own and (i == 0 or not hit[i - 1]):
            out += text[at : places[i][0]]
        if own:
            at = places[i][1]
    return out + text[at:]


def test_contaminated_spans_are_cut_out(spark, make_docs):
    passage = long_text(50, 25)
    items = [(1, passage), (10, "tiny Item"), (3, None), (None, long_text(51, 12))]
    texts = [*odd_texts(), f"x {passage} y", f"({passage}!){passage}.", "a TINY item, tiny-item tiny",
             "é tiny item", long_text(51, 12)]
    docs, table = make_docs(texts), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.remove_contamination(docs, table)
    assert got.columns == docs.columns and got.drop("text").exceptAll(docs.drop("text")).count() == 0
    clean = {x.doc_id: x.text for x in got.collect()}
    assert clean == {i: t if t is None else plain_cut(t, items) for i, t in enumerate(texts)}
    assert decontaminate.contamination(got, table).filter("contaminated").count() == 0
    spans = {x.doc_id: x.spans for x in decontaminate.contamination(docs, table).collect()}
    assert [tuple(s) for s in spans[len(odd_texts()) + 2]] == [(1, 5)]


def test_contamination_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs, rows = odd_docs
    assert rows_of(decontaminate.contamination(docs, none).drop("spans")) == brute.overlaps(rows, [])
    assert decontaminate.contamination(no_docs, none).count() == 0


# --- shards


def test_shards_follow_from_the_key(odd_docs, no_docs):
    docs, rows = odd_docs
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows)
    for x in out:
        name = "null" if x.doc_id is None else str(x.doc_id)
        key = int(hashlib.md5(name.encode()).hexdigest()[:16], 16)
        assert (x.shard, x.grown_shard) == (brute.jump(key, 40), brute.jump(key, 41))
        assert x.grown_shard in (x.shard, 40)
    own = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out)
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert own == sorted((-1 if i is None else i, len(t) + 16, zlib.crc32(t)) for i, t in raw)
    slots = {}
    for x in out:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(no_docs).count() == 0


def test_many_shards_need_the_longer_way(spark):
    keys = spark.range(300).select("id", sharding.key_halves(F.col("id")).alias("k"))
    out = keys.select("id", sharding.jump_shard(F.col("k"), 1000).alias("s")).collect()
    short = keys.select("id", sharding._jumps(
        F.struct(F.col("k.hi").alias("hi"), F.col("k.lo").alias("lo"), F.lit(-1).cast("long").alias("b"),
                 F.lit(0).cast("long").alias("j")), 1000, 2).alias("s")).collect()
    assert any(x.s.j < 1000 for x in short)
    for x in out:
        key = int(hashlib.md5(str(x.id).encode()).hexdigest()[:16], 16)
        assert x.s == brute.jump(key, 1000)


# --- token files


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_files_round_trip(odd_docs, tokenizer, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    docs, rows = odd_docs
    library = Tokenizer.from_file(tokenizer)
    manifest, dictionary = tokens.write_token_files(docs, tokenizer)
    out = tokens.read_token_files(manifest, dictionary, with_ids=True).orderBy("start").collect()
    ids = [x.doc_id for x in out]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(out) == len(rows)
    want = sorted(
        (-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids + [2])
        for i, t in rows
    )
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.ids) for x in out) == want
    at = 0
    for x in out:
        assert (x.start, x.n_tokens) == (at, len(x.ids))
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        at += x.n_tokens
    first = manifest.orderBy("part", "seq").first()
    assert tokens.read_document(first.file, dictionary, 0).tolist() == out[0].ids
    empty, dictionary = tokens.write_token_files(no_docs, tokenizer)
    assert tokens.read_token_files(empty, dictionary).count() == 0


def test_encoder_is_the_library(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE_WORDS", 200)
    encoder, r = tokens.Encoder(tokenizer), random.Random(2)
    bits = ["a", "b", " ", "\n", ".", "'", "s", "é", "\t", "\r", " ", "\x1c", "日", "<|endoftext|>",
            "́", " b", "\nd", " a", "c.", "!", "'s", ",,", " .", "1", "\x00"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(4000)] + [None]
    texts += [long_text(i, 40).replace("  ", " ") for i in range(40)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        want = encoder.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [x.tolist() for x in encoder.encode(pa.array(part))] == [w.ids for w in want]


# --- quality base counts


def test_quality_counts(odd_docs, labels_of, no_docs):
    docs, rows = odd_docs
    labels = labels_of([])
    out = quality.judge_documents(docs, labels).collect()
    got = [
        (x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)
        for x in out
    ]
    assert sorted(got, key=repr) == sorted(((i, *brute.quality_base(t)) for i, t in rows), key=repr)
    assert not [x for x in out if x.base_failed and x.kept]
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.judge_documents(no_docs, labels).count() == 0


# --- personal data


def test_personal_data(odd_docs, make_docs, no_docs):
    r = random.Random(5)
    bits = ["a", "@", ".", "-", "1", "25", " ", "+", "(", ")", "_", "%", "é", "\U0001f600", "0", "@a.b",
            "1.2.3.4", "4111111111111111", " +1 (555) 555-1234", "x@y.z", "256", "000"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [t for _, t in odd_docs[1]] + [" ".join(f"u{i}@host.org" for i in range(700))]
    out = pii.find_personal_data(make_docs(texts)).collect()
    for x in out:
        spans = brute.personal(texts[x.doc_id])
        kinds = [s[3] for s in spans]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [kinds.count(k) for k in pii.KINDS]
        assert x.base_sha256 == hashlib.sha256(brute.joined(spans).encode()).hexdigest()
        assert set(brute.joined(spans).split(",")) <= set(x.spans.split(","))
    assert len(out) == len(texts) and pii.find_personal_data(no_docs).count() == 0


def test_terms_that_reveal_are_changed(make_docs):
    common = [f"plain words of number {long_text(i, 10)}" for i in range(60)]
    telling = [f"{long_text(70 + i, 5)} Zanzibar wrote from zed@home.org about the plain words" for i in range(3)]
    docs = make_docs(common + telling, partitions=2)
    flagged = pii.disclosing_terms(docs, pii.find_base(docs, ["doc_id"])).collect()
    terms = {x.term for x in flagged if x.entity == "email:zed@home.org"}
    assert "zanzibar" in terms and "plain" not in terms and "words" not in terms
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    for i, text in enumerate(telling, len(common)):
        assert "Zanzibar" not in clean[i] and "zed@home.org" not in clean[i] and "<EMAIL>" in clean[i]
        assert clean[i].endswith("the plain words")
    assert all(clean[i] == t for i, t in enumerate(common))
    assert pii.sanitise(docs).columns == docs.columns


def test_an_entity_of_one_text_has_terms(make_docs):
    common = [f"plain words of number {long_text(i, 10)}" for i in range(60)]
    docs = make_docs([*common, "Zanzibar wrote from zed@home.org about the plain words"])
    flagged = pii.disclosing_terms(docs, pii.find_base(docs, ["doc_id"])).collect()
    terms = {x.term: x.disclosure for x in flagged if x.entity == "email:zed@home.org"}
    assert terms["zanzibar"] == pytest.approx(1) and not {"plain", "words"} & set(terms)


def test_copies_do_not_hide_a_term(make_docs):
    common = [f"plain words of number {long_text(i, 10)}" for i in range(60)]
    telling = ["Zanzibar wrote from zed@home.org today", "Later Zanzibar used zed@home.org"]
    docs = make_docs([*common, *telling, *[telling[0]] * 300])
    flagged = pii.disclosing_terms(docs, pii.find_base(docs, ["doc_id"])).collect()
    found = {(x.entity, x.term): x.disclosure for x in flagged}
    assert found["email:zed@home.org", "zanzibar"] == pytest.approx(1)


def test_terms_far_from_the_mention_are_changed(make_docs):
    common = [f"plain words of number {long_text(i, 10)}" for i in range(60)]
    far = "Zanzibar " + "plain words of number " * 30 + "zed@home.org, Zanzibar. " + "plain words " * 40 + "ZANZIBAR"
    docs = make_docs([*common, far, "Zanz\u00e9zed@home.org touches"])
    clean = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert "zanzibar" not in clean[60].lower() and clean[60].count("plain words") == 70
    row = pii.find_personal_data(docs).filter("doc_id = 60").first()
    spans = {(int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",")) if k == "term"}
    assert {far[a:b].lower() for a, b in spans} == {"zanzibar"} and row.n_terms == len(spans) == 3


def test_only_words_near_the_mention_of_one_text_are_terms(make_docs):
    """A rare word far from it is no evidence; of an entity of two texts, words anywhere are."""
    common = [f"plain words of number {long_text(i, 10)}" for i in range(60)]
    gap = "plain words of number " * 30
    once = f"Farawayword {gap} nearbyword zed@home.org {gap}"
    twice = [f"Bothword {gap} 198.51.100.7 {gap} plain{i}" for i in range(2)]
    docs = make_docs([*common, once, once, *twice])
    flagged = pii.disclosing_terms(docs, pii.find_base(docs, ["doc_id"])).collect()
    found = {}
    for x in flagged:
        found.setdefault(x.entity, set()).add(x.term)
    assert "nearbyword" in found["email:zed@home.org"] and "farawayword" not in found["email:zed@home.org"]
    assert "bothword" in found["ip:198.51.100.7"]


def test_few_rows_are_shuffled_for_the_terms(spark, make_docs):
    """No row per word of all texts, and of an entity of many texts no pair of each text with each term of the others."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def own(i):
        return " ".join(f"w{letters[i % 26]}{letters[i // 26]}{a}{b}" for a in "abcdef" for b in "abcde")

    telling = [f"{own(i)} zed@home.org" for i in range(60)]
    common = " ".join(f"plain{a}{b}" for a in letters[:10] for b in letters[:10])
    docs = make_docs([*telling, *[f"{common} {i}" for i in range(400)]], partitions=2).select("doc_id", "text")
    before = shuffled_records(spark)
    assert pii.find_personal_data(docs).agg(F.sum("n_terms")).first()[0] == 60 * 30
    assert shuffled_records(spark) - before < 30_000  # 400 * 100 and 60 * 60 * 30 if done by rows


def plain_terms(rows):
    """(text, term) of the terms to change, from texts as they are, word by word."""
    import math

    texts = sorted({t or "" for _, t in rows})
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for t in texts}
    n, whole, near, entities = len(texts), {}, {}, {}
    for t in texts:
        spans = [(a, b, k, t[a:b]) for a, _, b, k in brute.personal(t)]
        mails = [(a, b) for a, b, k, _ in spans if k == "email"]
        for m in re.finditer(r"[^\W\d_]+", t):
            touches = any(a <= m.end() and m.start() <= b for a, b in mails)
            if len(m.group()) >= 3 and not touches:
                w = m.group().lower()
                whole.setdefault(t, set()).add(w)
                if any(m.start() - b <= pii.REACH and a - m.end() <= pii.REACH for a, b, _, _ in spans):
                    near.setdefault(t, set()).add(w)
        for _, _, k, v in spans:
            name = re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower()
            entities.setdefault((k, name), set()).add(t)
    out = set()
    for own in entities.values():
        n_e = len(own)
        together = {}
        for t in own:
            for w in (whole if n_e > 1 else near).get(t, ()):
                together[w] = together.get(w, 0) + 1
        for w, n_te in together.items():
            n_t = sum(w in words[t] for t in texts)
            if n > n_e and math.log2(n_te * n / (n_t * n_e)) / math.log2(n / n_e) >= pii.GENERALISE:
                out |= {(t, w) for t in own if w in whole.get(t, ())}
    return out


def test_terms_equal_plain_counts(make_docs):
    r = random.Random(12)
    vocabulary = "river stone lamp Walks quiet über été naïve night Garden".split() + [f"rare{c}x" for c in "abcdefgh"]
    marks = ["zed@home.org", "198.51.100.7", "+41 22 767 61 11", "amy@work.net", "4111 1111 1111 1111"]
    texts = [None, ""]
    for i in range(60):
        w = [r.choice(vocabulary[:10]) for _ in range(30)] + [r.choice(vocabulary) for _ in range(2)]
        r.shuffle(w)
        if i % 3 == 0:  # an entity of its own, or one that goes with a word
            at = r.randrange(len(w))
            own = i // 3 % len(marks)
            w[at:at] = [f"u{i}@home.org", f"solo{'abcdefghijklmnopqrstuvwxyz'[i % 26]}"] if i % 2 else [marks[own]]
            w.insert(0, f"goes{'abcde'[own]}" if i % 2 == 0 else "x")
        texts.append(" ".join(w))
    texts += [texts[5], texts[8]]
    rows = list(enumerate(texts))
    got = set()
    for x in pii.find_personal_data(make_docs(rows)).collect():
        for s in x.spans.split(",") if x.spans else []:
            kind, a, b = s.split(":")
            if kind == "term":
                got.add((texts[x.doc_id], texts[x.doc_id][int(a) : int(b)].lower()))
    want = plain_terms(rows)
    assert got == want and want


def test_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 4)
    table = spark.range(1).select(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long")).alias("a"))
    got = table.select(pii.sums_before(F.col("a")).alias("s")).first().s
    assert got == [i * (i + 1) // 2 for i in range(30)]
