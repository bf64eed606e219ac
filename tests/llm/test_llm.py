"""The operators and the pipeline: edge cases, brute force, exact round trips, held-out accuracy."""

import collections
import hashlib
import os
import random
import re
import shutil
import subprocess
import sys
import time
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.llm import (
    bpe,
    common,
    components,
    language_id,
    license_scan,
    media_columns,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_counts,
    tokens,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, class_id string"
LINE = "This is a plain sentence with more than ten words in it, number {}."


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and one very long text, repeated rows, and columns whose names clash with results."""
    long = " ".join(f"word{i}" for i in range(60_000)) + "."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LINE.format(1), "en", "a", 10), (3, LINE.format(1), "en", "a", 10), (4, long, None, "b", len(long)), (None, "token = abcdef1", "de", None, 3), (5, " \n\t ", "fr", "a", 4), (6, "é" * 70, "fr", "c", 70)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# quality rules


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def test_quality_rules(docs, rows, edge, spark):
    for r in quality_rules.apply_rules(docs).collect():
        assert tuple(r)[1:7] == brute_measures(rows[r.doc_id]), r.doc_id
    out = quality_rules.apply_rules(edge).collect()
    assert len(out) == 8 and [r.kept for r in out if r.doc_id in (1, 2, 5)] == [False] * 3
    assert sum(r.kept for r in out if r.doc_id == 3) == 2
    assert quality_rules.apply_rules(empty(spark)).count() == 0
    kept = quality_rules.keep_good(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {3, 4}


def test_lines_fail_by_rule():
    ok = lambda line, earlier=0: not quality_rules.line_fails(line, len(line.split()), earlier, quality_rules.RULES)
    assert ok("A plain line of words.") and ok("Short heading") and ok("Ends with a quote here.”")
    assert not ok("No closing mark at the end of this")
    assert not ok("Home | News | Sports | Contact us.")
    assert not ok("WE SHOUT ALL OF THIS!!") and not ok("a### b$$$ c%%%.") and not ok("Please accept cookies to go on.")
    assert ok("Seen before.", 1) and not ok("Seen before.", 2)


# quality classifier


def test_quality_classifier(docs, edge, spark):
    found = quality_classifier.Resampler(docs, common.read(spark, SF, "labels"))
    out = found.decisions().collect()
    keys = sorted((r.key for r in out), reverse=True)
    assert len(out) == docs.count() and sum(r.kept for r in out) >= found.k
    assert found.k in (0, len(keys)) or keys[found.k - 1] == found.least_key
    kept = {r.doc_id for r in out if r.kept}
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    good = [d in kept for d, q in labels.items() if q == 1]
    bad = [d in kept for d, q in labels.items() if q == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.4 * len(bad)
    assert {r.doc_id for r in found.keep_good(docs).collect()} == kept
    none = spark.createDataFrame([], "doc_id long, quality int")
    # rows without doc_id draw by their text
    nameless = spark.createDataFrame([(None, "a b"), (None, "c d"), (None, "a b"), (5, "a b"), (5, "x")], "doc_id long, text string")
    noise = [r.g for r in nameless.select(quality_classifier.gumbel().alias("g")).collect()]
    assert noise[0] == noise[2] != noise[1] and noise[3] == noise[4]
    whole = quality_classifier.Resampler(edge, none)
    assert whole.decisions().where("kept").count() == 8 and whole.keep_good(edge).columns == edge.columns
    assert quality_classifier.Resampler(empty(spark), none).decisions().count() == 0


def test_quality_weights_equal_brute_force(docs, rows, spark):
    counts = quality_classifier.bucket_counts(docs.select("text", F.lit(False).alias("target")), 50)
    want = np.zeros(50, np.int64)
    for t in rows.values():
        np.add.at(want, quality_classifier.buckets_of(t.encode(), 50), 1)
    assert {r.bucket: r.raw for r in counts.collect()} == {i: n for i, n in enumerate(want.tolist()) if n}


def test_importance_resampling_equals_brute_force(docs, rows, spark):
    """Log ratios, keys and the draw from their definitions, on hashes that are computed anew."""
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    found = quality_classifier.Resampler(docs, common.read(spark, SF, "labels"), buckets=997)
    mask = (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", text)]
        pairs = [(a * 0x9E3779B97F4A7C15 & mask) ^ b for a, b in zip(h, h[1:], strict=False)]
        return [x % 997 for x in h] + [((p ^ p >> 32) * 0xD6E8FEB86659FD93 & mask) >> 8 for p in pairs]

    raw, target = collections.Counter(), collections.Counter()
    bags = {d: [b % 997 for b in grams(t)] for d, t in rows.items()}
    for d, bag in bags.items():
        raw.update(bag)
        if labels.get(d) == 1:
            target.update(bag)
    total, good = sum(raw.values()) + 0.5 * 997, sum(target.values())
    p = [(raw[b] + 0.5) / total for b in range(997)]
    prior = quality_classifier.PRIOR
    ratio = [np.log((target[b] + prior * p[b]) / (good + prior) / p[b]) for b in range(997)]
    weight = {d: sum(ratio[b] for b in bag) for d, bag in bags.items()}
    out = {r.doc_id: r for r in found.decisions().collect()}
    assert all(abs(out[d].log_weight - w) < 1e-6 for d, w in weight.items())
    assert found.temperature == 1.0
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality_classifier.gumbel().alias("g")).collect()}
    assert abs(np.mean(list(noise.values())) - np.euler_gamma) < 0.3 and abs(np.std(list(noise.values())) - np.pi / 6**0.5) < 0.3
    k = sum(w >= found.bound for w in weight.values())
    best = sorted(weight, key=lambda d: -(weight[d] + noise[d]))[:k]
    assert {d for d, r in out.items() if r.kept} == set(best)


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 1), 2) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 12_345, 29_999):
        assert quality_classifier.kth_largest(df, k, bins=16) == ordered[k - 1]


# language


def test_language_id(docs, edge, spark):
    model = language_id.fit(docs)
    out = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in out if r.held_out]
    assert held and sum(held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    got = {r.doc_id: r for r in language_id.identify(edge, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[5].lang_pred == "und" and got[1].score == 0
    assert language_id.identify(edge, language_id.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty(spark), model).count() == 0


def brute_kneser_ney(texts, order, alphabet):
    """Interpolated Kneser-Ney from its definition, on strings: a function of context and character."""
    counts = [collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1)) for n in range(order + 1)]
    for n in range(1, order):  # lower orders count how many characters stand before an n-gram; one that begins a text alone counts once
        before = collections.defaultdict(set)
        for g in counts[n + 1]:
            before[g[1:]].add(g[0])
        counts[n] = {g: max(1, len(before[g])) for g in counts[n]}
    discount = {}
    for n in range(1, order + 1):
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.75

    def probability(context, c):
        n = len(context) + 1
        lower = probability(context[1:], c) if context else 1 / (alphabet + 1)
        follow = {g[-1]: k for g, k in counts[n].items() if g[:-1] == context}
        total = sum(follow.values())
        if not total:
            return lower
        return max(follow.get(c, 0) - discount[n], 0) / total + discount[n] * len(follow) / total * lower

    return probability


def test_kneser_ney_equals_brute_force():
    samples = {"x": ["abab bab aab", "ba", "bbbab aab a"], "y": ["ccab cab", "abc abc"], "z": ["b"]}
    coded = {g: [language_id.folded(t.encode()) for t in ts] for g, ts in samples.items()}
    spelled = {g: [f" {t} " for t in ts] for g, ts in samples.items()}
    alphabet = len(set("".join("".join(ts) for ts in spelled.values())))
    for order in (1, 2, 3, 4):
        brute = {g: brute_kneser_ney(ts, order, alphabet) for g, ts in spelled.items()}
        for group in (1, 2, 8):
            model = language_id.Identifier.fit(coded, order, group)
            assert model.languages == ["x", "y", "z"]
            for text in ("abab", "cab cab abc", "b q zz b", "a"):
                t = f" {text} "
                want = [-sum(np.log(brute[g](t[max(0, i - order + 1) : i], c)) for i, c in enumerate(t)) / len(t) for g in model.languages]
                assert np.allclose(model.entropies([text.encode()])[0], want, atol=1e-9), (order, group, text)
        # all characters and one for the unknown ones have the whole mass
        for context in ("ab", "b", "", "cc"):
            assert abs(sum(brute["x"](context[-order + 1 :] if order > 1 else "", c) for c in "abc ?") - 1) < 1e-9


def test_languages_have_no_cap(spark):
    rows = [(300 + i, (f"{chr(0x4E00 + i % 150)}{chr(0x3041 + i % 80)} " * 30), f"l{i % 300:03}") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, per_language=50)
    assert len(model.languages) == 300 and len(model.groups) == 38
    some = language_id.training_rows(language_id.labelled(df), df.groupBy("lang").agg(F.count("*").alias("size")), 2, 10).collect()
    assert {r.lang for r in some} <= set(model.languages) and max(len(r.text) for r in some) == 10


def test_long_texts_are_scored_in_blocks(monkeypatch):
    model = language_id.Identifier.fit({g: [language_id.folded(t)] for g, t in (("x", b"abab bab aab"), ("y", b"ccab cab"))})
    text = "abba cab bac " * 3000
    whole = model.entropies([text.encode(), b"ab"])
    monkeypatch.setattr(language_id, "_CELLS", 1)
    assert np.allclose(model.entropies([text.encode(), b"ab"]), whole)


# licenses


def brute_base(text):
    low = text.translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(docs, rows, edge, spark):
    for r in license_scan.scan(docs).collect():
        assert tuple(r)[1:6] == brute_base(rows[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    texts = [
        "Released under the MIT License. Apache license and apache  LICENSE!",
        "Licensed under (see there) the Apache License, Version 2.0.",
        "the apache license",
        "Permission is hereby granted, entirely free of charge, to any person obtaining a copy of this software and the associated documentation files",
        "mit license " * 500,
        "nothing",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_base(t)
    assert got[0].labels == "apache,mit,mit-notice" and got[0].score == 1
    assert got[2].labels == "apache" and got[3].labels == "mit-text" and got[5].score == 0
    assert len(license_scan.scan(edge).collect()) == 8 and license_scan.scan(empty(spark)).count() == 0


def brute_labels(text):
    """Diagonal voting from its definition: the labels of verified diagonals and merged spans, and the greatest share of a span."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    labels, score = set(), 0.0
    for name, sentence in license_scan.TEMPLATES:
        t = license_scan.template_words(sentence)
        grams = len(t) - 2
        hits = collections.defaultdict(set)
        for i in range(len(words) - 2):
            for p in range(grams):
                if words[i : i + 3] == t[p : p + 3]:
                    hits[i - p].add(p)
        spans = []
        for d in sorted(hits):
            if not spans or d - spans[-1][-1] > license_scan.GAP:
                spans.append([])
            spans[-1].append(d)
        for span in spans:
            share = len(set().union(*(hits[d] for d in span))) / grams
            lo, hi = min(d + min(hits[d]) for d in span), max(d + max(hits[d]) for d in span)
            alone = max(len(hits[d]) for d in span) / grams
            score = max(score, share)
            if alone >= license_scan.LEAST or share >= license_scan.LEAST and hi - lo + 3 <= license_scan.SPREAD * len(t):
                labels.add(name)
    return labels, score


def test_license_labels_equal_brute_force(docs, rows, spark):
    rng = random.Random(8)
    texts = dict(rows)
    for i in range(300):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(license_scan.TEMPLATES)[1].split() * rng.choice((1, 1, 2))
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(3)] = ["x"] * rng.randrange(3)
                w = w or ["y"]
            parts.append(" ".join(w))
        texts[-1 - i] = " ".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        labels, score = brute_labels(texts[r.doc_id])
        assert set(r.labels.split(",")) - {""} == labels | (set(r.base_labels.split(",")) - {""}), texts[r.doc_id]
        assert abs(r.score - score) < 1e-12


@pytest.mark.parametrize("name", ["op3_license_scan", "op9_quality_rules", "op11_exact_dedup", "op12_fill_in_middle"])
def test_queries_equal_duckdb(spark, name):
    import duckdb

    from tagweave.llm import registry

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_paragraphs_of_licenses(spark):
    """The warranty paragraph and the sections of a license are known without its title."""
    texts = {
        "mit-text": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "apache-2.0-text": "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works.",
        "gpl-text": "4. Conveying Verbatim Copies. You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices",
        "bsd-text": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    }
    df = spark.createDataFrame([(i, f"Some words. {t} More words.") for i, t in enumerate(texts.values())], "doc_id long, text string")
    assert [r.labels for r in license_scan.scan(df).orderBy("doc_id").collect()] == list(texts)


def test_repeated_short_notices(spark):
    df = spark.createDataFrame([(1, "All rights reserved. All rights reserved."), (2, "rights reserved all")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == {1: "all-rights-reserved", 2: ""}


def test_license_templates_fit_the_bits():
    assert all(license_scan.GRAM <= len(license_scan.template_words(t)) <= 64 + license_scan.GRAM - 1 for _, t in license_scan.TEMPLATES)


# media


def test_media_columns(docs, rows, edge, spark):
    for r in media_columns.store_and_read(docs).collect():
        raw = rows[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media_columns.wav_header(len(payload)) + payload).hexdigest()
    out = media_columns.store_and_read(edge).collect()
    assert len(out) == 8 and [r.payload_bytes for r in out if r.doc_id in (1, 2)] == [64, 64]
    assert media_columns.store_and_read(empty(spark)).count() == 0


def test_chunks_are_content_defined():
    data = np.random.default_rng(1).integers(0, 256, 3_000_000, np.uint8).tobytes()
    ends = media_columns.cut_points(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media_columns.MAX_CHUNK and sizes[:-1].min() >= media_columns.MIN_CHUNK
    text = data[:500_000].hex().encode()
    assert b"".join(media_columns.chunks_of(text)) == text
    # files of different length share the chunks of a common opening
    one, two = (set(media_columns.chunks_of(media_columns.payload_of(text[:9000] + x))) for x in (b"", b" and an end of its own" * 9))
    assert len(one & two) >= len(one) - 2
    shared, moved_in = (set(media_columns.chunks_of(x + text[:8000])) for x in (b"", b"Some other words come first. " * 40))
    assert len(shared & moved_in) >= 0.5 * len(shared)
    moved = media_columns.cut_points(b"some bytes in front" + data)
    assert len({e - 19 for e in moved} & set(ends)) > 0.95 * len(ends)
    # the hash by doubling is the rolling gear hash
    h = np.uint32(0)
    with np.errstate(over="ignore"):
        for b in data[:5000]:
            h = np.uint32((int(h) << 1 & 0xFFFFFFFF) + int(media_columns._GEAR[b]) & 0xFFFFFFFF)
            last = h
    g = media_columns._GEAR[np.frombuffer(data[:5000], np.uint8)]
    for s in (1, 2, 4, 8, 16):
        g[s:] = g[s:] + (g[:-s] << np.uint32(s))
    assert g[-1] == last


# packing and tokens


def test_packing(docs, rows, edge, spark):
    lib = tokens.tokenizer(P.path("word_bpe_49k.json"))
    pieces = packing.pack(docs).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for d, t in rows.items():
        own = sorted(by_doc[d], key=lambda p: p.start)
        ids = array("I", [*lib.encode(t, add_special_tokens=False).ids, 1]).tobytes()
        assert b"".join(p.ids for p in own) == ids and {p.doc_tokens for p in own} == {len(ids) // 4}
    used = []
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        used.append(at)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert max(used) <= 2048 and padding <= 0.02 * sum(used)
    digests = {(p.doc_id, p.start): p.ids_crc32 for p in packing.pack_digests(docs).collect()}
    assert digests == {(p.doc_id, p.start): zlib.crc32(p.ids) for p in pieces}
    assert sum(p.length for p in packing.pack(edge).where("doc_id in (1, 2, 5)").collect()) == 3
    assert packing.pack(empty(spark)).count() == 0


@given(st.integers(1, 2048))
def test_rest_pieces(n):
    parts = packing.rest_pieces(n, 2048, packing.SLACK)
    assert sum(p for p, _ in parts) == n and all(p * j <= 2048 for p, j in parts) and all(j == 2048 // p or (2048 // j) == p for p, j in parts)


TEXT = st.text(st.one_of(st.sampled_from(list("ab the's.!1\n\t\x0b\x1c\x85\xa0 　é́ßΣςİ中😀‍<|>")), st.characters(exclude_categories=("Cs",))), max_size=40)
PARTS = st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", " <|startoftext|>", "don't", "  ", " x", "\n "])), max_size=5).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_chunked_tokens_equal_the_library(text):
    raw = text.encode()
    words, pieces = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    want = tokens.tokenizer(words).encode(text, add_special_tokens=False).ids
    own = _coder()(tokens.by_white_space(raw))
    assert b"".join(x[0] for x in own) == array("I", want).tobytes()
    assert b" ".join(x[1] for x in own if x[1]).decode() == tokens.tokenizer(words).decode(want, skip_special_tokens=False)
    assert b"".join(tokens.ids_of_words(words)(tokens.by_white_space(raw))) == array("I", want).tobytes()
    lengths = token_counts._lengths(pieces)(tokens.by_spaces(raw))
    assert sum(lengths) == len(tokens.tokenizer(pieces).encode(text, add_special_tokens=False).ids)


def by_blocks(coder, column, words=True):
    out = [[] for _ in range(len(column))]
    for block in tokens.word_blocks(column, words):
        known = coder(block.words)
        for k, first, to in block.spans:
            out[k].append(b"".join(known[p] for p in block.places[first:to]))
    return [b"".join(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), PARTS, st.sampled_from(["Don't STOP 'til 1st, ünï «Ça»...", "it's 'S ''s 's\n\x0bx"])), max_size=6))
def test_word_blocks_equal_the_library(texts):
    path = P.path("word_bpe_49k.json")
    want = [array("I", tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
    column = pa.array(texts, pa.string())
    assert by_blocks(tokens.ids_of_words(path), column) == want
    assert by_blocks(lambda words: [x[0] for x in _coder()(words)], column) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), PARTS), max_size=4))
def test_other_vocabularies_equal_the_library(texts):
    """A vocabulary that keeps white space takes whole texts."""
    path = P.path("byte_bpe_50k.json")
    lib, column = tokens.tokenizer(path), pa.array(texts, pa.string())
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    raw = [array("I", ids).tobytes() for ids in want]
    assert not tokens.splits_words(path) and by_blocks(tokens.ids_of_words(path), column, False) == raw
    coder = _OTHER_CODER or _OTHER_CODER.append(bpe.SpeculativeBpe(path)) or _OTHER_CODER
    assert by_blocks(lambda words: [x[0] for x in coder[0](words)], column, False) == raw
    decoded = by_blocks(lambda words: [x[1] for x in coder[0](words)], column, False)
    assert [d.decode() for d in decoded] == [lib.decode(ids, skip_special_tokens=False) for ids in want]


def test_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    path, rng = P.path("word_bpe_49k.json"), random.Random(4)
    word = "".join(rng.choice("abcdeé") for _ in range(100_000))
    texts = ["short one.", "Some words, again and again. " * 50, "x" * 300, word, " " * 500 + "end"]
    want = [array("I", tokens.tokenizer(path).encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert by_blocks(tokens.ids_of_words(path), pa.array(texts)) == want
    began = time.process_time()
    assert by_blocks(lambda words: [x[0] for x in _coder()(words)], pa.array(texts)) == want
    assert time.process_time() - began < 10
    coder = _coder()
    small = word[:3000].encode().decode("latin-1").translate(bpe._ALPHABET)
    exact = [coder.vocab[p] for p in coder.merged([*small[:-1], small[-1] + coder.end])]
    assert coder.encode_words([small]) == [exact]
    monkeypatch.setattr(bpe, "ROUNDS", 0)
    assert coder.encode_words([small, "thononing"])[0] == exact


def test_chunk_cache_keeps_two_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 6)
    asked = []
    cache = tokens.ChunkCache(lambda chunks: asked.extend(chunks) or [c + b"!" for c in chunks])
    for chunks in ([b"a", b"b", b"a"], [b"a", b"c"], [b"d", b"a"], [b"a", b"e", b"f"], [b"a", b"x" * 100]):
        assert cache(chunks) == [c + b"!" for c in chunks]
    assert asked.count(b"a") == 1 and len(cache.young) + len(cache.old) <= 8 and b"x" * 100 not in cache.young


_CODER, _OTHER_CODER = [], []


def _coder():
    if not _CODER:
        _CODER.append(bpe.SpeculativeBpe(P.path("word_bpe_49k.json")))
    return _CODER[0]


def test_token_counts_and_bpe(docs, rows, edge, spark):
    words, pieces = tokens.tokenizer(P.path("word_bpe_49k.json")), tokens.tokenizer(P.path("byte_bpe_50k.json"))
    for r in token_counts.count_tokens(docs).collect():
        n = len(pieces.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 1024)
    for r in bpe.encode_decode(docs).collect():
        ids = words.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == array("I", ids).tobytes() and r.decoded == words.decode(ids, skip_special_tokens=False)
    for op in (token_counts.count_tokens, bpe.encode_decode):
        out = op(edge).collect()
        assert len(out) == 8 and [r.n_tokens for r in out if r.doc_id in (1, 2)] == [0, 0] and op(empty(spark)).count() == 0


# secrets


def brute_spans(text):
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def test_secret_scan(docs, rows, edge, spark):
    for r in secret_scan.scan(docs).collect():
        base = ",".join(f"{k}:{a}:{b}" for a, k, b in brute_spans(rows[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    out = secret_scan.scan(edge).collect()
    assert len(out) == 8 and [r.n_assign for r in out if r.doc_id is None] == [1] and secret_scan.scan(empty(spark)).count() == 0
    clean = secret_scan.redact(edge)
    assert clean.columns == edge.columns and clean.where("doc_id is null").first().text == "[SECRET]"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", " ", '"', "pass", "secret:", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "ſecret=abcdef", "\n"]), max_size=14).map("".join))
def test_base_secrets_equal_brute_force(text):
    assert [(a, secret_scan.KINDS[k], b) for a, k, b in secret_scan.find_spans(text) if k < 3] == brute_spans(text)


def brute_entropy(text):
    """Entropy spans from their definition: every window of every candidate counted anew, then windows that touch joined."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
        s = m[0]
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(a.fullmatch(s) for a in secret_scan.ALLOWED):
            continue
        one_case = re.fullmatch("[0-9a-z]+|[0-9A-Z]+", s)
        least = 3.0 if re.fullmatch("[0-9a-fA-F]+", s) else 3.6 if one_case else 3.7
        covered = set()
        for i in range(len(s) - 19):
            n = collections.Counter(s[i : i + 20]).values()
            if -sum(c / 20 * np.log2(c / 20) for c in n) >= least - 1e-9:
                covered |= {(i + j, i + j + 1) for j in range(20)}
        runs = []
        for a, b in sorted(covered):
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        out += [(m.start() + a, m.start() + b) for a, b in runs]
    base = [(a, b) for a, _, b in brute_spans(text)]
    return [(a, b) for a, b in out if not any(s <= a and b <= e for s, e in base)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["tQ9xL2mZ8vK4bN7wR1yC", "jH3pD6fG0sA5", "q8w7e6r5t4y3u2i1o0pa", "0f1e2d3c4b5a69788796", "aaaaaaaaaa1", "EXAMPLE", "0123456789", "-", "_", "/", "=", "==", " ", "key: ", "token=", "é", "123e4567-e89b-12d3-a456-426614174000", "placeholder", "word"]), max_size=9).map("".join))
def test_entropy_spans_equal_brute_force(text):
    assert [(a, b) for a, k, b in secret_scan.find_spans(text) if k == 3] == brute_entropy(text)


def test_entropy_spans_of_all_documents(rows):
    found = [(d, a, b) for d, t in rows.items() for a, k, b in secret_scan.find_spans(t) if k == 3]
    assert found == [(d, a, b) for d, t in rows.items() for a, b in brute_entropy(t)]


def test_entropy_spans():
    assert secret_scan.entropy_spans("key tQ9xL2mZ8vK4bN7wR1yC5jH3pD6fG0sA end") and not secret_scan.entropy_spans("donaudampfschifffahrtsgesellschaft")
    assert not secret_scan.entropy_spans("123e4567-e89b-12d3-a456-426614174000") and not secret_scan.entropy_spans("a1a1a1a1a1a1a1a1a1a1a1a1a1")
    # the allow-list holds for whole candidates, not for keys that hold one of its words
    key = "tQ9xL2mZ8vK4bN7wR1yC5jH3pD6fG0sA"
    assert all(secret_scan.entropy_spans(f"{a}{key}{b}") for a, b in (("sample", ""), ("0123456789", ""), ("my-", "-key"), ("", "example")))
    assert not any(secret_scan.entropy_spans(x) for x in ("sample_api_key_0123456789_placeholder", "abcdefgh0123456789abcdefgh0123456789", "YOUR-SECRET-KEY-1234567890-HERE", "example" * 400 + "0123456789" * 400 + "!"))
    s = "".join(random.Random(2).choice("abcdefghij0123456789") for _ in range(60))
    want = [i for i in range(41) if -sum(c / 20 * np.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) >= 3.6 - 1e-9]
    got = {p for a, b in secret_scan.entropy_windows(s, 20, 3.6) for p in range(a, b)}
    assert got == {p for i in want for p in range(i, i + 20)}


# near-duplicates


def brute_classes(texts):
    shingles = {d: near_dedup.labelled_shingles(near_dedup.word_hashes(t.encode())) for d, t in texts.items()}
    ids, parent = list(texts), {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near_dedup.similarity(shingles[a], shingles[b]) > 0:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in texts}


def test_near_dedup_equals_brute_force(docs, rows):
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == brute_classes(rows)


def test_near_dedup_of_a_group_at_the_threshold(spark):
    """Variants of one text, near and beyond the threshold: pairs that only the prefix join can find count too."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((1, 3, 4, 5))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df, repeats=40).collect()} == brute_classes(texts)


def test_near_dedup_of_many_groups_that_share_passages(spark):
    """Texts that share half of their words fill common buckets without being similar; each has copies at and under the threshold."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5_000)}"
    shared = [[word() for _ in range(60)] for _ in range(3)]
    texts = {}
    for _ in range(60):
        base = rng.choice(shared) + [word() for _ in range(40)]
        for _ in range(rng.choice((1, 2, 4))):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df, repeats=40).collect()} == brute_classes(texts)


def test_near_dedup_of_texts_that_share_a_frame(spark, monkeypatch):
    """Many texts of one template, few of them similar: the pairs that are made are about those that are linked."""
    rng, made, plain = random.Random(3), [], near_dedup.prefix_join

    def counted(*rest):
        made.append(plain(*rest))
        return made[-1]

    monkeypatch.setattr(near_dedup, "prefix_join", counted)
    monkeypatch.setattr(near_dedup, "drop", lambda *tables: None)
    texts = {i: " ".join(f"v{k}-{rng.randrange(10)}" if k % 12 == 6 else f"frame{k}" for k in range(100)) for i in range(260)}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts) and len(set(got.values())) > 250
    assert made[0].count() <= 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=200), st.lists(st.integers(0, 300), max_size=200))
def test_bitmaps_never_tell_too_many_missing(a, b):
    x, y = (near_dedup.labelled_shingles(np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2) for v in (a, b))
    mx, my = (near_dedup.bitmap(v) for v in (x, y))
    missing = sum((p & ~q & (1 << 64) - 1).bit_count() for p, q in zip(mx, my, strict=True))
    assert missing <= len(set(x.tolist()) - set(y.tolist()))


def test_near_dedup_of_shared_and_missing_ids(spark):
    """Different texts under one doc_id are different documents; rows without doc_id have copies like others."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (2, b + " end"), (None, c), (None, c), (7, c), (None, d), (None, d + " more"), (8, "..."), (8, None), (9, a.upper())]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, kept_doc_id string, Row_Key string, class_id string")
    got = near_dedup.classes(df).collect()
    assert sorted(map(str, (r.class_id for r in got))) == sorted(map(str, (1, 1, 1, 7, 7, 7, None, None, 8, 8, 1)))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert left in [sorted([(1, a), (1, b), (7, c), (None, x), (8, "..."), (8, None)], key=str) for x in (d, d + " more")]


def test_near_dedup_edges(edge, spark):
    got = near_dedup.classes(edge).collect()
    assert len(got) == 8 and all(r.class_id == r.doc_id for r in got)
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 1 and kept.count() == 7
    assert near_dedup.classes(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_similarity_is_the_banded_alignment(a, b):
    x, y = (near_dedup.labelled_shingles(np.array(v, np.uint64) + np.uint64(7), 2) for v in (a, b))
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (x[i] == y[j]))
    common_ = int(table[-1, -1])
    want = common_ / (len(x) + len(y) - common_) if common_ else 0.0
    for least in (0.5, 0.8):
        assert near_dedup.similarity(x, y, least) == (want if want >= least - 1e-12 else 0.0)


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (500, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}


# pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.read(spark, SF, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, docs = {r.doc_id: r.text or "" for r in docs.collect()}, common.cut(out)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after and len(after) == docs.count()
        if name == "quality_rules":
            assert all(not brute_measures(before[d])[5] for d in after)
            assert all({*t.split("\n")} <= {*before[d].split("\n")} for d, t in after.items())
        if name == "quality_classifier":
            found = quality_classifier.Resampler(spark.createDataFrame(list(before.items()), "doc_id long, text string"), common.read(spark, SF, "labels"))
            assert set(after) == {r.doc_id for r in found.decisions().where("kept").collect()} and all(before[d] == t for d, t in after.items())
        if name == "near_dedup":
            assert after == {d: before[d] for d in set(brute_classes(before).values())}
        if name == "secret_scan":
            assert set(after) == set(before) and not any(brute_spans(t) for t in after.values())
            assert all(t == before[d] for d, t in after.items() if not secret_scan.find_spans(before[d]))
    lib = tokens.tokenizer(P.path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in pipeline.run(spark, SF).collect():
        pieces[r.doc_id].append((r.start, r.ids))
    assert set(pieces) == set(after)
    assert all(b"".join(i for _, i in sorted(own)) == array("I", [*lib.encode(after[d], add_special_tokens=False).ids, 1]).tobytes() for d, own in pieces.items())


def test_pipeline_stages_on_edge_rows(edge, spark, tmp_path):
    """Each stage takes what the one before it left of nulls, repeated rows and ids, long texts, and of a table without rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (77, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, empty(spark)):
        for name, stage in pipeline.STAGES[:-1]:
            before = docs.count()
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == edge.columns and dict(out.dtypes) == dict(edge.dtypes), name
            docs = common.cut(out)
            assert docs.count() <= before
        assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count() * bool(before)
    # a stage alone takes all the edge rows too
    for name, stage in pipeline.STAGES:
        assert stage(spark, edge, str(tmp_path)).count() > 0, name


def test_entry_without_this_subpackage(tmp_path):
    """The entry lists its other queries where this subpackage, or a library that only it needs, is missing."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(common.__file__)))
    shutil.copytree(root, tmp_path / "whole", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.copytree(tmp_path / "whole", tmp_path / "cut", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py"))
    told = "import sys; {}; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n[:2] == 'op' for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"

    def run(folder, first):
        out = subprocess.run([sys.executable, "-c", told.format(first)], cwd=tmp_path / folder, env=os.environ | {"PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(root, "")}, capture_output=True, text=True, timeout=120)
        return out.stdout.split() or out.stderr

    whole, cut, missing = run("whole", "pass"), run("cut", "pass"), run("whole", "sys.modules['tokenizers'] = None")
    assert whole[1:] == ["13", "True", "True"], whole
    assert cut[1:] == missing[1:] == ["0", "False", "True"], (cut, missing)
    assert int(whole[0]) == int(cut[0]) + 14 == int(missing[0]) + 14
