"""Tokenizers, licences, quality and toxicity on small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkdr.llm import bpe_codec, license_scan, rules, token_counts, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "I'LL don't 'S", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "  two  spaces\n\n\tand tabs ", "ΟΔΟΣ ΣΑΣ İstanbul", "x" * 5000, "ab" * 2000, "naïve café 中文 😀 ①②", "\x00\x1c\x85\xa0　"]
TEXTS = st.text(alphabet="abcXYZ éßΣσ'’١½٣ \t\n\r\x85\xa0　\x1c!?#<|endoftext|>中😀ͅﬁ\x00", max_size=60)


def frame(spark, texts, first=0):
    rows = [(first + i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int")  # clashing names


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_token_counts_match_the_library(text):
    library = Tokenizer.from_file(BYTE) if not hasattr(test_token_counts_match_the_library, "t") else test_token_counts_match_the_library.t
    test_token_counts_match_the_library.t = library
    assert token_counts._counter(BYTE)(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_codec_matches_the_library(text):
    library = Tokenizer.from_file(WORD) if not hasattr(test_codec_matches_the_library, "t") else test_codec_matches_the_library.t
    test_codec_matches_the_library.t = library
    ids, decoded = bpe_codec.codec(WORD).run([text])[0]
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, expected))
    assert decoded == library.decode(expected, skip_special_tokens=False)


def test_token_counts_on_a_table(spark):
    library = Tokenizer.from_file(BYTE)
    out = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, [*ODD, None, "a"]), BYTE, limit=100).collect()}
    for i, t in enumerate([*ODD, "", "a"]):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len(t.encode()), n, n > 100)
    assert token_counts.count_tokens(frame(spark, []), BYTE).count() == 0


def test_codec_on_a_table(spark):
    library = Tokenizer.from_file(WORD)
    texts = [*ODD, None, "a"]
    digests = {r.doc_id: r for r in bpe_codec.encode_digests(frame(spark, texts), WORD).collect()}
    whole = {r.doc_id: r for r in bpe_codec.encode_decode(frame(spark, texts), WORD).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert whole[i].ids == ids and whole[i].decoded == decoded
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_codec.encode_digests(frame(spark, []), WORD).count() == 0


def brute_license(text, threshold):
    best = []
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    body = re.sub(r"[^a-z0-9\n]+", " ", lowered)
    units = [(i, u) for i, u in enumerate(body.split("\n"))] + ([(-1, body.replace("\n", " "))] if "\n" in body else [])
    for at, unit in units:
        a = license_scan.bigrams(unit.split())
        found = []
        for name, template in license_scan.TEMPLATES:
            b = license_scan.bigrams(license_scan.normalize(template))
            if a:
                found.append((-round(2 * len(a & b) / (len(a) + len(b)), 9), name))
        found = [f for f in found if -f[0] >= threshold]
        if found:
            best.append((at, min(found)[1], -min(found)[0]))
    return sorted(best)


def test_license_scan_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["", None, "nothing here", "RELEASED under the MIT license!", "Released under the MIT License.\nLicensed under CC BY 4.0", "word " * 30_000]
    for name, template in license_scan.TEMPLATES:
        words = template.split()
        texts.append(template)
        for _ in range(3):
            edited = [w if rng.random() > 0.07 else "other" for w in words]
            at = rng.randrange(len(edited))
            texts.append("Some prose first.\n" + " ".join(edited[:at]) + "\n" * (rng.random() < 0.5) + " " + " ".join(edited[at:]))
    got: dict = {}
    for r in license_scan.scan(frame(spark, texts), 0.8).collect():
        got.setdefault(r.doc_id, []).append((r.position, r.license, r.dice))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_license(t, 0.8), t
    summary = {r.doc_id: r for r in license_scan.summarize(frame(spark, texts), 0.8).collect()}
    assert len(summary) == len(texts) and summary[2].n_matches == 0 and summary[2].license is None
    assert license_scan.summarize(frame(spark, []), 0.8).count() == 0


def test_license_rows_that_repeat(spark):
    twice = frame(spark, ["Released under the MIT License"]).unionByName(frame(spark, ["Released under the MIT License"]))
    rows = license_scan.summarize(twice).collect()
    assert [(r.n_matches, r.license) for r in rows] == [(1, "MIT line")] * 2


@pytest.mark.parametrize("seed", range(3))
def test_rules_learn_a_conjunction(seed):
    rng = np.random.default_rng(seed)
    x = rng.random((1500, len(rules.STATISTICS)))
    y = ((x[:, 3] < 0.4) & (x[:, 6] > 0.3)).astype(float)
    model = rules.fit_rules(x[:1000], y[:1000])
    margin = model.intercept + sum(w * rules._fires(r, x[1000:]) for r, w in model.rules)
    assert ((margin > 0) == (y[1000:] > 0)).mean() > 0.97
    assert len(model.rules) < 120 and len(model.describe()) == len(model.rules)


def _labelled(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            words = [w + "$$$" for w in words]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "moron", "scum"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    model = rules.fit_quality(docs, labels)
    out = rules.score_quality(docs.unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", "x")], docs.schema)), model)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[-1].score == rows[-2].score and 0 <= rows[-1].score <= 1
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in held) for i in truth)
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.95
    kept = rules.keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in truth if rows[i].score >= 0.3}


def test_quality_without_labels(spark):
    docs, labels = _labelled(spark, 20)
    model = rules.fit_quality(docs, labels.filter("doc_id < 0"))
    assert {round(r.score, 9) for r in rules.score_quality(docs, model).collect()} == {0.5}
    assert rules.score_quality(docs.filter("doc_id < 0"), model).count() == 0


def brute_segments(scores):
    """All maximal scoring subsequences by repeated search for the best one."""
    out = []

    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and j - i < best[2] - best[1] - 1)):
                    best = (total, i, j + 1)
        if best:
            out.append(best[1:] + (best[0],))
            search(a, best[1])
            search(best[2], b)

    search(0, len(scores))
    return sorted(out)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=24))
def test_maximal_segments_against_search(values):
    scores = np.array(values, float) + np.linspace(0, 1e-3, len(values)) ** 2
    got = sorted(toxicity.maximal_segments(scores))
    want = brute_segments(scores.tolist())
    assert math.isclose(max((s[2] for s in got), default=0), max((s[2] for s in want), default=0), abs_tol=1e-6)
    assert len(got) == len(want)
    assert all(math.isclose(g[2], w[2], abs_tol=1e-6) for g, w in zip(got, want))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "!!! ...", "x"), (-4, "scum moron " + "abc " * 50_000, "x")], docs.schema)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionByName(extra), model).collect()}
    assert rows[-1].score == rows[-2].score == rows[-3].score < 0.3
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (i in held) for i in truth)
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.93
    found = toxicity.toxic_passages(docs, model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("evidence").alias("e")).collect()
    assert all(r.n >= 1 and r.e > 0 for r in found)


def test_toxicity_without_labels(spark):
    docs, labels = _labelled(spark, 12)
    model = toxicity.fit_toxicity(docs, labels.filter("doc_id < 0"))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}
