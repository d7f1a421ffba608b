"""The pipeline stages against brute force on a small corpus, each on its predecessor's rows."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkdr.llm import mixing, rules
from tests.llm.test_dedup_operators import LOWER, brute_components, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder, n=260, seed=9):
    rng = random.Random(seed)
    docs, labels, good = [], [], []
    for i in range(n):
        bad = i % 5 == 0
        roll = rng.random()
        if good and not bad and roll < 0.15:
            text = rng.choice(good)
        elif good and not bad and roll < 0.4:
            words = rng.choice(good).split(" ")
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
            text = " ".join(words)
        else:
            text = " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(30, 150)))
            text = " ".join(w + "###" for w in text.split()) if bad else text
        if not bad:
            good.append(text)
        docs.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    make(spark, folder)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(("documents", docs, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        after.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, docs.collect()))
    return folder, out


def test_names_and_columns(results):
    _, out = results
    assert [name for name, _, _ in out[1:]] == ["quality", "exact", "near", "mix", "encode"]
    assert all(df.columns == out[0][1].columns for _, df, _ in out[:-1])


def test_quality_stage(spark, results):
    folder, out = results
    model = rules.fit_quality(out[0][1], spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.score for r in rules.score_quality(out[0][1], model).collect()}
    assert {r.doc_id for r in out[1][2]} == {i for i, s in scores.items() if s >= 0.3}
    assert {r.doc_id for r in out[1][2]} == {r.doc_id for r in out[0][2] if "###" not in r.text}


def test_exact_and_near_stages(results):
    _, out = results
    last = {}
    for r in out[1][2]:
        key = r.text.encode().translate(LOWER)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in out[2][2]) == sorted(last.values())
    components = brute_components([(r.doc_id, r.text, None) for r in out[2][2]], 5, 80)
    assert sorted(r.doc_id for r in out[3][2]) == sorted(i for i, (_, c) in components.items() if i == c)
    assert 0 < len(out[3][2]) < len(out[2][2]) < len(out[1][2])


def test_mix_stage(results):
    _, out = results
    plan = {r.doc_id: r for r in mixing.mix(out[3][1]).collect()}
    counts = collections.Counter(r.doc_id for r in out[4][2])
    assert counts == {i: n for i, r in plan.items() if (n := int(r.taken / r.size + 0.5))}
    size = {r.doc_id: len(words_of(r.text)) for r in out[3][2]}
    for s in {r.source for r in out[3][2]}:
        own = [r.doc_id for r in out[3][2] if r.source == s]
        assert abs(sum(plan[i].taken for i in own) - plan[own[0]].target) <= 4
        assert sum(size[i] for i in own) == plan[own[0]].source_size


def test_encode_stage(results):
    _, out = results
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in out[4][2]}
    assert collections.Counter(r.doc_id for r in out[5][2]) == collections.Counter(r.doc_id for r in out[4][2])
    for r in out[5][2]:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_applies_the_stages(spark, results):
    folder, out = results
    got = collections.Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == collections.Counter((r.doc_id, r.decoded_sha256) for r in out[-1][2])


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
