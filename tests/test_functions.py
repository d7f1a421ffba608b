import math

import pytest
from pyspark.sql import functions as F

from sparkdr.functions import paths, stem, text as tx, vectors as vx
from sparkdr.operators import tiler


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def col(value):
    return F.lit(value)


RECORDS = [
    {"query_id": "q1", "positives": {"doc_id": ["a", "b"], "docs": ["t1", "t2"]}, "negatives": {"docs": ["n1", "n2", "n3"]}, "items": [{"v": 1, "w": None}, {"v": 2, "w": "x"}]},
    {"query_id": "q2", "positives": {"doc_id": ["c"], "docs": ["t3"]}, "negatives": {"docs": ["n4", "n5"]}, "items": []},
]
SCHEMA = "query_id string, positives struct<doc_id:array<string>,docs:array<string>>, negatives struct<docs:array<string>>, items array<struct<v:int,w:string>>"


def test_nested_paths(spark):
    df = spark.createDataFrame(RECORDS, SCHEMA)
    get = lambda p: [r.x for r in df.select(paths.nested(df, p).alias("x")).collect()]
    assert get("positives.docs") == [["t1", "t2"], ["t3"]]
    assert get("negatives.docs[0]") == ["n1", "n4"] == get("negatives.docs.0")
    assert get("negatives.docs[*]") == get("negatives.docs[]") == [["n1", "n2", "n3"], ["n4", "n5"]]
    assert get("positives.docs[5]") == [None, None]
    assert get("items.v") == [[1, 2], []] and get("items.w") == [["x"], []]
    for bad in ("nope", "positives.nope", "query_id.x", "items[*].z"):
        with pytest.raises(paths.PathError):
            get(bad)
    assert [r.x for r in df.select(paths.first_present(df, "nope|query_id").alias("x")).collect()] == ["q1", "q2"]
    assert df.select(paths.first_present(df, "nope", default="d").alias("x")).first().x == "d"


def test_json_paths_present_null_wins(spark):
    get = lambda j, p: one(spark, paths.json_first_present(col(j), p))
    assert get('{"a": 1, "b": 2}', "x|b|a") == "2"
    assert get('{"a": null, "b": 2}', "a|b") is None
    assert get('{"a": {"b": [5, 6]}}', "a.b.1") == "6"


@pytest.mark.parametrize(
    "given,wanted",
    [
        ("https://h/docs/en/app/2.5.0?topic=x#y", "https://h/docs/en/app/latest?topic=x"),
        ("https://h/docs/en/app/13", "https://h/docs/en/app/latest"),
        ("https://h/docs/en/2024/app?x=1", "https://h/docs/en/2024/app?x=1"),
        ("https://h/other/2.5", "https://h/other/2.5"),
        ("https://h/docs/a/1.0/2.0?q", "https://h/docs/a/1.0/latest?q"),
        (None, None),
    ],
)
def test_normalized_urls(spark, given, wanted):
    assert one(spark, tx.normalize_doc_url(col(given).cast("string"))) == wanted


@pytest.mark.parametrize("given,wanted", [("p001-0-174", "p001"), ("a-b-1-2", "a-b"), ("a-1-2-3-4", "a-1-2"), ("plain", "plain"), ("x-1", "x-1")])
def test_original_ids(spark, given, wanted):
    assert one(spark, tx.original_id(col(given))) == wanted


TITLES = [(0, "all", False, True), (0, "first", False, True), (0, "none", False, False), (0, "all", True, False), (1, "all", False, True), (1, "first", False, False), (5, "none", False, False)]


@pytest.mark.parametrize("index,policy,opens,wanted", TITLES)
def test_title_policy(spark, index, policy, opens, wanted):
    assert one(spark, tx.needs_title(col(index), policy, col(opens))) is wanted


def test_titles_and_trimming(spark):
    assert one(spark, tx.with_title(col("body"), col("T"))) == "T\nbody"
    assert one(spark, tx.with_title(col("  T body"), col("T"))) == "  T body"
    assert one(spark, tx.with_title(col("body"), col(""))) == "body"
    assert one(spark, tx.trim(col("abcdef"), "3c")) == "abc" and one(spark, tx.trim(col("a  b c d"), "2t")) == "a b"
    assert one(spark, tx.trim_chars(col("abcdef"), 3, "!")) == "abc!" and one(spark, tx.trim_chars(col("abc"), -1)) == "abc"


def test_text_cleaning(spark):
    assert one(spark, tx.mask_urls(col("see https://a.b/c?d=1 and http://x.y."))) == "see URL and URL"
    assert one(spark, tx.remove_stop_words(col("The cat and THE hat"))) == "cat hat"
    assert one(spark, tx.detokenize(col("it 's ( a ) test , `` quoted '' 1 : 2 : 3 \\n  next  line "))) == "it's (a) test, \"quoted\" 1: 2: 3\nnext line"
    assert one(spark, tx.identifier(col("--my name/v1.2--"))) == "my_name_v1_2"
    assert one(spark, tx.analyze(col("The Cats' dog's stories"), "text_stop")) == ["cat", "dog", "story"]
    assert one(spark, tx.analyze(col("A  b"), "whitespace_lowercase")) == ["a", "b"]
    assert one(spark, tx.analyze(col("L'école des élèves"), "fr")) == ["ecol", "des", "elev"]
    assert one(spark, tx.list_literal(col("['a', \"b c\", 3]"))) == ["a", "b c", "3"]
    assert one(spark, tx.list_literal(col("plain"))) == ["plain"]
    with pytest.raises(ValueError):
        tx.analyze(col("x"), "nope")


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("conditional", "condit"), ("electrical", "electr"), ("adoption", "adopt"), ("controlling", "control"), ("agreed", "agre"), ("sky", "sky"), ("generalizations", "gener"), ("oscillators", "oscil")])
def test_porter(word, root):
    assert stem.porter(word) == root


def test_rouge():
    a, b = stem.rouge_words("the cats sat on the mat"), stem.rouge_words("a cat sat on a mat")
    p, r, f = stem.rouge_n(a, b)
    assert (round(p, 6), round(r, 6)) == (round(4 / 6, 6), round(4 / 6, 6)) and math.isclose(f, 4 / 6)
    assert stem.rouge_l(a, b)[1] == 4 / 6 and stem.rouge_n([], b) == (0.0, 0.0, 0.0)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.dot(a, b)) == 24 and one(spark, vx.norm(a)) == 5 and math.isclose(one(spark, vx.cosine(a, b)), 0.96)
    assert one(spark, vx.normalized(a)) == [0.6, 0.8] and one(spark, vx.normalized(zero)) == [0.0, 0.0]
    assert one(spark, vx.normalized(zero, drop_zero=True)) is None and one(spark, vx.cosine(a, zero)) is None
    assert one(spark, vx.prefix(a, 1)) == [1.0] and one(spark, vx.permuted(a, [1, 0])) == [4.0, 3.0]
    assert math.isclose(one(spark, vx.l2_distance(a, b)), math.sqrt(2))


PACKED = [([10], 100, 100, 5, [[0, 0]]), ([10, 10], 100, 100, 5, [[0, 1]]), ([5, 5, 5, 5], 100, 100, 5, [[0, 3]])]


@pytest.mark.parametrize("lengths,most,first,stride,wanted", PACKED)
def test_pack_exact(lengths, most, first, stride, wanted):
    assert tiler.pack_segments(lengths, most, first, stride) == wanted


@pytest.mark.parametrize("lengths,most,first,stride,least", [([30] * 4, 50, 50, 10, 2), ([15] * 4, 60, 20, 5, 2), ([10] * 20, 50, 50, 10, 4)])
def test_pack_properties(lengths, most, first, stride, least):
    out = tiler.pack_segments(lengths, most, first, stride)
    assert len(out) >= least and out[0][0] == 0 and out[-1][1] == len(lengths) - 1
    assert all(b[0] <= a[1] + 1 and b[0] > a[0] for a, b in zip(out, out[1:]))
    assert all(sum(lengths[a : b + 1]) <= (first if i == 0 else most) for i, (a, b) in enumerate(out))


def test_tiles_cover_the_text(spark):
    long = "One sentence here. " * 40 + "verylongword" * 3 + " end."
    rows = [("a", "T", "short text"), ("b", "T", long), ("c", "", None), ("d", None, "ünïcode https://x.y/z text"), ("e", "T", "w " * 300)]
    docs = spark.createDataFrame(rows, "id string, title string, text string")
    out = tiler.tile(docs, most=40, stride=8).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        by.setdefault(r.doc_id, []).append(r)
    assert by["a"][0].id == "a-0-10" and by["a"][0].text == "T\nshort text" and "c" not in by
    assert by["d"][0].text == "ünïcode URL text"
    assert len(by["b"]) > 1 and len({r.id for r in out}) == len(out) and all(r.tlen <= 40 for r in out)
    assert all(r.text.startswith("T\n") for r in by["b"])
    covered = 0
    for r in by["b"]:
        assert r.start <= covered
        covered = max(covered, r.end)
    assert covered == len(long)
    assert len(by["e"]) >= 8
    none = tiler.tile(docs, most=40, stride=8, policy="none").collect()
    assert not any(r.text.startswith("T\n") for r in none)
