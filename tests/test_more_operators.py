import math

import numpy as np
from pyspark.sql import functions as F

from sparkdr.functions import text as tx
from sparkdr.operators import answers, calibration, features, joins, losses, metrics, retrieval, statistics as st
from sparkdr.plans import cache
from sparkdr.sources import readers, writers


def test_answer_scores(spark):
    hits = spark.createDataFrame([("q", "a", 1, "the cats slept", ["x"]), ("q", "b", 2, "dogs run in a park", ["y", "z"])], "qid string, id string, rank int, text string, keywords array<string>")
    gold = spark.createDataFrame([("q", "a dog runs in the park", ["y", "x", "w"])], "qid string, text string, keywords array<string>")
    got = {r.k: r.rouge for r in answers.rouge_at_k(hits, gold, (1, 2)).collect()}
    assert got[1] == math.floor(1000 / 6) / 1000 and got[2] == math.floor(5000 / 6) / 1000
    best = answers.best_passage(hits, gold).first()
    assert best.id == "b" and math.isclose(best.recall, 5 / 6)
    assert answers.top_hit_recall(hits, gold, 0.9).first().n_above == 0
    assert math.isclose(answers.keyword_accuracy(hits, gold, 1).first().accuracy, 1 / 3)


def test_tf_idf_is_unit_length(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, [])], "doc_id int, w array<string>")
    table = features.feature_table(docs, F.col("w"), size=10, max_df=1.0)
    assert {r.term for r in table.collect()} == {"a", "b", "c", "a b", "b a", "b c"}
    sizes = features.tf_idf(docs, F.col("w"), table).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in sizes) and len(sizes) == 2
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "term string, vector array<double>")
    got = {r.doc_id: r.vector for r in features.average_vectors(docs, F.col("w"), vectors, 2).collect()}
    assert np.allclose(got[1], [2 / 3, 1 / 3]) and np.allclose(got[2], [0, 1]) and 3 not in got


def test_small_features(spark):
    df = spark.createDataFrame([(1, '["a","b"]', '["x"]')], "id int, a string, b string")
    assert [tuple(r) for r in features.zip_json_arrays(df, "a", "b").orderBy("position").collect()] == [(1, 0, "a", "x"), (1, 1, "b", None)]
    lines = spark.createDataFrame([("run m=a k=1",), ("run m=a k=1",), ("noise",), ("run m=b k=2",)], "value string")
    assert sorted(map(tuple, features.log_records(lines, r"m=(\w+) k=(\d+)", ["m", "k"]).collect())) == [("a", "1"), ("b", "2")]


def test_losses(spark):
    rows = [("q", "a", 0.9, 0.8, True), ("q", "b", 0.2, 0.4, False), ("q", "c", 0.1, 0.1, False)]
    pairs = spark.createDataFrame(rows, "qid string, id string, full double, short double, relevant boolean")
    assert math.isclose(losses.pairwise(pairs).first().loss, 0.1) and math.isclose(losses.neighbour(pairs, 1).first().loss, 0.1, abs_tol=1e-9)
    want = np.mean([math.log1p(math.exp(n - 0.8)) for n in (0.4, 0.1)])
    assert math.isclose(losses.ranking(pairs).first().loss, want)
    e = np.exp(np.array([0.8, 0.4, 0.1]) / 0.05)
    assert math.isclose(losses.info_nce(pairs).first().loss, -math.log(e[0] / e.sum()), rel_tol=1e-6, abs_tol=1e-9)
    assert math.isclose(losses.triplet(spark.createDataFrame([(0.8, 0.7), (0.9, 0.1)], "positive double, negative double")).first().loss, 0.05)
    v = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert losses.reconstruction(v, "a", "b").first().loss == 2.0


def test_table_description_and_export(spark):
    df = spark.createDataFrame([(1, None), (1, "b")], "a int, b string")
    got = {r.column: (r.type, r.n, r.nulls) for r in st.describe_table(df).collect()}
    assert got == {"a": ("int", 2, 0), "b": ("string", 2, 1)}
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows, stats = writers.embedding_export(vectors, "v", unit=True)
    assert stats.first().max_norm == 5.0 and rows.first().v == [0.6, 0.8]
    first = writers.first_context(spark.createDataFrame([("1", [{"text": "t"}], ["a"], "m")], "id string, contexts array<struct<text:string>>, answers array<string>, extra string")).first()
    assert first.text == "t" and first.metadata == '{"extra":"m"}'
    last = readers.last_input_text(spark.createDataFrame([([{"text": "a"}, {"text": "b"}],)], "input array<struct<text:string>>"))
    assert last.first().text == "b"


def test_lookup_and_paths(spark):
    docs = spark.createDataFrame([("a.txt", None, "old"), ("b", None, "kept")], "doc_id string, url string, title string")
    lookup = spark.createDataFrame([("a.txt", "u", "new")], "doc_id string, url string, title string")
    assert sorted(map(tuple, joins.attach_lookup(docs, lookup).collect())) == [("a", "u", "new"), ("b", None, "kept")]
    got = joins.path_parts(spark.createDataFrame([("/erp-cloud/x/y.txt",)], "path string")).first()
    assert (got["product"], got["coarse_product"], got["file"]) == ("erp-cloud", "erp", "y")


def test_neighbours_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, vector array<double>")
    assert retrieval.mine_neighbours(rows, 2).count() == 12
    calls = []

    def build():
        calls.append(1)
        return rows

    for limit in (1, 1, 2):
        assert cache.cached(spark, f"file://{tmp_path}", {"limit": limit}, build).count() == 6
    assert len(calls) == 2


def test_calibrated_report(spark):
    rng = np.random.default_rng(4)
    z = rng.standard_normal(300) * 2
    rows = spark.createDataFrame([(float(1 / (1 + np.exp(-2 * v))), int(rng.random() < 1 / (1 + np.exp(-v)))) for v in z], "p double, y int")
    got = {r.calibrator: r for r in calibration.calibrated_report(rows, rows).collect()}
    assert set(got) == {"none", "temperature", "platt", "isotonic"} and got["isotonic"].ece < got["none"].ece


def test_spread_small_inputs_only(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/one"
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert readers.spread(df).rdd.getNumPartitions() == cores and readers.spread(df).count() == 100
    monkeypatch.setattr(readers, "SPREAD_BYTES", 1)
    assert readers.spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_sums_over_pairs_against_numpy(spark):
    rng = np.random.default_rng(5)
    v, label = rng.normal(size=(60, 8)), rng.integers(0, 3, 60)
    rows = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, label))], "id long, vector array<double>, label int").repartition(4)
    asked = rows.filter("id % 5 = 0").withColumnsRenamed({"id": "qid", "label": "qlabel"})
    q = np.arange(0, 60, 5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    full, short, other = v[q] @ v.T, unit(v[q, :4]) @ unit(v[:, :4]).T, q[:, None] != np.arange(60)[None]
    got = losses.prefix_losses(rows, asked, 4, 3, ("qlabel", "label"), temperature=0.001).first()
    z = np.where(other, short / 0.001, -np.inf)
    e, alike = np.exp(z - z.max(1, keepdims=True)), label[q][:, None] == label[None]
    share = (e * alike).sum(1) / e.sum(1)
    near = [np.argsort(-np.where(o, f, -np.inf))[:3] for f, o in zip(full, other)]
    assert math.isclose(got.pairwise, np.abs(full - short)[other].mean(), rel_tol=1e-6)
    assert math.isclose(got.neighbour, np.mean([np.abs(full - short)[i, n].mean() for i, n in enumerate(near)]), rel_tol=1e-6)
    assert math.isclose(got.info_nce, np.mean(-np.log(share[share > 0])), rel_tol=1e-5)
    d = np.linalg.norm(unit(v[q])[:, None] - unit(v)[None], axis=2)
    assert math.isclose(metrics.class_separation(rows, asked, ("qlabel", "label")).first().separation, d[~alike].mean() / d[alike & other].mean(), rel_tol=1e-5)
    best = {(r.qid, r["rank"]): r.id for r in retrieval.dense_top_k(rows, asked, 2, exclude_self=True, group="label").collect()}
    for i, a in enumerate(q):
        ids = sorted((-f, j) for j, f in enumerate(full[i]) if j != a)
        firsts = list({label[j]: j for _, j in reversed(ids)}.values())
        assert [best[a, 1], best[a, 2]] == sorted(firsts, key=lambda j: -full[i, j])[:2]
    assert losses.prefix_sums(rows, asked.filter("qid < 0"), 4).count() == 0


def test_group_search_with_ties_and_null_groups(spark):
    rows = spark.createDataFrame([(i, [1.0], g) for i, g in enumerate(["a", None, "b", "a", None])], "id long, vector array<double>, g string")
    asked = spark.createDataFrame([(9, [1.0])], "qid long, vector array<double>")
    assert [r.id for r in retrieval.dense_top_k(rows, asked, 3, group="g").orderBy("rank").collect()] == [0, 1, 2]


def test_nested_trimming_and_composition(spark):
    df = spark.createDataFrame([(("abcd", ["xyz", None], {"key": "uvw"}, 5),), (None,)], "r struct<a string, b array<string>, c map<string,string>, d int>")
    got = [r.t for r in df.select(tx.trim_strings(F.col("r"), df.schema["r"].dataType, 2).alias("t")).collect()]
    assert got[0].asDict() == {"a": "ab", "b": ["xy", None], "c": {"key": "uv"}, "d": 5} and got[1] is None
    texts = spark.createDataFrame([("ﬁne ①",), ("plain",), (None,)], "t string")
    assert [r.n for r in texts.select(tx.nfkc(F.col("t")).alias("n")).collect()] == ["fine 1", "plain", None]


def test_edges_and_empty_texts(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 4.9, 5.0, 9.0, 10.0, 10.1, None, float("nan"))], "x double")
    assert {r.bin: r.n for r in st.edged_histogram(df, "x", [0, 1, 5, 10]).collect()} == {1: 1, 2: 2, 3: 3}
    docs = spark.createDataFrame([("", "en"), (None, "en"), ("t", "en"), ("t", "de")], "text string, lang string")
    assert joins.non_empty(docs).count() == 2 and joins.non_empty(docs, languages=("en",)).count() == 1
