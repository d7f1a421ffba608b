import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdr.operators import biohash, calibration as cal, dedup, fusion, joins, metrics, rerank, retrieval, statistics as st, tiler
from sparkdr.sources import writers


def test_metrics_small(spark):
    hits = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "x", 1), ("q4", "z", 1)], "qid string, doc_id string, rank int")
    gold = spark.createDataFrame([("q1", "b"), ("q1", "z"), ("q2", "y"), ("q3", "m"), ("q4", "-1")], "qid string, doc_id string")
    rows = {(r.qid, r.k): r for r in metrics.per_query(hits, gold, (1, 3)).collect()}
    assert set(rows) == {(q, k) for q in ("q1", "q2", "q3") for k in (1, 3)}
    one = rows["q1", 3]
    assert (one.match, one.mrr, one.recall, one.precision) == (1, 0.5, 0.5, 1 / 3)
    assert math.isclose(one.ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3))) and math.isclose(one.ap, 0.25)
    mean = {r.k: r for r in metrics.evaluate(hits, gold, (1, 3)).collect()}
    assert mean[1].match == 0 and math.isclose(mean[3].match, 1 / 3) and mean[3].n_queries == 3
    capped = {(r.qid, r.k): r for r in metrics.per_query(hits, gold, (1, 3, 5), ideal="list_capped").collect()}
    assert all(0 <= r.ndcg <= 1 for r in capped.values())


def test_dense_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, [])], "id long, vector array<double>").repartition(3)
    q = df.filter("id % 10 = 0").select(F.col("id").alias("qid"), "vector")
    for metric, score in (("ip", x @ x.T), ("l2", 1 / (1 + np.linalg.norm(x[:, None] - x[None], axis=2)))):
        got = retrieval.dense_top_k(df, q, 5, metric, exclude_self=True).collect()
        for i in range(0, 60, 10):
            want = sorted((j for j in range(60) if j != i), key=lambda j: (-round(score[i, j], 9), j))[:5]
            assert [r.id for r in sorted((r for r in got if r.qid == i), key=lambda r: r.rank)] == want
    assert retrieval.dense_top_k(df, q.filter("qid < 0"), 5).count() == 0
    with pytest.raises(ValueError):
        retrieval.dense_top_k(df, q, 5, "nope")


def test_fusion_is_invariant_to_scale(spark):
    a = spark.createDataFrame([("q", "x", 3.0, 1), ("q", "y", 2.0, 2)], "qid string, id string, score double, rank int")
    b = spark.createDataFrame([("q", "y", 0.5, 1), ("q", "z", 0.1, 2)], "qid string, id string, score double, rank int")
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(fusion.reciprocal_rank([a, b], 3)) == order(fusion.reciprocal_rank([a.withColumn("score", F.col("score") * 7), b], 3)) == ["y", "x", "z"]
    assert order(fusion.weighted([a, b], 1, [1, 3])) == ["y"]
    with pytest.raises(ValueError):
        fusion.weighted([a, b], 1, [1.0])


def test_rerank_keeps_the_tail(spark):
    hits = spark.createDataFrame([("q", "a", 3.0, 1, 0.1), ("q", "b", 2.0, 2, 0.9), ("q", "c", 1.0, 3, 5.0)], "qid string, id string, score double, rank int, s double")
    out = rerank.rerank(hits, F.col("s"), head=2).orderBy("new_rank").collect()
    assert [r.id for r in out] == ["b", "a", "c"]
    scored = rerank.with_pair_scores(hits.withColumn("query_text", F.lit("x")).withColumn("text", F.col("id")), lambda q, t: [float(ord(c)) for c in t])
    assert [r.id for r in rerank.rerank(scored, F.col("similarity")).orderBy("new_rank").collect()] == ["c", "b", "a"]


def test_dedup(spark):
    rows = [("q", "a", 1, "same words here", "k"), ("q", "b", 2, "same words here", None), ("q", "c", 3, "Same words, here too", "k"), ("q", "d", 4, "different thing", None)]
    hits = spark.createDataFrame(rows, "qid string, id string, rank int, text string, key string")
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(dedup.keep_first(hits, "text")) == ["a", "c", "d"]
    assert ids(dedup.keep_first(hits, "key", null_is_new=True)) == ["a", "b", "d"]
    once = dedup.drop_similar(hits, 0.8)
    assert ids(once) == ["a", "d"] == ids(dedup.drop_similar(once, 0.8))


def test_calibration(spark):
    perfect = spark.createDataFrame([(0.0, 0), (0.0, 0), (1.0, 1), (1.0, 1), (1.0, 1)], "p double, y int")
    half = spark.createDataFrame([(0.5, 0), (0.5, 0), (0.5, 1), (0.5, 1), (0.5, 1)], "p double, y int")
    assert cal.brier(perfect).first().brier == 0 and cal.brier(half).first().brier == 0.25
    assert cal.calibration_errors(cal.bin_table(cal.validated(perfect))).first().ece == 0
    third = spark.createDataFrame([(0.3, 1)], "p double, y int")
    assert cal.bin_table(third).first().bin == 2  # the third edge is just above 0.3
    assert cal.bin_table(spark.createDataFrame([(0.0, 1)], "p double, y int"), right_closed=True).count() == 0
    with pytest.raises(Exception):
        cal.validated(spark.createDataFrame([(1.5, 1)], "p double, y int")).collect()
    rng = np.random.default_rng(2)
    z = rng.standard_normal(800) * 2
    rows = [(i, float(1 / (1 + np.exp(-2.5 * v))), int(rng.random() < 1 / (1 + np.exp(-v)))) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "id int, p double, y int").cache()
    assert 2.0 < cal.fit_temperature(df) < 3.1
    slope, intercept = cal.fit_platt(df)
    assert slope > 0 and intercept < 0
    name, means = cal.choose_calibrator(df, folds=2)
    assert name != "none" and set(means) == {"none", "temperature", "platt", "isotonic"}


def test_randomization_test(spark):
    rows = [(f"q{i}", 0.5, 0.5 + (0.2 if i % 7 else -0.05)) for i in range(40)]
    out = st.paired_randomization(spark.createDataFrame(rows, "qid string, baseline double, result double"), trials=300).first()
    assert out.n == 40 and out.p_value < 0.05
    same = spark.createDataFrame([(f"q{i}", 0.5, 0.5) for i in range(10)], "qid string, baseline double, result double")
    assert st.paired_randomization(same, trials=50).first().p_value == 1.0


def test_profile_matches_known_numbers(spark):
    r = st.profile(spark.range(10).select(F.col("id").alias("v")), "v").first()
    assert r.mean == 4.5 and math.isclose(r.std**2, 8.25) and math.isclose(r.std, 2.87228132326901) and r.median == 4.5


def test_stage_times(spark):
    rows = [("a::b", 4.0), ("a::c", 6.0), ("a::c", 2.0), ("d", 1.0), ("e::f::g", 3.0), ("e", 10.0)]
    got = {r.name: (r.total_ms, round(r.percent, 3)) for r in st.stage_times(spark.createDataFrame(rows, "name string, ms double")).collect()}
    assert got["a"] == (12.0, 100.0) and got["a::c"] == (8.0, 66.667) and got["e"] == (10.0, 100.0) and got["e::f"] == (3.0, 30.0)


def test_joins(spark):
    q = spark.createDataFrame([("1", "x", ["i"]), ("2", "y", []), ("3", "z", None)], "qid string, text string, relevant array<string>")
    gold = spark.createDataFrame([("1", 5), ("1", 4)], "qid string, doc_id int")
    got = {r.qid: r.relevant for r in joins.attach_gold(q, gold).collect()}
    assert got == {"1": ["4", "5"], "2": [], "3": []} and joins.drop_without_gold(joins.attach_gold(q, gold)).count() == 1
    a = spark.createDataFrame([(1, "l", "a"), (2, "l", None)], "id int, s string, t string")
    b = spark.createDataFrame([(2, None, "b"), (3, "r", "c")], "id int, s string, t string")
    assert sorted(map(tuple, joins.merge_corpora(a, b, combine=True).collect())) == [(1, "l", "a"), (2, "l", "b"), (3, "r", "c")]
    assert sorted(map(tuple, joins.merge_corpora(a, b).collect()), key=lambda r: r[0]) == [(1, "l", "a"), (2, None, "b"), (3, "r", "c")]
    codes = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 3)], "code string, doc_id int")
    asked = spark.createDataFrame([("q", "c1", "c2", None)], "qid string, a string, b string, c string")
    assert joins.expand_codes(asked, codes, ["a", "b", "c"]).first().doc_ids == [1, 2, 3]
    docs = spark.range(500).select(F.col("id").cast("string").alias("doc_id"))
    judged = spark.createDataFrame([("q1", "1"), ("q1", "2"), ("q2", "3")], "qid string, doc_id string")
    trip = joins.triplets(judged, docs).collect()
    assert len(trip) == 3 and not {(r.qid, r.negative) for r in trip} & {("q1", "1"), ("q1", "2"), ("q2", "3")}


def test_vocabulary(spark):
    f = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("s", 1)], "token string, n long")
    got = [(r.token, r.new_id) for r in st.select_vocabulary(f, 3, ["s"]).orderBy("new_id").collect()]
    assert got == [("s", 0), ("a", 1), ("b", 2)]
    p = {r.token: r.p for r in st.interpolate([(f, 3.0), (f.filter("token = 'a'"), 1.0)]).collect()}
    assert math.isclose(p["a"], 0.75 * 5 / 12 + 0.25) and math.isclose(sum(p.values()), 1)


def test_hash_codes(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 16)) * 3
    x = [centres[i % 4] + rng.standard_normal(16) * 0.2 for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    model = biohash.fit(df, "v", "id", active=4, neurons=40, epochs=4)
    codes = biohash.encode(df, model, "v", "id").cache()
    stats = biohash.code_statistics(codes).first()
    assert (stats.n, stats.mean_active, stats.std_active) == (120, 4.0, 0.0)
    local = {r.id: set(r.active) for r in codes.collect()}
    hits = retrieval.hamming_top_k(codes, codes.filter("id % 20 = 0"), 5, 40, exclude_self=True).collect()
    for q in range(0, 120, 20):
        want = sorted((8 - 2 * len(local[q] & local[j]), j) for j in local if j != q)[:5]
        assert sorted((r.score, r.id) for r in hits if r.qid == q) == want
    links = {(r.a, r.b): r.distance for r in biohash.near_code_links(codes, 2).collect()}
    want = {(a, b): 8 - 2 * len(local[a] & local[b]) for a in local for b in local if a < b and 8 - 2 * len(local[a] & local[b]) <= 2}
    assert links == want
    assert np.isfinite(model.energy(np.array(x)))


def test_equal_codes_are_one_class(spark):
    rows = [(i, [0, 1, 2]) for i in range(1, 6)] + [(9, [2, 1, 0]), (10, [1, 2, 3]), (11, [7, 8, 9])]
    got = {r.id: (r.class_id, r.n_links) for r in biohash.near_code_classes(spark.createDataFrame(rows, "id long, active array<int>"), 2).collect()}
    assert got == {**{i: (1, 6) for i in (1, 2, 3, 4, 5, 9)}, 10: (10, 6), 11: (11, 0)}


def test_saved_statistics_and_filters_of_bm25(spark):
    texts = spark.createDataFrame([(1, "a b b", "x"), (2, "a c", "y"), (3, "b c c c", "x"), (4, "d", "y")], "id long, text string, lang string")
    asked = spark.createDataFrame([(7, "b c", "x"), (8, "a", "y")], "qid long, text string, qlang string")
    words = lambda c: F.split(c, " ")
    plain = retrieval.bm25_top_k(texts, asked, words, 10).collect()
    saved = retrieval.bm25_top_k(texts, asked, words, 10, statistics=retrieval.bm25_statistics(texts, words)).collect()
    place = lambda r: (r.qid, r.rank)
    assert sorted(plain, key=place) == sorted(saved, key=place)
    allowed = retrieval.where_equal(texts, asked, [("qlang", "lang")])
    got = {(r.qid, r.id) for r in retrieval.bm25_top_k(texts, asked, words, 10, allowed=allowed).collect()}
    assert got == {(7, 1), (7, 3), (8, 2)}


def test_character_windows(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab")], "id long, text string")
    got = [(r.id, r.window, r.start, r.piece) for r in tiler.char_windows(df, "text", 4, 1).orderBy("id", "window").collect()]
    assert got == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij"), (4, 0, 0, "ab")]


def test_metric_and_timing_files(spark, tmp_path):
    path = f"file://{tmp_path}"
    writers.write_metrics(spark.createDataFrame([(10, 0.5)], "rank int, ndcg double"), f"{path}/m", "one")
    writers.write_metrics(spark.createDataFrame([(10, 0.6)], "rank int, ndcg double"), f"{path}/m", "two")
    assert sorted((r.system, r.ndcg) for r in spark.read.csv(f"{path}/m", header=True, inferSchema=True).collect()) == [("one", 0.5), ("two", 0.6)]
    writers.write_timings(spark, {"ingest": 3.0, "search": 1.0}, f"{path}/t", "one")
    assert sorted((r.stage, r.share) for r in spark.read.csv(f"{path}/t", header=True, inferSchema=True).collect()) == [("ingest", 0.75), ("search", 0.25)]


def test_similar_hits_of_long_lists(spark):
    rows = [(q, f"w{i // 2} v{i // 2} {'same' if q else ''}", i) for q in (0, 1) for i in range(1_200)]
    got = dedup.drop_similar(spark.createDataFrame(rows, "qid int, text string, rank int").repartition(3), 0.9)
    assert sorted(map(tuple, got.select("qid", "rank").collect())) == [(q, i) for q in (0, 1) for i in range(0, 1_200, 2)]
