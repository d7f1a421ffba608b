import bz2
import json
import lzma

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkdr.__main__ import main
from sparkdr.plans import config as cf
from sparkdr.plans.search import Engine
from sparkdr.sources import readers, writers
from sparkdr.streaming import incremental

PASSAGES = [
    {"id": "p1", "title": "Whales", "text": "Whales are large marine mammals that breathe air."},
    {"id": "p2", "title": "Bees", "text": "Bees collect nectar and pollinate flowers in gardens."},
    {"id": "p3", "title": "Volcano", "text": "A volcano erupts molten rock and ash from the mantle."},
    {"id": "p4", "title": "Rivers", "text": "Rivers carry water from mountains to the sea."},
    {"id": "p5", "title": "Glacier", "text": "Glaciers are rivers of ice that carve mountains slowly."},
]
QUESTIONS = [
    {"id": "q1", "text": "which mammals live in the sea and breathe air", "relevant": ["p1"]},
    {"id": "q2", "text": "who pollinate flowers", "relevant": ["p2"]},
    {"id": "q3", "text": "molten rock from a volcano", "relevant": ["p3"]},
]


@pytest.mark.parametrize("preset", ["bm25", "bm25-floored", "dense", "dense-cosine", "dense-l2", "sparse", "hybrid-rrf", "hybrid-weighted", "rerank-dense"])
def test_engine_end_to_end(spark, preset):
    engine = Engine.from_preset(spark, preset, retrieval={"top_k": 3})
    engine.ingest(engine.read_data(PASSAGES))
    questions = engine.read_questions(spark.createDataFrame(QUESTIONS, "id string, text string, relevant array<string>"))
    hits = engine.search(questions)
    assert {"qid", "id", "doc_id", "score", "rank", "title", "text"} <= set(hits.columns)
    gold = questions.select("qid", F.explode("relevant").alias("doc_id"))
    got = {r.k: r for r in engine.evaluate(hits, gold).collect()}
    assert got[3].match == 1.0 and got[1].mrr >= 0.6


def test_prefixes_and_filters(spark):
    seen = []

    def encode(texts):
        seen.append(sorted(r.text[:2] for r in texts.collect())[0])
        from sparkdr.plans.search import hashed_encoder

        return hashed_encoder(32)(texts)

    engine = Engine.from_preset(spark, "dense", retrieval={"query_prefix": "q:", "document_prefix": "d:", "filters": [{"query": "lang", "document": "language"}]})
    engine.encoder = encode
    docs = [p | {"language": "en" if i % 2 else "de"} for i, p in enumerate(PASSAGES)]
    engine.ingest(engine.read_data(docs, keep=("language",)))
    questions = engine.read_questions(spark.createDataFrame(QUESTIONS, "id string, text string, relevant array<string>")).withColumn("lang", F.lit("en"))
    assert {r.doc_id for r in engine.search(questions).collect()} == {"p2", "p4"} and set(seen) == {"q:", "d:"}


def test_duplicate_removal(spark):
    engine = Engine.from_preset(spark, "bm25", retrieval={"duplicate_removal": "rouge", "similarity": 0.9})
    engine.ingest(engine.read_data([*PASSAGES, {"id": "copy", "title": "Bees", "text": PASSAGES[1]["text"]}]))
    hits = engine.search(engine.read_questions(spark.createDataFrame(QUESTIONS[1:2], "id string, text string, relevant array<string>"))).collect()
    assert len([r for r in hits if "nectar" in r.text]) == 1 and sorted(r.rank for r in hits) == list(range(1, len(hits) + 1))


def test_readers(spark, tmp_path):
    lines = "\n".join(map(json.dumps, PASSAGES))
    (tmp_path / "a.jsonl").write_text(lines)
    (tmp_path / "b.jsonl.bz2").write_bytes(bz2.compress(lines.encode()))
    (tmp_path / "c.jsonl.xz").write_bytes(lzma.compress(lines.encode()))
    (tmp_path / "d.json").write_text(json.dumps(PASSAGES))
    (tmp_path / "e.tsv").write_text("id\ttext\tanswers\n1\thello\t['x', 'y']\n2\tbye\tz\n")
    (tmp_path / "f.csv").write_text('id,text\n1,"a ""b"", c"\n')
    for name in ("a.jsonl", "b.jsonl.bz2", "c.jsonl.xz", "d.json"):
        assert sorted(r.id for r in readers.read_records(spark, str(tmp_path / name)).collect()) == ["p1", "p2", "p3", "p4", "p5"]
    assert readers.read_records(spark, str(tmp_path / "a.jsonl"), limit=2).count() == 2
    assert {r.product for r in readers.read_records(spark, f"prod:{tmp_path}/a.jsonl").collect()} == {"prod"}
    tsv = {r.id: r.answers for r in readers.read_records(spark, str(tmp_path / "e.tsv"), list_columns=("answers",)).collect()}
    assert tsv == {"1": ["x", "y"], "2": ["z"]}
    assert readers.read_records(spark, str(tmp_path / "f.csv")).first().text == 'a "b", c'
    assert readers.read_many(spark, [f"{tmp_path}/{{a,d}}.json*"]).count() == 10
    with pytest.raises(ValueError):
        readers.file_kind("x.docx")
    (tmp_path / "list").write_text(f"@{tmp_path}\na.jsonl\n")
    assert readers.file_list(str(tmp_path / "list")) == [f"{tmp_path}/a.jsonl"]
    (tmp_path / "corpus.tsv").write_text("id\ttitle\ttext\tanswers\n1\tT\tbody\ta::b\n")
    assert readers.read_corpus_tsv(spark, str(tmp_path / "corpus.tsv")).first() == ("1", "T", "T body", ["a", "b"])
    texts = readers.extract_texts(readers.read_records(spark, str(tmp_path / "a.jsonl")), limit=3)
    assert texts.count() == 3
    shaped = readers.map_fields(readers.read_records(spark, str(tmp_path / "a.jsonl")), {"id": "meta.source.id", "text": "text"}, {"meta.kind": "x"}).first()
    assert shaped.meta.source.id == "p1" and shaped.meta.kind == "x"


def test_questions_and_judgements(spark, tmp_path):
    df = spark.createDataFrame([("q1", "t", "a, b", "x::y"), (None, "u", "", None)], "qid string, question string, relevant string, answers string")
    rows = {r.text: r for r in readers.read_questions(df).collect()}
    assert rows["t"].relevant == ["a", "b"] and rows["t"].answers == ["x", "y"] and rows["u"].relevant == []
    (tmp_path / "trec.tsv").write_text("q1\t0\td1\t1\nq1\t0\td2\t0\nq2\t0\td3\t2\n")
    (tmp_path / "beir.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td3\t1\n")
    for name in ("trec.tsv", "beir.tsv"):
        assert sorted((r.qid, r.doc_id) for r in readers.read_judgements(spark, str(tmp_path / name)).collect()) == [("q1", "d1"), ("q2", "d3")]
    mixed = spark.createDataFrame([("q", "d", 1.0, None), ("q", "d", None, 2.0)], "query_id string, docid string, relevance double, score double")
    assert readers.read_relevance_records(mixed).first().relevance == 2.0


def test_results_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([("q1", "p1-0-5", 2.0, 1, "t", "x"), ("q1", "p2-0-5", 1.0, 2, "t", "y")], "qid string, id string, score double, rank int, title string, text string")
    questions = spark.createDataFrame([("q1", "what"), ("q2", "none")], "qid string, text string")
    writers.write_results(hits, questions, str(tmp_path / "out.jsonl"))
    back = readers.read_results(readers.read_records(spark, str(tmp_path / "out.jsonl"))).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score, r.rank) for r in back] == [("q1", "p1-0-5", 2.0, 1), ("q1", "p2-0-5", 1.0, 2)]
    with pytest.raises(Exception):
        writers.write_results(hits, questions, str(tmp_path / "out.jsonl"))
    writers.write_trec(hits.withColumnRenamed("id", "doc_id"), str(tmp_path / "run"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "run")).collect()) == ["q1\t0\tp1-0-5\t2.0", "q1\t0\tp2-0-5\t1.0"]
    assert main(["convert", "to-trec", str(tmp_path / "out.jsonl"), str(tmp_path / "run2")]) == 0
    stored = Engine.from_preset(spark, "stored", retrieval={"path": str(tmp_path / "out.jsonl")})
    assert stored.search(questions).count() == 2


def test_tables(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    spark.sql("DROP TABLE IF EXISTS t_index")
    assert writers.save_table(a, "t_index") == "create" and writers.save_table(b, "t_index") == "skip"
    assert writers.save_table(b, "t_index", exists="update") == "update"
    assert sorted(map(tuple, spark.table("t_index").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    spark.sql("DROP TABLE t_index")


def test_config():
    assert cf.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert cf.parse_overrides(["retrieval.top_k=5", "retrieval.metric=l2"]) == {"retrieval": {"top_k": 5, "metric": "l2"}}
    assert cf.resolve({"name": "x", "s": {"path": "{{name}}/y", "n": "{{m}}", "m": 3}})["s"] == {"path": "x/y", "n": 3, "m": 3}
    assert cf.load("dense", overrides=["retrieval.top_k=7"]).retrieval.top_k == 7
    for bad in (["retrieval.nope=1"], ["nope.x=1"], ["retrieval.engine=zzz"], ["retrieval.engine=hybrid"], ["broken"]):
        with pytest.raises(cf.ConfigError):
            cf.load(overrides=bad)
    with pytest.raises(cf.ConfigError):
        cf.resolve({"a": "{{missing}}"})
    assert len(cf.PRESETS) >= 10 and all(cf.build(cf.preset(p)) for p in cf.PRESETS)


def test_presets_command(capsys):
    assert main(["presets"]) == 0 and "bm25" in capsys.readouterr().out


def test_streaming(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "click", 1.0), (2, "2024-01-01 00:50:00", "click", 2.0), (2, "2024-01-01 00:50:00", "click", 2.0), (1, "2024-01-01 02:00:00", "view", 3.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(stream, "1 hour", late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, incremental.windowed_counts(df).collect()))
    q = incremental.drop_repeats(stream, ["user_id", "ts"]).writeStream.format("memory").queryName("d").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("d").count() == 3
    incremental.index_stream(stream, str(tmp_path / "index"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 4
    assert incremental.sessions(df).count() == 3


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_templates_and_question_sets(spark, tmp_path):
    assert readers.template("beir")["id"] == "_id" and readers.template("sap")["passage"] == "text"
    assert readers.template("id=a.b, text=c|d") == {"id": "a.b", "text": "c|d"}
    (tmp_path / "t.yaml").write_text("data_format:\n  id_header: key\nquery_format:\n  text_header: ask\n  id_header: n\n")
    assert readers.template(str(tmp_path / "t.yaml")) == {"id": "key"}
    (tmp_path / "q.jsonl").write_text('{"n": "q1", "ask": "what"}\n{"n": "q2", "ask": "why"}\n')
    (tmp_path / "gold.jsonl").write_text('{"query-id": "q1", "corpus-id": "d2", "score": 1}\n{"query-id": "q1", "corpus-id": "d1", "score": 1}\n')
    (tmp_path / "gold.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t1\n")
    for gold in ("gold.jsonl", "gold.tsv"):
        (tmp_path / "set.json").write_text(f'{{"question_file": "q.jsonl", "goldstandard_file": "{gold}"}}')
        got = {r.qid: r.relevant for r in readers.read_question_set(spark, str(tmp_path / "set.json"), readers.template(str(tmp_path / "t.yaml"), "query")).collect()}
        assert got == {"q1": ["d1", "d2"], "q2": []}
    for bad, read in (("t.yaml", lambda p: readers.read_question_set(spark, p)), ("set.json", readers.template)):
        with pytest.raises(ValueError):
            read(str(tmp_path / bad))


def test_filters_of_either_kind(spark):
    rows = spark.createDataFrame([("1", "d", "", "same words here", "en", "x"), ("2", "d", "", "same words here", "de", "y"), ("3", "d", "", "same words here", "de", "z"), ("4", "d", "", "same words here", None, None)], "id string, doc_id string, title string, text string, lang string, kind string")
    asked = spark.createDataFrame([("q", "same words", "de", "x")], "qid string, text string, qlang string, qkind string")
    for engine in ("bm25", "dense", "sparse"):
        for kinds, want in ((("must", "should"), []), (("should", "should"), ["1", "2", "3"]), (("must", None), ["2", "3"]), ((None, "should"), ["1"])):
            filters = [{"query": q, "document": d, "type": k} for q, d, k in zip(("qlang", "qkind"), ("lang", "kind"), kinds) if k]
            e = Engine.from_preset(spark, engine, retrieval={"filters": filters})
            e.ingest(rows)
            assert sorted(r.id for r in e.search(asked).collect()) == want, (engine, kinds)
    e = Engine.from_preset(spark, "bm25", rerank={"kind": "sparse"})
    e.ingest(rows.union(spark.createDataFrame([("5", "d", "", "words", "en", "x")], rows.schema)))
    found = e.search(asked).orderBy("rank").collect()
    assert [r.id for r in found] == ["1", "2", "3", "4", "5"] and found[0].score > found[-1].score > 0


def test_paths_with_several_alternatives(tmp_path):
    for name in ("a1.csv", "a2.csv", "b1.csv"):
        (tmp_path / name).write_text("x\n")
    got = readers.expand_paths(str(tmp_path / "{a,b}{1,2}.csv"))
    assert [p.rpartition("/")[2] for p in got] == ["a1.csv", "a2.csv", "b1.csv", "b2.csv"]
    assert readers.expand_paths("hdfs://x/{a,b}/*.csv") == ["hdfs://x/a/*.csv", "hdfs://x/b/*.csv"]
