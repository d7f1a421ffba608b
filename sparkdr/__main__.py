"""Command line: run, search, evaluate, presets, convert."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkdr", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "read, search and evaluate"), ("search", "read and search"), ("evaluate", "evaluate stored results")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--preset")
        s.add_argument("--config")
        s.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
        s.add_argument("--corpus", nargs="*")
        s.add_argument("--questions")
        s.add_argument("--judgements")
        s.add_argument("--results")
        s.add_argument("--output")
    s = sub.add_parser("presets", help="list or show presets")
    s.add_argument("name", nargs="?")
    s = sub.add_parser("convert", help="convert files")
    s.add_argument("what", choices=("json-to-jsonl", "to-trec", "tsv-to-parquet"))
    s.add_argument("source")
    s.add_argument("target")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "presets":
        import yaml

        from .plans.config import PRESETS, preset

        print(yaml.safe_dump(preset(a.name)) if a.name else "\n".join(PRESETS))
        return 0
    from pyspark.sql import SparkSession

    from .sources import readers, writers

    spark = SparkSession.builder.appName("sparkdr").getOrCreate()
    if a.command == "convert":
        df = readers.read_records(spark, a.source)
        if a.what == "json-to-jsonl":
            df.write.json(a.target)
        elif a.what == "tsv-to-parquet":
            df.write.parquet(a.target)
        else:
            hits = readers.read_results(df).withColumnRenamed("id", "doc_id")
            writers.write_trec(hits, a.target)
        return 0
    from .plans.search import Engine

    engine = Engine.from_files(spark, a.preset, a.config, a.set)
    judgements = readers.read_judgements(spark, a.judgements) if a.judgements else None
    if a.command == "evaluate":
        from .functions.text import original_id
        from pyspark.sql import functions as F

        hits = readers.read_results(readers.read_records(spark, a.results)).withColumn("doc_id", original_id(F.col("id")))
    else:
        questions = engine.read_questions(a.questions, judgements)
        engine.ingest(engine.read_data(a.corpus))
        hits = engine.search(questions)
        if a.output:
            writers.write_results(hits, questions, a.output)
    if a.command != "search" and judgements is not None:
        engine.evaluate(hits, judgements).orderBy("k").show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
