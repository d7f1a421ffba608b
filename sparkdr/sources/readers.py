"""Readers: files to DataFrames with the columns that plans expect."""

from __future__ import annotations

import glob as _glob
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import PathError, first_present, nested
from ..functions.text import list_literal

COMPRESSIONS = ("", ".bz2", ".gz", ".xz")
#: Fields that hold the text when no path is given, in order.
TEXT_FIELDS = ("text", "content", "question", "query", "passage", "document.text", "document")


def file_kind(path: str) -> str:
    """``jsonl``, ``json``, ``tsv``, ``csv`` or ``parquet`` from the name; fails for others."""
    name = path.lower()
    for suffix in COMPRESSIONS[1:]:
        name = name.removesuffix(suffix)
    if ".jsonl" in Path(name).name:
        return "jsonl"
    kind = name.rpartition(".")[2]
    if kind in ("json", "tsv", "csv", "parquet"):
        return kind
    raise ValueError(f"unknown kind of file: {path}")


def expand_paths(pattern: str) -> list[str]:
    """Sorted matches of each alternative of every ``{a,b}``; a pattern without matches stays, to fail when read.

    Patterns with a scheme, as ``hdfs://``, are left to Spark, which matches them where they lie.
    """
    found = re.search(r"\{([^{}]*)\}", pattern)
    if found:
        return [path for part in found[1].split(",") for path in expand_paths(pattern[: found.start()] + part + pattern[found.end() :])]
    return [pattern] if "://" in pattern else sorted(_glob.glob(pattern)) or [pattern]


def file_list(path: str) -> list[str]:
    """Paths of a list file: one a line, ``@dir`` in the first line gives their folder."""
    lines = [line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip() and not line.startswith("#")]
    folder = None
    if lines and lines[0].startswith("@"):
        folder, lines = lines[0][1:], lines[1:]
    return [str(Path(folder) / line) if folder else line for line in lines]


def _plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; ``.xz`` ones are decompressed as streams on the executors."""
    if not path.lower().endswith(".xz"):
        return spark.read.text(path)
    import pyarrow as pa

    def run(batches):
        import io
        import lzma

        for batch in batches:
            for content in batch.column(0).to_pylist():
                lines = []
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8") as f:
                    for line in f:
                        lines.append(line.rstrip("\n"))
                        if len(lines) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
                            lines = []
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def _json_lines(lines: DataFrame, schema=None) -> DataFrame:
    """Records of a frame of JSON lines, parsed in the JVM; their fields are inferred where no schema is given."""
    if schema is None:
        spark = lines.sparkSession
        texts = getattr(lines.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(spark._jsparkSession.read().json(texts), spark)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str, limit: int | None = None, schema=None, list_columns: tuple[str, ...] = ()) -> DataFrame:
    """Records of one file or pattern, by kind; ``product:path`` adds a ``product`` column."""
    product, _, rest = path.rpartition(":")
    if product and re.fullmatch(r"[A-Za-z0-9_-]{2,}", product) and product not in ("file", "hdfs", "viewfs", "http", "https") and not rest.startswith("//"):
        return read_records(spark, rest, limit, schema, list_columns).withColumn("product", F.lit(product))
    kind = file_kind(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "jsonl":
        df = _json_lines(_plain_lines(spark, path), schema) if path.endswith(".xz") else reader.json(path)
    elif kind == "json":
        df = reader.option("multiLine", True).json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        df = reader.option("sep", "\t" if kind == "tsv" else ",").option("quote", '"').option("escape", '"').option("multiLine", kind == "csv").csv(path, header=True)
    for c in list_columns:
        df = df.withColumn(c, list_literal(F.col(c)))
    return df if limit is None else df.limit(limit)


#: Largest input in bytes that :func:`spread` deals anew.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan of fewer files than half the cores, dealt to all of them; anything else as it is.

    A file of one row group is one task however large its rows' work is; dealing rows out
    pays for itself only while the input is small, which is checked.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) * 2 > cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES else df


def read_many(spark: SparkSession, patterns: list[str], limit: int | None = None) -> DataFrame:
    """Union by name of several files and patterns; missing fields are null."""
    out = None
    for pattern in patterns:
        for path in expand_paths(pattern):
            df = read_records(spark, path)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to read")
    return out if limit is None else out.limit(limit)


def read_corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(id, title, text, answers)`` of a TSV with 2 to 4 fields; the title goes before the text."""
    df = spark.read.option("sep", "\t").csv(path, header=True)
    if not 2 <= len(df.columns) <= 4 or not {"id", "text"} <= set(df.columns):
        raise ValueError(f"2 to 4 fields with id and text are expected, not {df.columns}")
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    answers = F.split("answers", "::") if "answers" in df.columns else F.lit(None).cast("array<string>")
    return df.select("id", title.alias("title"), F.concat_ws(" ", title, "text").alias("text"), answers.alias("answers"))


def extract_texts(df: DataFrame, path: str | None = None, limit: int | None = None) -> DataFrame:
    """``(text)`` at a path (arrays give one row an element), or in the first known text field."""
    if path is None:
        found = []
        for name in TEXT_FIELDS:
            try:
                column = nested(df, name)
            except PathError:
                continue
            kind = df.select(column.alias("t")).schema["t"].dataType.typeName()
            if kind == "string":
                found.append(column)
        if not found:
            raise PathError("no text field")
        out = df.select(F.coalesce(*found).alias("text"))
    else:
        out = df.select(nested(df, path).alias("text"))
        while out.schema["text"].dataType.typeName() == "array":
            out = out.select(F.explode("text").alias("text"))
    out = out.filter("text is not null")
    return out if limit is None else out.limit(limit)


def map_fields(df: DataFrame, fields: dict[str, str], constants: dict[str, object] | None = None) -> DataFrame:
    """Rename fields to nested targets (``a.b.c``) and add constants; structs are built from the targets."""
    tree: dict = {}
    for target, column in [*((t, F.col(f"`{s}`")) for s, t in fields.items()), *((t, F.lit(v)) for t, v in (constants or {}).items())]:
        at, *more = target.split(".")
        node = tree
        for step in more:
            node, at = node.setdefault(at, {}), step
        node[at] = column

    def build(node: dict) -> list:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))


def read_questions(df: DataFrame, template: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """``(qid, text, relevant array, answers array)`` of question records of varied shape.

    ``relevant`` may be an array or a comma-separated string, ``answers`` an array or a
    string of parts between ``::``.  A record without id gets a hash of its text.
    """
    roles = {"text": "text|query|question", "id": "id|qid|_id", "relevant": "relevant", "answers": "answers"} | (template or {})
    text = first_present(df, roles["text"]).cast("string")
    try:
        qid = first_present(df, roles["id"]).cast("string")
    except PathError:
        qid = F.md5(text)

    def many(role: str, separator: str):
        try:
            column = first_present(df, roles[role])
        except PathError:
            return F.array().cast("array<string>")
        if df.select(column.alias("c")).schema["c"].dataType.typeName() == "array":
            return column.cast("array<string>")
        return F.when(F.coalesce(column.cast("string"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(column.cast("string"), separator), lambda x: F.trim(x)))

    out = df.select(qid.alias("qid"), text.alias("text"), many("relevant", ",").alias("relevant"), many("answers", "::").alias("answers"))
    return out if limit is None else out.limit(limit)


#: Field paths by role of known record shapes.
TEMPLATES = {
    "default": {"data": {"id": "id", "text": "text|documents|document", "title": "title"}, "query": {"text": "text|query|question", "id": "id|qid|_id", "relevant": "relevant", "answers": "answers"}},
    "sap": {"data": {"id": "document_id", "text": "document", "passage": "text", "title": "title"}, "query": {"text": "text|query|question", "id": "id|qid|_id"}},
    "beir": {"data": {"id": "_id", "text": "text", "title": "title"}, "query": {"text": "text", "id": "_id"}},
}


def template(spec: str, part: str = "data") -> dict[str, str]:
    """Field paths by role: a name of ``TEMPLATES``, ``role=path,role=path``, or a YAML or JSON file with ``data_format`` and ``query_format``.

    In a file, roles may end in ``_header``, as in ``id_header: _id``.
    """
    if spec in TEMPLATES:
        return dict(TEMPLATES[spec][part])
    if "=" in spec:
        pairs = [piece.partition("=") for piece in spec.split(",")]
        return {role.strip(): path.strip() for role, _, path in pairs}
    import yaml

    values = yaml.safe_load(Path(spec).read_text(encoding="utf-8")) or {}
    if missing := {"data_format", "query_format"} - set(values):
        raise ValueError(f"{spec} has no {', '.join(sorted(missing))}")
    return {role.removesuffix("_header"): path for role, path in values[f"{part}_format"].items() if path is not None}


def read_question_set(spark: SparkSession, path: str, query_template: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Questions with their judged ids, of a JSON or YAML file that names ``question_file`` and ``goldstandard_file``.

    A file that is not there is looked for in the folder of ``path``.
    """
    import yaml

    from ..operators.joins import attach_gold

    values = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if missing := {"question_file", "goldstandard_file"} - set(values):
        raise ValueError(f"{path} has no {', '.join(sorted(missing))}")
    beside = lambda name: name if Path(name).exists() else str(Path(path).parent / name)
    questions = read_questions(read_records(spark, beside(values["question_file"])), query_template, limit)
    gold = beside(values["goldstandard_file"])
    if re.search(r"\.(jsonl?|parquet)(\.\w+)?$", gold.lower()):
        return attach_gold(questions, read_relevance_records(read_records(spark, gold)))
    return attach_gold(questions, read_judgements(spark, gold))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc_id, rel)`` with rel > 0 of a TREC file (no header) or one with a header line."""
    first = spark.read.text(path).first()
    head = re.split(r"[\t ]", first.value) if first else []
    separator = "\t" if first and "\t" in first.value else " "
    lines = spark.read.option("sep", separator)
    if head and not re.fullmatch(r"-?\d+(\.\d+)?", head[-1].strip()):
        df = lines.csv(path, header=True)
        q, d, r = (next(c for c in df.columns if c.lower() in names) for names in (("query-id", "query_id", "qid"), ("corpus-id", "corpus_id", "docid", "doc_id", "pid"), ("score", "relevance", "rel")))
        df = df.select(F.col(f"`{q}`").alias("qid"), F.col(f"`{d}`").alias("doc_id"), F.col(f"`{r}`").cast("int").alias("rel"))
    else:
        df = lines.schema("qid string, iter string, doc_id string, rel int").csv(path).select("qid", "doc_id", "rel")
    return df.filter("rel > 0")


def read_relevance_records(df: DataFrame) -> DataFrame:
    """``(qid, doc_id, relevance)`` of records that name their fields differently; of repeats the later one, as the files lie."""
    pick = lambda names: F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in df.columns])
    out = df.select(pick(["query_id", "query-id", "qid"]).alias("qid"), pick(["corpus_id", "corpus-id", "docid", "pid"]).alias("doc_id"), pick(["relevance", "score"]).cast("double").alias("relevance"))
    out = out.withColumn("_at", F.monotonically_increasing_id())
    return out.groupBy("qid", "doc_id").agg(F.max_by("relevance", "_at").alias("relevance"))


def read_results(df: DataFrame) -> DataFrame:
    """Long ``(qid, question, rank, id, score, text, title)`` of nested stored results, in stored order."""
    long = df.select("question", F.posexplode("retrieved_passages").alias("at", "p"))
    fields = df.schema["retrieved_passages"].dataType.elementType.names
    part = lambda n: F.col("p").getField(n) if n in fields else F.lit(None)
    return long.select(F.col("question.id").alias("qid"), F.col("question.text").alias("question"), (F.col("at") + 1).alias("rank"), part("id").cast("string").alias("id"), part("score").cast("double").alias("score"), part("text").cast("string").alias("text"), part("title").cast("string").alias("title"))


def last_input_text(df: DataFrame, field: str = "input") -> DataFrame:
    """``text`` of the last element of an array of structs."""
    return df.withColumn("text", F.element_at(F.col(field), -1).getField("text"))
