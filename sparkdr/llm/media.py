"""Media columns: content-defined chunks, stored once and read back verified.

A payload of 8-bit samples is cut where a rolling gear hash of the last 32 bytes has its
top bits clear, so equal passages give equal chunks wherever they stand.  A text is known
by its content digest: equal texts are one medium.  Chunk digests are counted by a Spark
aggregation; of a chunk that several media hold, the medium of the smallest content
digest keeps the bytes, the others name its digest only (joins on the digest).

:func:`store` writes one table of media to the shared folder: content digest, recipe (the
ordered list of chunk digests and lengths), the digests kept elsewhere, those kept for
others, and the compressed bytes of the medium's own chunks.  :func:`read_back` reads that
table: media that need no others are restored where they lie; for the rest the kept chunks
are joined by digest.  Every chunk is checked against its digest and the payload is put
together.  A missing or changed chunk raises an error.

A medium's file is its recipe followed by its distinct chunks in order of appearance;
``media_bytes`` and ``media_sha256`` are those of that file, so they depend on the text
alone, not on which medium keeps a shared chunk.

Texts are read twice (digests, then bytes) and are shuffled only where the media with
shared or repeated content are too many to be broadcast.  Hot digests multiply digests and
the bytes of the media that need them, nothing else.

Defined results: a null text counts as empty; the padding makes the payload a positive
multiple of 576 bytes; rows may repeat ids or have none, as media are known by content
and every row gets the values of its own text; an empty table gives an empty table; a
very long text is one row of chunks of bounded size; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from . import storage

UNIT, PAD = 576, 255
#: Least and most bytes of a chunk, and how many top bits of the gear hash a cut needs clear.
LEAST, MOST, CUT_BITS = 1024, 16_384, 11
_GEAR = np.random.default_rng(0x6EA2).integers(0, 2**32, 256, dtype=np.uint32)
_MAGIC = b"CDC8\x01"
_ENTRY = struct.Struct(">32sI")
_HEAD = struct.Struct(">5sQI")
#: Rows that a worker holds unpacked at once.
_SLICE_ROWS = 128


def payload_of(text: bytes) -> bytes:
    """The text padded to a positive multiple of the unit."""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + bytes([PAD]) * (size - len(text))


def cut_points(payload: bytes) -> list[int]:
    """Ends of the chunks of one payload."""
    n = len(payload)
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for w in (1, 2, 4, 8, 16):  # each step doubles the window of the rolling hash
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, begin = [], 0
    for m in marks:
        while m - begin > MOST:
            begin += MOST
            out.append(begin)
        if m - begin >= LEAST and m < n:
            out.append(m)
            begin = m
    while n - begin > MOST:
        begin += MOST
        out.append(begin)
    return [*out, n]


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cut_points(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def make_recipe(n_bytes: int, chunks: list[bytes]) -> tuple[bytes, list[bytes]]:
    """The recipe of a payload and its chunk digests, in order."""
    digests = [hashlib.sha256(c).digest() for c in chunks]
    return _HEAD.pack(_MAGIC, n_bytes, len(chunks)) + b"".join(map(_ENTRY.pack, digests, map(len, chunks))), digests


def read_recipe(recipe: bytes) -> tuple[int, list[tuple[bytes, int]]]:
    magic, n_bytes, n = _HEAD.unpack_from(recipe)
    if magic != _MAGIC:
        raise ValueError("not a media recipe")
    return n_bytes, [_ENTRY.unpack_from(recipe, _HEAD.size + i * _ENTRY.size) for i in range(n)]


def restore(recipe: bytes, own: bytes, others: dict[bytes, bytes]) -> tuple[bytes, bytes]:
    """The verified payload and the media file of a row, from its own and other rows' chunks."""
    _, entries = read_recipe(recipe)
    known, at, order = {}, 0, []
    for digest, size in entries:
        if digest not in known:
            chunk = others.get(digest)
            if chunk is None:
                chunk, at = own[at : at + size], at + size
            if len(chunk) != size or hashlib.sha256(chunk).digest() != digest:
                raise ValueError("a stored chunk does not match its digest")
            known[digest] = chunk
            order.append(chunk)
    return b"".join([known[d] for d, _ in entries]), recipe + b"".join(order)


def features(payload: bytes, n_chunks: int) -> str:
    """Counts of samples in 16 equal ranges of values, and the number of chunks."""
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return "chunks:" + str(n_chunks) + ";levels:" + ",".join(map(str, counts.tolist()))


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, text, content)``: the text and its digest."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("content"))


def _split(recipe: bytes, payload: bytes) -> dict[bytes, bytes]:
    """Distinct chunks of a payload by digest, in order of appearance."""
    at, out = 0, {}
    for digest, size in read_recipe(recipe)[1]:
        out.setdefault(digest, payload[at : at + size])
        at += size
    return out


def own_chunks(recipe: bytes, payload: bytes, foreign) -> bytes:
    """The bytes that a medium keeps: its distinct chunks but those that another one keeps."""
    away = set(foreign or ())
    return b"".join(chunk for digest, chunk in _split(recipe, payload).items() if digest not in away)


def chunk_lists(rows: DataFrame) -> DataFrame:
    """``(id, content, digests)`` of every row: its distinct chunk digests, as a shared table."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [list(dict.fromkeys(hashlib.sha256(c).digest() for c in chunks_of(payload_of(text.encode("utf-8"))))) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["id", "content", "digests"])

    schema = StructType([rows.schema["id"], StructField("content", BinaryType()), StructField("digests", ArrayType(BinaryType()))])
    return storage.materialize(rows.select("id", "content", "text").mapInArrow(run, schema), "chunk-lists")


def _decisions(lists: DataFrame) -> DataFrame:
    """``(content, n, writer, foreign, lent)`` of content that several rows hold or with chunks that several media hold.

    ``n`` is the number of rows of repeated content (else null), ``writer`` the id of the one that writes it.
    """
    repeated = lists.groupBy("content").agg(F.min("id").alias("writer"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = lists.select("content", F.explode("digests").alias("digest"))
    shared = pairs.groupBy("digest").agg(F.min("content").alias("owner"), F.max("content").alias("last")).filter("owner < last").select("digest", "owner")
    shared = storage.materialize(shared, "shared-digests")
    held = pairs.join(storage.sized(shared), "digest").distinct()
    away = F.col("content") != F.col("owner")
    held = held.groupBy("content").agg(F.collect_set(F.when(away, F.col("digest"))).alias("foreign"), F.collect_set(F.when(~away, F.col("digest"))).alias("lent"))
    none = F.array().cast("array<binary>")
    joined = held.join(repeated, "content", "full")
    joined = joined.select("content", "n", "writer", F.coalesce("foreign", none).alias("foreign"), F.coalesce("lent", none).alias("lent"))
    return storage.materialize(joined, "chunk-owners")


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the media: ``(id, content)`` of every row, and the stored table ``(content, recipe, foreign, lent, own)``."""
    import pyarrow as pa

    storage.bound_batches(docs.sparkSession)
    rows = _rows(docs, id_column, text_column)
    lists = chunk_lists(rows)
    decided = _decisions(lists)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    digests, copies = decided.agg(count(1 + F.size("foreign") + F.size("lent")), count(F.col("n") - 1)).first()
    met = rows.join(decided.hint("broadcast" if digests <= storage.BROADCAST_KEYS else "merge"), "content", "left")
    met = met.filter(F.col("n").isNull() | F.col("id").eqNullSafe(F.col("writer")))

    def run(batches):
        squeeze, _ = _compressor()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                recipes, own = [], []
                for text, foreign in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = text.encode("utf-8")
                    payload = payload_of(raw)
                    recipe, _ = make_recipe(len(raw), chunks_of(payload))
                    recipes.append(recipe)
                    own.append(squeeze.compress(own_chunks(recipe, payload, foreign)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(recipes, pa.binary()), part.column(2), part.column(3), pa.array(own, pa.binary())], _STORED.names)

    media = storage.materialize(met.select("content", "text", "foreign", "lent").mapInArrow(run, _STORED), "media")
    # rows that repeat id and text each write their medium; they are rare, so a count tells first
    if media.count() > lists.count() - copies:
        once = storage.materialize(media.dropDuplicates(["content"]), "media")
        storage.discard(media)
        media = once
    return lists.select("id", "content"), media


#: The stored table; ``foreign`` and ``lent``: null where no chunk is shared.
_STORED = StructType([StructField("content", BinaryType()), StructField("recipe", BinaryType()), StructField("foreign", ArrayType(BinaryType())), StructField("lent", ArrayType(BinaryType())), StructField("own", BinaryType())])
_VALUES = StructType(
    [StructField("content", BinaryType())]
    + [StructField(n, t) for n, t in (("n_bytes", LongType()), ("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("media_bytes", LongType()), ("media_sha256", StringType()), ("feature", StringType()))]
)


def lent_chunks(media: DataFrame) -> DataFrame:
    """``(digest, chunk)``: the chunks that stored media keep for others, compressed."""
    import pyarrow as pa

    def run(batches):
        squeeze, expand = _compressor()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                digests, chunks = [], []
                for recipe, foreign, lent, own in zip(*(batch.slice(at, _SLICE_ROWS).column(c).to_pylist() for c in range(4))):
                    have, data, start, away = {}, expand.decompress(own), 0, set(foreign)
                    for digest, size in read_recipe(recipe)[1]:
                        if digest not in away and digest not in have:
                            have[digest], start = data[start : start + size], start + size
                    digests += lent
                    chunks += [squeeze.compress(have[d]) for d in lent]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])

    return media.filter(F.size("lent") > 0).select("recipe", "foreign", "lent", "own").mapInArrow(run, "digest binary, chunk binary")


def _restored(media: DataFrame) -> DataFrame:
    """Values of stored media ``(content, recipe, own, pieces)``."""
    import pyarrow as pa

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        _, expand = _compressor()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                out = []
                for content, recipe, data, pieces in zip(*(part.column(c).to_pylist() for c in range(4))):
                    others = {p["digest"]: expand.decompress(p["chunk"]) for p in pieces or ()}
                    n_bytes, entries = read_recipe(recipe)
                    payload, file = restore(recipe, expand.decompress(data), others)
                    if hashlib.sha256(payload[:n_bytes]).digest() != content:
                        raise ValueError("a restored payload does not match its content digest")
                    out.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(payload, len(entries))))
                columns = list(zip(*out)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, types)], _VALUES.names)

    return media.mapInArrow(run, _VALUES)


def read_back(rows: DataFrame, media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of every row, from the stored media."""
    needs = F.coalesce(F.size("foreign"), F.lit(0)) > 0
    pieces = StructType([StructField("digest", BinaryType()), StructField("chunk", BinaryType())])
    whole = _restored(media.filter(~needs).select("content", "recipe", "own", F.lit(None).cast(ArrayType(pieces)).alias("pieces")))
    parts = media.filter(needs)
    fetched = parts.select("content", F.explode("foreign").alias("digest")).join(lent_chunks(media), "digest")
    fetched = fetched.groupBy("content").agg(F.collect_list(F.struct("digest", "chunk")).alias("pieces"))
    joined = _restored(parts.select("content", "recipe", "own").join(fetched, "content", "left"))
    values = storage.materialize(whole.unionByName(joined), "media-values")
    out = rows.join(values.hint("merge"), "content")
    return out.select(F.col("id").alias(id_column), *_VALUES.names[1:])


def store_and_read(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store every row's payload, then read the stored media: the columns of :func:`read_back`."""
    return read_back(*store(docs, id_column, text_column), id_column)
