"""Substring duplicates by sliding sentence spans.

Texts are split into sentences (ended by ``.``, ``!`` or ``?`` before white space, or by
a line break).  At every sentence begins a span: the run of ``span`` consecutive sentences,
hashed to 128 bits over its words (A-Z lower-cased, white space ignored).  The hashes are
joined globally: the first occurrence of a span is the one in the first text (by id, then
by a hash of the text), and there the earliest.  A sentence that any other occurrence
covers is removed.

With ``least_words`` (off by default) an occurrence counts only where it and the first one
are part of an equal passage of at least so many words: both are extended word by word, in
either direction, over sentence ends.  So page furniture of a few short sentences stays,
and a long passage goes even where its ends are joined to other words.  The words beside a
first occurrence travel as 32-bit hashes to the other ones.

A worker sends each distinct span of a text once (one shared table).  No task gathers the
texts that share a span: firsts combine before the shuffle, and the decision goes back by
equi-joins whose hot keys Spark splits.

Defined results: a null or empty text has no sentences and is returned as an empty text;
a text of fewer sentences than ``span`` has no span; rows that repeat both id and text count
as one text, so neither loses what both hold; rows that repeat an id with other texts are
texts of their own; a null id is later than any other; an empty table gives an empty table;
a very long text is one row of many spans; extra columns, whatever their names, stay out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import hashing, storage

U64 = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_CLOSERS = frozenset(b"\"')]")


def _sentences(data: np.ndarray, offsets: np.ndarray):
    """Sentences of a batch: word hashes, words per text, and a flag on each text-final or sentence-final word, with word bounds."""
    n = len(data)
    word = ~hashing._IS_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes, counts = hashing.word_hashes(data, offsets)
    last = data[ends - 1]
    stop = _ENDS[last]
    # a closing quote or bracket may follow the end mark
    long = ends - starts > 1
    closers = np.isin(last, np.array(sorted(_CLOSERS), np.uint8)) & long
    stop |= closers & _ENDS[data[np.maximum(ends - 2, 0)]]
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    following = np.concatenate((starts[1:], [n]))
    stop |= breaks[following] > breaks[ends]
    finals = np.cumsum(counts)[counts > 0] - 1
    stop[finals] = True
    return hashes, counts, stop, starts, ends


def _span_hashes(words: np.ndarray, first: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of words[first:stop] of each span, modulo 2**64, mixed."""
    n = len(words)
    powers, inverse = hashing._powers(base, n + 1), hashing._powers(pow(base, -1, 2**64), n + 1)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(words * powers[:n])))
    return hashing.mix((total[stop] - total[first]) * inverse[first] + (stop - first).astype(U64))


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Spans:
    """Spans of a batch of texts: sentences, their words and the spans that begin at them."""

    def __init__(self, column, span: int):
        self.data, self.offsets = hashing.utf8_batch(column)
        n = len(self.offsets) - 1
        if len(self.data):
            self.words, counts, stop, starts, ends = _sentences(self.data, self.offsets)
            last = np.flatnonzero(stop)
        else:
            self.words, counts, last, starts, ends = np.zeros(0, U64), np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first_word, self.after_word = np.concatenate(([0], last[:-1] + 1))[: len(last)], last + 1
        self.byte_from, self.byte_to = starts[self.first_word], ends[last]
        #: Word and sentence numbers at which each text begins, and where the last one ends.
        self.word_at = np.concatenate(([0], np.cumsum(counts)))
        self.sentence_at = np.searchsorted(last, self.word_at)
        text_of = np.repeat(np.arange(n), np.diff(self.sentence_at))
        a = np.arange(max(0, len(last) - span + 1))
        a = a[text_of[a] == text_of[a + span - 1]]
        #: Each span's first sentence; its words are from ``begin`` up to ``end``.
        self.sentence, self.owner = a, text_of[a]
        self.begin, self.end = self.first_word[a], self.after_word[a + span - 1]
        self.keys = np.array([_span_hashes(mixed, self.begin, self.end, b) for mixed, b in ((self.words, _BASES[0]), (hashing.mix(self.words), _BASES[1]))]).reshape(2, -1).view(np.int64)
        self.span_at = np.searchsorted(self.owner, np.arange(n + 1))
        order = np.lexsort((self.keys[1], self.keys[0], self.owner))
        k, o = self.keys[:, order], self.owner[order]
        again = (k[0][1:] == k[0][:-1]) & (k[1][1:] == k[1][:-1]) & (o[1:] == o[:-1])
        #: One span of each hash of a text, and which texts repeat a span.
        self.distinct = order[np.concatenate((np.ones(min(1, len(order)), bool), ~again))]
        self.repeats = np.zeros(n, bool)
        self.repeats[o[1:][again]] = True

    def of(self, text: int) -> tuple[range, dict[tuple[int, int], int]]:
        """The spans of one text, and the earliest one of each hash."""
        own = range(self.span_at[text], self.span_at[text + 1])
        earliest: dict[tuple[int, int], int] = {}
        for j, key in zip(own, zip(self.keys[0, own.start : own.stop].tolist(), self.keys[1, own.start : own.stop].tolist())):
            earliest.setdefault(key, j)
        return own, earliest

    def beside(self, text: int, j: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words before and after a span that may be needed to reach ``least`` words."""
        need = max(0, least - int(self.end[j] - self.begin[j]))
        left = self.words[max(self.word_at[text], self.begin[j] - need) : self.begin[j]]
        right = self.words[self.end[j] : min(self.word_at[text + 1], self.end[j] + need)]
        return left.astype(np.uint32), right.astype(np.uint32)

    def reaches(self, text: int, j: int, other: tuple[np.ndarray, np.ndarray], least: int) -> bool:
        """Whether a span and the words beside it agree with another occurrence for ``least`` words."""
        left, right = self.beside(text, j, least)
        return int(self.end[j] - self.begin[j]) + _agree(left[::-1], other[0][::-1]) + _agree(right, other[1]) >= least


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, key, text)``; a row is known by its id and the hash of its text."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


_HASHES = [StructField("h1", LongType()), StructField("h2", LongType())]


def emit_spans(rows: DataFrame, span: int) -> DataFrame:
    """``(h1, h2, id, key)``: each distinct span of each text, as a shared table."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = Spans(batch.column(2), span)
            k, o = found.keys[:, found.distinct], pa.array(found.owner[found.distinct])
            yield pa.RecordBatch.from_arrays([pa.array(k[0]), pa.array(k[1]), batch.column(0).take(o), batch.column(1).take(o)], ["h1", "h2", "id", "key"])

    schema = StructType([*_HASHES, rows.schema["id"], StructField("key", LongType())])
    return storage.materialize(rows.mapInArrow(run, schema), "spans")


def find_repeats(rows: DataFrame, span: int, least_words: int) -> DataFrame:
    """``(id, key, later array<struct<h1, h2, left, right>>)``: spans of a text that an earlier text holds first, with the words beside the first one."""
    import pyarrow as pa

    spans = emit_spans(rows, span)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    repeated = spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    repeated = storage.materialize(repeated, "repeated-spans")
    later = spans.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first"))).select("h1", "h2", "id", "key")
    if least_words <= 0:
        none = F.lit(b"")
        return later.groupBy("id", "key").agg(F.collect_list(F.struct("h1", "h2", none.alias("left"), none.alias("right"))).alias("later"))
    firsts = repeated.groupBy("first.id", "first.key").agg(F.collect_list(F.struct("h1", "h2")).alias("wanted"))

    def run(batches):
        for batch in batches:
            found, out = Spans(batch.column(0), span), []
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                if wanted:
                    _, earliest = found.of(i)
                    for w in wanted:
                        left, right = found.beside(i, earliest[w["h1"], w["h2"]], least_words)
                        out.append((w["h1"], w["h2"], left.tobytes(), right.tobytes()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["h1", "h2", "left", "right"])

    # texts of one id and content would say the same: one of them is asked
    beside = _met(rows, firsts, "wanted").select("text", "wanted").mapInArrow(run, "h1 long, h2 long, left binary, right binary").dropDuplicates(["h1", "h2"])
    return later.join(beside, ["h1", "h2"]).groupBy("id", "key").agg(F.collect_list(F.struct("h1", "h2", "left", "right")).alias("later"))


def _met(rows: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """All rows with what the lists hold for them.  Both joins of a query share one shuffle of the texts."""
    known = lists.select(F.col("id").alias("_id"), F.col("key").alias("_key"), column).hint("merge")
    return rows.join(known, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("id", "key", "text", column)


def remove_repeated_spans(docs: DataFrame, span: int = 3, least_words: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_sentences, n_removed, n_words, n_words_removed, text)`` of every row.

    ``text`` is the whole text without the removed sentences (and the white space before them).
    """
    import pyarrow as pa

    storage.bound_batches(docs.sparkSession)
    rows = _rows(docs, id_column, text_column)
    marked = _met(rows, find_repeats(rows, span, least_words), "later").select("id", "text", "later")
    schema = StructType([StructField(id_column, rows.schema["id"].dataType), *(StructField(n, LongType()) for n in ("n_sentences", "n_removed", "n_words", "n_words_removed")), StructField("text", StringType())])

    def run(batches):
        for batch in batches:
            found, out = Spans(batch.column(1), span), []
            for i, later in enumerate(batch.column(2).to_pylist()):
                begin, end = found.sentence_at[i], found.sentence_at[i + 1]
                gone = np.zeros(end - begin + 1, np.int64)
                if later or found.repeats[i]:
                    firsts = {(x["h1"], x["h2"]): (np.frombuffer(x["left"], np.uint32), np.frombuffer(x["right"], np.uint32)) for x in later or ()}
                    own, earliest = found.of(i)
                    for j, key in zip(own, zip(found.keys[0, own.start : own.stop].tolist(), found.keys[1, own.start : own.stop].tolist())):
                        if key not in firsts and earliest[key] == j:
                            continue
                        hit = key in firsts and found.reaches(i, j, firsts[key], least_words)
                        hit = hit or j > earliest[key] and found.reaches(i, j, found.beside(i, earliest[key], least_words), least_words)
                        if hit:
                            gone[found.sentence[j] - begin] += 1
                            gone[found.sentence[j] - begin + span] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                raw = found.data[found.offsets[i] : found.offsets[i + 1]].tobytes()
                sizes = (found.after_word - found.first_word)[begin:end]
                if gone.any():
                    b, e = found.byte_from[begin:end] - found.offsets[i], found.byte_to[begin:end] - found.offsets[i]
                    cut, parts = 0, []
                    for j in np.flatnonzero(gone).tolist():
                        before = int(e[j - 1]) if j else 0
                        parts.append(raw[cut : max(cut, before)])
                        cut = int(e[j])
                    raw = b"".join([*parts, raw[cut:]])
                out.append((len(gone), int(gone.sum()), int(sizes.sum()), int(sizes[gone].sum()), raw.decode("utf-8")))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], schema.names)

    return marked.mapInArrow(run, schema)
