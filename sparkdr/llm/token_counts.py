"""Token counts by heap-and-linked-list byte-pair merging.

For every pre-token the byte symbols form a linked list and the adjacent pairs a heap by
merge rank.  The lowest-ranked pair (leftmost among equals) is popped again and again;
the count is the number of initial symbols minus the number of merges.  No identifiers
are produced.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special-token strings
in a text count one token each; extra input columns are ignored; rows are independent,
so repeated rows and ties give equal counts; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from .vocabulary import SPACE, byte_symbols, load

#: Pre-tokens longer than this many characters are counted but not remembered.
REMEMBERED_LENGTH = 64
#: Distinct pre-tokens that a worker remembers before it starts anew (bounds memory).
REMEMBERED_WORDS = 400_000


class PairMerger:
    """Counts tokens of pre-tokens for one vocabulary."""

    def __init__(self, path: str):
        data = load(path)
        vocab = data["vocab"]
        self.special = data["special"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.rules = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for (a, b), rank in data["ranks"].items()}

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        symbols = [self.first[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return n
        rules = self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rule, i) for i in range(n - 1) if (rule := rules.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, made, i = heapq.heappop(heap)
            j = after[i]
            # symbols change when they merge: a stale entry no longer fits its place
            if symbols[i] < 0 or j >= n or rules.get((symbols[i], symbols[j])) != (rank, made):
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if rule := rules.get((made, symbols[k])):
                    heapq.heappush(heap, (*rule, i))
            h = before[i]
            if h >= 0 and (rule := rules.get((symbols[h], made))):
                heapq.heappush(heap, (*rule, h))
            merges += 1
        return n - merges


class _Remembered(dict):
    def __init__(self, merger: PairMerger):
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        n = self.merger.count(piece.encode("utf-8"))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def _counter(path: str):
    import regex

    merger = PairMerger(path)
    words = _Remembered(merger)
    pieces = regex.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    ).findall
    special = regex.compile("|".join(map(regex.escape, merger.special))) if merger.special else None

    def count(text: str) -> int:
        if special is not None and any(s in text for s in merger.special):
            parts = special.split(text)
            return len(parts) - 1 + sum(sum(map(words.__getitem__, pieces(p))) for p in parts)
        return sum(map(words.__getitem__, pieces(text)))

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each row, in one scan without a shuffle."""
    import pyarrow as pa

    kept = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = dict(kept.dtypes)[id_column]

    def run(batches):
        count = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                [id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return kept.mapInArrow(run, f"`{id_column}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
