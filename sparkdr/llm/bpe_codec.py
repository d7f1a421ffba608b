"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie.  A depth-first walk carries, for each prefix,
the last token of the prefix's encoding (its *state*): the state of a prefix is the
longest vocabulary token ending there that forms a valid pair with the state of what
precedes it.  Encodings of shared prefixes are therefore found once, and only where a
longer token may rest on them.  The last symbol of a word carries the end-of-word mark,
so it is a leaf of its own.

Defined results: a null text counts as empty (0 tokens, digests of the empty string);
special-token strings in a text become their identifiers; rows are independent, so
repeated rows give equal results; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from .vocabulary import SPACE, byte_symbols, load

#: Words whose encodings a worker remembers before it starts anew (bounds memory).
REMEMBERED_WORDS = 350_000
#: Longer words are encoded but not remembered beyond their batch.
REMEMBERED_LENGTH = 64
_END = "\x00"
_MARK = "</w>"
#: Words of more symbols have all their prefix states found from left to right.
_LONG = 128


class TrieEncoder:
    """Encodes distinct words of one vocabulary with end-of-word marks."""

    def __init__(self, path: str):
        data = load(path)
        inner = lambda t: t[: -len(_MARK)] + _END if t.endswith(_MARK) else t
        self.vocab = {inner(t): i for t, i in data["vocab"].items() if t not in data["special"]}
        self.shown = {i: t for t, i in data["vocab"].items()} | {i: t for t, i in data["special"].items()}
        self.ranks = {(inner(a), inner(b)): r for (a, b), r in data["ranks"].items()}
        self.special = data["special"]
        self.bytes = byte_symbols()
        # lengths (in symbols) of the tokens that end in two given symbols, longest first
        self.lengths: dict[str, list[int]] = {}
        for t in self.vocab:
            n = len(t) - t.endswith(_END)
            if n > 1:
                self.lengths.setdefault(t[n - 2 :], []).append(n)
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items()}
        self.valid: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first: only for pairs of tokens."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 30:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` can follow ``left`` ('' at the start) in an encoding."""
        key = (left, right)
        found = self.valid.get(key)
        if found is None:
            symbols = [*left, *(right[:-2] if right.endswith(_END) else right)]
            if right.endswith(_END):
                symbols.append(right[-2:])
            found = self.merge(symbols) == ([left, right] if left else [right])
            if len(self.valid) >= 300_000:
                self.valid.clear()
            self.valid[key] = found
        return found

    def _last(self, path: str, n: int, states: list, end: str) -> str:
        """Last token of the encoding of ``path[:n] + end``; states[k]: of the first k symbols."""
        vocab, valid = self.vocab, self.valid
        for size in self.lengths.get(path[max(0, n - 2) : n] + end, ()):
            if size <= n and (token := path[n - size : n] + end) in vocab:
                left = states[n - size]
                if left is None:
                    left = states[n - size] = self._last(path, n - size, states, "")
                found = valid.get((left, token))
                if found or found is None and self.fits(left, token):
                    return token
        return path[n - 1] + end

    def symbols(self, word: str) -> str:
        if word.isascii() and word.isalnum():
            return word
        return "".join(map(self.bytes.__getitem__, word.encode("utf-8")))

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Identifiers of each distinct non-empty word.

        The words in sorted order, each with the length of the prefix that it shares with
        the one before, are the trie in depth-first order: ``states`` holds the last-token
        states of the path from the root, found when first asked for, and going on to the
        next word keeps those of the shared prefix.
        """
        out: dict[str, list[int]] = {}
        before, states = "", [""]
        for path, word in sorted([(self.symbols(w), w) for w in words]):
            n = len(path)
            shared, most = 0, min(n, len(before))
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            states += [None] * (n - shared)
            before = path
            if n > _LONG:  # from left to right, so that _last does not call itself deeply
                for k in range(1, n):
                    if states[k] is None:
                        states[k] = self._last(path, k, states, "")
            token = self._last(path, n, states, _END)
            ids, at = [self.vocab[token]], n - len(token) + 1
            while at:
                token = states[at]
                if token is None:
                    token = states[at] = self._last(path, at, states, "")
                ids.append(self.vocab[token])
                at -= len(token)
            ids.reverse()
            out[word] = ids
        return out


class _Codec:
    def __init__(self, path: str):
        import regex

        self.trie = TrieEncoder(path)
        self.ids: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        self.pieces = regex.compile(
            rf"'(?:[stmd]|re|ve|ll)|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
        ).findall
        special = self.trie.special
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def words(self, text: str) -> list[str]:
        """Normalised pre-tokens; a special token stays as one entry of the form (text,)."""
        if self.split and any(s in text for s in self.trie.special):
            out: list = []
            for part in self.split(text):
                out += [(part,)] if part in self.trie.special else self.words(part)
            return out
        if not text.isascii():
            # the mapping goes by single characters: no special final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pieces(text.lower())

    def remember(self, words) -> None:
        if len(self.ids) > REMEMBERED_WORDS:
            self.ids.clear()
            self.shown.clear()
            words = set(words)
        new = []
        for w in words:
            if w not in self.ids:
                if isinstance(w, tuple):
                    self.ids[w], self.shown[w] = str(self.trie.special[w[0]]), w[0]
                else:
                    new.append(w)
        for w, ids in self.trie.encode(new).items():
            self.ids[w] = " ".join(map(str, ids))
            self.shown[w] = " ".join(map(self.trie.shown.__getitem__, ids))

    def run(self, texts: list[str]) -> list[tuple[str, str]]:
        """Space-joined identifiers and the decoded text of each text."""
        out = []
        known = self.ids
        for at in range(0, len(texts), 256):
            split = [self.words(t) for t in texts[at : at + 256]]
            missing = {w for words in split for w in words if w not in known}
            if missing:
                if len(known) > REMEMBERED_WORDS:
                    missing = {w for words in split for w in words}
                self.remember(missing)
            for words in split:
                out.append((" ".join(map(known.__getitem__, words)), " ".join(map(self.shown.__getitem__, words))))
            for w in [w for w in missing if len(w) > REMEMBERED_LENGTH]:
                known.pop(w, None)
                self.shown.pop(w, None)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> _Codec:
    return _Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of each row: one scan, no shuffle."""
    import pyarrow as pa

    kept = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = dict(kept.dtypes)[id_column]

    def run(batches):
        coder = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = coder.run(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([list(map(int, ids.split())) for ids, _ in found], pa.list_(pa.int32())),
                        pa.array([text for _, text in found], pa.string()),
                    ],
                    [id_column, "ids", "decoded"],
                )

    return kept.mapInArrow(run, f"`{id_column}` {id_type}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: as :func:`encode_decode`, digested in the worker."""
    import pyarrow as pa

    kept = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = dict(kept.dtypes)[id_column]
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        coder = codec(vocabulary)
        for batch in batches:
            found = coder.run(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in found], pa.int64()),
                    pa.array([sha(ids) for ids, _ in found]),
                    pa.array([sha(text) for _, text in found]),
                ],
                [id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return kept.mapInArrow(run, f"`{id_column}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
