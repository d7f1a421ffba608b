"""Byte-pair vocabularies in the JSON form of public tokenizers (path is a parameter)."""

from __future__ import annotations

import json
from functools import lru_cache

#: White space of Unicode's White_Space property, as pre-tokenizer patterns use it.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


@lru_cache(maxsize=4)
def load(path: str) -> dict:
    """Vocabulary, merge ranks and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
    return {
        "vocab": raw["model"]["vocab"],
        "ranks": {m: i for i, m in enumerate(merges)},
        "special": {t["content"]: t["id"] for t in raw["added_tokens"]},
    }
