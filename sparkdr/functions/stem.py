"""Porter stemming (M. F. Porter, 1980) and ROUGE scores over stemmed words."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

_VOWELS = "aeiou"
# Suffix tables of the published algorithm.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(word: str, i: int) -> bool:
    return word[i] in _VOWELS or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _measure(word: str) -> int:
    shape = "".join("v" if _vowel(word, i) else "c" for i in range(len(word)))
    return len(re.findall("v+c", shape))


def _has_vowel(word: str) -> bool:
    return any(_vowel(word, i) for i in range(len(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowel(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    return n > 2 and not _vowel(word, n - 3) and _vowel(word, n - 2) and not _vowel(word, n - 1) and word[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of up to three letters stay."""
    if len(word) <= 3:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_STEP2, 0), (_STEP3, 0)):
        for suffix, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > least:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            w = stem
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def rouge_words(text: str | None) -> list[str]:
    """Lower-cased ASCII words, stemmed."""
    return [porter(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]


def _scores(hits: int, n_reference: int, n_candidate: int) -> tuple[float, float, float]:
    precision = hits / n_candidate if n_candidate else 0.0
    recall = hits / n_reference if n_reference else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if hits else 0.0


def rouge_n(reference: list[str], candidate: list[str], n: int = 1) -> tuple[float, float, float]:
    """Precision, recall and F of n-gram overlap with counts clipped."""
    a = Counter(zip(*(reference[i:] for i in range(n))))
    b = Counter(zip(*(candidate[i:] for i in range(n))))
    return _scores(sum((a & b).values()), sum(a.values()), sum(b.values()))


def rouge_l(reference: list[str], candidate: list[str]) -> tuple[float, float, float]:
    """Precision, recall and F of the longest common subsequence."""
    row = [0] * (len(candidate) + 1)
    for x in reference:
        last = 0
        for j, y in enumerate(candidate, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return _scores(row[-1], len(reference), len(candidate))
