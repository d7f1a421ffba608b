"""Vectorised 64-bit hashing of the words and word shingles of a batch of texts.

All functions work on one Arrow batch at a time with numpy, so memory is bounded by
the batch.  Words are maximal runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``) after lower-casing A-Z only.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(0x5EED)
#: One random 64-bit value for each byte, A-Z sharing the values of a-z.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
_BASE = int(_RNG.integers(1, 2**63)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator: spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U64(pow(base, k, 2**64))
        k += m
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash every word of the concatenated texts ``data[offsets[i]:offsets[i+1]]``.

    Returns the hashes in order and, for each text, the number of its words.
    """
    n = len(data)
    docs = len(offsets) - 1
    if not n:
        return np.zeros(0, U64), np.zeros(docs, np.int64)
    word = ~_IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = word[inner]
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[data] * _powers(_BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * _powers(_BASE_INV, n)[starts]
    hashes = mix(hashes + (ends - starts).astype(U64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash every run of ``k`` words of each text; a shorter text is one shingle.

    Returns the hashes, grouped by text, and their number for each text (0: no words).
    """
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out_first = np.concatenate(([0], np.cumsum(sizes)))
    if not out_first[-1]:
        return np.zeros(0, U64), sizes
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - first, sizes)
    left = np.repeat(np.minimum(counts, k), sizes)
    out = np.zeros(len(at), U64)
    for j in range(k):
        # a text of fewer words mixes in its own words only
        value = words[np.minimum(at + j, len(words) - 1)]
        out = np.where(j < left, mix(out * U64(0x9E3779B97F4A7C15) + value), out)
    return mix(out + left.astype(U64)), sizes


def distinct_sets(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, concatenated, and their numbers."""
    parts, counts, at = [], np.zeros(len(sizes), np.int64), 0
    for i, n in enumerate(sizes.tolist()):
        if n:
            part = np.sort(hashes[at : at + n])
            keep = np.empty(n, bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
            parts.append(part)
            counts[i] = len(part)
            at += n
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), counts


def utf8_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls become empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
