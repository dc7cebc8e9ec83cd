"""Vectorised word and shingle hashes of whole texts.

Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]`` with A-Z
folded; a shingle is five consecutive words, or all words of a text with one to
four. Hashes are 64-bit; texts without a word have no shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quireflow.llm.common import ragged

#: Words of a shingle.
WORDS = 5
#: Bytes of text handled at once; one longer text is handled alone.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD += 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_MULTIPLY = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, np.uint64(b), dtype=np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word and the first word of every text (with a last entry for the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    black = ~_WHITE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = black.copy()
    start[1:] &= ~black[:-1] | first[1:n]
    end = black.copy()
    end[:-1] &= ~black[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_FOLD[data] * power[:n], out=total[1:])
        h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return s, e, h, np.searchsorted(s, offsets)


def shingle_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in word order and the first shingle of every text."""
    counts = np.diff(first)
    many = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    at = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    text = np.repeat(np.arange(len(many)), many)
    word = first[text] + np.arange(at[-1]) - at[text]
    last = first[text + 1] - 1
    out = np.zeros(at[-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            i = word + k
            inside = i <= last
            out += np.where(inside, h[np.minimum(i, last)] * _MULTIPLY[k], np.uint64(k + 1))
    return mix(out), at


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of runs of texts of about ``limit`` bytes."""
    data, offsets = ragged(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def distinct_by_text(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of every text and where each text's begin."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((sh, text))
    sh, text = sh[order], text[order]
    keep = np.ones(len(sh), dtype=bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
    sh, text = sh[keep], text[keep]
    return sh, np.searchsorted(text, np.arange(len(at)))


def signatures(sh: np.ndarray, at: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """``n`` MinHash values (uint32) a text; texts without shingles get the largest value throughout."""
    out = np.full((len(at) - 1, n), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 1 << 63, size=n, dtype=np.uint64)
    starts = at[some]
    with np.errstate(over="ignore"):
        for k in range(n):
            out[some, k] = np.minimum.reduceat(((sh * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def fingerprints(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every text's set of shingles; ``sh`` is distinct by text."""
    some = np.flatnonzero(np.diff(at))
    out = [np.zeros(len(at) - 1, np.uint64) for _ in range(2)]
    if len(some):
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                out[k][some] = mix(np.add.reduceat(mix(sh + np.uint64(salt)), at[some]) + np.diff(at)[some].astype(np.uint64))
    return out[0], out[1]


