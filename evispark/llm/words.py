"""Words of many texts as arrays of 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from evispark.llm.codepoints import decode

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(whether a code point is a letter or digit, its lower case)."""
    word = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x30000):
        c = chr(point)
        if c.isalnum():
            word[point] = True
            low = c.lower()
            lower[point] = ord(low[0])
    return word, lower


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word): longest runs of letters and digits, in lower case."""
    word, lower = _tables()
    points, offsets = decode(texts)
    n = len(points)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word[points]
    edge = inside[1:] != inside[:-1]
    borders = np.zeros(n + 1, bool)  # a word ends where its row ends
    borders[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | borders[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | borders[1:])) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = span_hashes(lower[points], starts, ends)
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of code points, wherever it stands."""
    n = len(points)
    power, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes, rows disregarded."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(_BASE) + words[i : i + n])
    return h
