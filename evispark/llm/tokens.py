"""Encoding with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern.  The pieces of one word
are merged by rank: a segment tree over the word's byte positions holds at
each leaf the rank of the pair that starts there, and at each inner node the
smaller of its two children, the left one among equals.  The leftmost pair of
smallest rank is found by walking down from the root; a merge then updates
three leaves: the merged piece, its left neighbour and the piece that is gone.
A word of n bytes takes O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: words kept with their ids in one worker; beyond it the memory is emptied, which changes no result
REMEMBERED = 400_000
_NONE = 1 << 60
_encoders: dict[tuple[int, str], BytePairEncoder] = {}


class BytePairEncoder:
    """Ranks of byte strings, a pattern of words, and the words met so far."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.words = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        n, rank = len(word), self.ranks.get
        if n == 1:
            return [self.ranks[word]]
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        for i in range(n - 1):
            tree[size + i] = rank(word[i : i + 2], _NONE)
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a <= b else b
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] < _NONE:
            i, low = 1, tree[1]
            while i < size:
                i *= 2
                if tree[i] != low:
                    i += 1
            i -= size
            gone = after[i]
            end = after[gone]
            after[i] = end
            if end <= n:
                before[end] = i
            put(gone, _NONE)
            put(i, rank(word[i : after[end]], _NONE) if end < n else _NONE)
            if i > 0:
                left = before[i]
                put(left, rank(word[left:end], _NONE))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text; special tokens' strings are ordinary text."""
        known, words = self.known, self.words(text)
        for word in set(words).difference(known):
            if len(known) >= REMEMBERED:
                known = self.known = {}
                return self._encode_apart(words)
            known[word] = self.merge(word.encode("utf-8"))
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def _encode_apart(self, words: list[str]) -> list[int]:
        own = {word: self.merge(word.encode("utf-8")) for word in set(words)}
        return list(chain.from_iterable(map(own.__getitem__, words)))


def encoder(vocabulary: bytes, pattern: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary."""
    key = hash(vocabulary), pattern
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(vocabulary, pattern)
    return _encoders[key]


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of byte_bpe_50k as the box offers it."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def encode_corpus(documents: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, in one pass without a shuffle.

    ``path`` names a vocabulary file of lines "base64 rank"; the driver reads it
    once and sends it to the workers, as a vocabulary is of fixed size.  The
    empty text and the null text give an empty list; repeated rows give a row
    each; an empty table gives none; other columns are ignored.
    """
    own_path, own_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    sent = documents.sparkSession.sparkContext.broadcast(Path(path or own_path).read_bytes())
    words = pattern or own_pattern
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, words).encode
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])

    return documents.select(documents[key].alias("key"), documents[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
