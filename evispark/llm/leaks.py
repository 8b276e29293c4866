"""Evaluation texts inside a corpus, by SimHash windows and Hamming blocks.

Items are cut into windows at every word: short ones, whose run in a document is
a verbatim passage, and item-sized ones, in sizes that grow by half from
``LEAST`` words up to the item's length, for altered and partial passages.  A
window has a 64-bit SimHash of its weighted shingles; shingles that many items
share weigh less.  The fingerprint is cut into blocks, and an index by block
holds every value within radius / blocks bits of an item's: of two fingerprints
within the radius one block at least is that close, so the lookups together
find every item window within the radius of a document window.  Candidates are
then verified by the exact weighted similarity of their shingles.

Short windows are compared at every word of a document that stands in a window
with at least one of the items' shingles; a window without any has similarity 0
and could not pass the verification, so none is lost.  Item-sized windows hash
single words, which survive alterations best, and are compared at every
``GRID``-th word; they are verified on pairs of words.

The items are the stated query set, held against all documents in one pass.
They are cut into blocks of bounded bytes, built one at a time; documents are
never shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.codepoints import chunks
from evispark.llm.lookalikes import one_form_array
from evispark.llm.words import mix, shingle_hashes, word_hashes

#: verbatim windows: words, words of a shingle, radius, least similarity
WINDOW, SHINGLE, RADIUS, SIMILARITY = 13, 5, 3, 0.8
#: item-sized windows: words of the smallest, growth, step in documents, radius, words of a shingle that verifies, least similarity
LEAST, GROWTH, GRID, WIDE_RADIUS, PAIR, ALTERED = 24, 1.5, 4, 15, 2, 0.45
#: bytes of the items' texts in one broadcast block
BLOCK_BYTES = 4 << 20
BLOCKS, BLOCK_BITS = 4, 16
_WORDS_AT_ONCE = 40_000
_MOST = 8


def sizes(longest: int, least: int = LEAST, growth: float = GROWTH) -> list[int]:
    """Window sizes from ``least`` on, each ``growth`` times the one before, up to ``longest``; multiples of ``GRID``."""
    out, at = [], float(least)
    while (size := int(at) // GRID * GRID) <= longest:
        out.append(size)
        at *= growth
    return out


class Shingles:
    """The items' shingles of one length with their weights: 8, less 1 for each doubling of the items that hold it, 1 at least."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, size: int) -> None:
        self.size = size
        hashes = shingle_hashes(words, size)
        whole = rows[: len(hashes)] == rows[size - 1 :][: len(hashes)]
        pairs = np.unique(np.stack([hashes[whole], rows[: len(hashes)][whole].astype(np.uint64)], 1), axis=0) if whole.any() else np.empty((0, 2), np.uint64)
        self.known, counts = np.unique(pairs[:, 0], return_counts=True)
        self.weights = np.maximum(1, _MOST - np.floor(np.log2(counts)).astype(np.int64)).astype(np.int32)

    def weigh(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, whether an item holds it) of shingles."""
        if not len(self.known):
            return np.full(hashes.shape, _MOST, np.int32), np.zeros(hashes.shape, bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        held = self.known[at] == hashes
        return np.where(held, self.weights[at], _MOST).astype(np.int32), held


def signs(hashes: np.ndarray) -> np.ndarray:
    """The bits of hashes as 1 and -1, 64 columns."""
    bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of sums of signs."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view(np.uint64).ravel()


@functools.cache
def masks(radius: int) -> np.ndarray:
    """All values of a block with at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BLOCK_BITS), n)], np.int64)


class BlockIndex:
    """Fingerprints by block value; a lookup finds all within the radius."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        near = masks(radius // BLOCKS)
        for block in range(BLOCKS):
            value = (self.block(prints, block)[:, None] ^ near).ravel().astype(np.uint16)
            order = np.argsort(value, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << BLOCK_BITS))])
            self.tables.append(((order // len(near)).astype(np.int32), ends))

    @staticmethod
    def block(prints: np.ndarray, block: int) -> np.ndarray:
        return (prints >> np.uint64(block * BLOCK_BITS) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place in the index) of all pairs within the radius, each once."""
        found = [np.empty(0, np.int64)]
        for block, (order, ends) in enumerate(self.tables):
            value = self.block(prints, block)
            first, count = ends[value], ends[value + 1] - ends[value]
            at = np.flatnonzero(count)
            for part in np.array_split(at, max(1, int(count[at].sum()) // 2_000_000 + 1)):
                doc = np.repeat(part, count[part])
                step = np.arange(len(doc)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                item = order[np.repeat(first[part], count[part]) + step]
                near = np.bitwise_count(prints[doc] ^ self.prints[item]) <= self.radius
                found.append(doc[near] * len(self.prints) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def similarity(a: np.ndarray, b: np.ndarray, shingles: Shingles) -> np.ndarray:
    """The weighted Jaccard similarity of the shingles of windows a and b (word hashes, one window a row)."""
    out = np.empty(len(a))
    for low in range(0, len(a), 2_000):
        sa, sb = (_rows(x[low : low + 2_000], shingles.size) for x in (a, b))
        (wa, _), (wb, _) = shingles.weigh(sa), shingles.weigh(sb)
        first_a, first_b = _first(sa), _first(sb)
        shared = (wa * (first_a & (sa[:, :, None] == sb[:, None, :]).any(2))).sum(1)
        out[low : low + 2_000] = shared / np.maximum(1, (wa * first_a).sum(1) + (wb * first_b).sum(1) - shared)
    return out


def _rows(words: np.ndarray, size: int) -> np.ndarray:
    """The shingles of each row."""
    n = words.shape[1] - size + 1
    h = np.zeros((len(words), n), np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, i : i + n])
    return h


def _first(hashes: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its row."""
    order = np.argsort(hashes, axis=1, kind="stable")
    ordered = np.take_along_axis(hashes, order, 1)
    new = np.ones(hashes.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    out = np.empty(hashes.shape, bool)
    np.put_along_axis(out, order, new, 1)
    return out


class ItemTables:
    """Windows, fingerprints and indexes of some items."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int = WINDOW, shingle: int = SHINGLE, radius: int = RADIUS) -> None:
        known = [(i, t) for i, t in zip(ids, texts) if t]
        self.ids = np.array([i for i, _ in known], np.int64)
        self.words, self.rows = word_hashes(one_form_array(pa.array([t for _, t in known], pa.string())))
        self.window, self.radius = window, radius
        self.shingles, self.single, self.pairs = (Shingles(self.words, self.rows, n) for n in (shingle, 1, PAIR))
        self.starts = self._starts(window)
        self.lengths = np.bincount(self.rows, minlength=len(self.ids))
        self.sizes = sizes(int(self.lengths.max(initial=0)))

    def _starts(self, size: int) -> np.ndarray:
        """The words at which a window of an item begins."""
        n = len(self.rows) - size + 1
        return np.flatnonzero(self.rows[:n] == self.rows[size - 1 :]) if n > 0 else np.empty(0, np.int64)

    @functools.cached_property
    def short(self) -> BlockIndex:
        return BlockIndex(self.short_prints(self.words, self.starts), self.radius)

    @functools.cached_property
    def wide(self) -> list[tuple[int, np.ndarray, BlockIndex]]:
        """(size, starts, index) of the item-sized windows, which begin at every quarter of their size and end with the item."""
        out = []
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(self.word_signs(self.words), axis=0, dtype=np.int32)])
        for size in self.sizes:
            starts = self._starts(size)
            first = np.searchsorted(self.rows, self.rows[starts])
            last = first + self.lengths[self.rows[starts]] - size
            starts = starts[((starts - first) % (size // GRID) == 0) | (starts == last)]
            out.append((size, starts, BlockIndex(packed(sums[starts + size] - sums[starts]), WIDE_RADIUS)))
        return out

    def short_prints(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The SimHashes of the short windows that begin at some words."""
        hashes = shingle_hashes(words, self.shingles.size)
        held = np.arange(self.window - self.shingles.size + 1)
        parts = [np.empty(0, np.uint64)]
        for low in range(0, len(at), 4_096):
            inside = hashes[at[low : low + 4_096, None] + held]
            parts.append(packed((signs(inside) * self.shingles.weigh(inside)[0][:, :, None]).sum(1)))
        return np.concatenate(parts)

    def word_signs(self, words: np.ndarray) -> np.ndarray:
        """The weighted signs of words, 64 columns."""
        hashes = shingle_hashes(words, 1)
        return signs(hashes) * self.single.weigh(hashes)[0].astype(np.int8)[:, None]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("short", "wide")}  # workers build the indexes


def _verbatim(t: ItemTables, words: np.ndarray, rows: np.ndarray, least: float) -> dict[tuple[int, int], tuple[int, float]]:
    """(longest run of words, best similarity) by (row, item) of short windows at least ``least`` alike."""
    out: dict[tuple[int, int], list[float]] = {}
    hashes = shingle_hashes(words, t.shingles.size)
    n = len(words) - t.window + 1
    if n <= 0 or not len(t.starts):
        return {}
    held = np.concatenate([[0], np.cumsum(t.shingles.weigh(hashes)[1])])
    span = t.window - t.shingles.size + 1
    at = np.flatnonzero((held[span : span + n] > held[:n]) & (rows[:n] == rows[t.window - 1 :]))
    doc, entry = t.short.candidates(t.short_prints(words, at))
    doc, start = at[doc], t.starts[entry]
    reach = np.arange(t.window)
    inside, of_item = words[doc[:, None] + reach], t.words[start[:, None] + reach]
    score = similarity(inside, of_item, t.shingles)
    keep = score >= least
    doc, start, score, same = doc[keep], start[keep], score[keep], (inside[keep] == of_item[keep]).all(1)
    # consecutive identical windows on one diagonal of a text and an item form one run of words
    row, owner = rows[doc], t.rows[start]
    order = np.lexsort((doc, doc - start, owner, row))
    previous, run = None, 0
    for r, o, d, p, s, e in zip(*(x[order].tolist() for x in (row, t.ids[owner], doc, start, score, same))):
        best = out.setdefault((r, o), [0, 0.0])
        best[1] = max(best[1], s)
        if e:
            run = run + 1 if previous == (r, o, d - p, d - 1) else 1
            previous = (r, o, d - p, d)
            best[0] = max(best[0], run + t.window - 1)
    return {k: (int(a), b) for k, (a, b) in out.items()}


def _altered(t: ItemTables, words: np.ndarray, rows: np.ndarray, least: float) -> dict[tuple[int, int], tuple[float, int]]:
    """(best similarity, words of the window) by (row, item) of item-sized windows at least ``least`` alike."""
    out: dict[tuple[int, int], tuple[float, int]] = {}
    if not t.sizes or len(words) < t.sizes[0]:
        return out
    place = np.arange(len(words)) - np.searchsorted(rows, rows)
    on_grid = np.flatnonzero(place % GRID == 0)
    # signs are summed from one grid word to the next, then over windows, which hold whole steps
    steps = np.add.reduceat(t.word_signs(words), on_grid, axis=0, dtype=np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(steps, axis=0)])
    for size, starts, index in t.wide:
        first = np.flatnonzero(on_grid + size <= len(words))
        first = first[rows[on_grid[first]] == rows[on_grid[first] + size - 1]]
        at = on_grid[first]
        doc, entry = index.candidates(packed(sums[first + size // GRID] - sums[first]))
        doc, start = at[doc], starts[entry]
        reach = np.arange(size)
        score = np.concatenate([np.empty(0), *(similarity(words[doc[a : a + 2_000, None] + reach], t.words[start[a : a + 2_000, None] + reach], t.pairs) for a in range(0, len(doc), 2_000))])
        for r, o, s in zip(*(x[score >= least].tolist() for x in (rows[doc], t.ids[t.rows[start]], score))):
            out[r, o] = max(out.get((r, o), (0.0, 0)), (s, size))
    return out


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items' (ids, texts) in blocks of about ``most`` bytes, of which the driver holds one at a time."""
    once = items.select("item_id", "text").where("text is not null and item_id is not null").distinct()
    whole = once.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-whole // most) or 1
    for block in range(n):
        rows = once.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).collect()  # about ``most`` bytes
        yield [r.item_id for r in rows], [r.text for r in rows]


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, radius: int = RADIUS, least: float = SIMILARITY, altered: float | None = ALTERED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_words, similarity, altered, altered_words): documents with passages of items.

    ``documents`` has (doc_id, text), ``items`` (item_id, text).  Words are runs
    of letters and digits of the one form, in lower case.  A row says that some
    short window of the document is within the radius and at least ``least``
    alike, or that an item-sized window is within its radius and at least
    ``altered`` alike; the columns of a test that fails are null, and with
    ``altered`` None only the first is made.  ``n_words`` is the longest run of
    the item's words that stands in the document unbroken, 0 if it is below
    ``window``; ``altered_words`` is the size of the most alike window.  Null and
    empty texts and items below ``window`` words match nothing; items without
    any give no rows.
    """
    spark = documents.sparkSession
    sent = [spark.sparkContext.broadcast(ItemTables(*block, window, shingle, radius)) for block in _blocks(items, block_bytes)]  # each of bounded bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column(1), _WORDS_AT_ONCE * 6):
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                words, rows = word_hashes(one_form_array(part))
                for block in sent:
                    t = block.value
                    same = _verbatim(t, words, rows, least)
                    near = _altered(t, words, rows, altered) if altered is not None else {}
                    if len(sent) > 1:
                        block.__dict__.pop("_value", None)  # one block at a time in memory
                    pairs = sorted(same.keys() | near.keys())
                    if pairs:
                        r, o = zip(*pairs)
                        n, s = zip(*(same.get(p, (0, None)) for p in pairs))
                        a, w = zip(*(near.get(p, (None, None)) for p in pairs))
                        columns = [ids.take(pa.array(r, pa.int64())), pa.array(o, pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.float64()), pa.array(a, pa.float64()), pa.array(w, pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_words", "similarity", "altered", "altered_words"])

    return documents.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(run, "doc_id long, item_id long, n_words int, similarity double, altered double, altered_words int")
