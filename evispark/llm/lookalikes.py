"""One form for texts that look the same.

The code points of a whole Arrow batch stand in one numpy array.  A lookup
table gives each code point its length in the one form and its place in a pool
of expansions, so that folding is two gathers; marks are then ordered and
composed for all rows at once, one step per mark of the longest run.

The form keeps what a reader sees: letters, case, accents, digits, signs and
line breaks.  It folds what a reader cannot see: full-width and styled forms,
ligatures, composed and decomposed accents, invisible characters, kinds of
space and hyphen, and letters of other scripts drawn like Latin ones.
Superscripts, fractions and other signs that look different stay.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.codepoints import chunks, decode, encode
from evispark.plans import staged

# Letters drawn like Latin letters.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
}
GREEK = {
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
}
LATIN = {"ɑ": "a", "ɡ": "g"}
HYPHENS = "‐‑"
#: compatibility forms that look like the plain character
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
LIGATURES = range(0xFB00, 0xFB07)
MICRO_SIGN = "µ"

_LIMIT = 0x110000
_GUARD = 0x10FFFF  # a non-character that keeps rows apart
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _folded(c: str) -> str:
    """What one character becomes before marks are composed."""
    category = unicodedata.category(c)
    if c in "\n\t" or category in ("Zs", "Zl", "Zp"):
        return "\n" if c == "\n" or category in ("Zl", "Zp") else " "
    point = ord(c)
    if category == "Cc" or (category == "Cf" and unicodedata.bidirectional(c) != "AN" and not 0x0600 <= point <= 0x08E2) or 0xFE00 <= point <= 0xFE0F or point == 0x034F:
        return "" if c != "\x85" else "\n"
    if c in HYPHENS:
        return "-"
    if _S <= point < _S + 11172:
        return c
    tag = unicodedata.decomposition(c).partition(" ")[0]
    if tag in SAME_LOOK or point in LIGATURES or c == MICRO_SIGN:
        c = unicodedata.normalize("NFKD", c)
    else:
        c = unicodedata.normalize("NFD", c)
    alike = CYRILLIC | GREEK | LATIN
    return "".join(alike.get(x, x) for x in c)


class _Tables:
    def __init__(self) -> None:
        self.length = np.ones(_LIMIT, np.uint8)
        self.place = np.arange(_LIMIT, dtype=np.int32)  # below the limit: the character itself
        self.classes = np.zeros(_LIMIT, np.uint8)
        pool: list[int] = []
        first: list[int] = []
        second: list[int] = []
        made: list[int] = []
        for point in (*range(0x80, 0x30000), *range(0xE0000, 0xE0200), *range(0x20), 0x7F):
            c = chr(point)
            if 0xD800 <= point < 0xE000:
                continue
            self.classes[point] = unicodedata.combining(c)
            into = _folded(c)
            if into != c:
                self.length[point] = len(into)
                self.place[point] = _LIMIT + len(pool)
                pool += map(ord, into)
            pair = unicodedata.decomposition(c)
            if pair and pair[0] != "<" and " " in pair and not _S <= point < _S + 11172:
                a, b = pair.split()
                if unicodedata.normalize("NFC", chr(int(a, 16)) + chr(int(b, 16))) == c:  # no composition exclusion
                    first.append(int(a, 16))
                    second.append(int(b, 16))
                    made.append(point)
        self.pool = np.array(pool, np.uint32)
        self.changed = self.place >= _LIMIT
        keys = np.array(first, np.int64) << 21 | np.array(second, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, np.uint32)[order]
        self.seconds = np.zeros(_LIMIT, bool)  # starters that compose with the starter before them
        self.seconds[[b for b in second if not unicodedata.combining(chr(b))]] = True
        self.seconds[_V : _V + 21] = True
        self.seconds[_T + 1 : _T + 28] = True

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What a and b compose to, 0 for nothing."""
        a64, b64 = a.astype(np.int64), b.astype(np.int64)
        at = np.searchsorted(self.keys, key := a64 << 21 | b64)
        at[at == len(self.keys)] = 0
        out = np.where(self.keys[at] == key, self.made[at], 0).astype(np.int64)
        lv = (a64 >= _L) & (a64 < _L + 19) & (b64 >= _V) & (b64 < _V + 21)
        out[lv] = _S + ((a64[lv] - _L) * 21 + (b64[lv] - _V)) * 28
        lvt = (a64 >= _S) & (a64 < _S + 11172) & ((a64 - _S) % 28 == 0) & (b64 > _T) & (b64 < _T + 28)
        out[lvt] = a64[lvt] + b64[lvt] - _T
        return out.astype(np.uint32)


@functools.cache
def tables() -> _Tables:
    return _Tables()


def _fold(points: np.ndarray, offsets: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Every code point's folded form, with offsets moved by the lengths; only folded places are touched."""
    at = np.flatnonzero(t.changed[points])
    if not len(at):
        return points, offsets
    length = t.length[points[at]].astype(np.int64)
    place = t.place[points[at]] - _LIMIT
    moved = np.cumsum(length - 1)
    times = np.ones(len(points), np.int64)
    times[at] = length
    out = np.repeat(points, times)
    start = at + moved - (length - 1)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(start, length) + step] = t.pool[np.repeat(place, length) + step]
    before = np.searchsorted(at, offsets)
    return out, offsets + np.concatenate([[0], moved])[before]


def _compose(points: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """(code points, kept) after canonical ordering and composition."""
    points = points.copy()
    kept = np.ones(len(points), bool)
    classes = t.classes[points]
    marks = np.flatnonzero(classes)
    if len(marks):
        starter = np.maximum.accumulate(np.where(classes == 0, np.arange(len(points)), -1))[marks]
        order = np.lexsort((np.arange(len(marks)), classes[marks], starter))
        points[marks] = points[marks[order]]  # runs are contiguous and sorted by starter, so each keeps its places
        classes = t.classes[points]
    while True:  # starter pairs, as of Hangul; each round shortens the text
        seconds = np.flatnonzero(t.seconds[points] & kept)
        if not len(seconds):
            break
        live = np.flatnonzero(kept)
        before = live[np.maximum(np.searchsorted(live, seconds) - 1, 0)]
        made = t.pair(points[before], points[seconds])
        hit = (made > 0) & (before < seconds) & (classes[before] == 0)
        hit[1:] &= ~(hit[:-1] & (before[1:] == seconds[:-1]))
        if not hit.any():
            break
        points[before[hit]] = made[hit]
        kept[seconds[hit]] = False
    if len(marks):
        base = starter
        rank = np.arange(len(marks)) - np.searchsorted(base, base)
        skipped = np.zeros(len(points), np.uint8)  # by starter: the class of the last mark left over
        for r in range(int(rank.max()) + 1):
            at = marks[rank == r]
            on = base[rank == r]
            free = (skipped[on] == 0) | (skipped[on] < classes[at])
            made = np.where(free & (on >= 0), t.pair(points[on], points[at]), 0)
            hit = made > 0
            points[on[hit]] = made[hit]
            kept[at[hit]] = False
            skipped[on[~hit]] = classes[at[~hit]]
    return points, kept


def one_form_array(texts: pa.Array) -> pa.Array:
    """The one form of each text of an Arrow string array; null stays null."""
    t = tables()
    parts = []
    for part in chunks(texts):
        points, offsets = decode(part)
        if not len(points) or (points.max() < 0x7F and (points.min() >= 0x20 or not ((points < 0x20) & (points != 10)).any())):
            parts.append(part.cast(pa.string()))
            continue
        rows = len(part)
        points = np.insert(points, offsets[:-1], _GUARD)
        offsets = offsets + np.arange(rows + 1)
        points, offsets = _fold(points, offsets, t)
        if t.classes[points].any() or t.seconds[points].any():
            points, kept = _compose(points, t)
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            points = points[kept]
        keep = np.ones(len(points), bool)
        keep[offsets[:-1]] = False
        out = encode(points[keep], offsets - np.arange(rows + 1))
        if part.null_count:
            import pyarrow.compute as pc

            out = pc.if_else(part.is_valid(), out, pa.scalar(None, pa.string()))
        parts.append(out)
    return pa.concat_arrays(parts) if parts else texts.cast(pa.string())


@functools.cache
def one_form_udf():
    @F.arrow_udf("string")
    def one_form(texts: pa.Array) -> pa.Array:
        return one_form_array(texts)

    return one_form


def one_form(column):
    """The one form of a text column; null gives null, the empty text the empty text.

    Texts of any length are handled whole.  Applying it twice changes nothing.
    """
    return one_form_udf()(column)


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """(field, key_a, key_b): records of a field whose texts differ but look the same.

    ``records`` has (field, key, text); other columns are ignored.  Repeated
    rows of a key count once, null texts and null keys are no case, an empty table
    gives none.
    Texts travel as 128-bit digests only, which are staged, so that each text
    is brought to its form once.  Classes in which all texts are
    stored alike leave before any pair is made, and pairs are made between
    distinct texts, so identical copies meet nothing but what the result holds.
    """
    digest = lambda c: F.unhex(F.md5(c))
    rows = staged(
        records.where(F.col("text").isNotNull() & F.col("key").isNotNull())
        .select("field", "key", digest(F.col("text")).alias("stored"), digest(one_form(F.col("text"))).alias("form"))
        .groupBy("field", "key")
        .agg(F.min("stored").alias("stored"), F.min("form").alias("form"))
    )
    mixed = rows.groupBy("field", "form").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("field", "form")
    rows = rows.join(mixed, ["field", "form"])
    texts = rows.select("field", "form", "stored").distinct()
    pairs = texts.withColumnRenamed("stored", "stored_a").join(texts.withColumnRenamed("stored", "stored_b"), ["field", "form"]).where("stored_a < stored_b")
    left = rows.select("field", "form", F.col("stored").alias("stored_a"), F.col("key").alias("a"))
    right = rows.select("field", "form", F.col("stored").alias("stored_b"), F.col("key").alias("b"))
    met = pairs.join(left, ["field", "form", "stored_a"]).join(right, ["field", "form", "stored_b"])
    return met.select("field", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
