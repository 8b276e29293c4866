"""Oversized items cut at natural boundaries.

An item starts as atomic segments.  A heap holds every pair of neighbours by
the strength of the boundary between them, then by their combined size; the
weakest boundary goes first, as long as the combined size and the overlap fit
the limit.  What is left are the pieces' bodies.

Words between two sentence ends always merge before the sentence end is
touched, so a sentence that fits starts as one segment; only a sentence above
the limit starts as words, and only a word above it as hard cuts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HARD, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
_BREAKS = re.compile(r"(\n[ \t\r]*\n\s*)|(\n)|((?:[.!?…。]+[\"'”»’)\]]*)[ \t ]+)")
_SPACES = re.compile(r"\s+")


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """(ends, strengths) of the atomic segments; a strength belongs to the boundary at its end."""
    ends: list[int] = []
    strengths: list[int] = []
    start = 0
    for end, strength in [*((m.end(), PARAGRAPH if m.group(1) else LINE if m.group(2) else SENTENCE) for m in _BREAKS.finditer(text)), (len(text), PARAGRAPH)]:
        if end <= start:
            continue
        if end - start > most:
            _words(text, start, end, most, ends, strengths)
        ends.append(end)
        strengths.append(strength)
        start = end
    return ends, strengths


def _words(text: str, start: int, end: int, most: int, ends: list[int], strengths: list[int]) -> None:
    for m in _SPACES.finditer(text, start, end):
        stop = m.end()
        while stop - start > most:
            start += most
            ends.append(start)
            strengths.append(HARD)
        if start < stop < end:
            ends.append(stop)
            strengths.append(WORD)
        start = max(start, stop)
    while end - start > most:
        start += most
        ends.append(start)
        strengths.append(HARD)


def bodies(text: str, most: int) -> list[int]:
    """Ends of the merged segments of at most ``most`` characters, in order."""
    ends, strengths = atoms(text, most)
    n = len(ends)
    starts = [0, *ends[:-1]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strengths[i], ends[i + 1] - starts[i], i, ends[i + 1]) for i in range(n - 1) if ends[i + 1] - starts[i] <= most]
    heapq.heapify(heap)
    while heap:
        strength, size, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or ends[j] != stop or stop - starts[i] != size or strengths[i] != strength:
            continue  # one of the two has grown since
        alive[j] = False
        ends[i], strengths[i], after[i] = stop, strengths[j], after[j]
        if after[j] < n:
            before[after[j]] = i
            size = ends[after[j]] - starts[i]
            if size <= most:
                heapq.heappush(heap, (strengths[i], size, i, ends[after[j]]))
        if (h := before[i]) >= 0:
            size = stop - starts[h]
            if size <= most:
                heapq.heappush(heap, (strengths[h], size, h, stop))
    return [ends[i] for i in range(n) if alive[i]]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; a text within the limit is one piece, the empty text none."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    pieces, start = [], 0
    for end in bodies(text, limit - overlap):
        pieces.append((start, end))
        start = max(start, end - overlap)
    return pieces


def split_items(items: DataFrame, keys: list[str], text: str, limit: int = 4000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Pieces of each item: (keys, piece_no, start, end[, piece]), from 0, in code points.

    A piece holds at most ``limit`` characters, ends at the strongest boundary
    that the merging left (paragraph, line, sentence, word, else a hard cut) and
    starts with the last ``overlap`` characters of the piece before it, or all
    of it if that is shorter.  The pieces cover the whole item; white space
    belongs to the segment before it.  Null and empty items give no piece,
    items within the limit one.  Repeated rows give their pieces again, other
    columns are ignored, an empty table gives none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    schema = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                owners, numbers, spans, cuts = [], [], [], []
                for i, value in enumerate(part.column(len(keys)).to_pylist()):
                    found = cut(value, limit, overlap) if value else []
                    owners += [i] * len(found)
                    numbers += range(len(found))
                    spans += found
                    if with_text:
                        cuts += [value[a:b] for a, b in found]
                taken = pa.array(owners, pa.int64())
                columns = [part.column(c).take(taken) for c in range(len(keys))]
                columns += [pa.array(numbers, pa.int32()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())]
                columns += [pa.array(cuts, pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(columns, [*keys, "piece_no", "start", "end", *(["piece"] if with_text else [])])

    extra = ", piece string" if with_text else ""
    return items.select(*keys, F.col(text)).mapInArrow(run, f"{schema}, piece_no int, start long, end long{extra}")


def line_range(text, first, last):
    """The lines first to last of a text, from 1, both inclusive; lines outside the text do not count."""
    first = F.greatest(first, F.lit(1))
    return F.when(last >= first, F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(last - first + 1, F.lit(0))), "\n"))
