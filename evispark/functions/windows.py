"""Where a query stands on a page: spans of its terms, and bounded windows of whole lines around them."""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F

from evispark.functions.text import prefix_end, search_tokens, stem

#: Bytes of a preview and of a whole candidate.
PREVIEW, CANDIDATE = 512, 2048
_WORD = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ])*")


def term_spans(text: str, query: str, stemmed: bool = True) -> list[tuple[int, int]]:
    """Spans of the words of ``text`` that are, by their stems, words of the query; accents do not count."""
    form = (lambda w: stem(w)) if stemmed else (lambda w: w)
    wanted = {form(w) for w in search_tokens(query)}
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).lower()
    return [m.span() for m in _WORD.finditer(text) if form(bare(m.group())) in wanted]


def variant_spans(text: str, term: str) -> list[tuple[int, int]]:
    """Spans of a term, its hyphens as they are, left out or as blanks, also across a line end; the earliest first."""
    parts = [re.escape(p) for p in re.split("-", term) if p]
    found = re.finditer(r"(?<![^\W_])" + r"(?:-\s*|\s+)?".join(parts) + r"(?![^\W_])", text, re.IGNORECASE) if parts else ()
    return [m.span() for m in found]


class _Lines:
    """Line starts of a text and its size in bytes up to each character's line."""

    def __init__(self, text: str) -> None:
        self.text = text
        lines = text.splitlines(keepends=True)
        self.starts = [0, *accumulate(map(len, lines))]
        self.bytes = [0, *accumulate(len(line.encode("utf-8")) for line in lines)]

    def line(self, place: int) -> int:
        return max(0, min(bisect_right(self.starts, place) - 1, len(self.starts) - 2))

    def grown(self, first: int, last: int, most: int) -> tuple[int, int]:
        """Whole lines first to last and as many around them, up and down in turn, as fit the bytes."""
        fits = lambda a, b: self.bytes[b + 1] - self.bytes[a] <= most
        more = True
        while more:
            more = False
            if first > 0 and fits(first - 1, last):
                first, more = first - 1, True
            if last < len(self.starts) - 2 and fits(first, last + 1):
                last, more = last + 1, True
        return first, last


def passages(text: str, spans: list[tuple[int, int]], preview: int = PREVIEW, most: int = CANDIDATE) -> list[dict[str, object]]:
    """Passages around matches: {start, end, first_line, last_line, truncated}, lines from 1, in order.

    Matches on one line or on neighbouring lines form a cluster.  A cluster
    becomes whole lines of at most ``preview`` bytes; a longer one keeps its own
    extent up to ``most`` bytes and is cut there, truncated.  Passages that
    share four fifths of the smaller one are joined if the union fits ``most``.
    """
    if not spans or not text:
        return []
    lines = _Lines(text)
    clusters: list[list[tuple[int, int]]] = []
    for start, end in sorted(spans):
        if clusters and lines.line(start) <= lines.line(max(e for _, e in clusters[-1]) - 1) + 1:
            clusters[-1].append((start, end))
        else:
            clusters.append([(start, end)])
    size = lambda a, b: len(text[a:b].encode("utf-8"))
    out: list[dict[str, object]] = []
    for cluster in clusters:
        low, high = cluster[0][0], max(e for _, e in cluster)
        first, last = lines.line(low), lines.line(high - 1)
        if size(low, high) > most:
            start, end, truncated = low, prefix_end(text, low, high, most), True
        elif lines.bytes[last + 1] - lines.bytes[first] <= preview:
            first, last = lines.grown(first, last, preview)
            start, end, truncated = lines.starts[first], lines.starts[last + 1], False
        elif lines.bytes[last + 1] - lines.bytes[first] <= most:
            start, end, truncated = lines.starts[first], lines.starts[last + 1], False
        else:
            start, end, truncated = low, high, False
        found = {"start": start, "end": end, "first_line": lines.line(start) + 1, "last_line": lines.line(max(start, end - 1)) + 1, "truncated": truncated}
        if out:
            before = out[-1]
            shared = min(before["end"], end) - max(before["start"], start)
            smaller = min(before["end"] - before["start"], end - start)
            joined = min(before["start"], start), max(before["end"], end)
            if smaller > 0 and shared * 5 >= smaller * 4 and size(*joined) <= most:
                before.update(start=joined[0], end=joined[1], first_line=min(before["first_line"], found["first_line"]), last_line=max(before["last_line"], found["last_line"]))
                continue
        out.append(found)
    return out


_PASSAGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("truncated", pa.bool_())]))


@functools.cache
def passages_udf():
    """(text, query) -> the passages around the query's stemmed terms."""

    def run(texts: pa.Array, queries: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), queries.to_pylist())
        return pa.array([None if t is None or q is None else passages(t, term_spans(t, q)) for t, q in pairs], _PASSAGE)

    run.__annotations__ = {"texts": pa.Array, "queries": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<start:int,end:int,first_line:int,last_line:int,truncated:boolean>>")
