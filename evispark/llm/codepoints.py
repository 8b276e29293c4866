"""Arrow strings as numpy code points, and back, without a call per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: code points handled at once, so that temporary arrays stay small; one longer text is one chunk
CHUNK = 1 << 20


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points as uint32, row offsets) of a string array; a null is an empty row."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2], np.uint8, high - low, low) if high > low else np.empty(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, offsets - low
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[offsets - low]


def encode(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The string array of code points cut at offsets."""
    data = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[pa.Array]:
    """Consecutive slices of a string array of about ``most`` bytes, at least one row each."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end
