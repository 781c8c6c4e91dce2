"""Words of whole texts as 64-bit hashes, computed over Arrow buffers with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; these bytes never occur inside a
multi-byte UTF-8 character, so this equals ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the 64-bit mixing steps.
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
#: FIRST[n] keeps the first n bytes of a little-endian 8-byte piece.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [a, b) of about ``most`` text bytes (one row at least): a, b, their bytes, and the b - a + 1 byte offsets. A null text has no bytes."""
    column = batch.column(batch.schema.get_field_index(column))
    text = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    if text.null_count:
        text = text.fill_null(b"")
    n = len(text)
    kind = np.int64 if pa.types.is_large_binary(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if n and text.buffers()[2] is not None and offsets[-1] > 0 else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and per row the index of its first word (one more entry at the end)."""
    inside = ~SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    if len(data):
        before[0] = False
        before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
        after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, from its length and its 8-byte pieces in turn."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    size = ends - starts
    with np.errstate(over="ignore"):
        h = mix((size.astype(np.uint64) + U(seed)) * M3)
        left, at = np.arange(len(starts)), 0
        while len(left):
            piece = eights[starts[left] + at].view("<u8").ravel() & FIRST[np.minimum(size[left] - at, 8)]
            h[left] = mix(h[left] * M3 ^ piece)
            at += 8
            left = left[size[left] > at]
    return h


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row, and the row of each; rows with fewer words give none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = mix(h * M3 + words[k : k + n])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    fits = np.arange(n) + width <= bounds[row + 1]
    return h[fits], row[fits]
