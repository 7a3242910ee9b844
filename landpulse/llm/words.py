"""Words of many texts as 64-bit hashes, straight from an Arrow batch's bytes.

A word is a run of bytes other than space, tab and line ends; A-Z are lower-cased. Everything is
done on the batch's byte buffer, without Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from landpulse.llm.lexing import mix64, span_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BATCH_BYTES = 1_000_000


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``limit`` bytes together; a longer text alone."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield begin, end
        begin = end


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, word hashes in order, words per text), run after run."""
    if len(column) == 0:
        return
    data, offsets = text_bytes(column)
    for begin, end in runs(offsets):
        part = data[offsets[begin]:offsets[end]]
        cuts = offsets[begin:end + 1] - offsets[begin]
        inside = ~_SPACE[part]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        borders = cuts[1:-1]
        borders = borders[(borders > 0) & (borders < len(part))]
        opens[borders] |= inside[borders]
        closes[borders - 1] |= inside[borders - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        hashes = span_hashes(_LOWER[part], starts, ends)
        yield begin, end, hashes, np.diff(np.searchsorted(starts, cuts))


def ngrams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``n`` words inside one text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(words) - n + 1
    value = words[:size].copy()
    for k in range(1, n):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + words[k:size + k])
    kept = owner[:size] == owner[n - 1:]
    return value[kept], owner[:size][kept]
