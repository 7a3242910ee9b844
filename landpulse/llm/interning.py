"""Words of alert messages and their n-grams, interned in an open-addressed numpy table.

A word is a run of letters, digits and bytes from 0x80 on; only A-Z are lower-cased. The words of a
run of messages are laid side by side with one space between, so that every n-gram is one span of
bytes. The table's keys are xxhash64 values of these spans; equal keys are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from landpulse.llm.lexing import spread
from landpulse.llm.words import runs, text_bytes

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

RUN_BYTES = 2_000_000
_PAD = 16

# The primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass
class WordRun:
    """Words of messages ``begin`` .. ``end - 1``: word i is ``data[starts[i]:ends[i]]``, a space
    follows each, ``counts`` has the words per message."""

    begin: int
    end: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, n-grams per message) of all runs of ``n`` words inside one message."""
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        first = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else np.zeros(0, np.int64)
        return self.starts[first], self.ends[first + n - 1], np.maximum(self.counts - (n - 1), 0)


def word_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[WordRun]:
    """The words of a string column, about ``limit`` bytes of messages at a time; NULL has none."""
    if len(column) == 0:
        return
    data, offsets = text_bytes(column)
    for begin, end in runs(offsets, limit):
        part, cuts = data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
        inside = _WORD[part]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        borders = cuts[1:-1]
        borders = borders[(borders > 0) & (borders < len(part))]
        opens[borders] |= inside[borders]
        closes[borders - 1] |= inside[borders - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sizes = ends - starts
        at = np.cumsum(sizes + 1) - (sizes + 1)
        laid = np.full(int((sizes + 1).sum()) + _PAD, 0x20, np.uint8)
        laid[spread(at, sizes)] = _LOWER[part[inside]]
        yield WordRun(begin, end, laid, at, at + sizes, np.diff(np.searchsorted(starts, cuts)))


def _lanes(data: np.ndarray, kind: str) -> np.ndarray:
    """The number that starts at each byte of ``data``."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(data) - size + 1,), kind, buffer=data, strides=(1,))


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of every ``data[start:end]``; ``data`` goes on for 8 bytes after the last.

    Spans of under 32 bytes are hashed side by side, longer ones by the library.
    """
    size = ends - starts
    value = size.astype(np.uint64) + _P5
    wide, half = _lanes(data, "<u8"), _lanes(data, "<u4")
    short = size < 32
    with np.errstate(over="ignore"):
        for k in range(3):
            at = np.flatnonzero(short & (size >= 8 * (k + 1)))
            lane = wide[starts[at] + 8 * k] * _P2
            value[at] = _rotl(value[at] ^ (_rotl(lane, 31) * _P1), 27) * _P1 + _P4
        at = np.flatnonzero(short & (size & 4 > 0))
        value[at] = _rotl(value[at] ^ (half[starts[at] + (size[at] & ~7)].astype(np.uint64) * _P1), 23) * _P2 + _P3
        for k in range(3):
            at = np.flatnonzero(short & (size & 3 > k))
            value[at] = _rotl(value[at] ^ (data[starts[at] + (size[at] & ~3) + k].astype(np.uint64) * _P5), 11) * _P1
        value = (value ^ (value >> np.uint64(33))) * _P2
        value = (value ^ (value >> np.uint64(29))) * _P3
    value ^= value >> np.uint64(32)
    for i in np.flatnonzero(~short):
        value[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]])
    return value


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` equal those from ``b``."""
    wide = _lanes(data, "<u8")
    same = np.ones(len(a), bool)
    for k in range(8):
        at = np.flatnonzero(same & (size > 8 * k) & (size <= 64))
        if len(at) == 0:
            break
        rest = np.minimum(size[at] - 8 * k, 8)
        same[at] = ((wide[a[at] + 8 * k] ^ wide[b[at] + 8 * k]) << (np.uint64(64) - np.uint64(8) * rest.astype(np.uint64))) == 0
    for i in np.flatnonzero(size > 64):
        same[i] = np.array_equal(data[a[i]:a[i] + size[i]], data[b[i]:b[i] + size[i]])
    return same


class InternTable:
    """Spans of one run of messages, each distinct one in a slot of its own.

    Open addressing with linear probing over a power of two of at least twice the spans. All spans
    probe side by side: those that meet a free slot claim it, one of them wins, and whoever finds a
    slot with its own key and the same bytes has arrived; the others step on. ``slot`` is the slot of
    each span, ``used`` the slots in use, ``count`` how many spans each slot stands for.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None):
        keys = xxhash64_spans(data, starts, ends) if keys is None else keys
        slots = 1 << max(4, (2 * len(starts) - 1).bit_length())
        size, mask = ends - starts, slots - 1
        owner = np.full(slots, -1, np.int64)
        self.slot = (keys & np.uint64(mask)).astype(np.int64)
        seeking = np.arange(len(starts))
        while len(seeking):
            here = self.slot[seeking]
            free = owner[here] < 0
            owner[here[free]] = seeking[free]
            held = owner[here]
            same = (keys[held] == keys[seeking]) & (size[held] == size[seeking])
            check = np.flatnonzero(same & (held != seeking))
            same[check] = same_spans(data, starts[seeking[check]], starts[held[check]], size[seeking[check]])
            seeking = seeking[~same]
            self.slot[seeking] = (self.slot[seeking] + 1) & mask
        self.slots, self.used = slots, np.flatnonzero(owner >= 0)
        self.first, self.last = starts[owner[self.used]], ends[owner[self.used]]
        self.count = np.bincount(self.slot, minlength=slots)

    def spans(self, data: np.ndarray) -> list[bytes]:
        """The bytes of each used slot."""
        whole = data.tobytes()
        return [whole[a:b] for a, b in zip(self.first.tolist(), self.last.tolist())]
