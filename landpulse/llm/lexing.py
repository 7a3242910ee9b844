"""Pretokens of many texts at once: a finite-state lexer run in lock step over equal chunks.

A tokenizer first cuts a text into pretokens (words, digits, punctuation, white space) and then
merges inside each of them. The cut is a regular language, so it is done here by a deterministic
transducer over character classes. All texts of a batch form one symbol row, cut into chunks of
equal length. Each chunk yields its state map (start state -> end state); the maps compose through
a parallel prefix scan, which gives every chunk its start state, and a second run from there emits
the boundaries. Numpy works on all chunks side by side, so no Python runs per character.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import regex

# The White_Space code points of Unicode.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
               0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Contractions cut off as pretokens of their own by the public word patterns.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

CLASSES = ("letter", "single", "r", "v", "l", "e", "number", "blank", "space", "quote", "other", "end")
LETTERS = ("letter", "single", "r", "v", "l", "e")
CLASS = {name: i for i, name in enumerate(CLASSES)}
END_CODE = 0x110000
BEFORE, EARLIER = 1, 2  # a boundary before this symbol, before the one in front of it
CHUNK, LANES = 256, 12
BATCH_CHARS = 500_000


def _class_table() -> np.ndarray:
    table = np.full(END_CODE + 1, CLASS["other"], np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, END_CODE))))
    for name, pattern in (("letter", r"\p{L}+"), ("number", r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            table[np.fromiter(map(ord, found[0]), np.int64, len(found[0]))] = CLASS[name]
    table[list(WHITE_SPACE)] = CLASS["space"]
    table[0x20], table[0x27], table[END_CODE] = CLASS["blank"], CLASS["quote"], CLASS["end"]
    for letters in (c[1:] for c in CONTRACTIONS):
        table[ord(letters[0])] = CLASS["single"] if len(letters) == 1 else CLASS[letters[0]]
    table[ord("e")] = CLASS["e"]
    return table


def _machine(kind: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Next state and emitted flags, both flat over (state, class), and the number of states.

    ``byte_level``: a blank joins the word after it, and of a longer run of white space the last
    character stands apart. ``word``: digits stand alone and white space is a pretoken to drop.
    """
    joined = kind == "byte_level"
    states = ["fresh", "letters", "numbers", "others", "blank1", "space1", "blanks", "spaces", "quote", "q_r", "q_v", "q_l"]
    at = {s: i for i, s in enumerate(states)}
    move = np.zeros((len(states), len(CLASSES)), np.uint8)
    flag = np.zeros_like(move)

    def opened(c: str) -> str:
        if c in LETTERS:
            return "letters"
        return {"number": "numbers" if joined else "fresh", "blank": "blank1", "space": "space1", "quote": "quote",
                "other": "others", "end": "fresh"}[c]

    def after_blank(c: str) -> str:
        return "others" if c in ("quote", "other") else opened(c)

    for s in states:
        for c in CLASSES:
            to, out = opened(c), BEFORE
            if s == "letters" and c in LETTERS or s == "numbers" and c == "number" or s == "others" and c in ("quote", "other"):
                to, out = s, 0
            elif s in ("blank1", "space1", "blanks", "spaces"):
                if c in ("blank", "space"):
                    to, out = ("blanks" if c == "blank" else "spaces"), 0
                elif joined and c != "end":
                    out = (EARLIER if s in ("blanks", "spaces") else 0) | (BEFORE if s in ("space1", "spaces") else 0)
                    to = after_blank(c) if s in ("blank1", "blanks") else opened(c)
            elif s == "quote":
                if c == "single":
                    to, out = "fresh", 0
                elif c in ("r", "v", "l"):
                    to, out = f"q_{c}", 0
                elif c in ("quote", "other"):
                    to, out = "others", 0
            elif s in ("q_r", "q_v", "q_l"):
                if c == ("l" if s == "q_l" else "e"):
                    to, out = "fresh", 0
                elif c in LETTERS:
                    to, out = "letters", EARLIER
                else:
                    out = EARLIER | BEFORE
            move[at[s], at_c := CLASS[c]], flag[at[s], at_c] = at[to], out
    return move.ravel(), flag.ravel(), len(states)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (chunks x states) in log2(chunks) rounds."""
    step = 1
    while step < len(maps):
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
        step *= 2
    return maps


class Lexer:
    """Boundaries of one pretoken pattern; the tables are built once per worker process."""

    _classes: np.ndarray | None = None

    def __init__(self, kind: str):
        if Lexer._classes is None:
            Lexer._classes = _class_table()
        self.move, self.flag, self.states = _machine(kind)

    def _run(self, rows: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Steps ``state`` (.., chunks) through ``rows`` (steps, chunks)."""
        width = np.uint8(len(CLASSES))
        for k in range(len(rows)):
            place = state * width + rows[k]
            if out is not None:
                np.take(self.flag, place, out=out[k])
            state = self.move[place]
        return state

    def state_maps(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, states) end state of each chunk for every start state.

        The machine forgets its start within a few symbols; only chunks whose lanes still differ
        after ``LANES`` symbols carry all of them to their end.
        """
        chunks = rows.shape[1]
        lanes = np.repeat(np.arange(self.states, dtype=np.uint8)[:, None], chunks, axis=1)
        lanes = self._run(rows[:LANES], lanes)
        same = (lanes == lanes[0]).all(axis=0)
        ends = np.empty_like(lanes)
        if same.any():
            ends[:, same] = self._run(rows[LANES:][:, same], lanes[0, same])
        if not same.all():
            ends[:, ~same] = self._run(rows[LANES:][:, ~same], lanes[:, ~same])
        return ends.T

    def cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, class of the first symbol) of the pretokens; each ``END_CODE`` is one of its own."""
        n = len(codes)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        classes = Lexer._classes[codes]
        padded = np.full(-(-n // CHUNK) * CHUNK, CLASS["end"], np.uint8)
        padded[:n] = classes
        rows = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
        start = np.zeros(rows.shape[1], np.uint8)
        start[1:] = compose_scan(self.state_maps(rows))[:-1, 0]
        flags = np.empty_like(rows)
        self._run(rows, start, flags)
        flat = flags.T.ravel()[:n]
        first = (flat & BEFORE).astype(bool)
        first[:-1] |= (flat[1:] & EARLIER).astype(bool)
        starts = np.flatnonzero(first)
        return starts, classes[starts]


# --- hashes of spans --------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1_200_000)
        for name, base in (("up", _ODD), ("down", _ODD_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``symbols[start:end]`` for each span: one running sum serves all spans."""
    up, down = _powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:len(symbols)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


# --- tokens of many texts ---------------------------------------------------------------------

class PretokenTable:
    """Results by pretoken hash, at most one per slot, so its memory has a fixed bound.

    ``resolve(word) -> ids`` is called for pretokens without a slot of their own; of those that
    want one slot the first keeps it.
    """

    def __init__(self, resolve: Callable[[str], Sequence[int]], slots: int = 1 << 20):
        self.resolve, self.mask = resolve, np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.at = np.zeros(slots, np.int64)
        self.size = np.full(slots, -1, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def lookup(self, hashes: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of pretoken i are ``ids[start[i]:start[i] + length[i]]``."""
        slot = (hashes & self.mask).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        missing = np.flatnonzero((self.keys[slot] != hashes) | (size < 0))
        if len(missing) == 0:
            return self.ids, at, size
        unique, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
        found = missing[first]
        pieces = [self.resolve(text[a:b]) for a, b in zip(starts[found].tolist(), ends[found].tolist())]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((i for p in pieces for i in p), np.uint32, int(lengths.sum()))
        where = np.cumsum(lengths) - lengths
        at[missing], size[missing] = len(self.ids) + where[back], lengths[back]
        ids = np.concatenate([self.ids, flat])
        want = (unique & self.mask).astype(np.int64)
        _, lead = np.unique(want, return_index=True)
        kept = lead[self.size[want[lead]] < 0]
        if len(kept):
            here = want[kept]
            self.keys[here], self.size[here] = unique[kept], lengths[kept]
            self.at[here] = len(self.ids) + np.cumsum(lengths[kept]) - lengths[kept]
            self.ids = np.concatenate([self.ids, flat[spread(where[kept], lengths[kept])]])
        return ids, at, size


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans ``start .. start + length``, span after span."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def batches_of(texts: Sequence[str], limit: int = BATCH_CHARS):
    """Runs of neighbouring texts of about ``limit`` characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def symbols_of(texts: Sequence[str], special: dict[str, int], end_id: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(one string over all texts, its code points, id of each separator, whether it closes a text).

    A separator (one character, ``END_CODE`` in the codes) closes each text with ``end_id`` (-1:
    no token) and stands for each special string inside a text with that string's id.
    """
    parts, ids, closing = [], [], []
    for text in texts:
        begin = 0
        for start, stop in special_spans(text, special):
            parts.append(text[begin:start])
            ids.append(special[text[start:stop]])
            closing.append(False)
            begin = stop
        parts.append(text[begin:])
        ids.append(end_id)
        closing.append(True)
    whole = "\0".join(parts) + "\0"
    codes = np.frombuffer(whole.encode("utf-32-le"), "<u4").copy()
    codes[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1] = END_CODE
    return whole, codes, np.array(ids, np.int64), np.array(closing, bool)


def special_spans(text: str, special: dict[str, int]) -> list[tuple[int, int]]:
    if not any(s in text for s in special):
        return []
    marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
    return [m.span() for m in marks.finditer(text)]


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: bytes that print stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
