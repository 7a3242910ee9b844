"""Token ids of texts in Arrow batches, as the public tokenizer files give them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from landpulse.llm import lexing


def public_path(name: str) -> str:
    """Place of a vocabulary file that comes with the ``public_tokenizers`` package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PretokenEncoder:
    """Encodes texts pretoken by pretoken with the ``tokenizers`` library's model of one file.

    The merges of a pretoken depend on nothing around it, so the library merges a distinct
    pretoken once and later ones are looked up. ``kind`` names the file's pretoken pattern (see
    ``lexing``); texts for ``word`` files are lower-cased and brought to NFC as those files ask,
    except their special strings, which are matched as they stand.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.kind = kind
        self.special = lexing.special_tokens(path)
        self.model = Tokenizer.from_file(path).model
        self.lexer = lexing.Lexer(kind)
        self.letters = lexing.byte_letters()
        self.table = lexing.PretokenTable(self._merge)

    def _merge(self, word: str) -> list[int]:
        if self.kind == "word" and ord(word[0]) in lexing.WHITE_SPACE:
            return []
        letters = self.letters
        return [t.id for t in self.model.tokenize("".join([letters[b] for b in word.encode()]))]

    def _normalised(self, text: str) -> str:
        if self.kind != "word":
            return text

        def plain(part: str) -> str:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # sign by sign: no final sigma
            return part.lower()

        begin, parts = 0, []
        for start, stop in lexing.special_spans(text, self.special):
            parts += [plain(text[begin:start]), text[start:stop]]
            begin = stop
        return "".join([*parts, plain(text[begin:])])

    def encode(self, texts: Sequence[str], end_id: int = -1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, past the last, all their ids, number of ids per text), run after run.

        ``end_id`` is appended to each text; -1 appends nothing.
        """
        for begin, stop in lexing.batches_of(texts):
            part = [self._normalised(t) for t in texts[begin:stop]]
            whole, codes, mark_ids, closing = lexing.symbols_of(part, self.special, end_id)
            starts, classes = self.lexer.cut(codes)
            ends = np.append(starts[1:], len(codes))
            ids, at, size = self.table.lookup(lexing.span_hashes(codes, starts, ends), whole, starts, ends)
            marks = np.flatnonzero(classes == lexing.CLASS["end"])
            size[marks], at[marks] = mark_ids >= 0, len(ids) + np.arange(len(marks))
            flat = np.concatenate([ids, np.maximum(mark_ids, 0).astype(np.uint32)])[lexing.spread(at, size)]
            yield begin, stop, flat, np.diff(np.cumsum(size)[marks[closing]], prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> PretokenEncoder:
    """One encoder per worker process and file, so that its table serves all batches."""
    return PretokenEncoder(path, kind)
