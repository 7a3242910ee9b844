"""Token counts of alert messages by a compiled finite-state tokenizer.

Two deterministic transducers in a row. The lexer (``lexing``) cuts the text into pretokens; its
chunk state maps compose through a parallel prefix scan, so long messages are cut in parallel. The
merge transducer reads a pretoken byte by byte; each transition carries the change of the token
count, so a pretoken's count is a sum along its path, without building its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landpulse.llm import lexing


class MergeTransducer:
    """Byte-pair merges of one vocabulary as a transducer with counts on its transitions.

    After each byte the tokens of the prefix end in one last token, and a token may follow another
    only if merging the two alone leaves both as they are. A state therefore holds, for every
    earlier place from which a longer token can still reach beyond the current byte: the trie node
    reached from there, the last token at that place, and its count relative to the present one.
    States are compiled when first reached and dropped together beyond ``max_states``, so the
    memory is bounded; counts do not depend on it.
    """

    START, ROOT = -1, 0

    def __init__(self, path: str, max_states: int = 150_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.letters, self.max_states = lexing.byte_letters(), max_states
        bytes_of = {letter: b for b, letter in self.letters.items()}
        special = lexing.special_tokens(path)
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [self.START]
        self.spelling: dict[int, str] = {}
        for word, number in Tokenizer.from_file(path).get_vocab(with_added_tokens=False).items():
            if word in special:
                continue
            node = self.ROOT
            for letter in word:
                node = self.children[node].setdefault(bytes_of[letter], len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(self.START)
            self.token[node] = number
            self.spelling[number] = word
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        first = ((self.ROOT, self.START, 0),)
        self.states, self.numbers, self.moves = [first], {first: 0}, {}

    def _follows(self, left: int, right: int) -> bool:
        """Whether ``right`` stays a token of its own behind ``left``."""
        if left == self.START:
            return True
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 8 * self.max_states:
                self.pairs.clear()
            merged = self.model.tokenize(self.spelling[left] + self.spelling[right])
            known = self.pairs[key] = [t.id for t in merged] == [left, right]
        return known

    def _compile(self, state: int, byte: int) -> int:
        """Adds the transition: next state and count change (+128) in one number."""
        reached = [(node, left, ahead) for at, left, ahead in self.states[state]
                   if (node := self.children[at].get(byte)) is not None]
        last, change = next((self.token[node], ahead + 1) for node, left, ahead in reached
                            if self.token[node] != self.START and self._follows(left, self.token[node]))
        after = (*((node, left, ahead - change) for node, left, ahead in reached if self.children[node]), (self.ROOT, last, 0))
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
        move = self.moves[state << 8 | byte] = number << 8 | change + 128
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > self.max_states:
            self._clear()
        state, total, moves = 0, -128 * len(word), self.moves
        for byte in word:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
            state = move >> 8
            total += move & 255
        return total


class MessageCounter:
    """Counts of many texts: lexer, then the merge transducer for pretokens not counted before."""

    def __init__(self, path: str, slots: int = 1 << 20):
        self.lexer, self.merges = lexing.Lexer("byte_level"), MergeTransducer(path)
        self.special = lexing.special_tokens(path)
        self.mask = np.uint64(slots - 1)
        self.keys, self.counts = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def _pretokens(self, hashes: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slot = (hashes & self.mask).astype(np.int64)
        counts = np.where(self.keys[slot] == hashes, self.counts[slot], 0).astype(np.int64)
        missing = np.flatnonzero(counts == 0)
        if len(missing):
            unique, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            found = missing[first]
            fresh = np.fromiter((self.merges.count(text[a:b].encode()) for a, b in zip(starts[found].tolist(), ends[found].tolist())),
                                np.int64, len(found))
            counts[missing] = fresh[back]
            free = self.counts[place := (unique & self.mask).astype(np.int64)] == 0
            self.keys[place[free]], self.counts[place[free]] = unique[free], fresh[free]
        return counts

    def count(self, texts: list[str]) -> np.ndarray:
        parts = []
        for begin, stop in lexing.batches_of(texts):
            whole, codes, mark_ids, closing = lexing.symbols_of(texts[begin:stop], self.special, -1)
            starts, classes = self.lexer.cut(codes)
            ends = np.append(starts[1:], len(codes))
            marks = np.flatnonzero(classes == lexing.CLASS["end"])
            words = np.ones(len(starts), bool)
            words[marks] = False
            counts = np.zeros(len(starts), np.int64)
            hashes = lexing.span_hashes(codes, starts, ends)
            counts[words] = self._pretokens(hashes[words], whole, starts[words], ends[words])
            counts[marks] = mark_ids >= 0
            parts.append(np.diff(np.cumsum(counts)[marks[closing]], prepend=0))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> MessageCounter:
    """One compiled tokenizer per worker process."""
    return MessageCounter(path)


def count_message_tokens(alerts: DataFrame, path: str, limit: int = 512, id_column: str = "alert_id",
                         message: str = "message_body") -> DataFrame:
    """(alert_id, n_bytes, n_tokens, over_limit) of every alert, counted over its whole message.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library; special strings inside a
    message count as one token each, nothing is added. A NULL message counts as empty (0 bytes, 0
    tokens); NULL and repeated ids are kept row by row; other columns are ignored.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter(path).count(texts), pa.int64())],
                                             ["alert_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(message), F.lit(""))
    rows = alerts.select(F.col(id_column).alias("alert_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("message_body"))
    kind = rows.schema["alert_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"alert_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
