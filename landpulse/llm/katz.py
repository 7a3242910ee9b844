"""Katz backoff scores of alert messages: Good-Turing discounted n-grams, by default three words long.

P(w | h) of a word after a history h is the discounted share of the n-gram where training text has it;
otherwise it is backoff(h) * P(w | h without its first word), down to the discounted share of the word and
what the words gave up for one that training text lacks. Backoff weights make every history's
probabilities sum to 1.

Words never leave as rows. Messages are dealt into batches, and one round an order goes through the
parts of that order's table: a batch sends its distinct n-grams, as packed arrays, to the parts that
their histories belong to; a part adds up the counts of all batches and answers with count and number of
each n-gram. Numbers of one order name the histories of the next, and its counts tell which histories
are long enough to be split. A batch sends at most one array for each distinct history that it holds, so
the arrays never outnumber the words. In the last order, n-grams of a history whose training places all lie
in one batch, and which no held-out text asks for, are counted in that batch and not sent. With all answers
a batch walks each token down the orders; weights of the histories that it backs off from are joined from
the stored table of backoff weights.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from landpulse.llm import storage
from landpulse.llm.lexing import mix64
from landpulse.llm.words import hashed_words

LIMIT = 5  # counts up to here are discounted
END = np.uint64(0x1D)  # no word hashes to this but by chance of 2**-64
START = 0  # the history of a message's first token; words are numbered from 1
BATCH_BYTES = 12 << 20
HOT = 400_000  # a history seen oftener in training is split by its next words
ORDER = 3
LEVEL = 5  # of compression


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Katz's factors for counts 1 .. LIMIT from the numbers of types seen 1 .. LIMIT + 1 times.

    Where Good-Turing gives no factor between 0 and 1 (small or odd tables), half a count is taken off.
    """
    n, k = [0, *counts_of_counts], LIMIT
    factors = []
    for r in range(1, k + 1):
        value = 0.0
        if n[1] and n[r] and (rest := 1.0 - (k + 1) * n[k + 1] / n[1]) > 0:
            value = ((r + 1) * n[r + 1] / (n[r] * r) - (k + 1) * n[k + 1] / n[1]) / rest
        factors.append(value if 0.0 < value < 1.0 else (r - 0.5) / r)
    return factors


def _pack(**arrays: np.ndarray) -> bytes:
    parts, head = [], []
    for name, a in arrays.items():
        if a.dtype.kind == "i" or a.dtype == np.uint64:
            top = int(a.max(initial=0))
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        head.append(f"{name}:{a.dtype.str}:{len(a)}")
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())  # high bytes together
    return zstandard.ZstdCompressor(level=LEVEL).compress(" ".join(head).encode() + b"\n" + b"".join(parts))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    line, at = data.index(b"\n"), data.index(b"\n") + 1
    out = {}
    for item in data[:line].decode().split():
        name, kind, n = item.split(":")
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, int(n) * wide, at).reshape(wide, int(n))
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(int(n))
        at += int(n) * wide
    return out


def _deal(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of one batch that are read together as one compressed stream."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
    for table in tables:
        number = table["batch"].to_numpy()
        order = np.argsort(number, kind="stable")
        rows = table.select([c for c in table.schema.names if c != "batch"])
        batches, begin = np.unique(number[order], return_index=True)
        blobs = []
        for a, b in zip(begin, [*begin[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
                stream.write_batch(rows.take(pa.array(order[a:b])))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.record_batch({"batch": pa.array(batches, pa.int32()), "blob": pa.array(blobs, pa.binary())})


class _Batch:
    """The tokens of one batch in a fixed order: messages by id and content."""

    def __init__(self, dealt: pa.Table):
        table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in dealt["blob"]]).combine_chunks()
        rank = pc.rank(table["alert_id"].chunk(0), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((table["digest"].to_numpy(), rank))
        table = table.take(pa.array(order))
        self.ids, self.held = table["alert_id"], table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        words, sizes = [], []
        for chunk in table["message_body"].chunks:
            for _, _, hashes, counts in hashed_words(chunk):
                words.append(hashes)
                sizes.append(counts)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.sizes = sizes + 1
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        ends = np.cumsum(self.sizes) - 1
        tokens = np.empty(len(self.doc), np.uint64)
        inner = np.ones(len(self.doc), bool)
        inner[ends] = False
        tokens[inner], tokens[ends] = flat, END
        coded = pa.array(tokens).dictionary_encode()
        words = coded.dictionary.to_numpy()
        order = np.argsort(words)
        self.words, rank = words[order], np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        self.number = rank[coded.indices.to_numpy()]
        self.held_places = self.held[self.doc]

    def parts(self, count: int) -> Iterator[tuple[int, np.ndarray]]:
        part = (mix64(self.words) % np.uint64(count)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for p in np.unique(part):
            yield int(p), order[slice(*np.searchsorted(part[order], [p, p + 1]))]


CLASSES = [f"n{r}" for r in range(1, LIMIT + 1)]  # types of a history seen r times
LOWER = [f"m{r}" for r in range(1, LIMIT + 1)]  # their counts one order down, where these are r
SENT = "part int, batch int, blob binary"
TOLD = "kind int, ord int, batch int, part int, blob binary"
SUMS = ["total", "above", "lower", "m_above", *CLASSES, "n6", *LOWER]
FOUND = "kind int, ord int, batch int, doc int, blob binary, history long, times long, sums array<long>"
ANSWER, HISTORY, COUNTS, DOCS, UNSEEN = range(5)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _ascending(*keys: np.ndarray) -> np.ndarray:
    """What np.lexsort gives for whole numbers from 0 on; places are sorted as the low bits of 64-bit values
    that hold as many keys as fit."""
    keys, n = list(keys), len(keys[0])
    place, order = n.bit_length(), None
    while keys:
        value, wide = np.arange(n, dtype=np.uint64), place
        while keys and wide + (bits := int(keys[0].max(initial=0)).bit_length()) <= 64:
            key = (keys[0] if order is None else keys[0][order]).astype(np.uint64)
            key <<= np.uint64(min(wide, 63))  # at 64 the key is 0
            value |= key
            wide += bits
            del keys[0], key
        if wide > place:
            value.sort()
            value &= np.uint64((1 << place) - 1)
            at = value.view(np.int64)
        elif keys:  # too wide a key
            at = np.argsort(keys[0] if order is None else keys[0][order], kind="stable")
            del keys[0]
        else:
            break
        order = at if order is None else order[at]
    return np.arange(n) if order is None else order


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int32) if a.max(initial=0) < 1 << 31 else a


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    size = max((len(c) for c in columns.values()), default=0)
    return pa.table({name: pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(size, kinds[kind])
                     for name, kind in (c.split() for c in schema.split(", "))})


def _sums(kind: int, order: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """Rows whose sums are listed as ``SUMS`` names them."""
    n = len(columns["total"])
    sums = np.zeros((n, len(SUMS)), np.int64)
    for c in set(SUMS) & set(columns):
        sums[:, SUMS.index(c)] = columns[c]
    listed = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, len(SUMS), dtype=np.int32), sums.reshape(-1))
    history = {"history": columns["history"].astype(np.int64)} if "history" in columns else {}
    return _table(FOUND, kind=np.full(n, kind), ord=np.full(n, order), sums=listed, **history)


def _counts_of_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    times = np.bincount(counts[counts <= LIMIT + 1].astype(np.int64), minlength=LIMIT + 2)
    return {f"n{r}": times[r:r + 1] for r in range(1, LIMIT + 2)}


def _summary(order: int, part: int, counts: np.ndarray) -> pa.Table:
    blob = _pack(total=np.array([counts.sum()], np.int64), above=np.array([len(counts)], np.int64), **_counts_of_counts(counts))
    return _table(TOLD, kind=[COUNTS], ord=[order], batch=[part], part=[part], blob=[blob])


class _Grams:
    """The n-grams of one order in a batch: distinct (history, word) sorted by part, history and word.

    Positions whose history training text lacks are not sent; where it lacks the n-gram one order down,
    the history goes with the word 0, as it may still be asked for its weight.

    ``wanted`` tells the n-grams one order down that some batch asks for, and counts one order down are sent
    for their followers only. With ``last``, n-grams of other histories that lie in this batch alone stay here.
    """

    def __init__(self, batch: _Batch, names: list[np.ndarray], counts: list[np.ndarray], parts: int, wanted: np.ndarray | None = None, last: bool = False):
        first = np.cumsum(batch.sizes) - batch.sizes
        self.history, self.seen = np.empty_like(names[-1]), np.empty_like(counts[-1])
        self.history[1:], self.seen[1:] = names[-1][:-1], counts[-1][:-1]
        self.history[first], self.seen[first] = START, counts[0][batch.sizes[0] - 1]  # as many starts as ends
        self.low, self.own, sent = counts[-1], None, self.seen > 0
        if wanted is not None:
            follows = np.ones(len(wanted), bool)
            follows[1:] = wanted[:-1]
            follows[first] = True
            self.low = np.where(follows, self.low, 0)
            if last:
                sent &= ~self._keep(np.flatnonzero(sent & ~follows), names[0])
        self.word = np.where(counts[-1] > 0, names[0], 0)
        at = np.flatnonzero(sent).astype(np.int32)
        h, w, hot = self.history[at], self.word[at], np.flatnonzero(self.seen[at] > HOT)
        spread = h.astype(np.uint64)
        salt = mix64(w[hot].astype(np.uint64)) % (self.seen[at[hot]] // HOT + 1).astype(np.uint64)
        spread[hot] += salt * GOLDEN
        part = ((mix64(spread) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        del spread, salt, hot
        order = _ascending(w, h, part)
        self.at, h, w, part = at[order], h[order], w[order], part[order]
        del order
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        self.gram, self.lead = np.cumsum(new, dtype=np.int32) - 1, self.at[new]
        part = part[new]
        self.begin = np.flatnonzero(np.diff(part, prepend=-1))
        self.present, self.end = part[self.begin], np.append(self.begin[1:], len(part))

    def _keep(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts the n-grams that stay in this batch and tells their positions; all of them are training text."""
        at = at[_ascending(self.history[at])]
        begin = np.flatnonzero(np.diff(self.history[at], prepend=-1))
        size = np.diff(begin, append=len(at))
        whole = np.repeat(self.seen[at[begin]] == size, size)
        once = np.repeat(size == 1, size)
        more = at[whole & ~once]
        _, gram = _distinct(self.history[more], words[more])
        at = np.concatenate([more, at[whole & once]]).astype(np.int32)
        times = np.bincount(gram)
        alone = np.ones(len(at) - len(more), np.int64)
        self.own = at, np.append(gram, len(times) + np.arange(len(alone))), np.append(times, alone)
        kept = np.zeros(len(self.seen), bool)
        kept[at] = True
        return kept

    def blobs(self, batch: _Batch, lower: np.ndarray, order: int) -> tuple[list[int], list[bytes]]:
        held = self.gram[batch.held_places[self.at]]
        by_held = np.bincount(held, minlength=len(self.lead))
        train, asks = np.bincount(self.gram, minlength=len(self.lead)) - by_held, by_held > 0
        out = []
        for a, b in zip(self.begin, self.end):
            lead = self.lead[a:b]
            at = np.flatnonzero(np.diff(self.history[lead], prepend=-1))  # in ascending order
            h, (w, w_at) = self.history[lead[at]], np.unique(self.word[lead], return_inverse=True)
            seen, low = self.seen[lead[at]], self.low[lead]
            if order == 2:  # the count of the word
                low = np.zeros(len(w), low.dtype)
                low[w_at] = self.low[lead]
            asked = np.add.reduceat(by_held[a:b], at) > 0
            out.append(_pack(histories=np.diff(h, prepend=0), grams=np.diff(at, append=len(lead)), split=np.where(seen > HOT, seen, 0),
                             asked=asks[a:b], lower=np.where(asked, lower[lead[at]], 0),
                             words=np.diff(w, prepend=0), w=w_at, low=low, train=train[a:b]))
        return self.present.tolist(), out

    def answers(self, told: dict, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (none in the last order) and count of the n-gram at every position, and whether some batch asks for it
        (not told in the last order)."""
        name = count = np.zeros(len(self.word), np.int32)
        wanted = np.zeros(len(self.word), bool)
        if len(self.lead):
            answers = [_unpack(told[p]) for p in self.present.tolist()]
            times = _narrow(np.concatenate([a["times"] for a in answers]).astype(np.int64))
            count = np.zeros(len(self.word), times.dtype)
            count[self.at] = times[self.gram]
            if "rank" in answers[0]:
                number = _narrow(np.concatenate([np.cumsum(a["rank"], dtype=np.int64) * parts + p + 1 for a, p in zip(answers, self.present)]))
                name = np.zeros(len(self.word), number.dtype)
                name[self.at] = number[self.gram]
                wanted[self.at] = np.concatenate([a["wanted"] for a in answers])[self.gram]
        if self.own is not None:
            at, gram, times = self.own
            if len(at):
                count = count.astype(np.promote_types(count.dtype, _narrow(times).dtype))
                count[at] = times[gram]
            self.own = times
        del self.at, self.gram, self.lead, self.word, self.low  # only histories are used any more
        return name, count, wanted


def _ask(parts: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        batch = _Batch(table)
        times = np.bincount(batch.number[~batch.held_places], minlength=len(batch.words))
        rows = [(p, _pack(words=np.diff(batch.words[at], prepend=np.uint64(0)), times=times[at])) for p, at in batch.parts(parts)]
        return _table(SENT, batch=[key[0].as_py()] * len(rows), part=[r[0] for r in rows], blob=[r[1] for r in rows])
    return ask


def _count_words(key: tuple, table: pa.Table) -> pa.Table:
    asked, part = [_unpack(b) for b in table["blob"].to_pylist()], key[0].as_py()
    sizes = [len(a["words"]) for a in asked]
    words, number = np.unique(np.concatenate([np.cumsum(a["words"], dtype=np.uint64) for a in asked]), return_inverse=True)
    total = np.bincount(number, np.concatenate([a["times"] for a in asked]), len(words)).astype(np.int64)
    cuts = np.cumsum(sizes)[:-1]  # a word's place in its part is its number there; asked words ascend
    answers = [_pack(times=t, rank=np.diff(n, prepend=0)) for t, n in zip(np.split(total[number], cuts), np.split(number, cuts))]
    n = len(answers)
    told = _table(TOLD, kind=[ANSWER] * n, ord=[1] * n, batch=table["batch"].to_pylist(), part=[part] * n, blob=answers)
    return pa.concat_tables([told, _summary(1, part, total[total > 0])])


def _answered(batch: _Batch, table: pa.Table, parts: int, orders: int, last: int):
    """Numbers of every position's word and longest n-gram, its counts of orders 1 .. ``orders``, the histories from order 2 on,
    and which of the longest n-grams some batch asks for."""
    told: dict = {}
    for kind, order, part, blob in zip(*(table[c].to_pylist() for c in ("kind", "ord", "part", "blob"))):
        if kind == ANSWER:
            told.setdefault(order, {})[part] = blob
    times, names = np.zeros(len(batch.words), np.int64), np.zeros(len(batch.words), np.int64)
    for p, at in batch.parts(parts):
        answer = _unpack(told[1][p])
        times[at], names[at] = answer["times"], np.cumsum(answer["rank"], dtype=np.int64) * parts + p + 1
    all_names, all_counts, grams, wanted = [_narrow(names)[batch.number]], [_narrow(times)[batch.number]], [], None
    del batch.number
    for order in range(2, orders + 1):
        grams.append(_Grams(batch, all_names, all_counts, parts, wanted, order == last))
        name, count, wanted = grams[-1].answers(told.get(order, {}), parts)
        all_names[1:] = [name]  # the words and the longest
        all_counts.append(count)
    return all_names, all_counts, grams, wanted


def _send(parts: int, order: int, last: int):
    def send(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _table(SENT, part=[])
        batch = _Batch(texts)
        names, counts, grams, wanted = _answered(batch, answers, parts, order - 1, last)
        lower = grams[-1].seen if grams else np.zeros(len(batch.doc), np.int64)
        part, blobs = _Grams(batch, names, counts, parts, wanted, order == last).blobs(batch, lower, order)
        return _table(SENT, part=part, batch=[key[0].as_py()] * len(part), blob=blobs)
    return send


def _distinct(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number) of each pair, numbered in ascending order of both."""
    order = _ascending(w, h)
    a, b = h[order], w[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _count_grams(order: int, last: bool):
    def count_grams(key: tuple, table: pa.Table) -> pa.Table:
        blobs, part = [_unpack(b) for b in table["blob"].to_pylist()], key[0].as_py()
        of_gram = lambda b, name: np.repeat(b[name].astype(np.int64), b["grams"].astype(np.int64))
        h = np.concatenate([np.repeat(np.cumsum(b["histories"], dtype=np.int64), b["grams"].astype(np.int64)) for b in blobs])
        w = np.concatenate([np.cumsum(b["words"], dtype=np.int64)[b["w"]] for b in blobs])
        first, number = _distinct(h, w)
        count = np.bincount(number, np.concatenate([b["train"] for b in blobs]), len(first)).astype(np.int64)
        cuts = np.cumsum([len(b["w"]) for b in blobs])[:-1]
        wanted = np.bincount(number, np.concatenate([b["asked"] for b in blobs]), len(first)) > 0
        answers = [_pack(times=count[n], **({} if last else {"rank": np.diff(n, prepend=0), "wanted": wanted[n]})) for n in np.split(number, cuts)]
        # sums of the histories that a batch may back off from; of split ones this part's share
        known, at = np.unique(h[first], return_inverse=True)
        held, below, used = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), np.zeros(len(known), bool)
        held[at] = np.concatenate([of_gram(b, "split") for b in blobs])[first]
        for b in blobs:  # a history's lower count comes from the batches that ask for it
            asked = np.add.reduceat(b["asked"].astype(np.int64), np.cumsum(b["grams"], dtype=np.int64) - b["grams"]) > 0
            mine = np.searchsorted(known, np.cumsum(b["histories"], dtype=np.int64)[asked])
            used[mine], below[mine] = True, b["lower"][asked]
        low = np.concatenate([b["low"][b["w"]] if order == 2 else b["low"] for b in blobs]).astype(np.int64)[first]
        have = count > 0
        add = lambda chosen, value: np.bincount(at[chosen], value[chosen], len(known)).astype(np.int64)
        ones = np.ones(len(count))
        sums = {"total": np.where(held > 0, held, add(have, count)), "above": add(count > LIMIT, count), "m_above": add(have & (low > LIMIT), low)}
        sums |= {c: add(count == r, ones) for r, c in enumerate(CLASSES, 1)}
        sums |= {c: add(have & (low == r), low) for r, c in enumerate(LOWER, 1)}
        used |= held > 0
        history = _pack(history=known[used], lower=below[used], **{c: v[used] for c, v in sums.items()})
        n = len(answers)
        told = _table(TOLD, kind=[ANSWER] * n + [HISTORY], ord=[order] * (n + 1), batch=[*table["batch"].to_pylist(), part], part=[part] * (n + 1),
                      blob=[*answers, history])
        return pa.concat_tables([told, _summary(order, part, count[have])])
    return count_grams


def _evaluate(parts: int, orders: int):
    """Every token down the orders to the first that training text has: per message, sums of logarithms
    without discounts, how often each discount applies, and the histories it backs off from."""
    def evaluate(key: tuple, texts: pa.Table, table: pa.Table) -> pa.Table:
        out, number = [], key[0].as_py()
        for kind, order, blob in zip(*(table[c].to_pylist() for c in ("kind", "ord", "blob"))):
            if kind != ANSWER:
                out.append(_sums(kind, order, _unpack(blob)))
        if not len(texts):
            return pa.concat_tables([*out, _table(FOUND, kind=[])])
        batch = _Batch(texts)
        _, counts, grams, _ = _answered(batch, table, parts, orders, orders)
        if (own := grams[-1].own) is not None and len(own):
            out.append(_sums(COUNTS, orders, {"total": own.sum(keepdims=True), "above": len(own) * np.ones(1, int), **_counts_of_counts(own)}))
        n = len(batch.sizes)
        open_, sums, rare = np.ones(len(batch.doc), bool), np.zeros(n), []
        for order in range(orders, 1, -1):
            count, gram = counts[order - 1], grams[order - 2]
            found = open_ & (count > 0)
            share = count[found] / (gram.seen[found] + (count[found] > LIMIT))
            sums += np.bincount(batch.doc[found], np.log10(share), n)
            rare += [np.bincount(batch.doc[found & (count == r)], minlength=n) for r in range(1, LIMIT + 1)]
            open_ &= ~found
            back = np.flatnonzero(open_ & (gram.seen > 0))
            if len(back):
                doc, h = batch.doc[back], gram.history[back]
                first, pair = _distinct(doc.astype(np.int64), h)
                out.append(_table(FOUND, kind=np.full(len(first), UNSEEN), ord=np.full(len(first), order), batch=np.full(len(first), number),
                                  doc=doc[first], history=h[first], times=np.bincount(pair)))
        left, doc = counts[0][open_], batch.doc[open_]
        sums += np.bincount(doc, np.log10(np.maximum(left, 1)), n)
        rare += [np.bincount(doc[left == r], minlength=n) for r in range(1, LIMIT + 1)]
        names = [json.dumps(i).encode() for i in batch.ids.to_pylist()]  # numbers or text
        documents = _pack(ids=np.frombuffer(b"".join(names), np.uint8), id_size=np.array([len(i) for i in names], np.int64), held=batch.held,
                          size=batch.sizes, known=np.bincount(batch.doc, counts[0] > 0, n).astype(np.int64),
                          base=np.bincount(batch.doc, np.log10(counts[0] + 0.1), n), sums=sums,
                          words=np.bincount(doc, minlength=n), unknown=np.bincount(doc[left == 0], minlength=n), rare=np.concatenate(rare))
        return pa.concat_tables([*out, _table(FOUND, kind=[DOCS], batch=[number], blob=[documents])])
    return evaluate


SCORED = "batch int, doc int, alert_id {}, held_out boolean, n_tokens long, n_known long, base double, score double"


def _documents(id_kind: pa.DataType, rare: np.ndarray, whole: float, unknown: float):
    """Rows of the messages, their sums completed by the logarithms of discounts, of the words' total and of
    the share of unknown words."""
    def documents(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for batch, blob in zip(table["batch"].to_pylist(), table["blob"].to_pylist()):
                told = _unpack(blob)
                n = len(told["size"])
                ends, letters = np.cumsum(told["id_size"].astype(np.int64)).tolist(), told["ids"].tobytes()
                ids = [json.loads(letters[a:b]) for a, b in zip([0, *ends], ends)]
                score = told["sums"] + rare @ told["rare"].reshape(len(rare), n).astype(float) - told["words"] * whole + told["unknown"] * unknown
                yield pa.record_batch({
                    "batch": pa.array(np.full(n, batch), pa.int32()), "doc": pa.array(np.arange(n), pa.int32()), "alert_id": pa.array(ids, id_kind),
                    "held_out": pa.array(told["held"]), "n_tokens": pa.array(told["size"].astype(np.int64)),
                    "n_known": pa.array(told["known"].astype(np.int64)), "base": pa.array(told["base"]), "score": pa.array(score)})
    return documents


def backoff_weights(found: DataFrame, factors: dict[int, list[float]], total: int, given_up: float) -> DataFrame:
    """(ord, history, log_backoff) from the sums of each history, of split ones from all their parts.

    ``found`` has kind, ord, history and a column for each of ``SUMS``; ``factors`` are the discounts by order; ``total`` and ``given_up`` are the training tokens and what
    words gave up for unknown ones. What a history's n-grams gave up is divided by the share, one
    order down, of the words that do not follow it.
    """
    def weighted(columns: list[str], by: list[float]) -> Column:
        return sum((F.col(c) * F.lit(f) for c, f in zip(columns, by)), F.lit(0.0))

    out = None
    for order in sorted(o for o in factors if o > 1):
        left = weighted(CLASSES, [(1.0 - d) * r for r, d in enumerate(factors[order], 1)]) / F.col("total")
        left = left + F.col("above") / (F.col("total") * (F.col("total") + 1.0))
        if order > 2:
            mass = weighted(LOWER, factors[order - 1]) / F.col("lower") + F.col("m_above") / (F.col("lower") + 1.0)
        elif given_up > 0:
            mass = (weighted(LOWER, factors[1]) + F.col("m_above")) / F.lit(float(total))
        else:
            mass = (weighted(LOWER, [1.0] * LIMIT) + F.col("m_above")) / F.lit(total + 1.0)
        rows = found.where((F.col("kind") == HISTORY) & (F.col("ord") == order)).groupBy("history").agg(
            F.max("total").alias("total"), F.max("lower").alias("lower"),
            *[F.sum(c).alias(c) for c in ["above", "m_above", *CLASSES, *LOWER]])
        if order > 2:
            rows = rows.where("lower > 0")  # split ones that nobody asks for come without it
        rows = rows.select(F.lit(order).alias("ord"), "history", F.log10(left / F.greatest(1.0 - mass, F.lit(1e-12))).alias("log_backoff"))
        out = rows if out is None else out.unionByName(rows)
    return out


def katz_scores(alerts: DataFrame, held_out: Column, id_column: str = "alert_id", message: str = "message_body", order: int = ORDER) -> DataFrame:
    """log10 probability of every message by an n-gram model of the messages not held out:
    (alert_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the lower-cased (A-Z) words of a message and one end; n-grams of up to ``order`` (2 or more) words
    begin with as many starts as needed. ``n_known`` counts tokens the training text has; ``base_score`` is
    the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))) with c a token's training count, N all training tokens and V
    the distinct ones. In ``score``, counts up to 5 are discounted by Good-Turing, order by order; a larger
    count r in a history seen c times keeps r / (c + 1), so that every history leaves something to back off
    with. All words outside the training text share one probability, as they do in the base.

    NULL messages are empty (one token, the end). A NULL ``held_out`` counts as training text. Rows with NULL or repeated ids are
    scored one by one; a very long message is scored whole; without training text every known count is 0 and ``score`` is NULL;
    other columns are ignored; an empty table stays empty. Histories seen in more than ``HOT`` training places are
    split by the next word over several parts.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    text = F.coalesce(F.col(message), F.lit(""))
    rows = alerts.select(F.col(id_column).alias("alert_id"), text.alias("message_body"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                         F.xxhash64(text).alias("digest"))
    id_type = rows.schema["alert_id"].dataType
    size = rows.agg(F.sum(F.octet_length("message_body"))).first()[0] or 0
    parts = int(size // BATCH_BYTES) + 1
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("alert_id", "digest"), F.lit(parts)).cast("int")).mapInArrow(_deal, "batch int, blob binary")
    # one plan, so that the dealt messages and every order's answers are made and shuffled once for all of their uses: a union of
    # tables dealt alike by batch keeps that deal
    told = storage.dealt(dealt.groupBy("batch").applyInArrow(_ask(parts), SENT).groupBy("part").applyInArrow(_count_words, TOLD), "batch")
    for k in range(2, order + 1):
        sent = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_send(parts, k, order), SENT)
        told = told.unionByName(storage.dealt(sent.groupBy("part").applyInArrow(_count_grams(k, k == order), TOLD), "batch"))
    found = storage.stored(dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_evaluate(parts, order), FOUND), "n-gram-sums")
    names = [*CLASSES, "n6"]
    sums = found.select("kind", "ord", "history", *[F.get("sums", F.lit(i)).alias(c) for i, c in enumerate(SUMS)])
    seen = {r["ord"]: r for r in sums.where(F.col("kind") == COUNTS).groupBy("ord").agg(
        *[F.sum(c).alias(c) for c in [*names, "total", "above"]]).collect()}  # a row an order
    total, vocabulary = (int(seen[1]["total"]), int(seen[1]["above"])) if 1 in seen else (0, 0)
    kinds = {k: [int(seen[k][c]) if k in seen else 0 for c in names] for k in range(1, order + 1)}
    factors = {k: discounts(kinds[k]) for k in kinds}
    given_up = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(factors[1], kinds[1]), 1))
    words = factors[1] if given_up > 0 else [1.0] * LIMIT  # without rare words one more count stands for the unknown ones
    rare = np.log10(np.concatenate([*(factors[k] for k in range(order, 1, -1)), words]))
    whole = math.log10(max(1.0, total if given_up > 0 else total + 1.0))
    told_docs = found.where(F.col("kind") == DOCS).select("batch", "blob").mapInArrow(
        _documents(to_arrow_type(id_type), rare, whole, math.log10(given_up) if given_up > 0 else 0.0), SCORED.format(id_type.simpleString()))
    backoff = storage.stored(backoff_weights(sums, factors, total, given_up), "backoff")
    unseen = (found.where(F.col("kind") == UNSEEN).select("batch", "doc", "ord", "history", "times").join(backoff, ["ord", "history"])
              .groupBy("batch", "doc").agg(F.sum(F.col("times") * F.col("log_backoff")).alias("unseen")))
    score = F.col("score") + F.coalesce("unseen", F.lit(0.0))
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + 0.1 * (vocabulary + 1)))
    return told_docs.join(unseen, ["batch", "doc"], "left").select(
        "alert_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (score if total else F.lit(None).cast("double")).alias("score"))
