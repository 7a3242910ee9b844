"""Passages that alert messages repeat, byte for byte, found by sorting suffixes.

A window is a string of ``length`` bytes. Among the 24-byte grams of a window the one with the
smallest hash is its anchor, so equal windows have equal anchors at equal places, and neighbouring
windows share theirs. Only suffixes that begin at an anchor travel, one for about 39 bytes, and first
only as tokens: the hash of the anchor's gram and the hash of all bytes of the windows that it stands
for. Splitters sampled from the suffixes cut their order into buckets, in which a multikey quicksort
finds equal ones. Where one gram stands in different surroundings the bytes are fetched, and all
suffixes that begin at one of its windows are sorted in the same way, eight bytes at a time. A group
that a splitter cuts hands its smallest members on, which are then compared across buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.llm import storage
from landpulse.llm.interning import _lanes
from landpulse.llm.lexing import mix64, spread
from landpulse.llm.words import runs, text_bytes

GRAM = 24
LENGTH = 100
PIECE_BYTES = 1_000_000
BUCKET_ROWS = 100_000
MOST_SPLITTERS = 1 << 18  # sent to every task, 24 bytes each; beyond, buckets grow with the table
PERIODS = range(1, 9)
REPEAT, CANDIDATE, OPEN = 0, 1, 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


# --- anchors ------------------------------------------------------------------------------------

def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def short_periods(data: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each byte equals the one 1 to 8 bytes before it."""
    count = len(data) - length + 1
    found = np.zeros(max(count, 0), bool)
    for period in PERIODS:
        same = data[period:] == data[:-period]
        if len(same) < length:
            break
        whole = same[:len(same) // 8 * 8].view("<u8") == np.uint64(0x0101010101010101)
        if np.count_nonzero(whole) < length // 8 - 1:
            continue
        running = np.concatenate([[0], np.cumsum(same)])
        found[period:] |= running[length:] - running[:-length] == length
    return found


def piece_anchors(data: np.ndarray, cuts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(message, first window, anchor, windows, gram hash, hash of the bytes of all its windows) of the
    anchors in ``data``, messages ``data[cuts[i]:cuts[i + 1]]`` side by side."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    wide, grams = _lanes(np.concatenate([data, np.zeros(8, np.uint8)]), "<u8"), n - GRAM + 1
    with np.errstate(over="ignore"):
        value = mix64(wide[:grams] + _OTHER)
        for at in range(8, GRAM, 8):
            value = mix64(value * _ODD + wide[at:at + grams])
    bits = np.uint64((1 << n.bit_length()) - 1)
    lowest = window_minimum((value & ~bits) | np.arange(grams, dtype=np.uint64), length - GRAM + 1)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[:len(lowest)]
    spots = np.arange(len(lowest))
    valid = cuts[owner + 1] >= spots + length
    again = short_periods(data, length)
    if again.any():  # a window like the one a few bytes before it in the same message needs no other proof
        valid &= ~(again & (cuts[owner] <= spots - max(PERIODS)))
    first = spots[valid]
    if len(first) == 0:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = (lowest[valid] & bits).astype(np.int64)
    breaks = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(first) != 1)) + 1
    heads, tails = np.append(0, breaks), np.append(breaks, len(first)) - 1
    low, high, anchor = first[heads], first[tails], anchor[heads]
    with np.errstate(over="ignore"):
        near = mix64((anchor - low).astype(np.uint64) * _OTHER + (high - low).astype(np.uint64))
        for step in range(0, 2 * length - GRAM, GRAM):
            near = mix64(near * _ODD + value[np.minimum(low + step, high + length - GRAM)])
    return owner[low], low, anchor, high - low + 1, value[anchor], near


def message_anchors(column: pa.Array, length: int, piece_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, spot, gram, near) of the anchors of a string column, piece after piece.

    ``spot`` holds the anchor's byte in its message, how many bytes before it its first window begins
    and the number of windows. A message longer than two pieces is cut into overlapping ones; each
    window lies in one piece, and windows that a cut parts from their anchor's others are told apart
    by their bytes later.
    """
    data, offsets = text_bytes(column)
    for begin, end in runs(offsets, piece_bytes):
        size = int(offsets[end] - offsets[begin])
        step = size if size <= 2 * piece_bytes else piece_bytes
        for at in range(0, size, max(step, 1)):
            part = data[offsets[begin] + at:offsets[begin] + min(size, at + step + length - 1)]
            cuts = offsets[begin:end + 1] - offsets[begin] if step == size else np.array([0, len(part)])
            owner, low, anchor, windows, gram, near = piece_anchors(part, cuts, length)
            place = anchor - cuts[owner] + at
            yield begin + owner, place << 24 | (anchor - low) << 12 | windows - 1, gram, near


def spot_parts(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's byte, first window's byte, number of windows)."""
    return spot >> 24, (spot >> 24) - (spot >> 12 & 0xFFF), (spot & 0xFFF) + 1


# --- sorting ------------------------------------------------------------------------------------

def multikey_quicksort(count: int, symbol: Callable[[int, np.ndarray], np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``count`` strings by ``depth`` symbols, and whether each equals the one before it.

    Numpy's quicksort orders all by the first symbol; only runs that agree in it go on to the next
    symbol, and of these only runs not in order already are sorted again.
    """
    order = np.argsort(symbol(0, np.arange(count)), kind="quicksort")
    tied = np.zeros(count, bool)
    if count:
        first = symbol(0, order)
        tied[1:] = first[1:] == first[:-1]
    for k in range(1, depth):
        at = np.flatnonzero(tied | np.append(tied[1:], False))
        if len(at) == 0:
            break
        inside = tied[at]
        group = np.cumsum(~inside)
        value = symbol(k, order[at])
        falls = np.flatnonzero((value[1:] < value[:-1]) & inside[1:]) + 1
        if len(falls):
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[falls]] = True
            some = np.flatnonzero(mixed[group])
            inner = some[np.lexsort((value[some], group[some]))]
            order[at[some]], value[some] = order[at[inner]], value[inner]
        tied[at[1:]] = inside[1:] & (value[1:] == value[:-1])
    return order, tied


def splitter_keys(*tokens: np.ndarray) -> np.ndarray:
    """Tokens of each row as one byte string that sorts like them."""
    return np.ascontiguousarray(np.column_stack(tokens).astype(">u8")).view(f"S{8 * len(tokens)}").ravel()


def pick_splitters(sample: np.ndarray, buckets: int) -> np.ndarray:
    if len(sample) == 0 or buckets < 2:
        return sample[:0]
    return np.unique(np.sort(sample)[np.arange(1, buckets) * len(sample) // buckets])


def leading_tokens(splitters: np.ndarray, tokens: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(8 * tokens, b"\0") for s in splitters.tolist()), ">u8").reshape(-1, tokens)[:, 0].astype(np.uint64)


def bucket_of(splitters: np.ndarray, lead: np.ndarray, *tokens: np.ndarray) -> np.ndarray:
    """Number of the splitters at or before each row; most rows are placed by their first token."""
    low, high = np.searchsorted(lead, tokens[0], side="left"), np.searchsorted(lead, tokens[0], side="right")
    cut = np.flatnonzero(low != high)
    if len(cut):
        low[cut] = np.searchsorted(splitters, splitter_keys(*(t[cut] for t in tokens)), side="right")
    return low


def is_cut(lead: np.ndarray, bucket: int, gram: np.ndarray) -> np.ndarray:
    """Whether a splitter at either end of the bucket has this first token."""
    ends = lead[max(bucket - 1, 0):bucket + 1] if bucket else lead[:1]
    return np.isin(gram, ends)


def record_rank(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Place of each row's record in the order of records; equal for rows of one record."""
    ranks = [pc.rank(table.column(k).combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) for k in keys]
    return ranks[0] if len(ranks) == 1 else ranks[0] * (table.num_rows + 1) + ranks[1]


# --- the two sorts as Spark steps ---------------------------------------------------------------

def _field(name: str, kind: T.DataType | None = None) -> T.StructField:
    return T.StructField(name, kind or T.LongType())


class _Keys:
    """Columns that name a record: the id, and a hash of the message where ids repeat."""

    def __init__(self, rows: DataFrame):
        self.names = [c for c in ("alert_id", "tie") if c in rows.columns]
        self.fields = [rows.schema[c] for c in self.names]

    def order(self) -> list[Column]:
        return [F.asc_nulls_first(c) for c in self.names]

    def join(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        named = right.withColumnsRenamed({k: f"_{k}" for k in self.names})
        on = left[self.names[0]].eqNullSafe(named[f"_{self.names[0]}"])
        for k in self.names[1:]:
            on = on & left[k].eqNullSafe(named[f"_{k}"])
        return left.join(named, on, how).drop(*(f"_{k}" for k in self.names))


def _as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def anchor_suffixes(rows: DataFrame, keys: _Keys, splitters: np.ndarray, length: int, piece_bytes: int) -> DataFrame:
    """(bucket, gram, near, salt, spot, keys) of every anchor; ``salt`` spreads equal tokens."""
    lead = leading_tokens(splitters, 3)
    schema = T.StructType([_field("bucket", T.IntegerType()), *map(_field, ("gram", "near", "salt", "spot")), *keys.fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = batch.column(1).to_numpy().view(np.uint64)
            for row, spot, gram, near in message_anchors(batch.column(0), length, piece_bytes):
                salt = mix64(seed[row] + spot.astype(np.uint64) * _ODD)
                bucket = bucket_of(splitters, lead, gram, near, salt)
                named = [batch.column(2 + i).take(pa.array(row)) for i in range(len(keys.names))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *map(_as_long, (gram, near, salt, spot)), *named], schema.names)

    return rows.select("message_body", F.xxhash64(*keys.names), *keys.names).mapInArrow(find, schema)


def compare_tokens(suffixes: DataFrame, keys: _Keys, splitters: np.ndarray) -> DataFrame:
    """(kind, gram, near, spot, keys) from one sort per bucket.

    ``REPEAT``: an earlier suffix has the same tokens, so all its windows are repeated. ``CANDIDATE``:
    the first of several different surroundings of one gram. ``OPEN``: the first in its bucket of a
    group that goes on in other buckets.
    """
    lead = leading_tokens(splitters, 3)
    schema = T.StructType([_field("kind", T.IntegerType()), *map(_field, ("gram", "near", "spot")), *keys.fields])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        gram, near, spot = (table.column(c).to_numpy().copy() for c in ("gram", "near", "spot"))
        gram = gram.view(np.uint64)
        symbols = (gram, near, record_rank(table, keys.names), spot)
        order, _ = multikey_quicksort(len(gram), lambda k, at: symbols[k][at], 4)
        gram, near = gram[order], near[order]
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new_class = new_gram | np.append(True, near[1:] != near[:-1])
        group = np.cumsum(new_gram) - 1
        several = np.bincount(group, new_class)[group] > 1
        kind = np.where(~new_class, REPEAT, np.where(is_cut(lead, key[0].as_py(), gram), OPEN, np.where(several, CANDIDATE, -1)))
        kept = np.flatnonzero(kind >= 0)
        rest = table.select(["gram", "near", "spot", *keys.names]).take(pa.array(order[kept]))
        return pa.table([pa.array(kind[kept], pa.int32()), *rest.columns], schema.names)

    return suffixes.select("bucket", "gram", "near", "spot", *keys.names).groupBy("bucket").applyInArrow(compare, schema)


def candidate_suffixes(marked: DataFrame, keys: _Keys, splitters: np.ndarray, length: int) -> DataFrame:
    """(bucket, gram, salt, spot, context, keys): the bytes of all windows of each marked anchor."""
    lead = leading_tokens(splitters, 2)
    schema = T.StructType([_field("bucket", T.IntegerType()), *map(_field, ("gram", "salt", "spot")), _field("context", T.BinaryType()), *keys.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            marks = batch.column(1)
            counts = np.diff(marks.offsets.to_numpy())
            flat = marks.flatten()
            gram, salt, spot = (flat.field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), counts)
            _, low, windows = spot_parts(spot)
            begins, sizes = offsets[row] + low, windows + length - 1
            for part in np.array_split(np.arange(len(row)), max(1, int(sizes.sum()) // 8_000_000)):
                ends = np.concatenate([[0], np.cumsum(sizes[part])]).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(data[spread(begins[part], sizes[part])])])
                named = [batch.column(2 + i).take(pa.array(row[part])) for i in range(len(keys.names))]
                bucket = bucket_of(splitters, lead, gram[part].view(np.uint64), salt[part].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(_as_long(x[part]) for x in (gram, salt, spot)), context, *named], schema.names)

    return marked.select("message_body", "marks", *keys.names).mapInArrow(cut, schema)


def compare_bytes(suffixes: DataFrame, keys: _Keys, splitters: np.ndarray, length: int) -> DataFrame:
    """(kind, low, high, begin, end, keys) from one sort per bucket of all windows of the candidates.

    ``REPEAT``: bytes ``begin`` .. ``end - 1`` lie in windows that occur earlier. ``OPEN``: the first
    window in its bucket of a group that goes on in other buckets, with 128 bits of hash of its bytes.
    """
    lead = leading_tokens(splitters, 2)
    schema = T.StructType([_field("kind", T.IntegerType()), *map(_field, ("low", "high", "begin", "end")), *keys.fields])
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        gram, spot = (table.column(c).to_numpy().copy() for c in ("gram", "spot"))
        gram = gram.view(np.uint64)
        context = table.column("context").combine_chunks()
        anchor, low, windows = spot_parts(spot)
        row = np.repeat(np.arange(len(spot)), windows)
        place = spread(low, windows)  # of each window in its message
        starts = np.frombuffer(context.buffers()[1], np.int32)[context.offset:context.offset + len(spot)].astype(np.int64)
        byte = spread(starts, windows)
        wide = _lanes(np.frombuffer(context.buffers()[2], np.uint8), "<u8")
        with np.errstate(over="ignore"):
            lead_token = gram[row] + (anchor[row] - place).astype(np.uint64) * _ODD

        def symbol(k: int, at: np.ndarray) -> np.ndarray:
            return lead_token[at] if k == 0 else wide[byte[at] + steps[k - 1]].byteswap()

        order, tied = multikey_quicksort(len(row), symbol, len(steps) + 1)
        group = np.empty(len(row), np.int64)
        group[order] = np.cumsum(~tied)
        record = record_rank(table, keys.names)[row]
        held = np.sort(order[tied | np.append(tied[1:], False)]) if len(order) else order
        held = held[np.lexsort((place[held], record[held], group[held]))]
        repeated = np.zeros(len(row), bool)
        repeated[held[1:]] = group[held[1:]] == group[held[:-1]]
        at = np.flatnonzero(repeated)
        heads = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(row[at]) != 0))) if len(at) else at
        tails = np.append(heads[1:], len(at)) - 1 if len(at) else at
        first, last = at[heads], at[tails]
        opened = np.flatnonzero(~repeated & is_cut(lead, key[0].as_py(), gram)[row])
        sums = []
        with np.errstate(over="ignore"):
            for odd in (_ODD, _OTHER):
                total = np.full(len(opened), odd)
                for step in steps:
                    total = mix64(total * odd + wide[byte[opened] + step])
                sums.append(total)
        rows = np.concatenate([row[first], row[opened]])
        kind = np.repeat([REPEAT, OPEN], [len(first), len(opened)])
        begin, end = np.concatenate([place[first], place[opened]]), np.concatenate([place[last], place[opened]]) + length
        low_hash = np.concatenate([mix64(lead_token[first] + first.astype(np.uint64)), sums[0]])
        high_hash = np.concatenate([np.zeros(len(first), np.uint64), sums[1]])
        named = [table.column(k).take(pa.array(rows)) for k in keys.names]
        return pa.table([pa.array(kind, pa.int32()), *map(_as_long, (low_hash, high_hash, begin, end)), *named], schema.names)

    return suffixes.select("bucket", "gram", "spot", "context", *keys.names).groupBy("bucket").applyInArrow(compare, schema)


def cut_repeats(marked: DataFrame, keys: _Keys, length: int) -> DataFrame:
    """(keys, n_bytes, spans, kept_body, copies) of every message with the spans found in it."""
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*keys.fields, _field("n_bytes"), _field("spans", span), _field("kept_body", T.BinaryType()), _field("copies")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            spans, counts, kept = [], [], []
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).flatten()
            begin_at, end_at = (flat.field(i).to_numpy() for i in range(2))
            base = int(ends[0])
            for i in range(batch.num_rows):
                body = data[offsets[i]:offsets[i + 1]]
                again = np.flatnonzero(short_periods(body, length))
                part = slice(int(ends[i]) - base, int(ends[i + 1]) - base)
                edges = np.zeros(len(body) + 1, np.int64)
                np.add.at(edges, np.concatenate([begin_at[part], again]), 1)
                np.add.at(edges, np.concatenate([end_at[part], again + length]), -1)
                gone = np.append(np.cumsum(edges[:-1]) > 0, False)
                turns = np.flatnonzero(np.diff(gone, prepend=False)).reshape(-1, 2)
                spans.append(turns)
                counts.append(len(turns))
                kept.append(body[~gone[:-1]].tobytes())
            turns = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                              pa.StructArray.from_arrays([pa.array(turns[:, 0].copy(), pa.int64()), pa.array(turns[:, 1].copy(), pa.int64())], ["begin", "end"]))
            named = [batch.column(3 + i) for i in range(len(keys.names))]
            yield pa.RecordBatch.from_arrays([*named, pa.array(np.diff(offsets)), listed, pa.array(kept, pa.binary()), batch.column(2)], schema.names)

    empty = F.array().cast(span)
    return marked.select("message_body", F.coalesce("spans", empty).alias("spans"), "copies", *keys.names).mapInArrow(cut, schema)


def _sampled(rows: DataFrame, tokens: Sequence[str], total: int, buckets: int, per_bucket: int = 64) -> np.ndarray:
    """Splitter keys of about ``per_bucket`` rows a bucket."""
    share = min(1.0, per_bucket * buckets / max(total, 1))
    found = (rows.sample(share, seed=7) if share < 1 else rows).select(*tokens).toArrow()
    return splitter_keys(*(found.column(c).to_numpy().view(np.uint64) for c in tokens))


def remove_repeated_passages(alerts: DataFrame, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS, piece_bytes: int = PIECE_BYTES,
                             id_column: str = "alert_id", message: str = "message_body") -> DataFrame:
    """(alert_id, n_bytes, spans, kept_body): every message without the bytes that repeat earlier text.

    Messages are taken as UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also
    starts earlier: in an alert with a smaller id, or earlier in the same message; strings may overlap,
    do not cross messages and are judged on the messages as given. ``spans`` are the removed runs
    (begin, end), largest possible and ascending; ``kept_body`` holds the other bytes in order.

    ``bucket_rows`` and ``piece_bytes`` only balance the work: the first is the aim for the suffixes
    sorted in one task, the second for the bytes looked at together. Splitters come from a sample of
    about 64 suffixes a bucket and only place the rows. Tokens are 64-bit hashes: two different
    surroundings of one gram count as equal with a chance of 2^-64.

    A NULL or empty message, or one shorter than ``length``, stays as it is. NULL ids come first. Rows of
    one id with different messages follow each other in the order of a hash of the message; rows that
    repeat id and message are one record, so each of them gets that record's result. Very long messages
    are read in pieces. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    if not 2 * GRAM <= length <= 2048:
        raise ValueError(f"length must be between {2 * GRAM} and 2048 bytes")
    spark = alerts.sparkSession
    rows = alerts.select(F.col(id_column).alias("alert_id"), F.coalesce(F.col(message).cast("string"), F.lit("")).alias("message_body"))
    if rows.groupBy("alert_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("alert_id", "message_body").agg(F.count(F.lit(1)).alias("copies")).withColumn("tie", F.xxhash64("message_body"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    keys = _Keys(rows)
    long_rows = rows.where(F.octet_length("message_body") >= length)
    total, count = long_rows.agg(F.coalesce(F.sum(F.octet_length("message_body")), F.lit(0)), F.count(F.lit(1))).first()
    expected = 2 * total // (length - GRAM + 2)
    buckets = max(1, min(MOST_SPLITTERS, expected // bucket_rows))
    share = min(1.0, max(64 * buckets / max(expected, 1), 500 / max(count, 1)))
    sample = long_rows.sample(share, seed=7) if share < 1 else long_rows
    none = np.zeros(0, "S24")
    found = anchor_suffixes(sample, keys, none, length, piece_bytes).select("gram", "near", "salt").toArrow() if buckets > 1 else None
    splitters = none if found is None else pick_splitters(splitter_keys(*(found.column(c).to_numpy().view(np.uint64) for c in ("gram", "near", "salt"))), buckets)

    suffixes = anchor_suffixes(long_rows, keys, splitters, length, piece_bytes)
    compared = storage.stored(compare_tokens(suffixes, keys, splitters), "suffixes")
    across = Window.partitionBy("gram", "near").orderBy(*keys.order(), "spot")
    opened = compared.where(F.col("kind") == OPEN).withColumn("place", F.row_number().over(across))
    columns = ["gram", "spot", *keys.names]
    candidates = compared.where(F.col("kind") == CANDIDATE).select(columns).unionByName(opened.where("place = 1").select(columns))
    repeats = compared.where(F.col("kind") == REPEAT).select(columns).unionByName(opened.where("place > 1").select(columns))
    begin = F.shiftright("spot", 24) - F.shiftright("spot", 12).bitwiseAND(0xFFF)
    spans = repeats.select(begin.alias("begin"), (begin + F.col("spot").bitwiseAND(0xFFF) + length).alias("end"), *keys.names)

    salted = candidates.withColumn("salt", F.xxhash64(*keys.names, "spot"))
    number = compared.where(F.col("kind") != REPEAT).count()
    buckets = max(1, min(MOST_SPLITTERS, number // max(1, bucket_rows // 5)))
    byte_splitters = pick_splitters(_sampled(salted, ("gram", "salt"), number, buckets), buckets) if buckets > 1 else np.zeros(0, "S16")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(parts, *keys.names)  # the one shuffle of the messages; both joins below read it
    marks = salted.groupBy(*keys.names).agg(F.collect_set(F.struct("gram", "salt", "spot")).alias("marks"))
    contexts = candidate_suffixes(keys.join(placed, marks, "inner"), keys, byte_splitters, length)
    windows = compare_bytes(contexts, keys, byte_splitters, length)
    same = Window.partitionBy("kind", "low", "high").orderBy(*keys.order(), "begin")
    late = windows.withColumn("place", F.row_number().over(same)).where((F.col("kind") == REPEAT) | (F.col("place") > 1))
    listed = (spans.unionByName(late.select("begin", "end", *keys.names)).groupBy(*keys.names)
              .agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    done = cut_repeats(keys.join(placed, listed, "left"), keys, length)
    if "tie" in keys.names:
        done = done.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return done.select("alert_id", "n_bytes", "spans", "kept_body")
