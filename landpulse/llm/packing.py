"""Packing messages into training sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.llm import storage
from landpulse.llm.tokens import encoder

PIECE_FIELDS = [T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]


def message_pieces(alerts: DataFrame, path: str, kind: str = "word", capacity: int = 2048, end_id: int = 0,
                   id_column: str = "alert_id", message: str = "message_body") -> DataFrame:
    """Tokenised messages cut into pieces of at most ``capacity`` ids:
    (alert_id, piece, start, length, ids_crc32).

    Each message is followed by ``end_id``. Only longer ones are cut; the last piece is the rest.
    A NULL message is empty (one piece with the end id); rows with NULL or repeated ids are cut one
    by one; very long messages are encoded alone, whole; other columns, whatever their names, are
    ignored; an empty table gives no pieces.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for begin, stop, flat, per_text in encoder(path, kind).encode(batch.column(1).to_pylist(), end_id):
                pieces = -(-per_text // capacity)
                owner = np.repeat(np.arange(begin, stop), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(per_text[owner - begin] - start, capacity)
                raw = flat.astype("<u4")
                ends = np.cumsum(length)
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip((ends - length).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64())], ["alert_id", "piece", "start", "length", "ids_crc32"])

    rows = alerts.select(F.col(id_column).alias("alert_id"), F.coalesce(F.col(message), F.lit("")).alias("message_body"))
    return rows.mapInArrow(cut, T.StructType([rows.schema["alert_id"], *PIECE_FIELDS]))


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """Combination of the available lengths (length -> copies) with the largest sum up to ``room``.

    Subset sums as a bitset: bit s of ``reach`` is set when s can be filled. Lengths are added from
    the longest, copies in powers of two, until ``room`` itself is reached; walking back over the
    kept bitsets finds the members.
    """
    reach, steps = 1, []
    full = (1 << room + 1) - 1
    for length in sorted((x for x in available if x <= room), reverse=True):
        copies, chunk = min(available[length], room // length), 1
        while copies > 0 and not reach >> room & 1:
            take = min(chunk, copies)
            steps.append((length, take, reach))
            reach |= reach << length * take & full
            copies -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths in a bin, number of such bins) until nothing is left.

    Each bin starts with the longest piece left and takes the fullest feasible combination beside
    it, which is then removed. As long as every member has copies left, the same combination is
    feasible and as full as before, so it is removed as often as the copies allow at once; the work
    depends on the number of distinct lengths, not of pieces.
    """
    left, plan = dict(counts), []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest({k: n for k, n in rest.items() if n}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        plan.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first bin, offset in the bin), by rank. The pieces of a length
    with rank first .. first + times - 1 go to that place of consecutive bins."""
    slots: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first_bin = 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                slots.setdefault(length, []).append((ranks.get(length, 0), first_bin, offset))
                ranks[length] = ranks.get(length, 0) + times
                offset += length
        first_bin += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    The packing depends on the lengths alone, so it is solved over their histogram, which has at
    most ``capacity`` rows whatever the table's size; that histogram and the resulting places are
    all that passes through the driver. Pieces get a rank inside their length from counts per
    (length, salt), so a length that a third of all pieces share is numbered in many tasks, and look
    their rank up in the plan. Returns every piece; extra columns travel along; an empty table stays
    empty. Which of several pieces of one length goes where is arbitrary but fixed by the stored
    ranks.
    """
    spark = pieces.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = storage.stored(pieces.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in ("alert_id", "piece", "start", "ids_crc32") if c in pieces.columns]), F.lit(salts))), "pieces")
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= capacity rows
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    slots = _slots(minimum_bin_slack(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    order = [F.col(c) for c in salted.columns if c not in ("length", "_salt")]
    within = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = (salted.withColumn("_in", F.row_number().over(within) - 1).join(based, ["length", "_salt"])
              .select(*pieces.columns, (F.col("_base") + F.col("_in")).alias("_rank")))
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                mine, table = length == value, slots[int(value)]
                row = np.searchsorted(table[:, 0], rank[mine], side="right") - 1
                sequence[mine], offset[mine] = table[row, 1] + rank[mine] - table[row, 0], table[row, 2]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
