"""Message ids in one concatenated array with Elias-Fano coded alert boundaries.

A file holds the token ids of consecutive alerts and two Elias-Fano sequences: the alert ids
(ascending; of text ids, where each ends in their concatenated bytes) and the boundaries (where each
alert ends). A sequence of n values up to u takes about
n * (2 + log2(u / n)) bits. Its select structure finds the i-th value from a sampled bit position,
so a reader gets one alert's slice without any table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landpulse.llm import storage
from landpulse.llm.tokens import encoder

MAGIC = b"LPEFIDS1"
SAMPLE = 512


class EliasFano:
    """Non-decreasing, non-negative integers with random access."""

    HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((top >> low_bits) + n + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` .. ``last - 1``: bits are read from the sample at or before ``first``
        up to the one after ``last``."""
        first, last = max(0, first), min(self.n, last)
        if first >= last:
            return np.zeros(0, np.uint64)
        sample = first // SAMPLE
        begin = int(self.samples[sample]) // 8
        after = -(-last // SAMPLE)
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:stop], bitorder="little")) + 8 * begin
        skip = np.searchsorted(ones, self.samples[sample]) + first - sample * SAMPLE
        high = ones[skip:skip + last - first] - np.arange(first, last)
        bit = first * self.low_bits
        packed = self.low[bit // 8:-(-last * self.low_bits // 8)]
        low_rows = np.unpackbits(packed, bitorder="little")[bit % 8:bit % 8 + (last - first) * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        low = low_rows.reshape(last - first, self.low_bits).astype(np.uint64) @ weights if self.low_bits else np.uint64(0)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | low

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, stream) -> EliasFano:
        n, low_bits, low, high = cls.HEAD.unpack(stream.read(cls.HEAD.size))
        part = lambda size, kind: np.frombuffer(stream.read(size), kind)
        return cls(n, low_bits, part(low, np.uint8), part(high, np.uint8), part(4 * -(-n // SAMPLE), "<u4"))


TEXT_IDS = b"LPEFIDT1"
HEADER = struct.Struct("<8sBQQqQ")  # magic, bytes per id, alerts, alerts without id, smallest alert id, token ids


def write_ids(stream, alert_ids: np.ndarray, missing: int, counts: np.ndarray, ids: list[np.ndarray]) -> None:
    """``alert_ids`` (numbers or text) ascending, after ``missing`` alerts whose id is NULL; ``ids`` in that
    order."""
    text = alert_ids.dtype == object
    width = 2 if max((int(a.max(initial=0)) for a in ids), default=0) < 1 << 16 else 4
    base = int(alert_ids[0]) if len(alert_ids) and not text else 0
    stream.write(HEADER.pack(TEXT_IDS if text else MAGIC, width, len(counts), missing, base, int(counts.sum())))
    if text:
        names = [i.encode() for i in alert_ids.tolist()]
        stream.write(EliasFano.of(np.cumsum([len(i) for i in names], dtype=np.int64)).to_bytes())
        stream.write(b"".join(names))
    else:
        stream.write(EliasFano.of(alert_ids.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)).to_bytes())
    stream.write(EliasFano.of(np.cumsum(counts)).to_bytes())
    for part in ids:
        stream.write(part.astype(f"<u{width}").tobytes())


def read_ids(stream, block: int = 4096) -> Iterator[tuple[list[int | str | None], np.ndarray, np.ndarray]]:
    """(alert ids, ends inside the file, token ids) of ``block`` alerts at a time."""
    magic, width, n, missing, base, total = HEADER.unpack(stream.read(HEADER.size))
    if magic not in (MAGIC, TEXT_IDS):
        raise ValueError("not a file of message ids")
    keys = EliasFano.read(stream)
    names_at = stream.tell()
    if magic == TEXT_IDS:
        stream.seek(names_at + (int(keys.select(keys.n - 1, keys.n)[0]) if keys.n else 0))
    ends = EliasFano.read(stream)
    if keys.n != n - missing or ends.n != n:
        raise ValueError("boundary count differs from the header")
    origin, done = stream.tell(), 0
    for first in range(0, n, block):
        last = min(n, first + block)
        stops = ends.select(first, last).astype(np.int64)
        none = [None] * max(0, min(missing, last) - first)
        if magic == TEXT_IDS:
            before = keys.select(first - missing - 1, first - missing)
            cuts = np.concatenate([before if len(before) else [0], keys.select(first - missing, last - missing)]).astype(np.int64)
            stream.seek(names_at + int(cuts[0]))
            letters = stream.read(int(cuts[-1] - cuts[0]))
            names = none + [letters[a - cuts[0]:b - cuts[0]].decode() for a, b in zip(cuts[:-1], cuts[1:])]
        else:
            names = none + (keys.select(first - missing, last - missing) + np.uint64(base & (1 << 64) - 1)).astype(np.int64).tolist()
        stream.seek(origin + done * width)
        ids = np.frombuffer(stream.read((int(stops[-1]) - done) * width), f"<u{width}")
        if len(ids) != stops[-1] - done:
            raise ValueError("token ids end early")
        yield names, stops, ids
        done = int(stops[-1])
    if done != total:
        raise ValueError("token ids and header differ in length")


def write_message_ids(alerts: DataFrame, folder: str, path: str, kind: str = "byte_level", end_id: int = 2,
                      id_column: str = "alert_id", message: str = "message_body") -> DataFrame:
    """Encodes every message and writes the ids in ascending alert order; returns the files.

    One file per range of alert ids: (file, path, alerts, token_ids), ``file`` ascending with the
    ids. Messages are ordered before they are encoded, so the ids never travel. A NULL message is
    empty (it keeps its end id); alerts with a NULL id come first; equal ids are ordered by a hash
    of their message; ids are whole numbers or text. A very long message is encoded whole. Other columns,
    whatever their names, are ignored. An empty table writes no file.
    """
    rows = alerts.select(F.col(id_column).alias("alert_id"), F.coalesce(F.col(message), F.lit("")).alias("message_body"))
    order = [F.col("alert_id").asc_nulls_first(), F.xxhash64("message_body").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, ids, missing = [], [], [], 0
        for batch in batches:
            column = batch.column(0)
            missing += column.null_count
            known = column.drop_null()
            keys.append(np.array(known.to_pylist(), object) if pa.types.is_string(column.type) else known.to_numpy(zero_copy_only=False))
            for _, _, flat, per_text in encoder(path, kind).encode(batch.column(1).to_pylist(), end_id):
                ids.append(flat.astype(np.uint16) if flat.max(initial=0) < 1 << 16 else flat)
                counts.append(per_text)
        if not counts:
            return
        file = TaskContext.get().partitionId()
        place, counts = f"{folder}/ids-{file:06d}", np.concatenate(counts)
        with storage.whole_file(place) as stream:
            write_ids(stream, np.concatenate(keys), missing, counts, ids)
        yield pa.RecordBatch.from_pydict({"file": [file], "path": [place], "alerts": [len(counts)], "token_ids": [int(counts.sum())]})

    return storage.stored(placed.mapInArrow(write, "file long, path string, alerts long, token_ids long"), "id-files")


def read_message_ids(files: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per alert from the files: (alert_id, start, n_tokens, ids_crc32, token_ids). ``id_type`` is
    ``long`` or ``string``, as the ids were.

    ``start`` counts the ids of all alerts before it over all files, from one total per file.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = files.select("path", F.coalesce(F.sum("token_ids").over(before), F.lit(0)).alias("base"), "file")
    spread = storage.dealt(based, "file")
    id_kind = pa.string() if id_type == "string" else pa.int64()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with storage.open_file(path) as stream:
                    done = 0
                    for names, stops, ids in read_ids(stream):
                        starts = np.append(done, stops[:-1])
                        raw = ids.astype("<u4")
                        crc = [zlib.crc32(raw[a - done:b - done].tobytes()) for a, b in zip(starts, stops)]
                        offsets = pa.array(np.append(starts, stops[-1]) - done, pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names, id_kind), pa.array(base + starts), pa.array(stops - starts), pa.array(crc, pa.int64()),
                             pa.ListArray.from_arrays(offsets, pa.array(raw.astype(np.int32)))],
                            ["alert_id", "start", "n_tokens", "ids_crc32", "token_ids"])
                        done = int(stops[-1])

    return spread.mapInArrow(read, f"alert_id {id_type}, start long, n_tokens long, ids_crc32 long, token_ids array<int>")
