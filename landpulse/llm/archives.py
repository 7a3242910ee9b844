"""Scene responses in WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every record after it is one
Zstandard frame of its own, so a reader decodes record by record and can start at any frame.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landpulse.llm import storage

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D  # skippable frame that carries a dictionary
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEAD = struct.Struct("<II")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArchiveError(ValueError):
    """A record or frame that does not say what it holds."""


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """Dictionary from a bounded sample of payloads; empty when they are too few or too short."""
    samples = [s for s in samples if len(s) >= 64]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstd.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return HEAD.pack(DICTIONARY_FRAME, len(dictionary)) + dictionary


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(scene_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'scene/{scene_id}')}>"


def record_bytes(scene_id, href: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record: headers, block and the two line ends after it.

    The block is an HTTP response; a revisit keeps its headers, Content-Length included, without
    the payload.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", href or f"urn:scene:{scene_id}")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(scene_id)),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Scene-ID", json.dumps(scene_id)),
            ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Scene", json.dumps(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def frames(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """Frames of a Zstandard file, one at a time; memory holds the present frame and one step.

    Frame ends are found from the block headers of the format, without decoding.
    """
    data, at, ended = b"", 0, False

    def need(n: int) -> bool:
        nonlocal data, at, ended
        while len(data) - at < n and not ended:
            more = stream.read(max(step, n))
            ended = not more
            data, at = data[at:] + more, 0
        return len(data) - at >= n

    while need(1):
        if not need(8):
            raise ArchiveError("file ends inside a frame header")
        magic, size = HEAD.unpack_from(data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            length = 8 + size
        elif magic == ZSTD_MAGIC:
            need(18)
            length = zstd.frame_header_size(data[at:at + 18])
            checksum = 4 * zstd.get_frame_parameters(data[at:at + 18]).has_checksum
            last = False
            while not last:
                if not need(length + 3):
                    raise ArchiveError("file ends inside a frame")
                block = int.from_bytes(data[at + length:at + length + 3], "little")
                last, kind = bool(block & 1), block >> 1 & 3
                length += 3 + (1 if kind == 1 else block >> 3)
            length += checksum
        else:
            raise ArchiveError("not a frame")
        if not need(length):
            raise ArchiveError("file ends inside a frame")
        yield data[at:at + length]
        at += length


def read_record(raw: bytes) -> dict:
    """Headers and payload of one record, checked: version, mandatory headers, both lengths, both
    digests, and nothing behind the record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ArchiveError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or name.lower() in fields:
            raise ArchiveError(f"bad header {name!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-scene-id", "warc-block-digest"} - fields.keys():
        raise ArchiveError(f"headers missing: {sorted(missing)}")
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ArchiveError("Content-Length and record differ")
    if _digest(block) != fields["warc-block-digest"]:
        raise ArchiveError("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?mi)^Content-Length: *(\d+)\r?$", http)
    if not found or not said:
        raise ArchiveError("no HTTP response in the block")
    revisit = fields["warc-type"] == "revisit"
    if fields["warc-type"] not in ("response", "revisit") or revisit and (payload or "warc-refers-to-scene" not in fields):
        raise ArchiveError("record type and block differ")
    if not revisit and (len(payload) != int(said[1]) or _digest(payload) != fields["warc-payload-digest"]):
        raise ArchiveError("payload differs from its length or digest")
    return {"fields": fields, "payload": None if revisit else payload, "payload_bytes": int(said[1])}


def read_archive(stream) -> Iterator[dict]:
    """Records of one archive. The dictionary comes from the leading skippable frame, which may
    itself be compressed; an archive without one is read as plain Zstandard."""
    decoder = zstd.ZstdDecompressor()
    for i, frame in enumerate(frames(stream)):
        magic, _ = HEAD.unpack_from(frame)
        if magic == DICTIONARY_FRAME:
            if i:
                raise ArchiveError("dictionary behind the first frame")
            data = frame[8:]
            if data[:4] == ZSTD_MAGIC.to_bytes(4, "little"):
                data = zstd.ZstdDecompressor().decompressobj().decompress(data)
            decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data)) if data else decoder
        elif magic == ZSTD_MAGIC:
            yield read_record(decoder.decompressobj().decompress(frame))


def mark_revisits(scenes: DataFrame, at_least: int = 100, id_column: str = "scene_id", content: str = "content") -> DataFrame:
    """(scene_id, href?, content, refers_to): of equal contents of ``at_least`` bytes, all but the
    one with the smallest id refer to that one.

    Contents are compared by SHA-256 and length. Only digests are grouped, with partial aggregation,
    and only groups of two or more are joined back.
    """
    body = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = scenes.select(F.col(id_column).alias("scene_id"), *([F.col("href")] if "href" in scenes.columns else [F.lit(None).cast("string").alias("href")]),
                         body.alias("content")).withColumn("_digest", F.unhex(F.sha2("content", 256)))
    first = (rows.where(F.length("content") >= at_least).groupBy("_digest")
             .agg(F.min("scene_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    joined = rows.join(first, "_digest", "left")
    return joined.select("scene_id", "href", "content", F.when(F.col("scene_id") != F.col("refers_to"), F.col("refers_to")).alias("refers_to"))


def write_archives(scenes: DataFrame, folder: str, at_least: int = 100, sample: int = 256, archive_bytes: int = 64 << 20,
                   level: int = 3, id_column: str = "scene_id", content: str = "content") -> DataFrame:
    """Archives of all scene responses: (path, records).

    ``content`` is text (stored in UTF-8) or binary; NULL is empty. Each archive takes its
    dictionary from its own first ``sample`` responses, and a new one begins after about
    ``archive_bytes``. Scene ids, numbers or text, are written as JSON, so that a NULL one reads back as NULL; rows that
    repeat an id are written one by one, and only a larger id refers to a smaller one. Other columns are ignored; an empty table
    writes no archive.
    """
    marked = mark_revisits(scenes, at_least, id_column, content)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        number, pending = 0, next(rows, None)
        while pending is not None:
            path = f"{folder}/scenes-{TaskContext.get().partitionId():06d}-{number:04d}.warc.zst"
            first, size = [], 0
            while pending is not None and len(first) < sample and size < archive_bytes:
                first.append(pending)
                size += len(pending[2])
                pending = next(rows, None)
            dictionary = train_dictionary([r[2] for r in first if r[3] is None])
            encoder = zstd.ZstdCompressor(level=level, write_checksum=True, **({"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}))
            with storage.whole_file(path) as stream:
                stream.write(dictionary_frame(dictionary))
                records = written = 0
                while first or pending is not None and size < archive_bytes:
                    if first:
                        scene_id, href, payload, refers_to = first.pop(0)
                    else:
                        (scene_id, href, payload, refers_to), pending = pending, next(rows, None)
                        size += len(payload)
                    stream.write(encoder.compress(record_bytes(scene_id, href, payload, refers_to)))
                    records += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records]})
            number += 1

    return storage.stored(marked.mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """Validated records of the archives in ``path``: (scene_id, href, record_type, payload_bytes,
    payload_digest, refers_to, payload); ``payload`` is NULL for revisits; ``id_type`` is the type of the
    scene ids (``long`` or ``string``). A bad frame or record fails
    the job."""
    kind = pa.string() if id_type == "string" else pa.int64()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with storage.open_file(path) as stream:
                    rows, size = [], 0
                    for record in read_archive(stream):
                        f = record["fields"]
                        name = lambda text: json.loads(text or "null")
                        rows.append((name(f["warc-scene-id"]), f.get("warc-target-uri"), f["warc-type"], record["payload_bytes"],
                                     f["warc-payload-digest"].partition(":")[2], name(f.get("warc-refers-to-scene")), record["payload"]))
                        size += record["payload_bytes"]
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield _batch(rows, kind)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, kind)

    return storage.dealt(archives.select("path"), "path").mapInArrow(read, READ_SCHEMA.format(id_type))


READ_SCHEMA = ("scene_id {0}, href string, record_type string, payload_bytes long, payload_digest string, refers_to {0}, "
               "payload binary")


def _batch(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = [id_kind, pa.string(), pa.string(), pa.int64(), pa.string(), id_kind, pa.binary()]
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
