"""Near-equal alert messages: n-gram Jaccard join with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.llm import storage
from landpulse.llm.lexing import mix64
from landpulse.llm.words import hashed_words, ngrams
from landpulse.operators.components import graph_components

BANDS, ROWS, STEP = 32, 4, 16
BLOCK = 512


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ordered: (hashes, shingles per text). A text of fewer than
    ``n`` words, but any, has one shingle of all its words."""
    value, owner = ngrams(words, counts, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        starts = np.cumsum(counts) - counts
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = counts[short] > k
            extra[more] = mix64(extra[more] * np.uint64(0x9E3779B97F4A7C15) + words[starts[short][more] + k] + np.uint64(k))
        value, owner = np.concatenate([value, mix64(extra)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[first], np.bincount(owner[first], minlength=len(counts))


def signatures(value: np.ndarray, per_text: np.ndarray, seed: int = 11) -> np.ndarray:
    """(texts, BANDS * ROWS) MinHash values of 32 bits; texts without shingles get all ones."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    out = np.full((len(per_text), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    some = per_text > 0
    if some.any():
        starts = (np.cumsum(per_text) - per_text)[some]
        for k in range(BANDS * ROWS):
            hashed = ((value * odd[k] + shift[k]) >> np.uint64(32)).astype(np.uint32)
            out[some, k] = np.minimum.reduceat(hashed, starts)
    return out


def fewest_matches(threshold: float, tolerance: float, total: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(compared, matches needed): below, the posterior probability that the similarity reaches
    ``threshold`` is under ``tolerance``.

    With a uniform prior, m matches among n values leave a Beta(m + 1, n - m + 1) posterior, whose
    mass above t is the chance of at most m successes in n + 1 draws of probability t.
    """
    needs = []
    for n in range(step, total + 1, step):
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        needs.append((n, m))
    return needs


def surviving_pairs(left: np.ndarray, right: np.ndarray, needs: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs not pruned: MinHash values are compared step by step, and pairs too far behind
    are dropped before the next values are looked at. ``same``: both sides are one block."""
    if same:
        a, b = np.triu_indices(len(left), 1)
    else:
        a, b = np.divmod(np.arange(len(left) * len(right)), max(1, len(right)))
    matches, seen = np.zeros(len(a), np.int32), 0
    for n, need in needs:
        matches = matches + (left[a, seen:n] == right[b, seen:n]).sum(axis=1)
        kept = matches >= need
        a, b, matches, seen = a[kept], b[kept], matches[kept], n
    return a, b


def _blocks(table: pa.Table) -> dict:
    return {"text": table["text"].to_numpy(), "side": table["side"].to_numpy(),
            "sig": np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)}


def _candidates(rows: dict, band: int, needs) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row indices) of one pair of blocks that meet first in ``band`` and are not pruned."""
    zero, one = np.flatnonzero(rows["side"] != 1), np.flatnonzero(rows["side"] == 1)
    same = len(one) == 0
    one = zero if same else one
    sig = rows["sig"]
    a, b = surviving_pairs(sig[zero], sig[one], needs, same)
    a, b = zero[a], one[b]
    if band and len(a):
        earlier = (sig[a, :band * ROWS] == sig[b, :band * ROWS]).reshape(len(a), band, ROWS).all(axis=2).any(axis=1)
        a, b = a[~earlier], b[~earlier]
    return a, b


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) for the linked nodes: a star per component."""
    parent = np.arange(n)
    while True:
        pa_, pb = parent[a], parent[b]
        differ = pa_ != pb
        if not differ.any():
            break
        np.minimum.at(parent, np.maximum(pa_, pb)[differ], np.minimum(pa_, pb)[differ])
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]
    nodes = np.flatnonzero(parent != np.arange(n))
    return nodes, parent[nodes]


def jaccard_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach ``threshold``, counted exactly.

    Shingles are numbered once; those of a text mark a row of a bit table that is as wide as the
    shingles some other text shares, so each pair costs one pass over two short rows.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    dense = np.cumsum(times > 1) - 1
    width = int((times > 1).sum())
    good = np.zeros(len(a), bool)
    number, owner = dense[number[shared]], owner[shared]
    row_bytes = -(-width // 8)
    table = np.zeros((len(sets), row_bytes), np.uint8)
    np.bitwise_or.at(table, (owner, number >> 3), (1 << (number & 7)).astype(np.uint8))
    some = max(1, (8 << 20) // max(1, row_bytes))
    for begin in range(0, len(a), some):
        i, j = a[begin:begin + some], b[begin:begin + some]
        common = np.bitwise_count(table[i] & table[j]).sum(axis=1, dtype=np.int64)
        good[begin:begin + some] = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return good & (sizes[a] > 0)


def text_digest(body: Column) -> Column:
    """64 bits of a digest of a message."""
    return F.xxhash64(F.sha2(body, 256))


def _prepared(alerts: DataFrame, n: int) -> DataFrame:
    """(alert_id, text, signature) of every alert, in one pass over the messages."""
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, words, counts in hashed_words(batch.column(1)):
                value, per_text = shingles(words, counts, n)
                sig = [s.tobytes() if p else None for s, p in zip(signatures(value, per_text), per_text.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(2).slice(begin, end - begin),
                                                  pa.array(sig, pa.binary())], ["alert_id", "text", "signature"])

    schema = T.StructType([alerts.schema["alert_id"], T.StructField("text", T.LongType()), T.StructField("signature", T.BinaryType())])
    return alerts.mapInArrow(prepare, schema)


def near_messages(alerts: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, id_column: str = "alert_id",
                  message: str = "message_body") -> DataFrame:
    """One row per alert: (alert_id, text_id, class_id, n_links, text, class_text).

    Equal messages share ``text_id``, the smallest id among them. Two different messages are linked
    when the Jaccard similarity of their sets of ``n``-word shingles is at least ``threshold``;
    ``n_links`` counts an alert's links to other texts, and ``class_id`` is the smallest id of the
    texts connected with it. ``text`` is the message's digest (see ``text_digest``) and ``class_text`` the
    smallest digest of its class, which names the class where ids repeat. A text of fewer than ``n`` words is one shingle; texts without words link
    to none. NULL messages are empty, alerts with NULL ids are left out of classes (all NULL but
    the id and the digest); repeated ids with one message count once, with two messages are two rows; other columns
    are ignored; an empty table gives no rows. Messages are compared whole, however long.

    Candidates share a band of MinHash values (``BANDS`` of ``ROWS`` values, which misses a pair at
    0.8 with probability below 1e-7). MinHash values of a pair are then compared ``STEP`` at a time and
    the pair is dropped when its posterior probability to reach the threshold falls under
    ``tolerance``; the pairs left are verified by their whole shingle sets. Bands with the same texts
    are looked at once, and a pair only in the first band where it meets. A band's texts are cut into
    blocks of ``BLOCK`` and compared block by block: pairs are never emitted, only counts per text and
    one tree per block pair, so a class of thousands costs rows in proportion to its blocks.
    """
    needs = fewest_matches(threshold, tolerance)
    body = F.coalesce(F.col(message), F.lit(""))
    rows = alerts.select(F.col(id_column).alias("alert_id"), body.alias("message_body"),
                         text_digest(body).alias("text"))  # names a text from here on
    prepared = storage.stored(_prepared(rows, n), "message-signatures")
    unique = storage.stored(prepared.where("alert_id IS NOT NULL").groupBy("text").agg(
        F.min("alert_id").alias("text_id"), F.any_value("signature").alias("signature")), "unique-texts")
    keys = F.array(*[F.xxhash64(F.substring("signature", band * 4 * ROWS + 1, 4 * ROWS)) for band in range(BANDS)])
    banded = unique.where("signature IS NOT NULL").select("text", F.posexplode(keys).alias("band", "key"))
    groups = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("text").cast("decimal(38,0)")).alias("sum"),
                                               F.bit_xor(F.xxhash64("text", F.lit(1))).alias("xor")).where("size > 1")
    lead = groups.groupBy("size", "sum", "xor").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key", "size")
    lead = storage.stored(lead.select("band", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bands")
    members = banded.join(lead, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    # a block meets itself and every other one: (bi, bj) with bi <= bj; side 1 marks block bj of a mixed pair
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = members.select("text", "band", "key", "block", other.alias("_o")).select(
        "text", "band", "key", F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"),
        F.when(F.col("block") > F.col("_o"), 1).otherwise(0).alias("side"))
    with_signature = placed.join(unique.select("text", "signature"), "text")
    group = ["band", "key", "bi", "bj"]

    def prune(key: tuple, table: pa.Table) -> pa.Table:
        rows = _blocks(table)
        a, b = _candidates(rows, key[0].as_py(), needs)
        kept = np.unique(np.concatenate([a, b]))
        return table.take(pa.array(kept, pa.int64())).select(["text", "band", "key", "bi", "bj", "side", "signature"])

    schema = "text long, band int, key long, bi int, bj int, side int, signature binary"
    left = storage.stored(with_signature.groupBy(*group).applyInArrow(prune, schema), "candidates")
    wanted = unique.join(left.select("text").distinct(), "text", "left_semi").select("text", F.col("text_id").alias("alert_id"))
    bodies = rows.join(wanted, ["alert_id", "text"], "left_semi").select("text", "message_body")
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, words, counts in hashed_words(batch.column(1)):
                value, per_text = shingles(words, counts, n)
                sets = [s.tobytes() for s in np.split(value, np.cumsum(per_text)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sets, pa.binary())], ["text", "shingles"])

    sets = bodies.mapInArrow(shingled, "text long, shingles binary").dropDuplicates(["text"])

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        rows = _blocks(table)
        a, b = _candidates(rows, key[0].as_py(), needs)
        good = jaccard_pairs([np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()], a, b, threshold)
        a, b = a[good], b[good]
        links = np.bincount(np.concatenate([a, b]), minlength=len(rows["text"]))
        linked = np.flatnonzero(links)
        order = np.argsort(rows["text"], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        node, root = forest(rank[a], rank[b], len(order))
        to = rows["text"].copy()
        to[order[node]] = rows["text"][order[root]]
        return pa.table({"text": rows["text"][linked], "linked_to": to[linked], "links": links[linked].astype(np.int64)})

    found = storage.stored(left.join(sets, "text").groupBy(*group).applyInArrow(verify, "text long, linked_to long, links long"), "links")
    counts = found.groupBy("text").agg(F.sum("links").alias("n_links"))
    edges = found.where("text <> linked_to").select(F.col("text").alias("src"), F.col("linked_to").alias("dst"))
    parts = graph_components(edges).select(F.col("node").alias("text"), "component")
    least = (parts.join(unique.select("text", "text_id"), "text").groupBy("component").agg(F.min("text_id").alias("class_id")))
    classes = parts.join(least, "component").select("text", "class_id", F.col("component").alias("class_text"))
    known = unique.select("text", "text_id").join(counts, "text", "left").join(classes, "text", "left").select(
        "text", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_text", "text").alias("class_text"))
    named = prepared.where("alert_id IS NOT NULL").select("alert_id", "text").join(known, "text")
    none = {"text_id": rows.schema["alert_id"].dataType, "class_id": rows.schema["alert_id"].dataType, "n_links": T.LongType()}
    nameless = prepared.where("alert_id IS NULL").select("alert_id", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()], "text", F.lit(None).cast("long").alias("class_text"))
    return named.select(*nameless.columns).unionByName(nameless)
