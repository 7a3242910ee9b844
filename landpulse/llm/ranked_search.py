"""Ranked search over alert messages: the best alerts for each alert title.

The index is a table of posting lists, cut by segment: neighbouring alerts of about ``SEGMENT_BYTES``
of messages, numbered inside the segment in id order. A segment is searched in one piece. Of a title's
lists, the short ones are summed term by term into accumulators; these then act as one more list, with
the largest sum as its bound, among the long lists that are read document by document. Ranges whose
bounds cannot reach the k-th best score are skipped, and lists that cannot lift a document there on
their own are only probed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.llm import storage
from landpulse.llm.interning import InternTable, word_runs
from landpulse.operators.skew import salted_join

SEGMENT_BYTES = 4_000_000
RANGE = 256  # alerts that are bounded and skipped together
BLOCK_TERMS = 50_000  # title terms that are searched together
SMALL_TERMS, SMALL_BYTES = 200_000, 16_000_000  # most terms, and most bytes of them, sent to every executor


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` as 32-bit numbers, cut into binary rows of ``counts`` numbers."""
    offsets = np.concatenate([[0], np.cumsum(4 * counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<u4"))])


def title_terms(titles: DataFrame, id_column: str = "alert_id", title: str = "message_title") -> DataFrame:
    """(title_id, term, repeats): the words of all titles. Rows that repeat id and title count once,
    different titles of one id are one query."""
    rows = titles.select(F.col(id_column).alias("title_id"), F.col(title).cast("string").alias("title")).distinct()
    schema = T.StructType([T.StructField("title_id", rows.schema["title_id"].dataType), T.StructField("term", T.StringType()), T.StructField("repeats", T.LongType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in word_runs(batch.column(1)):
                table = InternTable(run.data, run.starts, run.ends)
                owner = np.repeat(np.arange(run.begin, run.end), run.counts)
                both, n = np.unique(owner * len(table.used) + np.searchsorted(table.used, table.slot), return_counts=True)
                terms = pa.array(table.spans(run.data), pa.binary()).cast(pa.string()).take(pa.array(both % max(len(table.used), 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both // max(len(table.used), 1))), terms, pa.array(n, pa.int64())], schema.names)

    return rows.mapInArrow(split, schema).groupBy("title_id", "term").agg(F.sum("repeats").alias("repeats"))


def message_postings(alerts: DataFrame, wanted: set[bytes] | None = None, id_column: str = "alert_id", message: str = "message_body") -> DataFrame:
    """The index, as a table in the shared folder; ``wanted`` restricts it to these words.

    One row per segment and word: ``places`` (ascending numbers of alerts in the segment) and ``counts``
    (occurrences), both 32-bit little-endian, and ``n_alerts``. One row per segment without ``term``:
    ``alert_ids`` by place, ``counts`` with the words of each alert, ``n_words`` in all and ``n_alerts``
    with any. Words are counted over whole messages, whether wanted or not.
    """
    rows = alerts.select(F.col(id_column).alias("alert_id"), F.col(message).cast("string").alias("message_body"))
    id_type = rows.schema["alert_id"].dataType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n_alerts", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()),
                           T.StructField("alert_ids", T.ArrayType(id_type))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for run in word_runs(batch.column(1), SEGMENT_BYTES):
                ids = batch.column(0).slice(run.begin, run.end - run.begin)
                by_id = pc.array_sort_indices(ids, null_placement="at_start")
                size = len(run.counts)
                place = np.empty(size, np.int64)
                place[by_id.to_numpy()] = np.arange(size)
                lengths = run.counts[by_id.to_numpy()]
                table = InternTable(run.data, run.starts, run.ends)
                both, n = np.unique(np.searchsorted(table.used, table.slot) * size + place[np.repeat(np.arange(size), run.counts)], return_counts=True)
                words = table.spans(run.data)
                if wanted is not None:
                    kept = np.fromiter((w in wanted for w in words), bool, len(words))[both // size]
                    both, n = both[kept], n[kept]
                word, at = both // size, both % size
                first = np.flatnonzero(np.diff(word, prepend=-1))
                df = np.diff(np.append(first, len(word)))
                terms = pa.array([words[w] for w in word[first].tolist()], pa.binary()).cast(pa.string())
                none = pa.nulls(len(first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), segment)), terms, pa.array(df, pa.int64()), none.cast(pa.int64()), _binary(at, df), _binary(n, df), none.cast(pa.list_(ids.type))], schema.names)
                own = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), ids.take(by_id))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment]), pa.array([None], pa.string()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
                     pa.array([None], pa.binary()), _binary(lengths, np.array([size])), own], schema.names)
                segment += 1

    return storage.stored(rows.mapInArrow(index, schema), "postings")


class BoundedList:
    """Places in ascending order with their gains, the largest gain, and the largest per range."""

    def __init__(self, places: np.ndarray, gains: np.ndarray, size: int):
        self.places, self.gains, self.bound = places, gains, int(gains.max(initial=0))
        self.cuts = np.searchsorted(places, np.arange(0, size + RANGE, RANGE))
        self.range_bounds = np.zeros(len(self.cuts) - 1, np.int64)
        filled = np.flatnonzero(np.diff(self.cuts))
        if len(filled):
            self.range_bounds[filled] = np.maximum.reduceat(gains, self.cuts[filled])

    def within(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.cuts[number], self.cuts[number + 1])
        return self.places[part], self.gains[part]


def _summed(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list with the gains of equal places added up."""
    places, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    gains = np.zeros(len(places), np.int64)
    np.add.at(gains, back, np.concatenate([g for _, g in parts]))
    return places, gains


def best_places(lists: Sequence[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` largest sums of gains above 0, ties to the smaller place.

    Lists of at most 1/16 of the places (or one range) are summed term by term. Their k-th largest sum
    is the first threshold: no place below it can be among the best.
    """
    short = max(RANGE, size // 16)
    few = [x for x in lists if len(x[0]) <= short]
    open_lists = [BoundedList(*x, size) for x in lists if len(x[0]) > short]
    least = 0
    if few:
        places, sums = _summed(few)
        open_lists.append(BoundedList(places, sums, size))
        if len(sums) >= k:
            least = int(np.partition(sums, len(sums) - k)[len(sums) - k])
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not open_lists:
        return best, scores
    bounds = np.array([x.range_bounds for x in open_lists])
    reach = bounds.sum(axis=0)
    for number in range(bounds.shape[1]):
        if reach[number] < max(least, 1):
            continue
        rising = np.argsort(bounds[:, number], kind="stable")
        below = np.cumsum(bounds[rising, number])
        probed = int(np.searchsorted(below, least))  # together these lists stay under the threshold
        places, sums = _summed([open_lists[i].within(number) for i in rising[probed:]])
        for i in rising[:probed][::-1]:
            alive = sums + below[probed - 1] >= least
            places, sums, probed = places[alive], sums[alive], probed - 1
            there, gains = open_lists[i].within(number)
            at = np.minimum(np.searchsorted(there, places), len(there) - 1)
            if len(there):
                sums = sums + np.where(there[at] == places, gains[at], 0)
        kept = sums >= max(least, 1)
        best, scores = np.concatenate([best, places[kept]]), np.concatenate([scores, sums[kept]])
        order = np.lexsort((best, -scores))[:k]
        best, scores = best[order], scores[order]
        if len(best) == k:
            least = max(least, int(scores[-1]))
    return best, scores


def search_segment(own: dict, postings: list[dict], alerts: int, words: int, k: int) -> Iterator[tuple]:
    """(title_id, alert_id, score) of the best alerts of one segment for every title in ``postings``."""
    lengths = np.frombuffer(own["counts"], "<u4").astype(np.int64)
    drag = 8 * (25 + 75 * lengths * alerts // max(words, 1))
    lists: dict = {}
    for row in postings:
        places, tf = np.frombuffer(row["places"], "<u4").astype(np.int64), np.frombuffer(row["counts"], "<u4").astype(np.int64)
        gains = row["weight"] * (1_000_000_000 * tf // (1000 * tf + drag[places]))
        for use in row["uses"]:
            lists.setdefault(use["title_id"], []).append((places, gains * use["repeats"]))
    for title, found in lists.items():
        places, scores = best_places(found, len(lengths), k)
        for place, score in zip(places.tolist(), scores.tolist()):
            yield title, own["alert_ids"][place], score


def rank_alerts(alerts: DataFrame, titles: DataFrame, k: int = 10, id_column: str = "alert_id", message: str = "message_body",
                title_id_column: str = "alert_id", title: str = "message_title") -> DataFrame:
    """(title_id, rank, alert_id, score): for each title the ``k`` alerts whose messages score highest.

    Terms are runs of letters, digits and non-ASCII characters of whole texts; only A-Z are lower-cased.
    N alerts have a term, L terms in all; a term that df alerts hold weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))). An alert of n terms, tf of them the title's term, gains
    w * ((10^9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L, for each term of the title,
    repeats included. Scores are whole numbers above 0; equal scores rank by ascending alert id (NULL
    first), equal rows in any order.

    N, L and df cover every message. Titles are searched in blocks of about ``BLOCK_TERMS`` terms, each
    against every segment, so neither titles nor alerts are bounded in number; a title is whole in its
    block. A NULL or empty message or title has no terms and never appears in the result. Rows that repeat
    a title's id and text count once; several titles of one id are searched as one. Repeated alerts are
    ranked one by one. Other columns, whatever their names, are ignored; an empty table on either side
    gives no rows.
    """
    terms = storage.stored(title_terms(titles, title_id_column, title), "title-terms")
    asked = terms.select("term").distinct()
    n_asked, n_bytes = asked.agg(F.count("term"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    small = n_asked <= SMALL_TERMS and n_bytes <= SMALL_BYTES
    wanted = {r["term"].encode() for r in asked.collect()} if small else None
    index = message_postings(alerts, wanted, id_column, message)
    own, postings = index.where("term IS NULL"), index.where("term IS NOT NULL")
    n_alerts, n_words = own.agg(F.coalesce(F.sum("n_alerts"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    n_terms = terms.count()
    blocks = -(-n_terms // BLOCK_TERMS) or 1

    df = postings.groupBy("term").agg(F.sum("n_alerts").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_alerts + 2.0) / (2.0 * F.col("df") + 1.0)))
    block = F.pmod(F.xxhash64("title_id"), F.lit(blocks)).cast("int").alias("block")
    uses = terms.groupBy(block, "term").agg(F.collect_list(F.struct("title_id", "repeats")).alias("uses"))
    queries = storage.stored(uses.join(df.withColumn("weight", weight), "term").where("weight > 0").select("block", "term", "weight", "uses"), "queries")
    lists = postings.select("segment", "term", "places", "counts")
    if small and n_terms <= SMALL_TERMS:
        found = lists.join(F.broadcast(queries), "term")
    else:
        found = salted_join(lists, queries, ["term"], ["segment"])
    spread_own = own.select("segment", "counts", "alert_ids", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    joined = found.select("segment", "block", "term", "weight", "uses", "places", "counts").unionByName(spread_own, allowMissingColumns=True)
    title_type, id_type = terms.schema["title_id"].dataType, alerts.schema[id_column].dataType
    schema = T.StructType([T.StructField("title_id", title_type), T.StructField("alert_id", id_type), T.StructField("score", T.LongType())])

    def search(table: pa.Table) -> pa.Table:
        mark = table.column("term").is_null()
        own_row = table.filter(mark).select(["counts", "alert_ids"]).to_pylist()[0]
        rows = table.filter(pc.invert(mark)).select(["weight", "uses", "places", "counts"]).to_pylist()
        found = list(search_segment(own_row, rows, n_alerts, n_words, k))
        title_kind, id_kind = table.schema.field("uses").type.value_type.field("title_id").type, table.schema.field("alert_ids").type.value_type
        kinds = (title_kind, id_kind, pa.int64())
        return pa.table([pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)], names=schema.names)

    best = joined.groupBy("segment", "block").applyInArrow(search, schema)
    order = Window.partitionBy("title_id").orderBy(F.desc("score"), F.asc_nulls_first("alert_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("title_id", "rank", "alert_id", "score")
