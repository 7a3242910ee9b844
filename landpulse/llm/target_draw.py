"""Alerts drawn to look like a target set of alerts, by importance resampling of their messages.

Features are the words of ``message_body`` and the runs of neighbouring words. Each run of messages
interns its n-grams in an open-addressed table (``interning``) whose slots hold bucket and count, so
a bucket is computed once per distinct n-gram; every occurrence keeps its slot id and gathers its
gain through it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.llm import storage
from landpulse.llm.interning import InternTable, WordRun, word_runs
from landpulse.operators.ordered import bucketed, running_totals

BUCKETS = 10_000


class FeatureSlots:
    """Interned n-grams of one run of messages: ``bucket`` and ``count`` per used slot, and the slots
    of all occurrences, message after message for each n in turn."""

    def __init__(self, run: WordRun, longest: int, buckets: int):
        parts = [run.ngrams(n) for n in range(1, longest + 1)]
        self.sizes = [sizes for _, _, sizes in parts]
        self.table = InternTable(run.data, np.concatenate([s for s, _, _ in parts]), np.concatenate([e for _, e, _ in parts]))
        crc = np.fromiter(map(zlib.crc32, self.table.spans(run.data)), np.int64, len(self.table.used))
        self.bucket, self.count = crc % buckets, self.table.count[self.table.used]

    def totals(self, gains: np.ndarray) -> np.ndarray:
        """Sum of ``gains`` (per bucket) over each message's occurrences."""
        of_slot = np.zeros(self.table.slots, np.int64)
        of_slot[self.table.used] = gains[self.bucket]
        running = np.concatenate([[0], np.cumsum(of_slot[self.table.slot])])
        total, at = np.zeros(len(self.sizes[0]), np.int64), 0
        for sizes in self.sizes:
            ends = at + np.cumsum(sizes)
            total += running[ends] - running[ends - sizes]
            at = int(ends[-1]) if len(ends) else at
        return total


def feature_counts(alerts: DataFrame, longest: int = 2, buckets: int = BUCKETS, message: str = "message_body") -> np.ndarray:
    """Occurrences of all features of ``message`` per bucket: summed in tasks, then by Spark; at most
    ``buckets`` numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for run in word_runs(batch.column(0)):
                found = FeatureSlots(run, longest, buckets)
                np.add.at(held, found.bucket, found.count)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(held[used], pa.int64())], ["bucket", "n"])

    rows = alerts.select(F.col(message).cast("string").alias("m")).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the two add-one smoothed probabilities, per bucket."""
    buckets, targets, raws = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (raws + buckets) / ((s + 1) * (targets + buckets))))
                     for t, s in zip(target.astype(float).tolist(), raw.astype(float).tolist())], np.int64)


def message_weights(alerts: DataFrame, gains: np.ndarray, longest: int = 2, id_column: str = "alert_id", message: str = "message_body") -> DataFrame:
    """(alert_id, n_words, n_features, weight) of every row; weight is the floored mean gain, 0 without
    features."""
    rows = alerts.select(F.col(id_column).alias("alert_id"), F.col(message).cast("string").alias("message_body"))
    schema = T.StructType([T.StructField("alert_id", rows.schema["alert_id"].dataType)]
                          + [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for run in word_runs(batch.column(1)):
                found = FeatureSlots(run, longest, len(gains))
                words[run.begin:run.end], features[run.begin:run.end] = run.counts, sum(found.sizes)
                total[run.begin:run.end] = found.totals(gains)
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], schema.names)

    return rows.mapInArrow(weigh, schema)


def draw_like_target(alerts: DataFrame, target_alerts: DataFrame, percent: int = 25, min_words: int = 20, longest: int = 2, buckets: int = BUCKETS,
                     seed: str = "7", id_column: str = "alert_id", message: str = "message_body", target_message: str = "message_body") -> DataFrame:
    """(alert_id, n_features, weight, score, rank) of every alert: which alerts a draw that follows the
    messages of ``target_alerts`` takes, and in which order.

    Words are runs of letters, digits and non-ASCII characters, with only A-Z lower-cased; features are
    all runs of 1 to ``longest`` words, repeats counted. A feature's bucket is the crc32 of its bytes
    modulo ``buckets``. The gain of a bucket is floor(1000 ln) of its share in the target messages over
    its share in all messages (add-one smoothed); ``weight`` is the floored mean gain of a message's
    features. ``score`` adds Gumbel noise hashed from seed and id, so that taking the highest scores
    draws without replacement. Of the N alerts with ``min_words`` words or more, the
    floor(``percent`` * N / 100) highest scores have a ``rank`` (1, 2, ...); the others have NULL.

    Every message counts in the raw model, whole. A NULL or empty message has no features, weight 0 and
    is never drawn (unless ``min_words`` is 0). Equal scores rank by ascending id (NULL first); rows that
    repeat an id share their noise and, where all else is equal too, rank in any order among themselves.
    NULL ids share the noise of an empty id. An empty table gives no rows, an empty target leaves only
    the raw shares. Other columns, whatever their names, are ignored.
    """
    gains = bucket_gains(feature_counts(target_alerts, longest, buckets, target_message), feature_counts(alerts, longest, buckets, message))
    weighed = message_weights(alerts, gains, longest, id_column, message)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("alert_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = storage.stored(weighed.withColumn("score", F.col("weight") + noise), "scored-alerts")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("alert_id")]
    cut = bucketed(scored.where(able).withColumns({"_falling": -F.col("score"), "_one": F.lit(1)}), [], "_falling")
    place = F.col("cum__one").cast("long")
    ranked = running_totals(cut, [], order, "_bucket", ["_one"]).withColumn("rank", F.when(place <= drawn, place))
    columns = ["alert_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(columns))
