"""Quality selection of alert messages by importance resampling.

Two generative models of hashed n-grams, one of target text and one of raw text, give every message
the log ratio of its probabilities. Gumbel noise on these ratios turns taking the k largest into
drawing k messages without replacement, with chances in proportion to the ratios.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landpulse.llm import storage
from landpulse.llm.lexing import CLASS, Lexer, batches_of, mix64, span_hashes, symbols_of
from landpulse.llm.mixing import hash_uniform

BUCKETS = 1 << 17
_LEXER: list[Lexer] = []


def bucket_features(texts: Sequence[str], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, bucket, text) of all words and pairs of neighbours.

    Words are runs of letters, digits or punctuation. A word behind itself counts as one and the
    same pair whatever the word, so that repetition is a feature of its own.
    """
    if not _LEXER:
        _LEXER.append(Lexer("word"))
    for begin, end in batches_of(texts):
        _, codes, _, _ = symbols_of(texts[begin:end], {}, -1)
        starts, classes = _LEXER[0].cut(codes)
        ends = np.append(starts[1:], len(codes))
        closes = classes == CLASS["end"]
        owner = np.cumsum(closes) - closes
        words = ~closes & (classes != CLASS["blank"]) & (classes != CLASS["space"])
        one, owner = span_hashes(codes, starts[words], ends[words]), owner[words]
        two = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        two[one[:-1] == one[1:]] = np.uint64(1)
        inside = owner[:-1] == owner[1:]
        hashes = np.concatenate([one, two[inside]])
        yield begin, end, (hashes % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def bucket_counts(alerts: DataFrame, is_target: Column, buckets: int = BUCKETS, message: str = "message_body") -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket of target and of raw messages.

    Raw text is every message; a message is target text where ``is_target`` holds. Counted inside
    tasks and summed by Spark; 2 * ``buckets`` numbers reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for begin, _, bucket, owner in bucket_features(batch.column(0).to_pylist(), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[chosen[begin + owner]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    rows = alerts.select(F.coalesce(F.col(message), F.lit("")).alias("m"), F.coalesce(is_target, F.lit(False)).alias("t"))
    summed = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in summed.toLocalIterator():  # at most `buckets` rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return target, raw


def own_log_ratios(bucket: np.ndarray, owner: np.ndarray, chosen: np.ndarray, target: np.ndarray, raw: np.ndarray,
                   smoothing: float) -> np.ndarray:
    """Sum over each text's n-grams of log(target probability / raw probability), by models of all
    other texts: the text's own counts are taken off, so that target texts have no advantage.

    A bucket's ratio is (target count + s) / (count expected from the raw share + s), with ``s`` the
    ``smoothing``: rare n-grams say little either way.
    """
    texts, share = len(chosen), target.sum() / max(1.0, raw.sum())
    both, own = np.unique(owner * len(raw) + bucket, return_counts=True)
    who, where = both // len(raw), both % len(raw)
    held = np.maximum(target[where] - own * chosen[who], 0.0)
    expected = np.maximum(raw[where] - own, 0.0) * share
    return np.bincount(who, own * np.log((held + smoothing) / (expected + smoothing)), texts)


def ratio_scores(alerts: DataFrame, target: np.ndarray, raw: np.ndarray, is_target: str, smoothing: float = 2.0,
                 message: str = "message_body") -> DataFrame:
    """Adds ``log_ratio``, summed over the message's n-grams, and ``n_grams``; columns of these names
    are replaced. Without target text every ratio is 0."""
    kept = alerts.drop("log_ratio", "n_grams")
    columns, buckets, fitted = kept.columns, len(raw), bool(target.any())
    place, mark = columns.index(message), columns.index(is_target)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            chosen = batch.column(mark).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for begin, end, bucket, owner in bucket_features(batch.column(place).fill_null("").to_pylist(), buckets):
                if fitted:
                    totals[begin:end] = own_log_ratios(bucket, owner, chosen[begin:end], target, raw, smoothing)
                sizes[begin:end] = np.bincount(owner, minlength=end - begin)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals), pa.array(sizes)], [*columns, "log_ratio", "n_grams"])

    return kept.mapInArrow(score, kept.select("*", F.lit(0.0).alias("log_ratio"), F.lit(0).cast("long").alias("n_grams")).schema)


def gumbel_noise(seed: str, *columns: Column) -> Column:
    """Standard Gumbel noise hashed from seed and columns, the same in every run."""
    u = (hash_uniform(seed, *columns) * float((1 << 52) - 1) + 0.5) / float(1 << 52)  # inside (0, 1)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The ``k``-th largest value; -inf from the number of rows on.

    Each round counts the rows of ``bins`` equal parts of the interval that holds it, until few
    values are left; neither rows nor more than ``bins`` numbers reach the driver at once.
    """
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if k >= ends["n"]:
        return float("-inf")
    if k <= 0:
        return float("inf")
    lo, hi, left = ends["lo"], ends["hi"], k
    value = F.col(column)
    while True:
        inside = rows.where((value >= lo) & (value <= hi))
        width = (hi - lo) / bins
        if not width or lo + width == lo:
            return lo
        counted = inside.groupBy(F.least(F.floor((value - lo) / width), F.lit(bins - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for r in sorted(counted, key=lambda r: -r["bin"]):
            if left <= r["n"]:
                lo, hi, few = r["lo"], r["hi"], r["n"] <= bins
                break
            left -= r["n"]
        if few:
            return sorted((r[0] for r in rows.where((value >= lo) & (value <= hi)).select(column).collect()), reverse=True)[left - 1]


def best_cut(scored: DataFrame, good: str) -> float:
    """Cut on ``log_ratio`` that best separates labelled good from bad messages (sum of both rates),
    the lowest of several, from counts of quarter-wide classes within +-200; -inf without either."""
    at = F.floor(F.least(F.greatest(F.col("log_ratio"), F.lit(-200.0)), F.lit(200.0)) * 4)
    counts = scored.where(F.col(good).isNotNull()).groupBy(at.alias("at")).agg(
        F.count_if(F.col(good)).alias("good"), F.count_if(~F.col(good)).alias("bad")).collect()  # at most 1,601 rows
    good_all, bad_all = sum(r["good"] for r in counts), sum(r["bad"] for r in counts)
    if not good_all or not bad_all:
        return float("-inf")
    best, cut, lost, caught = 1.0, float("-inf"), 0, 0
    for r in sorted(counts, key=lambda r: r["at"]):
        lost, caught = lost + r["good"], caught + r["bad"]
        rate = (good_all - lost) / good_all + caught / bad_all
        if rate > best + 1e-12:
            best, cut = rate, (r["at"] + 1) / 4
    return cut


def resample_by_quality(alerts: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, label_sample: int = 20_000,
                        seed: str = "quality-1", id_column: str = "alert_id", message: str = "message_body") -> DataFrame:
    """Every alert with ``log_ratio``, ``n_grams``, ``gumbel_key`` and ``kept``: whether it is drawn.

    ``labels`` (alert_id, quality) names good (1) and bad (0) messages. Up to ``label_sample`` of them,
    those with the smallest hash of their id, fit the selection: the good ones are the target text, and
    both tell how many messages ``k`` to draw, as many as lie above the ratio that separates them best.
    The raw model and all scores cover every message; a message is scored by the counts of all others.
    Rows that tie with the k-th are drawn too.

    A NULL message is empty and, like one without words, has ratio 0. Rows with NULL ids share one
    noise value, as do rows that repeat an id. An id labelled twice counts with its larger quality. Without good or without bad
    labels everything is kept. Other columns travel along, those of the added names are replaced; an
    empty table stays empty.
    """
    known = (labels.where(F.col("quality").isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_labelled"))
             .agg((F.max("quality") == 1).alias("_good")).orderBy(F.xxhash64("_labelled")).limit(label_sample))
    fitted = storage.stored(known, "labels")  # at most `label_sample` rows
    joined = alerts.drop("_labelled", "_good").join(F.broadcast(fitted), F.col(id_column) == F.col("_labelled"), "left").drop("_labelled")
    target, raw = bucket_counts(joined, F.col("_good"), buckets, message)
    scored = ratio_scores(joined, target, raw, "_good", message=message)
    scored = scored.withColumn("gumbel_key", F.col("log_ratio") + gumbel_noise(seed, F.col(id_column)))
    keys = storage.stored(scored.select("log_ratio", "gumbel_key", "_good"), "ratios")
    if k is None:
        cut = best_cut(keys, "_good")
        k = keys.where(F.col("log_ratio") >= cut).count()
    least = kth_largest(keys, "gumbel_key", k)
    return scored.withColumn("kept", F.col("gumbel_key") >= least).drop("_good")
