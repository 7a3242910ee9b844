"""Structured Streaming forms: keyed state, idempotent ingest, epoch windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from landpulse.operators.jobs import pending, work_key
from landpulse.session import scratch_path
from landpulse.streaming import transitions as t


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, exactly once, into a parquet table."""
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def lifecycle_stream(obs: DataFrame, key: str) -> DataFrame:
    """Lifecycle state per key and epoch. ``obs``: key (bigint), epoch, severity, resolvable.

    Rows of one key are put in epoch order inside a micro-batch; an epoch at or before the last
    one seen is late and passes through flagged, without changing the state.
    """
    out = f"{key} bigint, epoch int, state string, stress int, normal int, peak double, total int, late boolean"

    def advance(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, current = None, dict(t.LIFECYCLE_START)
        if state.exists:
            last, *values = state.get
            current = dict(zip(("state", "stress", "normal", "peak", "total"), values))
        rows = []
        for r in pd.concat(list(batches)).sort_values("epoch").itertuples():
            late = last is not None and r.epoch <= last
            if not late:
                severity = None if pd.isna(r.severity) else float(r.severity)
                current = t.lifecycle_step(current, severity, bool(r.resolvable))
                last = int(r.epoch)
            rows.append((k[0], int(r.epoch), *current.values(), late))
        state.update((last, *current.values()))
        yield pd.DataFrame(rows, columns=[key, "epoch", "state", "stress", "normal", "peak", "total", "late"])

    return obs.groupBy(key).applyInPandasWithState(advance, out, "last int, " + t.LIFECYCLE_STATE, "append", "NoTimeout")


def flag_repeats(stream: DataFrame, key: str, ledger: str, output: str, checkpoint: str) -> None:
    """Flood observations with ``repeated``: their hash was processed before, in whatever area.

    Evidence on hold processes nothing. The first row of a hash in the order (day, key, seq) of a
    micro-batch counts if no earlier batch has booked the hash; rows without a hash never count.
    Rows are written before their hashes are booked, both under the batch id, so that a repeated
    batch replaces its own.
    """
    position = ["day", key, "seq"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        free = ~F.col("status").isin(*t.FLOOD_HOLDS)
        booked = spark.read.schema("hash string, batch long").parquet(ledger).where(F.col("batch") != batch_id)
        first = batch.where(free).groupBy("hash").agg(F.min(F.struct(*position)).alias("_first")).join(booked, "hash", "left_anti")
        first = first.select("hash", *[F.col(f"_first.{c}").alias(c) for c in position], F.lit(False).alias("_again"))
        flagged = (batch.join(first, ["hash", *position], "left").withColumn("repeated", F.coalesce("_again", F.lit(True)))
                   .withColumn("batch", F.lit(batch_id).cast("long")).drop("_again"))
        flagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)
        (spark.read.schema(flagged.schema).parquet(output).where((F.col("batch") == batch_id) & free & ~F.col("repeated")).select("hash", "batch")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger))

    empty = stream.sparkSession.createDataFrame([], "hash string, batch long")
    empty.write.mode("append").partitionBy("batch").parquet(ledger)
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def flood_alert_stream(obs: DataFrame, key: str) -> DataFrame:
    """Alert transitions per area. ``obs``: key (bigint), day, seq, ha, hash, status, repeated
    (from ``flag_repeats``: a hash counts once over all areas).
    """
    out = f"{key} bigint, day date, seq bigint, transition string, severity string"

    def advance(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = dict(zip(("ha", "sev"), state.get)) if state.exists and state.get[1] is not None else None
        rows = []
        for r in pd.concat(list(batches)).sort_values(["day", "seq"]).itertuples():
            current, action, severity = t.flood_step(current, float(r.ha), r.status, bool(r.repeated))
            rows.append((k[0], r.day, r.seq, action, severity))
        state.update(tuple(current.values()) if current else (None, None))
        yield pd.DataFrame(rows, columns=[key, "day", "seq", "transition", "severity"])

    return obs.groupBy(key).applyInPandasWithState(advance, out, "ha double, sev string", "append", "NoTimeout")


def drought_alert_stream(obs: DataFrame, key: str) -> DataFrame:
    """Alert actions per tracked event. ``obs``: key (bigint), day (double), severity, blackout."""
    out = f"{key} bigint, day double, action string, tier string, alert_count int"

    def advance(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = dict(zip(("tier", "day", "count"), state.get)) if state.exists and state.get[0] is not None else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("day").itertuples():
            current, action, tier = t.drought_step(current, float(r.day), None if pd.isna(r.severity) else float(r.severity), bool(r.blackout))
            rows.append((k[0], float(r.day), action, tier, current["count"] if current else 0))
        state.update(tuple(current.values()) if current else (None, None, None))
        yield pd.DataFrame(rows, columns=[key, "day", "action", "tier", "alert_count"])

    return obs.groupBy(key).applyInPandasWithState(advance, out, "tier string, day double, n int", "append", "NoTimeout")


def idempotent_ingest(stream: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def epoch_windows(stream: DataFrame, key: str, event_time: str, value: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Closed epoch metrics per area; an epoch is emitted once the watermark has passed it."""
    return (stream.withWatermark(event_time, delay).groupBy(key, F.window(event_time, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak")))


def all_epoch_windows(stream: DataFrame, key: str, event_time: str, value: str, parts: str, late: str, checkpoint: str,
                      width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Metrics of every epoch per area, closed or not: (key, w, n, total, peak, is_open).

    An epoch is closed once the latest time seen lies ``delay`` behind its end; ``is_open`` marks the others
    as the input ends. Rows of an epoch that earlier batches have closed, and rows without a time, go to
    the table ``late``. Both tables hold their rows under the batch id, so a repeated batch replaces its own.
    """
    spark, kinds = stream.sparkSession, dict(stream.dtypes)
    part_schema = f"{key} {kinds[key]}, w struct<start: timestamp, end: timestamp>, n bigint, total {kinds[value]}, peak {kinds[value]}, latest timestamp, batch bigint"
    behind = lambda latest: latest - F.expr(f"INTERVAL {delay}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        seen = session.read.schema(part_schema).parquet(parts).where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        end = F.window(event_time, width)["end"]
        timed = batch.where(F.col(event_time).isNotNull())  # window() drops rows without a time
        split = (timed.withColumn("_late", F.lit(False) if seen is None else end <= behind(F.lit(seen)))
                 .unionByName(batch.where(F.col(event_time).isNull()).withColumn("_late", F.lit(True))))
        write = lambda df, path: (df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
                                  .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
        write(split.where("_late").drop("_late"), late)
        summed = split.where("NOT _late").groupBy(key, F.window(event_time, width).alias("w")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).cast(kinds[value]).alias("total"), F.max(value).alias("peak"), F.max(event_time).alias("latest"))
        write(summed, parts)

    for path, schema in ((parts, part_schema), (late, f"{', '.join(f'{c} {t}' for c, t in stream.dtypes)}, batch bigint")):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(path)
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(part_schema).parquet(parts)
    seen = found.agg(F.max("latest")).first()[0]
    out = found.groupBy(key, "w").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("peak").alias("peak"))
    return out.withColumn("is_open", F.col("w.end") > behind(F.lit(seen).cast("timestamp")))


def process_new_windows(stream: DataFrame, key_columns: list[str], ledger: str, output: str, checkpoint: str) -> None:
    """Micro-batches of work windows: only keys missing from the ledger are written and booked.

    The work is written before it is booked, under the batch id, so a repeated batch replaces
    its own rows instead of adding to them.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.select(*key_columns).distinct().withColumn("job_key", work_key(*[F.col(c).cast("string") for c in key_columns]))
        booked = spark.read.schema("job_key string, batch int").parquet(ledger).where(F.col("batch") != batch_id)
        fresh = pending(keyed, booked).withColumn("batch", F.lit(batch_id))
        (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output))
        (spark.read.schema(fresh.schema).parquet(output).where(F.col("batch") == batch_id).select("job_key", "batch")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger))

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_table(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Stage a batch table as a streaming source."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)
