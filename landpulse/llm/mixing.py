"""Mixing alert sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landpulse.llm import storage

UNIT = float(1 << 52)


def hash_uniform(seed: str, *columns: Column) -> Column:
    """Number in [0, 1) from an md5 of seed and columns, the same in every engine and run."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(UNIT)


def poisson_table(mean: float) -> list[float]:
    """Cumulative probabilities of Poisson(mean) up to where doubles end: P(count <= k) for k = 0, 1, ..

    Terms are taken relative to the mode and scaled by their sum, so large means do not underflow.
    """
    if not mean > 0:
        return [1.0]
    mode = int(mean)
    up, down = [1.0], []
    k = mode
    while up[-1] > 1e-18:
        k += 1
        up.append(up[-1] * mean / k)
    value, k = 1.0, mode
    while k > 0 and value > 1e-18:
        value *= k / mean
        k -= 1
        down.append(value)
    terms = [0.0] * k + down[::-1] + up
    total, run, table = math.fsum(terms), 0.0, []
    for t in terms:
        run += t
        table.append(min(1.0, run / total))
    return table


def source_rates(alerts: DataFrame, targets: Mapping[str, float] | None = None, smoothing: float = 0.5, epochs: float = 1.0,
                 source: str = "aoi_name", size: Column | None = None) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its target share.

    Shares are of ``size`` (rows by default). Without ``targets`` the share of a source goes with
    its size to the power ``smoothing``. ``epochs`` is the size of the mix in units of the input.
    A source missing from ``targets``, or without size, gets rate 0. NULL is a source of its own.
    """
    sizes = alerts.groupBy(F.col(source).alias("_mix_source")).agg(F.sum((size if size is not None else F.lit(1)).cast("long")).alias("_size"))
    if targets is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(smoothing))
    else:
        weight = F.lit(0.0)
        for name, share in targets.items():
            weight = F.when(F.col("_mix_source") == name, F.lit(float(share))).otherwise(weight)
    weighted = sizes.select("_mix_source", "_size", F.when(F.col("_size") > 0, weight).otherwise(0.0).alias("_weight"))
    totals = weighted.agg(F.sum("_size").alias("n"), F.sum("_weight").alias("w")).first()  # one row
    everything, weights = float(totals["n"] or 0), float(totals["w"] or 0)
    rate = F.lit(epochs) * F.col("_weight") / F.lit(weights or 1.0) * F.lit(everything) / F.col("_size")
    return weighted.select("_mix_source", F.when(F.col("_weight") > 0, rate).otherwise(0.0).alias("_rate"))


def replicate_to_weights(alerts: DataFrame, targets: Mapping[str, float] | None = None, smoothing: float = 0.5, epochs: float = 1.0,
                         seed: str = "mix", id_column: str = "alert_id", source: str = "aoi_name", size: Column | None = None,
                         max_sources: int = 100_000) -> DataFrame:
    """Alerts repeated to reach target source weights, in a global random order.

    The number of copies of an alert is Poisson distributed with its source's rate: a uniform number
    hashed from seed and alert id is inverted through the cumulative distribution. Copies are
    exploded and then shuffled by a hash of seed, id and copy: the rows come sorted by
    ``mix_order`` over range partitions. All columns travel along, with ``mix_copy`` (from 0),
    ``mix_copies`` and ``mix_order`` added (same-named columns of the input are replaced).

    Rates need one row per source; with up to ``max_sources`` sources they travel as a broadcast
    of that bounded size, otherwise as a plain join whose hot source adaptive execution splits.
    Alerts with NULL ids share one draw per source, as do rows that repeat an id; a NULL source is a
    source of its own; an empty table stays empty.
    """
    rates = source_rates(alerts, targets, smoothing, epochs, source, size)
    table = storage.stored(rates, "source-rates")
    cumulative = F.udf(poisson_table, "array<double>")  # one call per source, not per row
    tables = table.select("_mix_source", cumulative("_rate").alias("_mix_table"))
    few = table.limit(max_sources + 1).count() <= max_sources
    joined = alerts.join(F.broadcast(tables) if few else tables, F.col(source).eqNullSafe(F.col("_mix_source")), "left")
    drawn = hash_uniform(f"{seed}|count", F.col(id_column), F.col(source))
    counted = (joined.withColumn("mix_copies", F.size(F.filter("_mix_table", lambda p: p <= drawn)).cast("int")).drop("_mix_source", "_mix_table")
               .where("mix_copies > 0"))
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    keyed = copies.withColumn("mix_order", hash_uniform(f"{seed}|order", F.col(id_column), F.col("mix_copy")))
    return keyed.repartitionByRange("mix_order", id_column, "mix_copy").sortWithinPartitions("mix_order", id_column, "mix_copy")
