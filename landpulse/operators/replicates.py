"""Bootstrap replicates as a matrix: resampled sums without a row per unit and replicate.

A unit (station, spatial block) counts with a Poisson(1) weight in each replicate. Weights come from a
counter: a digest of the unit's name and the replicate's number, mixed in whole numbers, so that
every run and every engine draws the same. Tasks multiply their rows by these weights in numpy and
hand on one array per group, which are then added up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLICATES = 1000
PRIME = 2147483647
# Steps of the counter and multipliers of its rounds, all below the prime.
UNIT_STEP, REPLICATE_STEP, ROUNDS = 48271, 69621, (1664525, 22695477, 1103515245)
CHUNK = 512  # units whose weights are drawn together
GROUPS_HELD = 4096


def poisson_steps(mean: float = 1.0) -> list[float]:
    """Cumulative Poisson probabilities up to the last that a draw of the counter can reach."""
    steps, p, total = [], math.exp(-mean), 0.0
    while total + p <= (PRIME - 1) / PRIME and p > 0:
        total += p
        steps.append(total)
        p *= mean / len(steps)
    return steps


def unit_number(unit: Sequence[Column], seed: int) -> Column:
    """32 bits of a digest of the unit's name and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *unit, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def poisson_weights(units: np.ndarray, replicates: int) -> np.ndarray:
    """(units, replicates) weights."""
    x = (units[:, None] % PRIME * UNIT_STEP + np.arange(1, replicates + 1) * REPLICATE_STEP) % PRIME
    for factor in ROUNDS:
        x = (x ^ (x >> 15)) * factor % PRIME
    return np.searchsorted(poisson_steps(), x / PRIME, side="right").astype(float)


def weights_sql(units: str, out: str, replicates: int = REPLICATES, seed: int = 42) -> str:
    """The same weights in SQL: table ``out`` (unit, b, w) for the names in ``units`` (unit)."""
    ctes = [f"""{out}_0 AS (SELECT unit, b.i AS b, (('0x' || substr(md5(concat_ws('|', unit, '{seed}')), 1, 8))::BIGINT % {PRIME} * {UNIT_STEP} + b.i * {REPLICATE_STEP}) % {PRIME} AS x
  FROM {units}, range(1, {replicates + 1}) b(i))"""]
    for i, factor in enumerate(ROUNDS):
        ctes.append(f"{out}_{i + 1} AS (SELECT unit, b, xor(x, x >> 15) * {factor} % {PRIME} AS x FROM {out}_{i})")
    count = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in poisson_steps())
    return ",\n".join(ctes) + f",\n{out} AS (SELECT unit, b, {count} AS w FROM (SELECT unit, b, x / {PRIME}.0::DOUBLE AS u FROM {out}_{len(ROUNDS)}))"


def _distinct(columns: Sequence[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct combination, number of the combination of every row)."""
    code = np.zeros(rows, np.int64)
    for column in columns:
        encoded = column.dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(len(encoded.dictionary), 1) + encoded.indices.to_numpy(), return_inverse=True)[1]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return first, number


def replicate_sums(rows: DataFrame, unit: Sequence[Column], groups: Sequence[str], values: Sequence[str],
                   replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(groups, one array per value): sums of each value over the group's rows, weighted by unit, one
    entry per replicate. A NULL value adds nothing.

    Meant for groups by the thousand at most (bins, score levels): each holds ``replicates`` numbers per
    value and task. Rows are first summed per unit and group and listed per unit, so that a unit's
    weights are drawn once. A task passes its sums on once it holds ``GROUPS_HELD`` groups; they are
    added up in two steps, 64 tasks at a time, so that no group gathers an array from every task of a large job.
    """
    fields = [rows.schema[g] for g in groups]
    arrays = [T.StructField(v, T.ArrayType(T.DoubleType())) for v in values]
    partial = T.StructType([T.StructField("_part", T.IntegerType()), *fields, *arrays])
    merged = T.StructType([*fields, *arrays])
    names = list(groups)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kinds = TaskContext.get().partitionId() // 64, {}, []

        def passed_on() -> pa.RecordBatch:
            keys, sums = list(held), np.array(list(held.values()))
            held.clear()
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
            offsets = pa.array(np.arange(len(keys) + 1) * replicates, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(sums[:, i].ravel())) for i in range(len(values))]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), *columns, *lists], partial.names)

        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                chunk = batch.slice(begin, CHUNK)
                weights = poisson_weights(chunk.column(0).to_numpy(), replicates)
                listed = chunk.column(1)
                owner = np.repeat(np.arange(chunk.num_rows), np.diff(listed.offsets.to_numpy()))
                cells = listed.flatten()
                keyed = [cells.field(i) for i in range(len(names))]
                kinds = [c.type for c in keyed]
                first, number = _distinct(keyed, len(cells))
                keys = list(zip(*(c.take(pa.array(first)).to_pylist() for c in keyed))) if names else [()] * len(first)
                table = np.zeros((len(values), len(first), chunk.num_rows))
                for i in range(len(values)):
                    table[i, number, owner] = cells.field(len(names) + i).to_numpy(zero_copy_only=False)
                for i, sums in enumerate(np.swapaxes(table @ weights, 0, 1)):
                    held[keys[i]] = held.get(keys[i], 0.0) + sums
                if len(held) >= GROUPS_HELD:
                    yield passed_on()
        if held:
            yield passed_on()

    def added(table: pa.Table, columns: Sequence[str]) -> pa.Table:
        lists = []
        for v in values:
            flat = table.column(v).combine_chunks().flatten().to_numpy()
            lists.append(pa.ListArray.from_arrays(pa.array([0, replicates], pa.int32()), pa.array(flat.reshape(-1, replicates).sum(axis=0))))
        return pa.table([*[table.column(c).slice(0, 1) for c in columns], *lists], names=[*columns, *values])

    named = rows.withColumn("_unit", F.concat_ws("|", *unit))
    summed = named.groupBy("_unit", *names).agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("double").alias(v) for v in values])
    listed = summed.groupBy("_unit").agg(F.collect_list(F.struct(*names, *values)).alias("_cells"))
    parts = listed.select(unit_number([F.col("_unit")], seed).alias("_unit"), "_cells").mapInArrow(weigh, partial)
    halfway = parts.groupBy("_part", *names).applyInArrow(lambda t: added(t, ["_part", *names]), partial)
    return halfway.groupBy(*names).applyInArrow(lambda t: added(t, names), merged)


def replicate_intervals(sums: DataFrame, groups: Sequence[str], measures: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]],
                        names: Sequence[str], quantiles: dict[str, float], order: str | None = None) -> DataFrame:
    """Per group the quantiles of each measure over the replicates: ``<measure>_<quantile name>``, and
    ``<measure>_n``, how many replicates define it.

    ``measures`` turns the group's sums, one (rows, replicates) matrix per value with rows ascending by
    the column ``order``, which comes along, into one number per replicate and measure; NaN counts as
    undefined.
    """
    values = [c for c in sums.columns if c not in groups and c != order]
    fields = [T.StructField(f"{m}_{q}", T.DoubleType()) for m in names for q in quantiles] + [T.StructField(f"{m}_n", T.LongType()) for m in names]
    schema = T.StructType([*[sums.schema[g] for g in groups], *fields])
    kept = list(groups)

    def interval(table: pa.Table) -> pa.Table:
        rows = table.sort_by(order) if order else table
        matrix = {v: rows.column(v).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) for v in values}
        found = measures(matrix | ({order: rows.column(order).to_numpy()} if order else {}))
        out, counts = [], []
        for m in names:
            known = found[m][~np.isnan(found[m])]
            out += [pa.array([float(np.quantile(known, q)) if len(known) else None], pa.float64()) for q in quantiles.values()]
            counts.append(pa.array([len(known)]))
        return pa.table([*[rows.column(g).slice(0, 1) for g in kept], *out, *counts], names=schema.names)

    return sums.groupBy(*kept).applyInArrow(interval, schema)


def curve_measures(alarm_level: int) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """precision, recall and f1 of alarms from ``alarm_level`` on, and the PR area over all levels, per
    replicate, from counts ``pos`` and ``neg`` of the score levels present (``level``, ascending).

    The area is summed by trapezoids from (recall 0, precision 1) down the levels; it is 0 without
    positives, as is a ratio with an empty denominator.
    """
    def measures(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        pos, neg = counts["pos"], counts["neg"]
        ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
        alarm = counts["level"] >= alarm_level
        tp, fp, all_pos = pos[alarm].sum(axis=0), neg[alarm].sum(axis=0), pos.sum(axis=0)
        precision, recall = ratio(tp, tp + fp), ratio(tp, all_pos)
        down_pos, down = np.cumsum(pos[::-1], axis=0), np.cumsum((pos + neg)[::-1], axis=0)
        at = ratio(down_pos, down)
        before = np.where(down[:-1] > 0, at[:-1], 1.0)
        before = np.vstack([np.ones((1, pos.shape[1])), before])
        area = ratio(pos[::-1] * (at + before) / 2.0, np.broadcast_to(all_pos, pos.shape)).sum(axis=0)
        return {"precision": precision, "recall": recall, "f1": ratio(2.0 * precision * recall, precision + recall), "pr_auc": area}

    return measures


def correlation_measure(moments: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Pearson r per replicate from ``n, x, y, xx, yy, xy``; NaN without variance."""
    n, x, y, xx, yy, xy = (moments[k][0] for k in ("n", "x", "y", "xx", "yy", "xy"))
    vx, vy = n * xx - x * x, n * yy - y * y
    known = (vx > 1e-12) & (vy > 1e-12)
    r = np.full(len(n), np.nan)
    r[known] = (n * xy - x * y)[known] / np.sqrt(vx[known]) / np.sqrt(vy[known])
    return {"r": r}
