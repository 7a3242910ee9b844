"""Object overlap and one-to-one matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landpulse.operators.components import graph_components
from landpulse.operators.groups import whole_groups
from landpulse.session import cut_lineage


TIE_STEP = 1e-11  # pairs of equal weight differ by less than 1009 of these


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared cells, sizes and IoU of touching objects.

    ``left``/``right``: one row per cell with object id columns ``p`` and ``r``.
    """
    shared = (left.join(right, [*keys, "row", "col"]).groupBy(*keys, "p", "r")
              .agg(F.count(F.lit(1)).alias("n_shared")))
    size_p = left.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n_p"))
    size_r = right.groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("n_r"))
    union = F.col("n_p") + F.col("n_r") - F.col("n_shared")
    return (shared.join(size_p, [*keys, "p"]).join(size_r, [*keys, "r"])
            .withColumn("iou", F.col("n_shared") / union))


def _best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum-count, then maximum-weight matching (shortest augmenting paths).

    Ineligible pairs carry weight 0 and cost as much as leaving the rows unmatched.
    """
    n, m = weight.shape
    if n > m:
        return [(i, j) for j, i in _best_assignment(weight.T)]
    cost = np.where(weight > 0, -weight, 2.0 * n + 2.0)  # more than any rearrangement of the others can win
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        shortest, previous = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, column, base = i, -1, 0.0
        scanned = []
        while True:
            reduced = base + cost[row] - u[row] - v
            better = ~done & (reduced < shortest)
            shortest[better], previous[better] = reduced[better], column
            column = int(np.argmin(np.where(done, np.inf, shortest)))
            base = shortest[column]
            done[column] = True
            scanned.append(column)
            if owner[column] < 0:
                break
            row = owner[column]
        u[i] += base
        for j in scanned[:-1]:
            u[owner[j]] += base - shortest[j]
            v[j] -= base - shortest[j]
        while column >= 0:
            back = previous[column]
            owner[column] = owner[back] if back >= 0 else i
            column = back
    return [(int(owner[j]), j) for j in range(m) if owner[j] >= 0 and weight[owner[j], j] > 0]


def assign_one_to_one(pairs: DataFrame, keys: Sequence[str], p: str = "p", r: str = "r",
                      weight: str = "iou") -> DataFrame:
    """Matched (keys, p, r, weight): most pairs first, then most total weight; among equal totals the
    ids decide: each pair adds (31 p + 17 r) mod 1009 steps of ``TIE_STEP``.

    Pairs whose two ends have no other partner are final at once. The rest falls into connected
    groups of competing objects, solved independently. Objects of one side do not overlap, so an
    object has at most 1/threshold partners and groups stay small.
    """
    keys = list(keys)
    per_p, per_r = Window.partitionBy(*keys, p), Window.partitionBy(*keys, r)
    degree = cut_lineage(pairs.select(*keys, p, r, weight).withColumns(
        {"_dp": F.count(F.lit(1)).over(per_p), "_dr": F.count(F.lit(1)).over(per_r)}))
    alone = degree.where("_dp = 1 AND _dr = 1").drop("_dp", "_dr")
    rest = degree.where("_dp > 1 OR _dr > 1").drop("_dp", "_dr")
    if rest.isEmpty():
        return alone
    # both sides share one node space: p doubled, r doubled plus one
    edges = rest.select(*keys, (F.col(p) * 2).alias("src"), (F.col(r) * 2 + 1).alias("dst"))
    groups = graph_components(edges, keys).select(*keys, (F.col("node") / 2).cast("bigint").alias(p), "component", "node").where("node % 2 = 0").drop("node")
    grouped = rest.join(groups, [*keys, p])

    by, columns = [*keys, "component"], alone.columns

    def solve(table: pa.Table, group: np.ndarray) -> pa.Table:
        ps, rs, ws = (table.column(c).to_numpy() for c in (p, r, weight))
        ranked = ws + TIE_STEP * ((ps * 31 + rs * 17) % 1009)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        won: list[int] = []
        for begin, end in zip(starts, np.append(starts[1:], len(group))):
            mine = slice(begin, end)
            left, i = np.unique(ps[mine], return_inverse=True)
            right, j = np.unique(rs[mine], return_inverse=True)
            if len(left) == 1 or len(right) == 1:
                best = begin + int(np.argmax(ranked[mine]))
                won += [best] if ranked[best] > 0 else []
                continue
            cells, at = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), np.int64)
            cells[i, j], at[i, j] = ranked[mine], np.arange(begin, end)
            won += [int(at[x]) for x in _best_assignment(cells)]
        return table.take(pa.array(won, pa.int64())).select(columns)

    # the work lies in the groups, not in their bytes: a given number of parts is not drawn together
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.select(*alone.columns, "component").repartition(parts, *by).sortWithinPartitions(*by, p, r)
    return alone.unionByName(dealt.mapInArrow(whole_groups(by, solve), alone.schema))


def match_by_priority(pairs: DataFrame, keys: Sequence[str], left: str, right: str, weight: str,
                      priority: str) -> DataFrame:
    """Each left object in order of ``priority`` takes its heaviest right object still free.

    With one common priority this is the unique stable matching, so it is reached by rounds of
    proposals: every left object asks for its best remaining partner, each right object keeps
    the asker of best priority, and the refused pairs are removed until none is refused.
    """
    open_pairs = pairs
    while True:
        ask = Window.partitionBy(*keys, left).orderBy(F.desc(weight), F.asc(right))
        keep = Window.partitionBy(*keys, right, "_asked").orderBy(F.asc(priority))
        marked = open_pairs.withColumn("_asked", F.row_number().over(ask) == 1)
        marked = marked.withColumn("_kept", F.col("_asked") & (F.row_number().over(keep) == 1))
        marked = cut_lineage(marked)
        if marked.where("_asked AND NOT _kept").isEmpty():
            return marked.where("_kept").drop("_asked", "_kept")
        open_pairs = marked.where("NOT _asked OR _kept").drop("_asked", "_kept")
