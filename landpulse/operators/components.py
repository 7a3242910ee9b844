"""Connected components of grids and of general graphs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.operators.groups import whole_groups
from landpulse.session import cut_lineage, stored

BLOCK = 256
_SHIFT = 32


def _steps(connectivity: int) -> list[tuple[int, int]]:
    """Half of the neighbours; the other half finds the same pairs."""
    return [(0, 1), (1, 0)] + ([(1, -1), (1, 1)] if connectivity == 8 else [])


def _joined(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each number's set, where ``a[i]`` and ``b[i]`` belong together."""
    parent = np.arange(count)
    while True:
        pa_, pb = parent[a], parent[b]
        differ = pa_ != pb
        if not differ.any():
            return parent
        np.minimum.at(parent, np.maximum(pa_, pb)[differ], np.minimum(pa_, pb)[differ])
        while True:
            jump = parent[parent]
            if np.array_equal(jump, parent):
                break
            parent = jump


def _touching(group: np.ndarray, rows: np.ndarray, cols: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of distinct cells, number of the distinct cell of each row, pairs of distinct cells that
    touch inside one group). Distinct cells are in (group, row, column) order."""
    height, width = int(rows.max() - rows.min()) + 3, int(cols.max() - cols.min()) + 3
    code = (group.astype(np.int64) * height + (rows - rows.min() + 1)) * width + (cols - cols.min() + 1)  # a free border around each group
    distinct, first, number = np.unique(code, return_index=True, return_inverse=True)
    a, b = [], []
    for dr, dc in _steps(connectivity):
        target = distinct + dr * width + dc
        at = np.minimum(np.searchsorted(distinct, target), len(distinct) - 1)
        hit = np.flatnonzero(distinct[at] == target)
        a.append(hit)
        b.append(at[hit])
    return first, number, np.concatenate(a), np.concatenate(b)


def _left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys meet NULL keys."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(named[f"_on_{c}"])
    return left.join(named, same, "left").drop(*[f"_on_{c}" for c in on])


def label_cells(cells: DataFrame, keys: Sequence[str], connectivity: int = 8, block: int = BLOCK) -> DataFrame:
    """Adds ``label``: the code of the first cell (in row, column order) of the component.

    All columns of ``cells`` travel along, so no join is needed to get them back; select the
    wanted ones first. Cells are labelled inside square blocks and written out once. Blocks are
    then merged two by two in both directions, level by level, until one is left (see
    ``merge_blocks``); grids of a single block need no merging at all.
    """
    placed = cells.withColumns({
        "_br": F.floor(F.col("row") / block).cast("int"), "_bc": F.floor(F.col("col") / block).cast("int")})
    schema = T.StructType(placed.schema.fields + [T.StructField("label", T.LongType())])
    by = [*keys, "_br", "_bc"]

    def label_blocks(table: pa.Table, group: np.ndarray) -> pa.Table:
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        inner_r, inner_c = row - table.column("_br").to_numpy().astype(np.int64) * block, col - table.column("_bc").to_numpy().astype(np.int64) * block
        first, number, a, b = _touching(group, inner_r, inner_c, connectivity)
        code = (row[first] << _SHIFT) | col[first]
        return table.append_column("label", pa.array(code[_joined(len(first), a, b)][number], pa.int64()))

    sorted_blocks = placed.repartition(*by).sortWithinPartitions(*by)
    labelled = stored(sorted_blocks.mapInArrow(whole_groups(by, label_blocks), schema), "labelled")
    merged = merge_blocks(labelled, keys, connectivity, block)
    if merged is None:
        return labelled.drop("_br", "_bc")
    joined = _left_join(labelled, merged, [*keys, "label"])
    return joined.withColumn("label", F.coalesce("_to", "label")).drop("_to", "_br", "_bc")


def merge_blocks(labelled: DataFrame, keys: Sequence[str], connectivity: int, block: int) -> DataFrame | None:
    """(keys, label, _to) of the labels that change when touching blocks are joined; None if every grid
    has a single block.

    A level joins 2 x 2 blocks: only cells on the blocks' outer borders travel, to the task of the
    larger block, which unites their labels and hands its own border on. So n blocks a side take
    log2(n) passes, and a task holds the border cells of four blocks. Renamings of the levels are
    composed from the last one down.
    """
    keys = list(keys)
    ends = labelled.agg(*[f(c).alias(f"{c}{n}") for c in ("_br", "_bc") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["_brlo"] is None:
        return None
    row0, col0 = ends["_brlo"] * block, ends["_bclo"] * block
    levels = max(ends["_brhi"] - ends["_brlo"], ends["_bchi"] - ends["_bclo"]).bit_length()
    at = lambda c, zero, size: F.pmod(F.col(c) - zero, F.lit(size)).isin(0, size - 1)
    border = labelled.where(at("row", row0, block) | at("col", col0, block)).select(*keys, "row", "col", "label")
    by = [*keys, "_gr", "_gc"]
    renamed = []
    for level in range(1, levels + 1):
        size, last = block << level, level == levels
        placed = border.withColumns({"_gr": F.floor((F.col("row") - row0) / size).cast("int"), "_gc": F.floor((F.col("col") - col0) / size).cast("int")})
        schema = T.StructType([*[placed.schema[k] for k in keys], T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
                               T.StructField("label", T.LongType()), T.StructField("_to", T.LongType())])

        def unite(table: pa.Table, group: np.ndarray, size=size, last=last) -> pa.Table:
            row, col, label = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "label"))
            first, number, a, b = _touching(group, row, col, connectivity)
            order = np.lexsort((label, group))
            new = np.append(True, (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1]))
            name = np.empty(len(label), np.int64)
            name[order] = np.cumsum(new) - 1  # labels numbered in ascending order inside each group
            value, holder = label[order][new], order[new]
            to = value[_joined(len(value), name[first][a], name[first][b])]
            changed = np.flatnonzero(to != value)
            out = [holder[changed]]
            if not last:
                r, c = (row - row0) % size, (col - col0) % size
                out.append(np.flatnonzero((r == 0) | (r == size - 1) | (c == 0) | (c == size - 1)))
            rows = np.concatenate(out)
            renaming = np.arange(len(rows)) < len(changed)
            return pa.table([*[table.column(k).take(pa.array(rows)) for k in keys], pa.array(row[rows], pa.int32(), mask=renaming), pa.array(col[rows], pa.int32()),
                             pa.array(np.where(renaming, label[rows], to[name[rows]])), pa.array(to[name[rows]])], names=schema.names)

        step = placed.repartition(*by).sortWithinPartitions(*by).mapInArrow(whole_groups(by, unite), schema)
        step = step if last else stored(step, "borders")
        renamed.append(step.where("row IS NULL").select(*keys, "label", "_to"))
        border = step.where("row IS NOT NULL").select(*keys, "row", "col", "label")
    if not renamed:
        return None
    total = renamed[-1]
    for step in renamed[-2::-1]:
        total = stored(total, "renamed")
        on = total.select(*keys, F.col("label").alias("_to"), F.col("_to").alias("_end"))
        total = _left_join(step, on, [*keys, "_to"]).select(*keys, "label", F.coalesce("_end", "_to").alias("_to")).unionByName(total)
    return total


def graph_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, component) with component = smallest node id, by alternating star steps.

    ``edges`` has columns ``src``, ``dst`` (orderable). Each step replaces the edges of a node
    by edges to its smallest neighbour. The smallest neighbour comes from partial aggregation, and
    the join back is a plain equi-join: the node table is as large as the graph, so copying it per
    salt would cost more than a hub, whose partition adaptive execution splits. Every round is
    checkpointed. Ends when the edge set no longer changes.
    """
    keys = list(keys)

    def both_ways(e: DataFrame) -> DataFrame:
        return e.select(*keys, "src", "dst").union(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))

    def large_star(e: DataFrame) -> DataFrame:
        pairs = both_ways(e)
        low = pairs.groupBy(*keys, "src").agg(F.least(F.min("dst"), F.col("src")).alias("_m"))
        hit = pairs.where("dst > src").join(low, [*keys, "src"])
        return hit.select(*keys, F.col("dst").alias("src"), F.col("_m").alias("dst")).where("src <> dst").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(*keys, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy(*keys, "src").agg(F.min("dst").alias("_m"))
        hit = down.join(low, [*keys, "src"])
        to_low = hit.select(*keys, F.col("dst").alias("src"), F.col("_m").alias("dst"))
        own = low.select(*keys, "src", F.col("_m").alias("dst"))
        return to_low.union(own).where("src <> dst").distinct()

    def fingerprint(e: DataFrame):
        row = e.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64(*keys, "src", "dst").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    current = cut_lineage(edges.where("src <> dst").select(*keys, "src", "dst").distinct())
    seen = fingerprint(current)
    while True:
        current = cut_lineage(small_star(large_star(current)))
        now = fingerprint(current)
        if now == seen:
            break
        seen = now
    nodes = current.select(*keys, F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = current.select(*keys, F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return nodes.union(roots)


def chain_roots(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, root) where every node names at most one parent (NULL or itself at the root).

    Pointer doubling: the pointer of a node jumps to the pointer of its pointer, so a chain of
    length n takes log2(n) rounds.
    """
    keys = list(keys)
    current = cut_lineage(links.select(*keys, "node", F.coalesce("parent", "node").alias("root")))
    while True:
        jump = current.select(*keys, F.col("node").alias("root"), F.col("root").alias("_to"))
        moved = current.join(jump, [*keys, "root"]).select(*keys, "node", "root", "_to")
        moved = cut_lineage(moved.select(*keys, "node", F.col("_to").alias("root"), (F.col("_to") != F.col("root")).alias("_moved")))
        if moved.where("_moved").isEmpty():
            return moved.drop("_moved")
        current = moved.drop("_moved")
