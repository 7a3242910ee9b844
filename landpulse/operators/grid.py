"""Grid alignment, resampling, sampling and burning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.functions.geo import ring_contains
from landpulse.operators.skew import salted_join

CELL = ["tile_id", "epoch", "row", "col"]


def align(left: DataFrame, right: DataFrame, on: Sequence[str] = CELL) -> DataFrame:
    """Inner join of two tables on the same grid."""
    return left.join(right, list(on))


def grid_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tiles whose grid definitions differ, with the differing fields."""
    fields = ["crs", "x0", "dx", "y0", "dy", "width", "height"]
    r = right.select("tile_id", *[F.col(f).alias(f"_{f}") for f in fields])
    wrong = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields])
    out = left.join(r, "tile_id").select("tile_id", F.filter(wrong, lambda x: x.isNotNull()).alias("mismatches"))
    return out.where(F.size("mismatches") > 0)


def _cells_of(size: int, factor: float) -> int:
    """Target cells that cover ``size`` source cells; the last one may reach past the border."""
    return math.ceil(size / factor - 1e-9)


def resample_nearest(src: DataFrame, factor: float, keys: Sequence[str], bands: Sequence[str],
                     height: int, width: int) -> DataFrame:
    """Target cell takes the source cell under its centre. ``factor`` = target size / source size.

    The target cells cover the source grid, so empty sources stay NULL; centres past its border take
    the border cell.
    """
    rows = F.sequence(F.lit(0), F.lit(_cells_of(height, factor) - 1))
    cols = F.sequence(F.lit(0), F.lit(_cells_of(width, factor) - 1))
    spine = (src.select(*keys).distinct().withColumn("t_row", F.explode(rows)).withColumn("t_col", F.explode(cols))
             .withColumns({"row": F.least(F.floor((F.col("t_row") + 0.5) * factor).cast("int"), F.lit(height - 1)),
                           "col": F.least(F.floor((F.col("t_col") + 0.5) * factor).cast("int"), F.lit(width - 1))}))
    return (spine.join(src.select(*keys, "row", "col", *bands), [*keys, "row", "col"], "left")
            .select(*keys, F.col("t_row").alias("row"), F.col("t_col").alias("col"), *bands))


def block_aggregate(src: DataFrame, factor, value: str, keys: Sequence[str]) -> DataFrame:
    """Coarse cells: mean, majority flag and share of values >= 0.5 over the non-null cells."""
    v = F.col(value)
    return (src.where(v.isNotNull())
            .groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"))
            .agg(F.avg(v).alias("mean"), F.avg((v >= 0.5).cast("double")).alias("fraction"), F.count(F.lit(1)).alias("n_cells"))
            .withColumn("majority", (F.col("mean") >= 0.5).cast("double")))


def resample_bilinear(src: DataFrame, factor: float, keys: Sequence[str], band: str, height: int, width: int) -> DataFrame:
    """Weighted mean of the four source cells around each target centre, over those present."""
    rows = F.sequence(F.lit(0), F.lit(_cells_of(height, factor) - 1))
    cols = F.sequence(F.lit(0), F.lit(_cells_of(width, factor) - 1))
    at = lambda c, size: F.least((F.col(c) + 0.5) * factor - 0.5, F.lit(size - 1.0))
    spine = (src.select(*keys).distinct().withColumn("t_row", F.explode(rows)).withColumn("t_col", F.explode(cols))
             .withColumns({"_y": at("t_row", height), "_x": at("t_col", width)}))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    four = spine.withColumn("_k", corner).withColumns({
        "row": (F.floor("_y") + F.col("_k.a")).cast("int"), "col": (F.floor("_x") + F.col("_k.b")).cast("int")})
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    weight = F.when(F.col("_k.a") == 1, fy).otherwise(1.0 - fy) * F.when(F.col("_k.b") == 1, fx).otherwise(1.0 - fx)
    joined = (four.withColumn("_w", weight)
              .join(src.where(F.col(band).isNotNull()).select(*keys, "row", "col", band), [*keys, "row", "col"]))
    out = joined.groupBy(*keys, F.col("t_row").alias("row"), F.col("t_col").alias("col")).agg(
        F.sum(F.col("_w") * F.col(band)).alias("_v"), F.sum("_w").alias("_s"))
    return out.where("_s > 0").select(*keys, "row", "col", (F.col("_v") / F.col("_s")).alias(band))


METHODS = ("nearest", "bilinear", "average")
GRID_FIELDS = ("x0", "dx", "y0", "dy", "width", "height")
_EDGE = 1e-9  # cells: what two grids may differ by where their edges are meant to meet


TARGET_BLOCK = 64  # target cells a side that are summed up together
PAIRS_HELD = 1 << 20  # pairs of a source and a target cell worked on at a time


def _reach(index, source, target, pad: float, floor, least, greatest):
    """First and last target cell along one axis that a source cell (or its centre's surroundings, with
    ``pad``) touches. ``source`` and ``target`` are (origin, step, size); works on columns and on arrays."""
    (s0, sd, _), (t0, td, count) = source, target
    a, b = (s0 + (index - pad) * sd - t0) / td, (s0 + (index + (1.0 + pad)) * sd - t0) / td
    return greatest(floor(least(a, b)), 0 * count), least(floor(greatest(a, b)), count - 1)


def _axis_weights(index: np.ndarray, at: np.ndarray, source: Sequence[np.ndarray], target: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    """Weight per method of source cells ``index`` in target cells ``at`` along one axis.

    ``average`` is the share of the target cell that the source cell covers; ``bilinear`` falls from 1 to 0
    over one source cell around its centre, for target centres inside the source; ``nearest`` is 1 where
    the target centre lies in the source cell.
    """
    (s0, sd, size), (t0, td, _) = source, target
    edges = (s0 + index * sd - t0) / td, (s0 + (index + 1) * sd - t0) / td
    covered = np.fmin(np.maximum(*edges), at + 1) - np.fmax(np.minimum(*edges), at)
    centre = (t0 + (at + 0.5) * td - s0) / sd
    inside = (centre >= -_EDGE) & (centre <= size + _EDGE)
    return {"average": np.where(covered > _EDGE, covered, 0.0), "bilinear": np.where(inside, np.fmax(0.0, 1.0 - np.abs(centre - 0.5 - index)), 0.0),
            "nearest": (inside & (np.minimum(np.floor(centre + _EDGE), size - 1) == index)).astype(float)}


def _block_sums(keys: Sequence[str], bands: Mapping[str, tuple[str, str]], pad: float, complete: bool, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weighted means per target cell, from source cells sorted by ``keys`` and block. Only the sums of one
    block wait for the next batch, however many source cells it has."""
    by, names = [*keys, "_br", "_bc"], list(bands)
    axes = (("row", "_br", "y0", "dy", "height"), ("col", "_bc", "x0", "dx", "width"))

    def added(cells: pa.RecordBatch, sums: np.ndarray, place: np.ndarray, width: np.ndarray) -> None:
        known = {c: cells.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("row", "col", "_br", "_bc", *(f"_{g}_{f}" for g in "st" for f in GRID_FIELDS))}
        sides = []
        for index, block, *names_of in axes:
            source, target = ([known[f"_{g}_{f}"] for f in names_of] for g in "st")
            low, high = _reach(known[index], source, target, pad, np.floor, np.fmin, np.fmax)
            low, high = np.maximum(low, known[block] * TARGET_BLOCK), np.minimum(high, (known[block] + 1) * TARGET_BLOCK - 1)
            n = np.maximum(high - low + 1, 0).astype(np.int64)
            sides.append((index, block, source, target, low, n))
        n = sides[0][5] * sides[1][5]
        part = (np.cumsum(n) - n) // PAIRS_HELD
        for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
            weight, inner = [], []
            count = n[rows]
            owner = np.repeat(np.arange(len(rows)), count)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            across = sides[1][5][rows][owner]
            for (index, block, source, target, low, m), step in zip(sides, (k // np.maximum(across, 1), k % np.maximum(across, 1))):
                m = m[rows]
                who = np.repeat(rows, m)
                at = low[who] + np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
                found = _axis_weights(known[index][who], at, [x[who] for x in source], [x[who] for x in target])
                pick = (np.cumsum(m) - m)[owner] + step
                weight.append({method: w[pick] for method, w in found.items()})
                inner.append((at - known[block][who] * TARGET_BLOCK)[pick].astype(np.int64))
            code = place[rows][owner] + inner[0] * width[rows][owner] + inner[1]
            for i, (band, method) in enumerate(bands.values()):
                column = cells.column(band)
                used = column.is_valid().to_numpy(zero_copy_only=False)[rows][owner] & ((w := weight[0][method] * weight[1][method]) > 0)
                value = column.to_numpy(zero_copy_only=False)[rows][owner][used]
                sums[2 * i] += np.bincount(code[used], w[used] * value, sums.shape[1])
                sums[2 * i + 1] += np.bincount(code[used], w[used], sums.shape[1])

    def means(key: pa.RecordBatch, height: np.ndarray, width: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        """Rows of whole blocks; ``key`` has a row for each of them."""
        size = height * width
        owner = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        row, col = (key.column(c).to_numpy()[owner] * TARGET_BLOCK + step for c, step in (("_br", k // width[owner]), ("_bc", k % width[owner])))
        kept = np.flatnonzero((sums[1::2] > 0).any(axis=0) | complete)
        mean = [pa.array(np.divide(v, w, out=np.zeros_like(v), where=w > 0)[kept], mask=w[kept] <= 0) for v, w in zip(sums[::2], sums[1::2])]
        return pa.RecordBatch.from_arrays([*[key.column(c).take(pa.array(owner[kept])) for c in keys], pa.array(row[kept], pa.int32()), pa.array(col[kept], pa.int32()), *mean], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in by:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            key = batch.select(by).take(pa.array(first))
            height, width = (np.minimum(TARGET_BLOCK, batch.column(f"_t_{f}").to_numpy()[first] - key.column(c).to_numpy() * TARGET_BLOCK).astype(np.int64)
                             for f, c in (("height", "_br"), ("width", "_bc")))
            place = np.cumsum(height * width) - height * width
            sums = np.zeros((2 * len(names), int((height * width).sum())))
            cells = np.flatnonzero(batch.column("_s_height").is_valid().to_numpy(zero_copy_only=False))
            if len(cells):
                added(batch.take(pa.array(cells)), sums, place[group[cells]], width[group[cells]])
            if held is not None and held[0].slice(0, 1).to_pylist() == key.slice(0, 1).to_pylist():
                sums[:, :held[3].shape[1]] += held[3]
            elif held is not None:
                yield means(*held)
            last = int(place[-1])
            if last:
                yield means(key.slice(0, len(first) - 1), height[:-1], width[:-1], sums[:, :last])
            held = key.slice(len(first) - 1), height[-1:], width[-1:], sums[:, last:].copy()
        if held is not None:
            yield means(*held)

    return run


def regrid(src: DataFrame, source_grids: DataFrame, target_grids: DataFrame, bands: Mapping[str, tuple[str, str]],
           keys: Sequence[str] = ("tile_id", "epoch"), complete: bool = True) -> DataFrame:
    """Bands of ``src`` on other grids: (keys, row, col, one column per entry of ``bands``).

    ``bands`` maps an output column to (band, method); methods are ``nearest``, ``bilinear`` and
    ``average``, which weighs by the exact area that cells share. The two grid tables have one row per
    ``tile_id`` (x0, dx, y0, dy, width, height in one coordinate system); origins, steps, their signs
    and sizes may differ freely and from tile to tile. A missing or NULL source cell takes no part and
    the others' weights make up for it. Target centres outside the source grid have no nearest or
    bilinear value. With ``complete`` every cell of the target grid is returned for each (tile, epoch)
    present, else only those with a value.

    Source cells are dealt to the blocks of target cells that they touch, and tasks add up one block after
    the other for all bands and methods, so that little more than the source cells is shuffled.
    """
    wrong = {m for _, m in bands.values()} - set(METHODS)
    if wrong:
        raise ValueError(f"unknown method: {sorted(wrong)}")
    pairs = source_grids.select("tile_id", *[F.col(f).alias(f"_s_{f}") for f in GRID_FIELDS]).join(
        target_grids.select("tile_id", *[F.col(f).alias(f"_t_{f}") for f in GRID_FIELDS]), "tile_id").dropna()
    used = sorted({b for b, _ in bands.values()})
    # the whole grid of NULL keys stays without values; a cell without row (or column) lies along the whole axis
    placed = salted_join((src.dropna(subset=list(keys)) if complete else src).select(*keys, "row", "col", *[F.col(b).cast("double").alias(b) for b in used]), pairs, ["tile_id"], ["row", "col"])
    pad = 0.5 if any(m == "bilinear" for _, m in bands.values()) else 0.0

    def blocks(index: str, o: str, d: str, n: str) -> Column:
        low, high = _reach(F.col(index), *[(F.col(f"_{g}_{o}"), F.col(f"_{g}_{d}"), F.col(f"_{g}_{n}")) for g in "st"], pad, F.floor, F.least, F.greatest)
        return F.explode(F.when(low <= high, F.sequence(F.floor(low / TARGET_BLOCK).cast("int"), F.floor(high / TARGET_BLOCK).cast("int"))))

    dealt = placed.withColumn("_br", blocks("row", "y0", "dy", "height")).withColumn("_bc", blocks("col", "x0", "dx", "width"))
    if complete:  # a row without a cell for every block of the target grids
        every = lambda c: F.explode(F.when(F.col(c) > 0, F.sequence(F.lit(0), F.floor((F.col(c) - 1) / TARGET_BLOCK).cast("int"))))
        size = target_grids.select("tile_id", F.col("height").alias("_t_height"), F.col("width").alias("_t_width"))
        dealt = dealt.unionByName(src.select(*keys).distinct().join(size, "tile_id").withColumn("_br", every("_t_height")).withColumn("_bc", every("_t_width")), allowMissingColumns=True)
    by = [*keys, "_br", "_bc"]
    schema = T.StructType([*[src.schema[k] for k in keys], T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in bands]])
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_block_sums(keys, dict(bands), pad, complete, schema), schema)


def map_blocks(df: DataFrame, fn, schema, keys: Sequence[str] = ("tile_id", "epoch"), block: int = 256) -> DataFrame:
    """User hook: ``fn(pandas.DataFrame) -> pandas.DataFrame`` per square block of a grid. A block
    holds at most ``block**2`` cells, however large the tile is."""
    rows, cols = F.floor(F.col("row") / block).alias("_br"), F.floor(F.col("col") / block).alias("_bc")
    return df.groupBy(*keys, rows, cols).applyInPandas(fn, schema)


def locate(points: DataFrame, x: str, y: str, grid: DataFrame) -> DataFrame:
    """Adds row and col of the point's cell; points outside their grid, or of a tile without one, get
    NULL and ``outside``."""
    g = salted_join(points, grid, ["tile_id"], [x, y], how="left")
    col, row = F.floor((F.col(x) - F.col("x0")) / F.col("dx")), F.floor((F.col(y) - F.col("y0")) / F.col("dy"))
    inside = F.coalesce((col >= 0) & (col < F.col("width")) & (row >= 0) & (row < F.col("height")), F.lit(False))
    return g.withColumns({"row": F.when(inside, row).cast("int"), "col": F.when(inside, col).cast("int"), "outside": ~inside})


def sample(located: DataFrame, pixels: DataFrame, band: str, id_col: str, keys: Sequence[str] = ("tile_id", "epoch"),
           default: float = 0.5) -> DataFrame:
    """Cell value at each point; a missing value falls back to the 3x3 median, then ``default``.
    Points outside every grid stay, flagged ``outside``, without a value."""
    offset = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    around = F.array(*[offset(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = (located.select(*keys, id_col, "outside", F.col("row").alias("_r"), F.col("col").alias("_c"))
            .withColumn("_o", F.explode(F.when(F.col("outside"), F.array(offset(0, 0))).otherwise(around)))
            .withColumns({"row": F.col("_r") + F.col("_o.a"), "col": F.col("_c") + F.col("_o.b")}))
    values = near.join(pixels.select(*keys, "row", "col", F.col(band).alias("_v")), [*keys, "row", "col"], "left")
    own = F.max(F.when((F.col("_o.a") == 0) & (F.col("_o.b") == 0), F.col("_v")))
    out = values.groupBy(*keys, id_col, "outside", F.col("_r").alias("row"), F.col("_c").alias("col")).agg(
        own.alias("_own"), F.percentile("_v", F.lit(0.5)).alias("_med"))
    inside = ~F.col("outside")
    return out.select(*keys, id_col, "row", "col", F.when(inside, F.coalesce("_own", "_med", F.lit(default))).alias(band),
                      (inside & F.col("_own").isNull()).alias("fallback"), "outside")


def burn_polygons(polygons: DataFrame, keys: Sequence[str], value: str, order: str, height: int, width: int) -> DataFrame:
    """Cells whose centre lies in a polygon; the polygon of the highest ``order`` wins.

    ``polygons``: keys, ring ARRAY<STRUCT<x, y>> in grid units, value, order. Only the cells of
    each polygon's own bounding box are generated.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    first = lambda a, top: F.greatest(F.lit(0), F.floor(F.array_min(a)).cast("int"))
    last = lambda a, top: F.least(F.lit(top - 1), F.ceil(F.array_max(a)).cast("int"))
    span = lambda a, top: F.when(first(a, top) <= last(a, top), F.sequence(first(a, top), last(a, top)))
    cells = (polygons.withColumn("row", F.explode(span(ys, height))).withColumn("col", F.explode(span(xs, width))))
    hit = cells.where(ring_contains("ring", F.col("col") + 0.5, F.col("row") + 0.5))
    return hit.groupBy(*keys, "row", "col").agg(F.max_by(value, order).alias(value))


def majority_class(cells: DataFrame, keys: Sequence[str], group: str, label: str) -> DataFrame:
    """Most frequent non-zero class per group (smallest class on ties) and its share."""
    counts = (cells.where(F.col(label) > 0).groupBy(*keys, group, label).agg(F.count(F.lit(1)).alias("_n")))
    best = counts.groupBy(*keys, group).agg(
        F.min_by(F.struct(F.col(label).alias("c"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(label))).alias("_b"),
        F.sum("_n").alias("coverage_pixels"))
    return best.select(*keys, group, F.col("_b.c").alias("reference_class"), "coverage_pixels",
                       (F.col("_b.n") / F.col("coverage_pixels")).alias("agreement"))
