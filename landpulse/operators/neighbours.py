"""Neighbourhood operators on long-form grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landpulse.functions.core import as_col, clip

GRID = ("tile_id", "epoch")


def offset_cells(radius: int, shape: str = "square") -> Column:
    """Array literal of (dr, dc) structs around a cell."""
    cells = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)
             if shape == "square" or abs(r) + abs(c) <= radius]
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in cells])


def dilate(cells: DataFrame, keys: Sequence[str], radius: int, height: int, width: int,
           shape: str = "square") -> DataFrame:
    """Cells within ``radius`` of a true cell, cut to the grid. Equals ``radius`` passes of a
    3x3 square (or cross) structuring element."""
    spread = (cells.select(*keys, "row", "col", F.explode(offset_cells(radius, shape)).alias("_o"))
              .select(*keys, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col")))
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return spread.where(inside).distinct()


def fringe(cells: DataFrame, keys: Sequence[str], radius: int, height: int, width: int) -> DataFrame:
    """Dilated cells minus the cells themselves."""
    return dilate(cells, keys, radius, height, width).join(
        cells.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti")


def binary_opening(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """2x2 opening: a cell stays when some all-true 2x2 block holds it."""
    corners = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (0, 1) for c in (0, 1)])
    blocks = (cells.select(*keys, "row", "col", F.explode(corners).alias("_o"))
              .groupBy(*keys, (F.col("row") - F.col("_o.dr")).alias("row"), (F.col("col") - F.col("_o.dc")).alias("col"))
              .agg(F.count(F.lit(1)).alias("_n")).where("_n = 4"))
    return (blocks.select(*keys, "row", "col", F.explode(corners).alias("_o"))
            .select(*keys, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"))
            .distinct())


def _along(axis: str, keys: Sequence[str]):
    fixed = "row" if axis == "col" else "col"
    return Window.partitionBy(*keys, fixed).orderBy(axis)


def slope_degrees(df: DataFrame, elevation: str, cell_x_m: float, cell_y_m: float,
                  keys: Sequence[str] = GRID) -> DataFrame:
    """Terrain slope on a dense grid: central differences, one-sided at the edges.

    Each window covers one grid line, never a whole tile.
    """
    z = F.col(elevation)

    def gradient(axis: str, step: float) -> Column:
        w = _along(axis, keys)
        low, high = F.lag(elevation).over(w), F.lead(elevation).over(w)
        first, last = F.lag(axis).over(w).isNull(), F.lead(axis).over(w).isNull()
        return (F.when(first & last, F.lit(None).cast("double")).when(first, (high - z) / step)
                .when(last, (z - low) / step).otherwise((high - low) / (2.0 * step)))

    out = df.withColumn("_dx", gradient("col", cell_x_m)).withColumn("_dy", gradient("row", cell_y_m))
    steepness = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    return out.withColumn("slope_deg", F.degrees(F.atan(steepness))).drop("_dx", "_dy")


def local_relief(df: DataFrame, elevation: str, radius: int = 2, ceiling: float = 150.0,
                 keys: Sequence[str] = GRID) -> DataFrame:
    """Highest minus lowest elevation in a square, one axis after the other."""
    across = _along("col", keys).rangeBetween(-radius, radius)
    down = _along("row", keys).rangeBetween(-radius, radius)
    out = df.withColumns({"_hi": F.max(elevation).over(across), "_lo": F.min(elevation).over(across)})
    relief = F.max("_hi").over(down) - F.min("_lo").over(down)
    return out.withColumn("relief_m", clip(relief, 0.0, ceiling)).drop("_hi", "_lo")


def valley_scale(df: DataFrame, valley, keys: Sequence[str] = GRID) -> DataFrame:
    """Channel-width factor on a dense grid.

    The factor is the distance to the nearest non-valley cell over two pixels, bounded to
    [0.5, 1], so only distances 1 and sqrt(2) matter and a radius-1 test is exact.
    """
    across = _along("col", keys).rangeBetween(-1, 1)
    down = _along("row", keys).rangeBetween(-1, 1)
    out = df.withColumn("_v", as_col(valley)).withColumn("_dry", F.when(F.col("_v"), 0).otherwise(1))
    out = out.withColumn("_h", F.max("_dry").over(across))
    out = out.withColumns({"_d": F.max("_h").over(down), "_u": F.max("_dry").over(down)})
    return out.withColumn("scale_factor", _scale_from_distance()).drop("_v", "_dry", "_h", "_d", "_u")


def mask_algebra(left: DataFrame, right: DataFrame, how: str, keys: Sequence[str] = GRID) -> DataFrame:
    """Cell-set and / or / and-not."""
    cols = [*keys, "row", "col"]
    a, b = left.select(*cols), right.select(*cols)
    if how == "and":
        return a.intersect(b)
    if how == "or":
        return a.union(b).distinct()
    if how == "and_not":
        return a.subtract(b)
    raise ValueError(f"Unknown mask operation: {how}")


def gray_opening(df: DataFrame, value: str, name: str, keys: Sequence[str] = GRID) -> DataFrame:
    """2x2 opening of a score: {opened >= t} equals the opening of {score >= t} for every t, so
    several thresholds share one pass. NULL scores and missing cells count as false."""
    return gray_openings(df, {value: name}, keys)


def gray_openings(df: DataFrame, names: Mapping[str, str], keys: Sequence[str] = GRID) -> DataFrame:
    """``gray_opening`` of several scores of the same cells (score -> name of its opening) in one pass.

    Erosion and dilation look at the next cell of one grid line and axis at a time: columns, rows
    (both steps), columns, so a table already laid out by column needs two more shuffles.
    """
    def erode(out: DataFrame, axis: str, columns: dict[str, str]) -> DataFrame:
        w = _along(axis, keys)
        follows = F.lead(axis).over(w) == F.col(axis) + 1
        ahead = {c: F.lead(c).over(w) for c in columns}
        return out.withColumns({n: F.when(follows & F.col(c).isNotNull() & ahead[c].isNotNull(), F.least(F.col(c), ahead[c])) for c, n in columns.items()})

    def dilate_back(out: DataFrame, axis: str, columns: dict[str, str]) -> DataFrame:
        w = _along(axis, keys)
        follows = F.lag(axis).over(w) == F.col(axis) - 1
        return out.withColumns({n: F.greatest(F.col(c), F.when(follows, F.lag(c).over(w))) for c, n in columns.items()})

    step = lambda letter: [f"_{letter}{i}" for i in range(len(names))]
    h, e, d = step("h"), step("e"), step("d")
    out = erode(df, "row", dict(zip(names, h)))
    out = erode(out, "col", dict(zip(h, e)))
    out = dilate_back(out, "col", dict(zip(e, d)))
    return dilate_back(out, "row", dict(zip(d, names.values()))).drop(*h, *e, *d)


def relief_and_valley(df: DataFrame, elevation: str, valley, radius: int = 2, ceiling: float = 150.0,
                      keys: Sequence[str] = GRID) -> DataFrame:
    """``local_relief`` and ``valley_scale`` together: one pass along rows, one along columns."""
    line, column = _along("col", keys), _along("row", keys)
    out = df.withColumn("_v", as_col(valley)).withColumn("_dry", F.when(F.col("_v"), 0).otherwise(1))
    out = out.withColumns({"_hi": F.max(elevation).over(line.rangeBetween(-radius, radius)), "_lo": F.min(elevation).over(line.rangeBetween(-radius, radius)),
                           "_h": F.max("_dry").over(line.rangeBetween(-1, 1))})
    down, near = column.rangeBetween(-radius, radius), column.rangeBetween(-1, 1)
    out = out.withColumns({"_top": F.max("_hi").over(down), "_low": F.min("_lo").over(down), "_d": F.max("_h").over(near), "_u": F.max("_dry").over(near)})
    out = out.withColumns({"relief_m": clip(F.col("_top") - F.col("_low"), 0.0, ceiling), "scale_factor": _scale_from_distance()})
    return out.drop("_v", "_dry", "_hi", "_lo", "_h", "_top", "_low", "_d", "_u")


def _scale_from_distance() -> Column:
    return (F.when(~F.col("_v"), 1.0).when((F.col("_h") == 1) | (F.col("_u") == 1), 0.5)
            .when(F.col("_d") == 1, F.sqrt(F.lit(2.0)) / 2.0).otherwise(1.0))
