"""Events: connected groups of candidate cells and their attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landpulse.functions.core import as_col
from landpulse.operators.components import BLOCK, label_cells
from landpulse.operators.neighbours import GRID, dilate
from landpulse.operators.ordered import bucketed_row_number

ROW_BAND = 64


def label_candidates(pixels: DataFrame, condition, carry: Sequence[str] = (), keys: Sequence[str] = GRID,
                     connectivity: int = 8, block: int = BLOCK) -> DataFrame:
    """Candidate cells with the ``carry`` columns and the component ``label``."""
    candidates = pixels.where(as_col(condition)).select(*keys, "row", "col", *carry)
    return label_cells(candidates, keys, connectivity, block)


def summarize(labelled: DataFrame, keys: Sequence[str] = GRID, min_pixels: int = 9,
              measures: Sequence[Column] = ()) -> DataFrame:
    """One row per event of at least ``min_pixels`` cells, numbered 1.. in scan order per grid.

    Numbers follow the first cell of each event; the numbering runs over bands of rows, so a
    grid with very many events is not numbered in one task.
    """
    grouped = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area_pixels"),
        F.min("row").alias("min_row"), F.min("col").alias("min_col"),
        F.max("row").alias("max_row"), F.max("col").alias("max_col"),
        F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"), *measures)
    kept = grouped.where(F.col("area_pixels") >= min_pixels)
    banded = kept.withColumn("_band", F.floor(F.shiftright("label", 32) / ROW_BAND))
    return bucketed_row_number(banded, keys, "_band", [F.asc("label")], "event_id").drop("_band")


def with_area(events: DataFrame, pixel_m: float) -> DataFrame:
    area = F.col("area_pixels") * (pixel_m * pixel_m)
    return events.withColumns({"area_m2": area, "area_ha": area / 10000.0})


def event_cells(labelled: DataFrame, events: DataFrame, keys: Sequence[str] = GRID) -> DataFrame:
    """Cells of the kept events, with their ``event_id``. A plain join: small events are too
    many to copy per salt, and the partition of a giant one is split by adaptive execution."""
    ids = events.select(*keys, "label", "event_id")
    return labelled.join(ids, [*keys, "label"]).drop("label")


def area_bounds(pixels: DataFrame, cells: DataFrame, score: str, low: float, high: float,
                pixel_ha: float, height: int, width: int, valid=True, keys: Sequence[str] = GRID,
                floor_ha: float | None = None) -> DataFrame:
    """Area interval per event: cells above the strict threshold inside the event, and cells
    above the loose threshold inside its one-cell surroundings."""
    floor_ha = pixel_ha if floor_ha is None else floor_ha
    own = cells.groupBy(*keys, "event_id").agg(
        F.count(F.lit(1)).alias("n_std"),
        F.count_if(as_col(valid) & (F.col(score) >= high)).alias("n_high"))
    around = dilate(cells, [*keys, "event_id"], 1, height, width)
    loose = (around.join(pixels.where(as_col(valid) & (F.col(score) >= low)).select(*keys, "row", "col"),
                         [*keys, "row", "col"])
             .groupBy(*keys, "event_id").agg(F.count(F.lit(1)).alias("n_low")))
    out = own.join(loose, [*keys, "event_id"], "left")
    expected = F.col("n_std") * pixel_ha
    smallest = F.greatest(F.lit(floor_ha), F.col("n_high") * pixel_ha)
    largest = F.greatest(expected, F.coalesce("n_low", F.lit(0)) * pixel_ha)
    margin = (largest - smallest) / 2.0
    return out.select(*keys, "event_id", "n_std", expected.alias("area_expected_ha"),
                      smallest.alias("area_low_ha"), largest.alias("area_high_ha"),
                      margin.alias("area_margin_ha"),
                      (margin / F.greatest(F.lit(0.1), expected) * 100.0).alias("area_margin_pct"))


def horizontal_runs(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unbroken stretches of cells per grid line: (keys, row, first_col, last_col)."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    marked = cells.select(*keys, "row", "col").withColumn("_run", F.col("col") - F.row_number().over(w))
    return marked.groupBy(*keys, "row", "_run").agg(
        F.min("col").alias("first_col"), F.max("col").alias("last_col")).drop("_run")


def event_features(cells: DataFrame, x0: float, y0: float, dx: float, dy: float,
                   keys: Sequence[str] = GRID) -> DataFrame:
    """GeoJSON features, one per event and band of rows, each a MultiPolygon of cell runs.

    Large events become several features sharing one event_id, so no single row has to hold an
    unbounded geometry.
    """
    runs = horizontal_runs(cells, [*keys, "event_id"])
    left, right = x0 + F.col("first_col") * dx, x0 + (F.col("last_col") + 1) * dx
    top, bottom = y0 + F.col("row") * dy, y0 + (F.col("row") + 1) * dy
    point = lambda x, y: F.array(x, y)
    ring = F.array(F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom), point(left, top)))
    parts = (runs.withColumn("_band", F.floor(F.col("row") / ROW_BAND))
             .groupBy(*keys, "event_id", "_band")
             .agg(F.sort_array(F.collect_list(F.struct("row", "first_col", ring.alias("ring")))).alias("_runs"),
                  F.sum(F.col("last_col") - F.col("first_col") + 1).alias("area_pixels")))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("_runs.ring").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct("event_id", "area_pixels").alias("properties"), geometry.alias("geometry"))
    return parts.select(*keys, "event_id", F.col("_band").alias("band"), "area_pixels",
                        F.to_json(feature).alias("feature"))
