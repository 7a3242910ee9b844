"""Composed passes over a user's own pixel tables.

Each function takes DataFrames in the column layout named in its text and returns a dict of
lazy DataFrames; only the labelled cells are written out on the way, as several results read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landpulse.config import DROUGHT, FLOOD, DroughtSettings, FloodSettings
from landpulse.functions import indices
from landpulse.operators import events, tracking
from landpulse.operators.neighbours import GRID
from landpulse.plans.detection import alert_package
from landpulse.plans.expressions import decided_drought, scored_flood
from landpulse.session import cut_lineage


def disturbance_chain(pairs: DataFrame, pixel_m: float, threshold: float = 0.2,
                      score_threshold: float = 0.9, min_pixels: int = 9) -> dict[str, DataFrame]:
    """Index change to tracked events.

    ``pairs``: tile_id, epoch, row, col, index_b, index_e. Results: ``change``, ``cells``,
    ``events`` and ``tracks`` (events with their track_id).
    """
    change = pairs.withColumn("delta", F.col("index_e") - F.col("index_b"))
    change = change.withColumns({"changed": indices.is_changed("delta", threshold), "score": indices.disturbance_score("delta", threshold)})
    labelled = cut_lineage(events.label_candidates(change, F.col("score") >= score_threshold, ["delta", "score"], GRID, 8))
    found = events.summarize(labelled, GRID, min_pixels, [F.avg("delta").alias("mean_change"), F.avg("score").alias("mean_score")])
    found = cut_lineage(events.with_area(found, pixel_m))
    cells = cut_lineage(events.event_cells(labelled, found, GRID))
    linked = tracking.link_by_overlap_or_distance(found, cells, pixel_m)
    return {"change": change, "cells": cells, "events": found, "tracks": tracking.chain_tracks(linked)}


def flood_pass(inputs: DataFrame, shape: tuple[int, int], settings: FloodSettings = FLOOD) -> dict[str, DataFrame]:
    """Flood evidence to alerts.

    ``inputs``: tile_id, epoch, row, col, vv_b, vv_e, vh_b, vh_e, green, nir, swir, scl,
    occurrence, slope. Results: ``scores``, ``cells``, ``events``, ``area_bounds`` and ``alerts``.
    """
    scored = scored_flood(inputs, settings)
    hit = F.col("valid") & (F.col("score") >= settings.threshold)
    labelled = cut_lineage(events.label_candidates(scored, hit, ["score", "valid"], GRID, 8))
    found = events.summarize(labelled, GRID, settings.min_event_pixels, [F.avg("score").alias("mean_score"), F.max("score").alias("peak_score")])
    found = cut_lineage(events.with_area(found, settings.pixel_m))
    cells = cut_lineage(events.event_cells(labelled, found, GRID))
    pixel_ha = settings.pixel_m * settings.pixel_m / 10000.0
    bounds = events.area_bounds(scored, cells, "score", 0.10, 0.40, pixel_ha, *shape, F.col("valid"))
    return {"scores": scored, "cells": cells, "events": found, "area_bounds": bounds, "alerts": alert_package(found)}


def drought_pass(anomalies: DataFrame, shape: tuple[int, int], pixel_m: float,
                 settings: DroughtSettings = DROUGHT) -> dict[str, DataFrame]:
    """Anomaly channels to drought events.

    ``anomalies``: tile_id, epoch, row, col, scl, ndvi_m and the nine z columns veg_1m/3m/6m,
    precip_1m/3m/6m, soil_surface, soil_rootzone, thermal. Results: ``decisions``, ``cells``,
    ``events`` and ``area_bounds``.
    """
    decided = decided_drought(anomalies).withColumn("seen", F.col("o") >= settings.observable)
    labelled = cut_lineage(events.label_candidates(decided, F.col("state") == "DROUGHT", ["score", "o", "seen"], GRID, 8))
    found = events.summarize(labelled, GRID, settings.min_event_pixels,
                             [F.avg("score").alias("mean_severity"), F.max("score").alias("peak_severity"), F.avg("o").alias("mean_observability")])
    found = cut_lineage(events.with_area(found, pixel_m).withColumn("well_observed", F.col("mean_observability") >= settings.observable))
    cells = cut_lineage(events.event_cells(labelled, found, GRID))
    bounds = events.area_bounds(decided, cells, "score", settings.watch, settings.severe, pixel_m * pixel_m / 10000.0, *shape, F.col("seen"))
    return {"decisions": decided, "cells": cells, "events": found, "area_bounds": bounds}
