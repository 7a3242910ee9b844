"""Linking events over epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landpulse.operators.components import chain_roots
from landpulse.operators.matching import match_by_priority, overlap_pairs
from landpulse.operators.ordered import bucketed_row_number
from landpulse.session import cut_lineage


def _epoch_overlaps(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IoU of each event (p) with the events of the previous epoch (r) that it touches."""
    now = cells.select(*keys, "epoch", "row", "col", F.col("event_id").alias("p"))
    before = cells.select(*keys, (F.col("epoch") + 1).alias("epoch"), "row", "col", F.col("event_id").alias("r"))
    return overlap_pairs(now, before, [*keys, "epoch"])


def link_by_overlap_or_distance(events: DataFrame, cells: DataFrame, pixel_m: float, keys: Sequence[str] = ("tile_id",),
                                min_iou: float = 0.20, max_km: float = 2.0) -> DataFrame:
    """Best predecessor per event: IoU >= ``min_iou`` or centroid within ``max_km``.

    Score = IoU + 0.25 * closeness; several events may name the same predecessor. Events are
    disjoint and have a minimum size, so the number of centroids in reach is bounded by area.
    Adds ``prev_event_id`` (NULL starts a track).
    """
    reach = max_km * 1000.0 / pixel_m
    here = events.select(*keys, "epoch", F.col("event_id").alias("p"), F.col("centroid_row").alias("_pr"),
                         F.col("centroid_col").alias("_pc"))
    prior = events.select(*keys, (F.col("epoch") + 1).alias("epoch"), F.col("event_id").alias("r"),
                          F.col("centroid_row").alias("_rr"), F.col("centroid_col").alias("_rc"))
    bucket = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = (here.withColumn("_n", around).withColumns({"_br": bucket("_pr") + F.col("_n.a"), "_bc": bucket("_pc") + F.col("_n.b")})
            .join(prior.withColumns({"_br": bucket("_rr"), "_bc": bucket("_rc")}), [*keys, "epoch", "_br", "_bc"])
            .select(*keys, "epoch", "p", "r"))
    touching = _epoch_overlaps(cells, keys).select(*keys, "epoch", "p", "r", "iou")
    pairs = (near.unionByName(touching.select(*keys, "epoch", "p", "r")).distinct()
             .join(touching, [*keys, "epoch", "p", "r"], "left").fillna(0.0, ["iou"])
             .join(here, [*keys, "epoch", "p"]).join(prior, [*keys, "epoch", "r"]))
    dr, dc = F.col("_pr") - F.col("_rr"), F.col("_pc") - F.col("_rc")
    km = F.sqrt(dr * dr + dc * dc) * (pixel_m / 1000.0)
    scored = pairs.withColumn("_km", km).where((F.col("iou") >= min_iou) | (F.col("_km") <= max_km))
    scored = scored.withColumn("_score", F.col("iou") + F.greatest(F.lit(0.0), 1.0 - F.col("_km") / max_km) * 0.25)
    best = scored.groupBy(*keys, "epoch", F.col("p").alias("event_id")).agg(
        F.min_by(F.struct(F.col("r").alias("prev_event_id"), F.col("_score").alias("link_score")),
                 F.struct(-F.col("_score"), F.col("r"))).alias("_b"))
    return (events.join(best, [*keys, "epoch", "event_id"], "left")
            .select(*events.columns, F.col("_b.prev_event_id").alias("prev_event_id"), F.col("_b.link_score").alias("link_score")))


def chain_tracks(linked: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Adds ``track_id``: every chain of predecessors is one track, numbered by first epoch and
    event. Each event names at most one predecessor in the previous epoch, so a chain has a
    single earliest event."""
    node = lambda epoch, event: F.shiftleft(epoch.cast("bigint"), 32).bitwiseOR(event.cast("bigint"))
    coded = cut_lineage(linked.withColumns({
        "_node": node(F.col("epoch"), F.col("event_id")), "_prev": node(F.col("epoch") - 1, F.col("prev_event_id"))}))
    roots = chain_roots(coded.select(*keys, F.col("_node").alias("node"), F.col("_prev").alias("parent")), keys)
    rooted = coded.join(roots.select(*keys, F.col("node").alias("_node"), F.col("root").alias("_root")), [*keys, "_node"])
    starts = rooted.where("_root = _node").select(*keys, "_root", "epoch")
    numbered = bucketed_row_number(starts, keys, "epoch", [F.asc("_root")], "track_id").drop("epoch")
    return rooted.join(numbered, [*keys, "_root"]).drop("_node", "_prev", "_root")


def track_summary(tracked: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Lifetime figures per track. The observations stay in long form in ``tracked``."""
    return tracked.groupBy(*keys, "track_id").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"),
        F.count(F.lit(1)).alias("n_observations"), F.sum("area_ha").alias("cumulative_area_ha"),
        F.max("area_ha").alias("peak_area_ha"), F.max(F.abs("mean_change")).alias("max_abs_change"),
        F.avg("mean_score").alias("mean_score"))


def link_exclusive(events: DataFrame, cells: DataFrame, epochs: Sequence[int], keys: Sequence[str] = ("tile_id",),
                   min_iou: float = 0.15) -> DataFrame:
    """One event per track: older tracks choose first, by IoU with their last mask.

    Runs epoch by epoch, as identity depends on earlier choices; each step is distributed over
    all tracks of that epoch. A track without a match ends. Adds ``track_id``.
    """
    overlaps = cut_lineage(_epoch_overlaps(cells, keys).where(F.col("iou") >= min_iou)
                           .select(*keys, "epoch", "p", "r", "iou"))
    events = cut_lineage(events)
    key = lambda epoch, event: F.shiftleft(F.lit(epoch).cast("bigint"), 32).bitwiseOR(F.col(event).cast("bigint"))
    steps, current = [], None
    for epoch in epochs:
        now = events.where(F.col("epoch") == epoch)
        if current is None:
            current = now.withColumn("_start", key(epoch, "event_id"))
        else:
            last = current.select(*keys, F.col("event_id").alias("r"), "_start")
            pairs = overlaps.where(F.col("epoch") == epoch).join(last, [*keys, "r"])
            won = match_by_priority(pairs, keys, "r", "p", "iou", "_start")
            current = now.join(won.select(*keys, F.col("p").alias("event_id"), "_start"), [*keys, "event_id"], "left")
            current = cut_lineage(current.withColumn("_start", F.coalesce("_start", key(epoch, "event_id"))))
        steps.append(current)
    merged = steps[0]
    for step in steps[1:]:
        merged = merged.unionByName(step)
    starts = merged.groupBy(*keys, "_start").agg(F.min("epoch").alias("_band"))
    numbered = bucketed_row_number(starts, keys, "_band", [F.asc("_start")], "track_id").drop("_band")
    return merged.join(numbered, [*keys, "_start"]).drop("_start")
