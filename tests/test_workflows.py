"""Composed passes on small grids."""

import pandas as pd
from pyspark.sql import functions as F

from landpulse.operators import grid
from landpulse.plans import workflows
from landpulse.sources import tables


def test_disturbance_chain_tracks_one_patch_over_two_epochs(spark):
    rows = [(0, e, r, c, 0.6, 0.1 if 2 <= r <= 5 and 2 <= c <= 5 else 0.6) for e in (1, 2) for r in range(10) for c in range(10)]
    df = spark.createDataFrame(rows, "tile_id bigint, epoch int, row int, col int, index_b double, index_e double")
    out = workflows.disturbance_chain(df, 10.0)
    assert [(r["epoch"], r["area_pixels"], r["track_id"]) for r in out["tracks"].orderBy("epoch").collect()] == [(1, 16, 1), (2, 16, 1)]
    assert out["change"].where("changed").count() == 32


def test_flood_pass_finds_the_flooded_block(spark):
    rows = []
    for r in range(10):
        for c in range(10):
            wet = r < 4 and c < 3
            rows.append((0, 1, r, c, 0.10, 0.004 if wet else 0.10, 0.02, 0.001 if wet else 0.02, 0.3, 0.05, 0.02, 9, 0.0, 1.0))
    df = spark.createDataFrame(rows, "tile_id bigint, epoch int, row int, col int, vv_b double, vv_e double, vh_b double, vh_e double, green double, nir double, "
                                     "swir double, scl int, occurrence double, slope double")
    out = workflows.flood_pass(df, (10, 10))
    event = out["events"].collect()
    assert len(event) == 1 and event[0]["area_pixels"] == 12 and abs(event[0]["area_ha"] - 0.48) < 1e-12
    assert out["alerts"].first()["event_count"] == 1 and out["area_bounds"].first()["area_low_ha"] > 0


def test_drought_pass_runs_on_the_tables(spark, sf):
    out = workflows.drought_pass(tables.drought_inputs(tables.pixels(spark, sf)), (tables.SIDE, tables.SIDE), 20.0)
    states = {r["state"]: r["count"] for r in out["decisions"].groupBy("state").count().collect()}
    assert states["UNRESOLVED"] > 0 and states["NO_DROUGHT"] > 0
    assert out["events"].count() == out["area_bounds"].count()


def test_map_blocks_sees_bounded_groups(spark):
    df = spark.createDataFrame([(0, 0, r, c) for r in range(20) for c in range(20)], "tile_id bigint, epoch int, row int, col int")
    sizes = grid.map_blocks(df, lambda pdf: pd.DataFrame({"n": [len(pdf)]}), "n bigint", block=8)
    assert sizes.agg(F.max("n"), F.sum("n")).first() == (64, 400)


def test_object_scores_of_small_masks(spark):
    from landpulse.operators import matching
    from landpulse.plans.validation import object_scores

    def objects(blocks, name):
        rows = [(0, 0, r, c, i) for i, (r0, r1, c0, c1) in enumerate(blocks) for r in range(r0, r1) for c in range(c0, c1)]
        return spark.createDataFrame(rows, f"tile_id bigint, epoch int, row int, col int, {name} bigint")

    def score(pred, ref):
        p, r = objects(pred, "p"), objects(ref, "r")
        pairs = matching.overlap_pairs(p, r, ["tile_id", "epoch"]).select("tile_id", "epoch", "p", "r", "iou")
        n = lambda d, c: d.groupBy("tile_id", "epoch", c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
        return {x["tau"]: x for x in object_scores(pairs, n(p, "p"), n(r, "r"), (0.1, 0.5)).collect()}

    two = [(5, 9, 5, 9), (15, 18, 15, 18)]
    same = score(two, two)[0.5]
    assert (same["n_matched"], same["precision"], same["recall"], same["f1"], same["median_iou"]) == (2, 1.0, 1.0, 1.0, 1.0)
    part = score([(5, 8, 5, 8), (20, 24, 20, 24)], [(5, 9, 5, 9)])[0.5]
    assert (part["n_matched"], part["precision"], part["recall"], part["f1"]) == (1, 0.5, 1.0, 0.666667)
