import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpulse.operators import grid

FIELDS = "tile_id bigint, x0 double, dx double, y0 double, dy double, width int, height int"
# source and target grid of each tile: shifted, fractional, flipped, finer, and without common ground
PAIRS = [((0.0, 10.0, 100.0, -10.0, 9, 7), (3.5, 25.0, 97.0, -25.0, 5, 4)), ((50.0, 4.0, 0.0, 4.0, 6, 6), (50.0, 3.0, 24.0, -3.0, 8, 8)),
         ((0.0, 7.0, 0.0, -3.0, 5, 8), (-2.0, 2.5, 1.0, -1.5, 16, 20)), ((0.0, 1.0, 0.0, 1.0, 4, 4), (100.0, 1.0, 0.0, 1.0, 3, 2))]


def brute(values, source, target):
    x0, dx, y0, dy, w, h = source
    X0, DX, Y0, DY, W, H = target
    out = {}
    for R in range(H):
        for C in range(W):
            sums = {"average": [0, 0], "bilinear": [0, 0], "nearest": [0, 0]}
            qx, qy = (X0 + (C + 0.5) * DX - x0) / dx, (Y0 + (R + 0.5) * DY - y0) / dy
            inside = -1e-9 <= qx <= w + 1e-9 and -1e-9 <= qy <= h + 1e-9
            for (r, c), v in values.items():
                share = 1.0
                for o, d, i, O, D, I in ((x0, dx, c, X0, DX, C), (y0, dy, r, Y0, DY, R)):
                    a, b = sorted((o + i * d, o + (i + 1) * d))
                    A, B = sorted((O + I * D, O + (I + 1) * D))
                    part = (min(b, B) - max(a, A)) / (B - A)
                    share *= part if part > 1e-9 else 0.0
                weights = {"average": share, "bilinear": inside * max(0, 1 - abs(qx - 0.5 - c)) * max(0, 1 - abs(qy - 0.5 - r)),
                           "nearest": float(inside and min(math.floor(qx + 1e-9), w - 1) == c and min(math.floor(qy + 1e-9), h - 1) == r)}
                for m, k in weights.items():
                    if k > 0 and v is not None:
                        sums[m][0] += k * v
                        sums[m][1] += k
            out[R, C] = {m: a / b if b else None for m, (a, b) in sums.items()}
    return out


def tables(spark):
    rng = random.Random(4)
    rows, values = [], {}
    for t, (source, _) in enumerate(PAIRS):
        values[t] = {(r, c): rng.choice([None, rng.random(), rng.random(), rng.random()]) for r in range(source[5]) for c in range(source[4]) if rng.random() < 0.9}
        rows += [(t, 2020, r, c, v, 1) for (r, c), v in values[t].items()]
    px = spark.createDataFrame(rows, "tile_id bigint, epoch int, row int, col int, band double, _average int")
    grids = [spark.createDataFrame([(t, *pair[i]) for t, pair in enumerate(PAIRS)], FIELDS) for i in (0, 1)]
    return px, values, grids


def test_regrid_equals_brute_force(spark):
    px, values, (own, target) = tables(spark)
    got = {(r["tile_id"], r["row"], r["col"]): r for r in grid.regrid(px, own, target, {m: ("band", m) for m in grid.METHODS}).collect()}
    assert len(got) == sum(t[4] * t[5] for _, t in PAIRS)
    for t, (source, goal) in enumerate(PAIRS):
        for at, want in brute(values[t], source, goal).items():
            for m in grid.METHODS:
                value = got[(t, *at)][m]
                assert (value is None) == (want[m] is None) and (value is None or value == pytest.approx(want[m], abs=1e-12)), (t, at, m)


def test_regrid_without_empty_cells_and_with_wrong_method(spark):
    px, _, (own, target) = tables(spark)
    assert grid.regrid(px, own, target, {"v": ("band", "average")}, complete=False).where("v IS NULL OR tile_id = 3").count() == 0
    assert grid.regrid(px.limit(0), own, target, {"v": ("band", "average")}).count() == 0
    with pytest.raises(ValueError):
        grid.regrid(px, own, target, {"v": ("band", "cubic")})


def test_average_keeps_the_total(spark):
    """Coarse cells that cover the source exactly hold its area-weighted mean."""
    px = spark.createDataFrame([(0, 0, r, c, float(r * 6 + c)) for r in range(6) for c in range(6)], "tile_id bigint, epoch int, row int, col int, band double")
    own = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0, 6, 6)], FIELDS)
    target = spark.createDataFrame([(0, 0.0, 1.5, 0.0, 1.5, 4, 4)], FIELDS)
    out = grid.regrid(px, own, target, {"v": ("band", "average")})
    assert out.agg(F.avg("v")).first()[0] == pytest.approx(np.arange(36).mean())
    plan = grid.regrid(px, own, target, {"a": ("band", "average"), "n": ("band", "nearest")}, complete=False)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
