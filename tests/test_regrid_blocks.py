import pytest

from landpulse.operators import grid
from tests.test_regrid import FIELDS, brute

SOURCE, TARGET = (0.0, 10.0, 0.0, -10.0, 12, 12), (-3.0, 1.7, 2.0, -1.6, 75, 80)


def test_target_blocks_are_whole_and_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(grid, "PAIRS_HELD", 500)
    values = {(r, c): float(r * 12 + c) if (r + c) % 7 else None for r in range(12) for c in range(12) if (r, c) != (4, 4)}
    px = spark.createDataFrame([(0, 1, r, c, v) for (r, c), v in values.items()], "tile_id bigint, epoch int, row int, col int, band double")
    own, target = (spark.createDataFrame([(0, *g)], FIELDS) for g in (SOURCE, TARGET))
    out = grid.regrid(px, own, target, {m: ("band", m) for m in grid.METHODS})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan
    got = {(r["row"], r["col"]): r for r in out.collect()}
    want = brute(values, SOURCE, TARGET)
    assert got.keys() == want.keys()
    for at, w in want.items():
        for m in grid.METHODS:
            assert got[at][m] is None if w[m] is None else got[at][m] == pytest.approx(w[m], abs=1e-9)
