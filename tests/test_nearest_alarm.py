import math
import random

from landpulse import config
from landpulse.operators import fire


def test_nearest_alarm_without_sorting_the_candidates(spark):
    rng = random.Random(8)
    spot = lambda: (70 + rng.randrange(60) * 0.0005, 10 + rng.randrange(60) * 0.0005)
    points = [(i, *spot(), rng.choice([1, 2])) for i in range(80)]
    alarms = [(f"a{rng.randrange(30)}", *spot(), rng.choice([1, 2])) for _ in range(300)]
    out = fire.nearest_alarm(spark.createDataFrame(points, "id int, lon double, lat double, epoch int"),
                             spark.createDataFrame(alarms, "alarm_id string, lon double, lat double, epoch int"), 600.0, 10.0, ["epoch"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "min(round(dist_m" in plan and "min(struct(_c0" not in plan
    mx, my = config.METERS_PER_DEG_LON * math.cos(math.radians(10.0)), config.METERS_PER_DEG_LAT
    for r in out.collect():
        near = [(round(d, 4), a, d) for a, x, y, e in alarms if e == r["epoch"] and (d := math.hypot((r["lon"] - x) * mx, (r["lat"] - y) * my)) <= 600.0]
        assert (r["dist_m"] is None) == (not near)
        if near:
            assert r["alarm_id"] == min(near)[1] and abs(r["dist_m"] - min(near)[2]) < 1e-6
