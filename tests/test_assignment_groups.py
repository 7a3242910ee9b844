from landpulse.operators import matching


def test_groups_are_solved_many_at_a_time(spark):
    """Groups of 2 x 2 where the heaviest pair is not part of the largest matching, of 1 x 2, and a single pair."""
    rows = [(t, *x) for t in range(40) for x in ((1, 1, 0.9), (1, 2, 0.4), (2, 1, 0.4), (3, 3, 0.3), (3, 4, 0.5), (5, 5, 0.2))]
    won = matching.assign_one_to_one(spark.createDataFrame(rows, "tile_id bigint, p bigint, r bigint, iou double"), ["tile_id"])
    plan = won._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted(tuple(r) for r in won.collect()) == [(t, *x) for t in range(40) for x in ((1, 2, 0.4), (2, 1, 0.4), (3, 4, 0.5), (5, 5, 0.2))]
