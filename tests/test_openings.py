import random

from landpulse.operators import neighbours


def test_scores_are_opened_together(spark):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, rng.random(), rng.random()])
    df = spark.createDataFrame([(0, e, r, c, pick(), pick()) for e in (1, 2) for r in range(9) for c in range(9) if rng.random() < 0.9],
                               "tile_id bigint, epoch int, row int, col int, a double, b double")
    both = {tuple(r[:4]): (r["x"], r["y"]) for r in neighbours.gray_openings(df, {"a": "x", "b": "y"}).collect()}
    for i, s in enumerate("ab"):
        value = {tuple(r[:4]): r[s] for r in df.collect()}
        for (t, e, r, c), got in both.items():
            blocks = [[value.get((t, e, y + j, x + k)) for j in (0, 1) for k in (0, 1)] for y in (r - 1, r) for x in (c - 1, c)]
            assert got[i] == max((min(b) for b in blocks if None not in b), default=None)
