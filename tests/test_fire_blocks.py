import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from landpulse.functions.geo import EARTH_RADIUS_M
from landpulse.operators import fire

NOON = dt.datetime(2024, 5, 1, 12)
SCHEMA = "seq int, lat double, lon double, ts timestamp, frp double"


def metres(a, b):
    la, lo, ma, mo = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((ma - la) / 2) ** 2 + math.cos(la) * math.cos(ma) * math.sin((mo - lo) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def greedy(rows):
    kept = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        for seq, (u, best, n) in kept.items():
            if abs((r[3] - u[3]).total_seconds()) <= 1800 and metres(r, u) <= 250.0:
                kept[seq] = (u, max(best, r[4]), n + 1)
                break
        else:
            kept[r[0]] = (r, r[4], 1)
    return {seq: (best, n) for seq, (_, best, n) in kept.items()}


def merged(df, **settings):
    return {r["seq"]: (r["frp"], r["n_merged"]) for r in fire.merge_duplicates(df, ["ts", "seq"], **settings).collect()}


@pytest.mark.parametrize("crowded", [5, 20_000])
def test_blocks_equal_greedy(spark, crowded):
    """Dense places over several blocks, with repeated records; crowded blocks are cut finer."""
    rng = random.Random(crowded)
    rows = [(i, 45 + rng.choice([0, 0.07, 0.0715]) + rng.random() * 0.012, 7 + rng.random() * 0.012, NOON + dt.timedelta(minutes=rng.randrange(3000)), float(i % 97)) for i in range(900)]
    rows += [(1000 + i, *rows[i][1:3], rows[i][3], 500.0 + i) for i in range(40)]
    assert merged(spark.createDataFrame(rows, SCHEMA), crowded=crowded) == greedy(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """1,000 records at one place, each within reach of the one before it."""
    rows = [(i, 10.0, 20.0 + (i % 2) * 0.001, NOON + dt.timedelta(minutes=20 * i), 1.0 * i) for i in range(1000)]
    rounds = []
    stored = fire.stored
    monkeypatch.setattr(fire, "stored", lambda df, label: rounds.append(label) or stored(df, label))
    assert merged(spark.createDataFrame(rows, SCHEMA)) == greedy(rows)
    assert rounds.count("decided") <= 4  # a handful, where the chain crosses blocks, not a round a record


def test_nothing_and_unparsed_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fire.merge_duplicates(none, ["ts", "seq"]).count() == 0
    odd = spark.createDataFrame([(1, None, 2.0, NOON, 3.0), (2, 5.0, 5.0, None, 4.0), (3, 5.0, 5.0, NOON, None), (4, 5.0, 5.0, NOON, 9.0)], SCHEMA)
    assert merged(odd) == {1: (3.0, 1), 2: (4.0, 1), 3: (9.0, 2)}


def test_no_pairs_in_the_plan(spark):
    df = spark.range(50).select(F.col("id").cast("int").alias("seq"), (F.col("id") / 1e4).alias("lat"), F.lit(1.0).alias("lon"), F.lit(NOON).alias("ts"), F.lit(1.0).alias("frp"))
    plan = fire.merge_duplicates(df, ["ts", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
