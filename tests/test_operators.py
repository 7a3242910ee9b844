"""Operators against brute force on small inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpulse.functions import geo
from landpulse.operators import components, events, fire, grid, jobs, matching, metrics, neighbours, ordered, scenes, skew, tracking

GRID = ["tile_id", "epoch"]


def cells(spark, mask, tile=0, epoch=0):
    rows = [(tile, epoch, int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    return spark.createDataFrame(rows, "tile_id bigint, epoch int, row int, col int")


def flood_fill(mask, conn):
    label, out = np.full(mask.shape, -1), {}
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if conn == 8 else [])
    for r, c in zip(*np.nonzero(mask)):
        if label[r, c] >= 0:
            continue
        code, stack = (int(r) << 32) | int(c), [(r, c)]
        label[r, c] = 0
        while stack:
            y, x = stack.pop()
            out[(int(y), int(x))] = code
            for dy, dx in steps:
                v, w = y + dy, x + dx
                if 0 <= v < mask.shape[0] and 0 <= w < mask.shape[1] and mask[v, w] and label[v, w] < 0:
                    label[v, w] = 0
                    stack.append((v, w))
    return out


@pytest.mark.parametrize("conn,block", [(4, 256), (8, 256), (8, 7), (4, 5)])
def test_labels_equal_flood_fill_across_blocks(spark, conn, block):
    mask = np.random.default_rng(3).random((24, 31)) < (0.45 if conn == 8 else 0.58)
    got = components.label_cells(cells(spark, mask), GRID, conn, block=block).collect()
    assert {(r["row"], r["col"]): r["label"] for r in got} == flood_fill(mask, conn)


@pytest.mark.parametrize("conn,block,shape", [(8, 2, (37, 70)), (4, 3, (50, 29)), (8, 5, (90, 41)), (8, 1, (9, 17))])
def test_labels_merge_over_many_levels(spark, conn, block, shape):
    """A snake through the whole grid, random cells, and cells at negative rows of another grid."""
    mask = np.random.default_rng(block).random(shape) < 0.5
    mask[::4], mask[1::4, -1], mask[2::4], mask[3::4, 0] = True, True, True, True
    mask[1::4, :-1] &= np.random.default_rng(9).random(mask[1::4, :-1].shape) < 0.3
    px = cells(spark, mask).withColumn("note", F.lit(None).cast("string"))
    far = spark.createDataFrame([(7, None, r, 400 + r, "x") for r in range(12)] + [(7, None, 3, 403, "again")], "tile_id bigint, epoch int, row int, col int, note string")
    got = components.label_cells(px.unionByName(far.select(px.columns)), GRID, conn, block).collect()
    assert {(r["row"], r["col"]): r["label"] for r in got if r["tile_id"] != 7} == flood_fill(mask, conn)
    diagonal = [r["label"] for r in got if r["tile_id"] == 7]
    assert len(diagonal) == 13 and len(set(diagonal)) == (1 if conn == 8 else 12)


def test_block_size_changes_no_label(spark):
    mask = np.zeros((12, 300), bool)
    mask[3, 250:262] = mask[0, :20] = mask[5:9, 30] = True
    px = cells(spark, mask).withColumn("score", F.lit(1.0))
    tables = [sorted(events.label_candidates(px, F.lit(True), ["score"], GRID, 8, block).collect()) for block in (5, 16, 256)]
    assert tables[0] == tables[1] == tables[2]
    assert len({r["label"] for r in tables[0]}) == 3
    assert components.label_cells(cells(spark, mask).limit(0), GRID).count() == 0


@pytest.mark.parametrize("factor", [5, 2.5, 0.5])
def test_resampling_covers_grids_whose_size_is_no_multiple(spark, factor):
    px = cells(spark, np.ones((16, 16), bool)).withColumn("v", F.col("row") * 16.0 + F.col("col"))
    size = math.ceil(16 / factor)
    nearest = {(r["row"], r["col"]): r["v"] for r in grid.resample_nearest(px, factor, GRID, ["v"], 16, 16).collect()}
    at = [min(int((i + 0.5) * factor), 15) for i in range(size)]
    assert nearest == {(i, j): at[i] * 16.0 + at[j] for i in range(size) for j in range(size)}
    linear = grid.resample_bilinear(px, factor, GRID, "v", 16, 16)
    assert {(r["row"], r["col"]) for r in linear.collect()} == set(nearest)


def test_graph_components_with_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(25)] + [(300, 301)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.graph_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{100 + i: 100 for i in range(26)}, 300: 300, 301: 300}


def test_chain_roots(spark):
    links = [(i, i - 1 if i % 10 else None) for i in range(30)]
    got = components.chain_roots(spark.createDataFrame(links, "node bigint, parent bigint")).collect()
    assert all(r["root"] == r["node"] // 10 * 10 for r in got)


def test_event_table_of_a_block_and_a_small_spot(spark):
    rows = [(0, 0, r, c, -0.35, 0.9) for r in (1, 2, 3) for c in (1, 2, 3)] + [(0, 0, 5, 5, -0.8, 0.9)]
    px = spark.createDataFrame(rows, "tile_id bigint, epoch int, row int, col int, change double, score double")
    lab = events.label_candidates(px, F.col("score") >= 0.5, ["change", "score"], GRID, 8, 4)
    found = events.with_area(events.summarize(lab, GRID, 4, [F.avg("change").alias("mean_change")]), 10.0).collect()
    assert len(found) == 1 and found[0]["area_pixels"] == 9 and found[0]["event_id"] == 1
    assert found[0]["area_ha"] == 0.09 and abs(found[0]["mean_change"] + 0.35) < 1e-12


def test_event_numbers_follow_scan_order_over_row_bands(spark):
    mask = np.zeros((200, 3), dtype=bool)
    mask[::2, 1] = True
    lab = components.label_cells(cells(spark, mask), GRID, 4)
    found = events.summarize(lab, GRID, 1).orderBy("event_id").collect()
    assert [r["event_id"] for r in found] == list(range(1, 101)) and [r["min_row"] for r in found] == list(range(0, 200, 2))


def test_features_keep_every_cell(spark):
    mask = np.random.default_rng(5).random((150, 12)) < 0.7
    lab = components.label_cells(cells(spark, mask), GRID, 8)
    found = events.summarize(lab, GRID, 1)
    feats = events.event_features(events.event_cells(lab, found), 0.0, 0.0, 10.0, -10.0)
    assert feats.agg(F.sum("area_pixels")).first()[0] == int(mask.sum())
    assert feats.select("band").distinct().count() == 3


def opened(mask):
    out = np.zeros_like(mask)
    for r in range(mask.shape[0] - 1):
        for c in range(mask.shape[1] - 1):
            if mask[r:r + 2, c:c + 2].all():
                out[r:r + 2, c:c + 2] = True
    return out


def test_openings_agree(spark):
    score = np.random.default_rng(7).random((18, 18))
    rows = [(0, 0, r, c, float(score[r, c])) for r in range(18) for c in range(18) if score[r, c] > 0.05]
    df = spark.createDataFrame(rows, "tile_id bigint, epoch int, row int, col int, s double")
    gray = neighbours.gray_opening(df, "s", "o").cache()
    for t in (0.1, 0.3, 0.5):
        want = {(int(r), int(c)) for r, c in zip(*np.nonzero(opened(score >= t)))}
        assert {(r["row"], r["col"]) for r in gray.where(F.col("o") >= t).collect()} == want
        assert {(r["row"], r["col"]) for r in neighbours.binary_opening(df.where(F.col("s") >= t), GRID).collect()} == want


def test_relief_and_valley_equal_the_single_operators(spark):
    rng = np.random.default_rng(9)
    rows = [(0, 0, r, c, float(rng.integers(0, 90)), bool(rng.random() < 0.7)) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(rows, "tile_id bigint, epoch int, row int, col int, z double, v boolean")
    both = {(r["row"], r["col"]): (r["relief_m"], r["scale_factor"]) for r in neighbours.relief_and_valley(df, "z", "v").collect()}
    one = {(r["row"], r["col"]): r["relief_m"] for r in neighbours.local_relief(df, "z").collect()}
    two = {(r["row"], r["col"]): r["scale_factor"] for r in neighbours.valley_scale(df, "v").collect()}
    z = np.array([r[4] for r in rows]).reshape(12, 12)
    for (r, c), (relief, scale) in both.items():
        w = z[max(0, r - 2):r + 3, max(0, c - 2):c + 3]
        assert relief == w.max() - w.min() == one[(r, c)] and scale == two[(r, c)]


def brute_assignment(pairs):
    best = (0, 0.0)
    for k in range(len(pairs), 0, -1):
        for combo in itertools.combinations(pairs, k):
            if len({p for p, _, _ in combo}) == k and len({r for _, r, _ in combo}) == k:
                best = max(best, (k, round(sum(w for *_, w in combo), 9)))
        if best[0] == k:
            break
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_is_largest_then_heaviest(spark, seed):
    rng = random.Random(seed)
    pairs = [(p, r, round(rng.uniform(0.1, 0.9), 3)) for p in range(5) for r in range(5) if rng.random() < 0.45]
    df = spark.createDataFrame([(0, *x) for x in pairs], "tile_id bigint, p bigint, r bigint, iou double")
    won = matching.assign_one_to_one(df, ["tile_id"]).collect()
    assert len({w["p"] for w in won}) == len({w["r"] for w in won}) == len(won)
    assert (len(won), round(sum(w["iou"] for w in won), 9)) == brute_assignment(pairs)


def test_priority_matching_is_the_serial_choice(spark):
    rng = random.Random(4)
    pairs = [(l, r, round(rng.random(), 4), l) for l in range(12) for r in range(12) if rng.random() < 0.4]
    free, want = set(range(12)), {}
    for l in range(12):
        mine = sorted((x for x in pairs if x[0] == l and x[1] in free), key=lambda x: (-x[2], x[1]))
        if mine:
            want[l] = mine[0][1]
            free.discard(mine[0][1])
    df = spark.createDataFrame([(0, *x) for x in pairs], "tile_id bigint, l bigint, r bigint, w double, pr bigint")
    got = matching.match_by_priority(df, ["tile_id"], "l", "r", "w", "pr").collect()
    assert {g["l"]: g["r"] for g in got} == want


def test_exclusive_tracks_keep_identity(spark):
    rows = [(0, 1, 1, r, c) for r in range(10, 30) for c in range(10, 30)] + [(0, 2, 1, r, c) for r in range(12, 35) for c in range(10, 35)] + \
           [(0, 2, 2, r, c) for r in range(40, 45) for c in range(40, 45)]
    ec = spark.createDataFrame(rows, "tile_id bigint, epoch int, event_id int, row int, col int")
    ev = ec.groupBy("tile_id", "epoch", "event_id").agg(F.count(F.lit(1)).alias("area_pixels"))
    got = {(r["epoch"], r["event_id"]): (r["track_id"], r["area_pixels"] * 0.04) for r in tracking.link_exclusive(ev, ec, [1, 2]).collect()}
    assert got == {(1, 1): (1, 16.0), (2, 1): (1, 23.0), (2, 2): (2, 1.0)}


def greedy_fire(rows, radius=250.0, minutes=30):
    def dist(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))

    kept = []
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        for k in kept:
            if dist(r, k["row"]) <= radius and abs(r[3] - k["row"][3]) <= minutes * 60:
                k["frp"], k["n"] = max(k["frp"], r[4]), k["n"] + 1
                break
        else:
            kept.append({"row": r, "frp": r[4], "n": 1})
    return {k["row"][0]: (k["frp"], k["n"]) for k in kept}


@pytest.mark.parametrize("seed,lat", [(1, 22.0), (2, 68.0), (3, 0.0)])
def test_fire_dedup_equals_the_greedy_pass(spark, seed, lat):
    rng = random.Random(seed)
    rows = [(i, lat + rng.choice([0.0, rng.uniform(0, 0.02)]), 82.0 + rng.choice([0.0, rng.uniform(0, 0.02)]), 1700000000 + rng.randrange(0, 9000, 60), rng.uniform(1, 50)) for i in range(160)]
    df = spark.createDataFrame(rows, "seq int, lat double, lon double, t bigint, frp double").withColumn("ts", F.timestamp_seconds("t"))
    got = fire.merge_duplicates(df.drop("t"), ["ts", "seq"]).collect()
    assert {r["seq"]: (r["frp"], r["n_merged"]) for r in got} == greedy_fire(rows)


@pytest.mark.parametrize("lat,lon", [(12.0, 180.0), (89.999, 0.0), (-90.0, 77.0)])
def test_fire_dedup_across_the_date_line_and_at_the_poles(spark, lat, lon):
    rng = random.Random(5)
    turn = lambda x: (x + 180.0) % 360.0 - 180.0
    rows = [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.004, 0.004))), turn(lon + rng.uniform(-0.004, 0.004) * (1 if abs(lat) < 80 else 40000)),
             1700000000 + rng.randrange(0, 5000, 60), rng.uniform(1, 50)) for i in range(80)]
    df = spark.createDataFrame(rows, "seq int, lat double, lon double, t bigint, frp double").withColumn("ts", F.timestamp_seconds("t"))
    got = fire.merge_duplicates(df.drop("t"), ["ts", "seq"]).collect()
    assert {r["seq"]: (r["frp"], r["n_merged"]) for r in got} == greedy_fire(rows)


def test_points_outside_every_grid_stay_flagged(spark):
    grids = spark.createDataFrame([(1, 0.0, 10.0, 0.0, -10.0, 2, 2)], "tile_id int, x0 double, dx double, y0 double, dy double, width int, height int")
    pixels = spark.createDataFrame([(1, 0, 0, 0.25), (1, 0, 1, 0.75)], "tile_id int, row int, col int, red double")
    points = spark.createDataFrame([(1, 1, 5.0, -5.0), (2, 1, 5.0, -15.0), (3, 1, 25.0, -5.0), (4, 9, 5.0, -5.0), (5, 1, None, -5.0)], "id int, tile_id int, x double, y double")
    out = grid.sample(grid.locate(points, "x", "y", grids), pixels, "red", "id", keys=["tile_id"]).collect()
    assert {r["id"]: (r["red"], r["fallback"], r["outside"]) for r in out} == {
        1: (0.25, False, False), 2: (0.5, True, False), 3: (None, False, True), 4: (None, False, True), 5: (None, False, True)}


def test_fire_dedup_golden(spark):
    rows = [("22.350", "82.650", "2025-03-01", "0700", 5.0, 0), ("22.3501", "82.6501", "2025-03-01", "0710", 12.0, 1), ("22.400", "82.700", "2025-03-01", "0700", 3.0, 2), ("x", "82.7", "2025-03-01", "1", 1.0, 3)]
    df = spark.createDataFrame(rows, "latitude string, longitude string, acq_date string, acq_time string, frp double, seq int")
    got = {r["seq"]: r["frp"] for r in fire.merge_duplicates(fire.parse_points(df), ["ts", "seq"]).collect()}
    assert got == {0: 12.0, 2: 3.0, 3: 1.0}


def test_percentiles_and_ranks_with_one_dominant_group(spark):
    rng = np.random.default_rng(11)
    rows = [("hot", float(x)) for x in rng.integers(0, 400, 3000) / 7.0] + [("cold", float(x)) for x in rng.random(5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ordered.exact_percentiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).collect()}
    for g in ("hot", "cold"):
        v = [x for k, x in rows if k == g]
        assert np.allclose([got[g][n] for n in "abc"], np.percentile(v, [5, 50, 95]))


def test_every_large_group_spreads_over_buckets(spark):
    rows = [("wide", float(i)) for i in range(9000)] + [("narrow", 5.0 + i * 1e-6) for i in range(1000)] + [("small", float(i)) for i in range(9)] + [("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = ordered.bucketed(df, ["g"], "v").collect()
    of = lambda g: sorted((r["v"], r["_bucket"]) for r in out if r["g"] == g and r["v"] is not None)
    assert len(out) == len(rows) and {r["_bucket"] for r in out if r["v"] is None or r["g"] == "small"} == {0}
    for g, n in (("wide", 9000), ("narrow", 1000)):
        buckets = [b for _, b in of(g)]
        assert buckets == sorted(buckets) and max(buckets.count(b) for b in set(buckets)) <= n / 30
    assert len({r["_bucket"] for r in ordered.bucketed(df.drop("g"), [], "v").collect()}) > 30


def test_last_before_carries_over_buckets(spark):
    rows = [("k", d, v) for d, v in enumerate([1, None, None, 4, None, None, None, 8, None])]
    df = spark.createDataFrame(rows, "k string, d int, v int").withColumn("b", F.floor(F.col("d") / 2))
    got = ordered.last_before(df, ["k"], "b", [F.asc("d")], F.when(F.col("v").isNotNull(), F.struct("v")), "p").orderBy("d").collect()
    assert [r["p"]["v"] if r["p"] else None for r in got] == [None, 1, 1, 1, 4, 4, 4, 4, 8]


def test_salted_join_equals_plain_join(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how in ("inner", "left"):
        a = sorted(map(tuple, skew.salted_join(big, small, ["k"], ["id"], how).select("k", "id", "v").collect()), key=str)
        b = sorted(map(tuple, big.join(small, "k", how).select("k", "id", "v").collect()), key=str)
        assert a == b


def test_curve_areas_with_ties(spark):
    score, label = [0.9, 0.8, 0.8, 0.4, 0.3, 0.3, 0.1], [True, True, False, True, False, True, False]
    got = metrics.curve_areas(spark.createDataFrame(list(zip(score, label)), "s double, y boolean"), [], "s", "y").first()
    points, prev, area, roc, prev_roc = [], (0.0, 1.0), 0.0, 0.0, (0.0, 0.0)
    for t in sorted(set(score), reverse=True):
        tp = sum(y for s, y in zip(score, label) if s >= t)
        n = sum(s >= t for s in score)
        now, now_roc = (tp / 4, tp / n), ((n - tp) / 3, tp / 4)
        area += (now[0] - prev[0]) * (now[1] + prev[1]) / 2
        roc += (now_roc[0] - prev_roc[0]) * (now_roc[1] + prev_roc[1]) / 2
        prev, prev_roc = now, now_roc
    assert abs(got["pr_auc"] - area) < 1e-12 and abs(got["roc_auc"] - roc) < 1e-12


def test_burned_polygons_and_ring_area(spark):
    square = [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]
    df = spark.createDataFrame([(0, 1, 7, [{"x": x, "y": y} for x, y in square]), (0, 2, 9, [{"x": x + 2, "y": y} for x, y in square])],
                               "tile_id bigint, o int, cls int, ring array<struct<x:double,y:double>>")
    got = {(r["row"], r["col"]): r["cls"] for r in grid.burn_polygons(df, ["tile_id"], "cls", "o", 8, 8).collect()}
    assert got == {(r, c): (9 if c >= 3 else 7) for r in (1, 2) for c in (1, 2, 3, 4, 5)}
    assert df.select(geo.ring_area("ring")).first()[0] == 6.0


def test_bbox_coverage(spark):
    df = spark.range(1)
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert df.select(geo.bbox_coverage(box(0, 0, 10, 10), box(5, 0, 15, 10))).first()[0] == 0.5
    assert df.select(geo.bbox_coverage(box(0, 0, 10, 10), box(20, 0, 30, 10))).first()[0] == 0.0


def test_cap_per_class_is_exact_with_a_dominant_class(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("c"))
    got = jobs.cap_per_class(df, "c", 50, F.md5(F.col("id").cast("string"))).collect()
    import hashlib

    for c in (1, 2):
        ids = sorted((i for i in range(2000) if (2 if i % 10 == 0 else 1) == c), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:50]
        assert {r["id"] for r in got if r["c"] == c} == set(ids)


def test_polarization_and_orbit(spark):
    df = spark.createDataFrame([(" vv, vh", "S1A_IW_GRDH_1SDV_20240101_012345_0A1B2C_3D4E"), ("HH/HV", "S1B_IW_12345_X"), ("odd", "S1A_none")], "p string, i string")
    got = df.select(scenes.polarization("p").alias("p"), scenes.absolute_orbit("i").alias("o")).collect()
    assert [tuple(r) for r in got] == [("DV", 12345), ("DH", 12345), ("odd", None)]
