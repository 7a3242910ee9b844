"""Join queries: grid alignment, scene pairing, sampling, polygons, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions import drought
from landpulse.functions.core import round6, with_fixed_rows
from landpulse.operators import components, events, fire, grid, jobs, matching, scenes
from landpulse.plans import sqlbase as s
from landpulse.plans.detection import LABEL_BLOCK, GRID, _FEV, _TRK, components_sql, flood_events, rsql, tracked_changes
from landpulse.plans.expressions import scored_drought, scored_flood
from landpulse.plans.catalog import _IMPACT, impacts
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.session import cut_lineage, stored
from landpulse.sources import tables
from landpulse.sources.tables import CELL, SIDE


@query("pixel_align_join", s.sql(s.PIX, f"""SELECT e.tile_id, e.epoch, e.row, e.col, {r6('b.swir')} AS before, {r6('e.swir')} AS after, e.reference AS mask
  FROM pix e JOIN pix b ON e.tile_id = b.tile_id AND e.row = b.row AND e.col = b.col AND e.epoch = b.epoch + 1"""))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    before = px.select("tile_id", (F.col("epoch") + 1).alias("epoch"), "row", "col", round6("swir").alias("before"))
    after = px.select(*CELL, round6("swir").alias("after"), F.col("reference").alias("mask"))
    return grid.align(before, after)


@query("climatology_join", s.sql(s.PIX + """,
cb AS (SELECT l_suppkey // 10 AS tile_id, CAST(l_orderkey % 16 AS INTEGER) AS row, CAST(l_partkey % 16 AS INTEGER) AS col, month(l_shipdate) AS month,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4),
ob AS (SELECT l_suppkey // 10 AS tile_id, CAST(l_orderkey % 16 AS INTEGER) AS row, CAST(l_partkey % 16 AS INTEGER) AS col, year(l_shipdate) AS yr, month(l_shipdate) AS month,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4, 5)""",
    f"SELECT o.tile_id, CAST(o.yr AS INTEGER) AS epoch, CAST(o.month AS INTEGER) AS month, o.row, o.col, {r6('o.q / o.n::DOUBLE - c.q / c.n::DOUBLE')} AS anomaly FROM ob o JOIN cb c USING (tile_id, row, col, month)"))
def _(spark, sf):
    li = tables.table(spark, sf, "lineitem").select(
        F.expr("l_suppkey div 10").alias("tile_id"), F.year("l_shipdate").alias("epoch"), F.month("l_shipdate").alias("month"),
        (F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col"), F.col("l_quantity").cast("bigint").alias("q"))
    obs = li.groupBy(*CELL, "month").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("n"))
    base = obs.groupBy("tile_id", "row", "col", "month").agg((F.sum("q") / F.sum("n")).alias("baseline"))
    joined = grid.align(obs, base, ["tile_id", "row", "col", "month"])
    return joined.select("tile_id", "epoch", "month", "row", "col", round6(F.col("q") / F.col("n") - F.col("baseline")).alias("anomaly"))


@query("same_grid_check", s.sql(s.PIX, """SELECT DISTINCT tile_id, CASE WHEN tile_id % 4 = 1 THEN 'dx' WHEN tile_id % 4 = 2 THEN 'crs,height' END AS mismatches FROM pix WHERE tile_id % 4 IN (1, 2)"""))
def _(spark, sf):
    g = tables.grids(tables.pixels(spark, sf))
    t = F.col("tile_id") % 4
    other = g.withColumns({"dx": F.when(t == 1, 20.0).otherwise(F.col("dx")), "crs": F.when(t == 2, "EPSG:4326").otherwise(F.col("crs")),
                           "height": F.when(t == 2, 8).otherwise(F.col("height"))})
    return grid.grid_mismatches(g, other).withColumn("mismatches", F.concat_ws(",", "mismatches"))


_HARM = s.DENSE + """,
nr AS (SELECT t.tile_id, t.epoch, CAST(a.i AS INTEGER) AS row, CAST(b.i AS INTEGER) AS col, p.red FROM (SELECT DISTINCT tile_id, epoch FROM pix) t, range(8) a(i), range(8) b(i)
  LEFT JOIN pix p ON p.tile_id = t.tile_id AND p.epoch = t.epoch AND p.row = a.i * 2 + 1 AND p.col = b.i * 2 + 1),
av AS (SELECT tile_id, epoch, row // 2 AS row, col // 2 AS col, avg(nir) AS nir FROM pix GROUP BY 1, 2, 3, 4),
bl AS (SELECT tile_id, epoch, row // 2 AS row, col // 2 AS col, sum(0.25 * swir) / sum(0.25) AS swir FROM pix GROUP BY 1, 2, 3, 4)"""


@query("stack_harmonize_join", s.sql(_HARM, f"SELECT nr.tile_id, nr.epoch, nr.row, nr.col, {r6('red')} AS red_nearest, {r6('nir')} AS nir_average, {r6('swir')} AS swir_bilinear FROM nr LEFT JOIN av USING (tile_id, epoch, row, col) LEFT JOIN bl USING (tile_id, epoch, row, col)"))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    own = tables.grids(px)
    target = own.withColumns({"dx": F.col("dx") * 2, "dy": F.col("dy") * 2, "width": F.ceil(F.col("width") / 2).cast("int"), "height": F.ceil(F.col("height") / 2).cast("int")})
    bands = {"red_nearest": ("red", "nearest"), "nir_average": ("nir", "average"), "swir_bilinear": ("swir", "bilinear")}
    return grid.regrid(px, own, target, bands).select(*CELL, *[round6(b).alias(b) for b in bands])


# two target grids per tile: coarser by a fraction and shifted, and finer and reaching past the border
_VARIANTS = (("coarse", 3.0, 2.5, 25.0, 7), ("fine", -1.5, 4.0, 6.0, 28))
_AFFINE = s.PIX + ",\nvr(variant, sx, sy, d, n) AS (VALUES " + ", ".join(f"('{v}', {x}::DOUBLE, {y}::DOUBLE, {d}::DOUBLE, {n})" for v, x, y, d, n in _VARIANTS) + """),
ax AS (SELECT variant, side, j, c, least((10 * j + 10 - shift) / d, c + 1) - greatest((10 * j - shift) / d, c::DOUBLE) AS wa, (shift + (c + 0.5) * d) / 10.0 AS q
  FROM (SELECT variant, 'r' AS side, sy AS shift, d, n FROM vr UNION ALL SELECT variant, 'c', sx, d, n FROM vr) v, range(16) a(j), range(28) b(c) WHERE c < n),
aw AS (SELECT variant, side, j, c, CASE WHEN wa > 1e-9 THEN wa ELSE 0 END AS wa, CASE WHEN q >= -1e-9 AND q <= 16 + 1e-9 THEN greatest(0.0, 1.0 - abs(q - 0.5 - j)) ELSE 0 END AS wl,
  CASE WHEN q >= -1e-9 AND q <= 16 + 1e-9 AND least(floor(q + 1e-9), 15) = j THEN 1.0 ELSE 0.0 END AS wn FROM ax),
sn AS (SELECT p.tile_id, p.epoch, r.variant, r.c AS row, c.c AS col, p.red, p.nir, p.swir, r.wa * c.wa AS wa, r.wl * c.wl AS wl, r.wn * c.wn AS wn
  FROM pix p JOIN aw r ON r.side = 'r' AND r.j = p.row JOIN aw c ON c.side = 'c' AND c.variant = r.variant AND c.j = p.col),
rg AS (SELECT tile_id, epoch, variant, row, col, sum(wn * red) FILTER (wn > 0) / sum(wn) FILTER (wn > 0) AS red, sum(wa * nir) FILTER (wa > 0) / sum(wa) FILTER (wa > 0) AS nir,
  sum(wl * swir) FILTER (wl > 0) / sum(wl) FILTER (wl > 0) AS swir FROM sn GROUP BY 1, 2, 3, 4, 5),
sp AS (SELECT t.tile_id, t.epoch, variant, r.i AS row, c.i AS col FROM (SELECT DISTINCT tile_id, epoch FROM pix) t, vr, range(28) r(i), range(28) c(i) WHERE r.i < n AND c.i < n)"""


@query("stack_harmonize_affine", s.sql(_AFFINE, f"SELECT sp.tile_id, sp.epoch, sp.variant, CAST(sp.row AS INTEGER) AS row, CAST(sp.col AS INTEGER) AS col, {r6('red')} AS red_nearest, {r6('nir')} AS nir_average, {r6('swir')} AS swir_bilinear "
                                       "FROM sp LEFT JOIN rg USING (tile_id, epoch, variant, row, col)"))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    own = tables.grids(px)
    bands = {"red_nearest": ("red", "nearest"), "nir_average": ("nir", "average"), "swir_bilinear": ("swir", "bilinear")}
    parts = []
    for name, dx, dy, step, size in _VARIANTS:
        target = own.select("tile_id", (F.col("x0") + dx).alias("x0"), F.lit(step).alias("dx"), (F.col("y0") - dy).alias("y0"), F.lit(-step).alias("dy"),
                            F.lit(size).alias("width"), F.lit(size).alias("height"))
        parts.append(grid.regrid(px, own, target, bands).withColumn("variant", F.lit(name)))
    out = parts[0].unionByName(parts[1])
    return out.select(*GRID, "variant", "row", "col", *[round6(b).alias(b) for b in bands])


def radar_scenes(spark, sf):
    return tables.scenes(spark, sf).withColumn("pol", scenes.polarization("raw_polarization"))


@query("scene_pair_match", s.sql(s.SCENES + """,
dv AS (SELECT * FROM sc WHERE raw_polarization = 'VV+VH'),
pr AS (SELECT b.rel_orbit AS orbit, b.scene_id AS before_id, a.scene_id AS after_id, abs(epoch(a.dt) - epoch(b.dt)) / 86400.0 AS gap_days,
  2.0::DOUBLE + CASE WHEN a.platform = b.platform THEN 1 ELSE 0 END + CASE WHEN a.slice_number = b.slice_number THEN 2 ELSE 0 END + CASE WHEN a.rel_orbit = 3 THEN 3 ELSE 0 END
  - abs(abs(epoch(a.dt) - epoch(b.dt)) / 86400.0 - 365.25) / 365.25 AS score, a.site
  FROM dv b JOIN dv a ON a.site = b.site AND a.direction = b.direction AND a.mode = b.mode AND a.rel_orbit = b.rel_orbit
  WHERE b.dt < TIMESTAMP '1998-07-01' AND a.dt >= TIMESTAMP '1998-07-01' AND abs(epoch(a.dt) - epoch(b.dt)) / 86400.0 <= 400)""",
    f"SELECT site, orbit AS rel_orbit, before_id, after_id, {r6('gap_days')} AS gap_days, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, before_id, after_id) AS rn FROM pr) WHERE rn = 1"))
def _(spark, sf):
    sc = radar_scenes(spark, sf)
    split = F.lit("1998-07-01").cast("timestamp")
    best = scenes.best_pair(sc.where(F.col("dt") < split), sc.where(F.col("dt") >= split), ["site"], preferred_orbit=3)
    return best.select("site", "rel_orbit", "before_id", "after_id", round6("gap_days").alias("gap_days"), round6("score").alias("score"))


_TARGETS = """tg AS (SELECT site, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS target FROM (SELECT site, date_trunc('month', min(dt)) + INTERVAL 14 DAY AS lo, date_trunc('month', max(dt)) + INTERVAL 14 DAY AS hi FROM sc GROUP BY site)),
am AS (SELECT t.site, t.target, s.scene_id, s.cloud, s.tile_ref, row_number() OVER (PARTITION BY t.site, t.target ORDER BY s.cloud, s.scene_id) AS rn FROM tg t JOIN sc s ON s.site = t.site
  AND abs(date_diff('day', t.target, CAST(s.dt AS DATE))) <= 7 WHERE s.cloud < 25),
af AS (SELECT * FROM am WHERE rn = 1),
bm AS (SELECT t.site, t.target, s.scene_id, s.cloud, s.tile_ref, row_number() OVER (PARTITION BY t.site, t.target ORDER BY CASE WHEN s.tile_ref = t.tile_ref THEN 0 ELSE 1 END, s.cloud, s.scene_id) AS rn
  FROM af t JOIN sc s ON s.site = t.site AND abs(date_diff('day', t.target, CAST(s.dt AS DATE)) + 365) <= 15 WHERE s.cloud < 25)"""


@query("scene_pair_window", s.sql(s.SCENES + "," + _TARGETS, "SELECT a.site, a.target, a.scene_id AS after_id, b.scene_id AS before_id, a.tile_ref = b.tile_ref AS same_tile FROM af a JOIN bm b ON a.site = b.site AND a.target = b.target AND b.rn = 1"))
def _(spark, sf):
    sc = tables.scenes(spark, sf)
    middle = lambda day: F.date_add(F.trunc(day, "month"), 14)
    targets = sc.groupBy("site").agg(F.sequence(middle(F.min("dt")), middle(F.max("dt")), F.expr("INTERVAL 1 MONTH")).alias("months"))
    targets = targets.select("site", F.explode("months").alias("target"))
    clear = sc.where("cloud < 25")
    after = scenes.best_in_windows(targets, clear, ["site"], 0, 7, [F.col("cloud"), F.col("scene_id")], "a")
    goal = after.select("site", "target", F.col("a.tile_ref").alias("want_tile"), F.col("a.scene_id").alias("after_id"))
    other = F.when(F.col("tile_ref") == F.col("want_tile"), 0).otherwise(1)
    before = scenes.best_in_windows(goal.select("site", "target", "want_tile"), clear, ["site"], 365, 15, [other, F.col("cloud"), F.col("scene_id")], "b")
    both = goal.join(before, ["site", "target"])
    return both.select("site", "target", "after_id", F.col("b.scene_id").alias("before_id"), (F.col("want_tile") == F.col("b.tile_ref")).alias("same_tile"))


@query("asof_nearest_scene", s.sql(s.SCENES + """,
tg AS (SELECT site, CAST(UNNEST(generate_series(lo, hi, INTERVAL 20 DAY)) AS TIMESTAMP) AS target FROM (SELECT site, CAST(CAST(min(dt) AS DATE) AS TIMESTAMP) AS lo, CAST(CAST(max(dt) AS DATE) AS TIMESTAMP) AS hi FROM sc GROUP BY site)),
nn AS (SELECT t.site, t.target, s.scene_id, abs(epoch(s.dt) - epoch(t.target)) / 86400.0 AS gap, row_number() OVER (PARTITION BY t.site, t.target ORDER BY abs(epoch(s.dt) - epoch(t.target)), s.cloud, s.scene_id) AS rn
  FROM tg t JOIN sc s ON s.site = t.site)""", f"SELECT site, target, scene_id, {r6('gap')} AS gap_days FROM nn WHERE rn = 1"))
def _(spark, sf):
    sc = tables.scenes(spark, sf)
    dates = F.sequence(F.to_date(F.min("dt")), F.to_date(F.max("dt")), F.expr("INTERVAL 20 DAYS"))
    targets = sc.groupBy("site").agg(dates.cast("array<timestamp>").alias("dates")).select("site", F.explode("dates").alias("target"))
    near = scenes.nearest_scene(targets, sc.withColumn("dt", F.col("dt").cast("timestamp")), ["site"])
    return near.select("site", "target", "scene_id", round6("gap_days").alias("gap_days"))


_SAMPLE = s.PIX + """,
pt AS (SELECT o_orderkey AS point_id, o_custkey // 10 AS tile_id, CAST(1995 + o_orderkey % 7 AS INTEGER) AS epoch, (o_custkey // 10) * 160.0::DOUBLE + (o_orderkey % 170) - 3 AS x, -1.0::DOUBLE * (o_custkey % 165) AS y FROM orders),
lc AS (SELECT *, CAST(floor((x - tile_id * 160.0) / 10.0) AS INTEGER) AS c, CAST(floor(y / -10.0) AS INTEGER) AS r FROM pt),
ins AS (SELECT *, NOT coalesce(inside, false) AS outside, CASE WHEN inside THEN r END AS row, CASE WHEN inside THEN c END AS col
  FROM (SELECT *, c BETWEEN 0 AND 15 AND r BETWEEN 0 AND 15 AND tile_id IN (SELECT tile_id FROM pix) AS inside FROM lc)),
md AS (SELECT i.point_id, quantile_cont(p.swir, 0.5) AS med FROM ins i JOIN pix p ON p.tile_id = i.tile_id AND p.epoch = i.epoch AND abs(p.row - i.row) <= 1 AND abs(p.col - i.col) <= 1 GROUP BY 1)"""


@query("point_sample", s.sql(_SAMPLE, f"SELECT i.tile_id, i.epoch, i.point_id, i.row, i.col, CASE WHEN NOT outside THEN {r6('coalesce(p.swir, m.med, 0.5)')} END AS swir, NOT outside AND p.swir IS NULL AS fallback, outside FROM ins i LEFT JOIN pix p USING (tile_id, epoch, row, col) LEFT JOIN md m USING (point_id)"))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    points = tables.table(spark, sf, "orders").select(
        k.alias("point_id"), F.expr("o_custkey div 10").alias("tile_id"), (1995 + k % 7).cast("int").alias("epoch"),
        (F.expr("o_custkey div 10") * 160.0 + (k % 170) - 3).alias("x"), (-1.0 * (c % 165)).alias("y"))
    located = grid.locate(points, "x", "y", tables.grids(px))
    out = grid.sample(located, px, "swir", "point_id")
    return out.withColumn("swir", round6("swir"))


ALARM = s.FLOODSCORE + ", cand AS (SELECT * FROM flood WHERE valid AND score >= 0.4)," + components_sql("cand", "lab") + """,
aev AS (SELECT tile_id, epoch, label, count(*) AS k FROM lab GROUP BY 1, 2, 3 HAVING count(*) >= 4)"""
ALARM_CELLS = ALARM + """,
ac AS (SELECT tile_id || '_' || epoch || '_' || label AS alarm_id, 70.0::DOUBLE + (tile_id // 25) * 0.01 + col * 0.0005 AS lon, 10.0::DOUBLE + (tile_id % 25) * 0.01 + row * 0.0005 AS lat FROM lab JOIN aev USING (tile_id, epoch, label)),"""
LOCATED = ALARM_CELLS + s.FIRE + """,
pt AS (SELECT *, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon FROM fp),
ml AS (SELECT avg(lat) AS m FROM pt),
ds AS (SELECT p.seq, c.alarm_id, sqrt(((p.lon - c.lon) * (111320.0 * (SELECT cos(radians(m)) FROM ml))) * ((p.lon - c.lon) * (111320.0 * (SELECT cos(radians(m)) FROM ml))) + ((p.lat - c.lat) * 110750.0) * ((p.lat - c.lat) * 110750.0)) AS d FROM pt p JOIN ac c ON abs(p.lon - c.lon) < 0.011 AND abs(p.lat - c.lat) < 0.011),
nd AS (SELECT seq, min(d) AS d, arg_min(alarm_id, (d, alarm_id)) AS alarm_id FROM ds WHERE d <= 1000.0 GROUP BY 1),
loc AS (SELECT p.*, n.d AS dist_m, n.alarm_id FROM pt p LEFT JOIN nd n USING (seq))"""


def alarm_cells(spark, sf):
    scored = scored_flood(tables.flood_inputs(tables.pixels(spark, sf)))
    labelled = events.label_candidates(scored, F.col("valid") & (F.col("score") >= 0.4), [], GRID, 8, LABEL_BLOCK)
    kept = labelled.groupBy(*GRID, "label").agg(F.count(F.lit(1)).alias("_k")).where("_k >= 4")
    cells = labelled.join(kept, [*GRID, "label"])
    return cells.select("epoch", F.concat_ws("_", *GRID, "label").alias("alarm_id"),
                        (70.0 + F.expr("tile_id div 25") * 0.01 + F.col("col") * 0.0005).alias("lon"),
                        (10.0 + (F.col("tile_id") % 25) * 0.01 + F.col("row") * 0.0005).alias("lat"))


def located_points(spark, sf):
    pts = fire.parse_points(tables.fire_points(spark, sf)).withColumn("point_id", F.col("seq"))
    cells = cut_lineage(alarm_cells(spark, sf))
    return fire.nearest_alarm(pts, cells, max(config.FIRE_RADII_M)), cells


@query("point_cell_distance_join", rsql(LOCATED, f"SELECT seq, {r6('dist_m')} AS dist_m, dist_m IS NOT NULL AS near FROM loc"))
def _(spark, sf):
    located, _cells = located_points(spark, sf)
    return located.select("seq", round6("dist_m").alias("dist_m"), F.col("dist_m").isNotNull().alias("near"))


RING = """ring AS (SELECT s_suppkey AS poly, s_suppkey // 10 AS tile_id, [(s_suppkey * 7 % 10)::DOUBLE + 0.3, (s_suppkey * 7 % 10)::DOUBLE + 3.7 + s_suppkey % 4, (s_suppkey * 7 % 10)::DOUBLE + 2.1, (s_suppkey * 7 % 10)::DOUBLE - 1.4] AS px,
  [(s_suppkey * 3 % 11)::DOUBLE + 0.2, (s_suppkey * 3 % 11)::DOUBLE + 1.1, (s_suppkey * 3 % 11)::DOUBLE + 4.6 + s_suppkey % 3, (s_suppkey * 3 % 11)::DOUBLE + 2.9] AS py,
  CAST(s_suppkey % 5 AS INTEGER) + 1 AS cls FROM supplier)"""
_CROSS = " + ".join(f"CASE WHEN (py[{i}] > y) <> (py[{i % 4 + 1}] > y) AND x < (px[{i % 4 + 1}] - px[{i}]) * (y - py[{i}]) / (py[{i % 4 + 1}] - py[{i}]) + px[{i}] THEN 1 ELSE 0 END" for i in range(1, 5))
BURN = RING + f""",
bc AS (SELECT poly, tile_id, cls, px, py, CAST(a.i AS INTEGER) AS row, CAST(b.i AS INTEGER) AS col, b.i + 0.5::DOUBLE AS x, a.i + 0.5::DOUBLE AS y FROM ring, range(16) a(i), range(16) b(i)),
burn AS (SELECT tile_id, row, col, arg_max(cls, poly) AS cls FROM bc WHERE ({_CROSS}) % 2 = 1 GROUP BY 1, 2, 3)"""


def polygons(spark, sf):
    """One four-cornered polygon per supplier, in cell units of its tile."""
    k = F.col("s_suppkey")
    x, y = (k * 7 % 10).cast("double"), (k * 3 % 11).cast("double")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(corner(x + 0.3, y + 0.2), corner(x + 3.7 + k % 4, y + 1.1), corner(x + 2.1, y + 4.6 + k % 3), corner(x - 1.4, y + 2.9))
    return tables.table(spark, sf, "supplier").select(k.alias("poly"), F.expr("s_suppkey div 10").alias("tile_id"), ring.alias("ring"), ((k % 5).cast("int") + 1).alias("cls"))


@query("polygon_to_cells", s.sql(BURN, "SELECT tile_id, row, col, cls FROM burn"))
def _(spark, sf):
    return grid.burn_polygons(polygons(spark, sf), ["tile_id"], "cls", "poly", SIDE, SIDE)


OBJECTS = s.FLOODSCORE + ", pc AS (SELECT * FROM flood WHERE valid AND score >= 0.4), rc AS (SELECT * FROM flood WHERE reference)," + components_sql("pc", "plab") + "," + components_sql("rc", "rlab") + """,
psz AS (SELECT tile_id, epoch, label AS p, count(*) AS n_p FROM plab GROUP BY 1, 2, 3 HAVING count(*) >= 4),
rsz AS (SELECT tile_id, epoch, label AS r, count(*) AS n_r FROM rlab GROUP BY 1, 2, 3),
ov AS (SELECT a.tile_id, a.epoch, a.label AS p, b.label AS r, count(*) AS n_shared FROM plab a JOIN rlab b USING (tile_id, epoch, row, col) GROUP BY 1, 2, 3, 4),
pairs AS (SELECT tile_id, epoch, p, r, n_shared, n_p, n_r, n_shared / (n_p + n_r - n_shared)::DOUBLE AS iou FROM ov JOIN psz USING (tile_id, epoch, p) JOIN rsz USING (tile_id, epoch, r))"""


def object_cells(spark, sf, min_pixels=4):
    """(predicted cells with p, reference cells with r); small predictions are dropped. Both masks are
    labelled in one pass and written out once, as the overlap count and the sizes read them in turn."""
    scored = scored_flood(tables.flood_inputs(tables.pixels(spark, sf)))
    masks = F.array_compact(F.array(F.when(F.expr("valid AND score >= 0.4"), "p"), F.when(F.col("reference"), "r")))
    both = stored(components.label_cells(scored.select(*CELL, F.explode(masks).alias("mask")), [*GRID, "mask"], 8, LABEL_BLOCK), "objects")
    size = both.where("mask = 'p'").groupBy(*GRID, "label").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= min_pixels)
    p = both.where("mask = 'p'").join(size, [*GRID, "label"])
    return p.select(*CELL, F.col("label").alias("p")), both.where("mask = 'r'").select(*CELL, F.col("label").alias("r"))


@query("overlap_pairs", rsql(OBJECTS, f"SELECT tile_id, epoch, p, r, n_shared, n_p, n_r, {r6('iou')} AS iou FROM pairs"))
def _(spark, sf):
    p, r = object_cells(spark, sf)
    return matching.overlap_pairs(p, r, GRID).select(*GRID, "p", "r", "n_shared", "n_p", "n_r", round6("iou").alias("iou"))


@query("reference_majority", rsql(_FEV + """,
cnt AS (SELECT e.tile_id, e.epoch, e.event_id, p.scl % 4 AS cls, count(*) AS k FROM ecell e JOIN pix p USING (tile_id, epoch, row, col) WHERE p.scl % 4 > 0 GROUP BY 1, 2, 3, 4),
mj AS (SELECT tile_id, epoch, event_id, arg_min(cls, (-k, cls)) AS reference_class, sum(k)::BIGINT AS coverage_pixels, max(k) AS mx FROM cnt GROUP BY 1, 2, 3)""",
    f"SELECT n.tile_id, n.epoch, n.event_id, reference_class, coalesce(coverage_pixels, 0) AS coverage_pixels, {r6('mx / coverage_pixels::DOUBLE')} AS agreement FROM events_n n LEFT JOIN mj USING (tile_id, epoch, event_id)"))
def _(spark, sf):
    scored, labelled, found = flood_events(spark, sf, keep=True)
    cells = events.event_cells(labelled.select(*CELL, "label", (F.col("scl") % 4).alias("cls")), found, GRID)
    best = grid.majority_class(cells, GRID, "event_id", "cls")
    out = found.select(*GRID, "event_id").join(best, [*GRID, "event_id"], "left")
    return out.select(*GRID, "event_id", "reference_class", F.coalesce("coverage_pixels", F.lit(0)).alias("coverage_pixels"), round6("agreement").alias("agreement"))


@query("catalog_left_join", rsql(_TRK + """,
bio AS (SELECT tile_id, epoch, event_id, (event_id * 7 + epoch) % 5 AS cls FROM events_n WHERE (tile_id + epoch) % 3 <> 0)""",
    "SELECT t.tile_id, t.epoch, t.event_id, t.track_id, b.cls AS class_id, CASE WHEN b.cls IS NULL THEN 'unclassified' ELSE 'classified' END AS status FROM tracked t LEFT JOIN bio b USING (tile_id, epoch, event_id)"))
def _(spark, sf):
    t = tracked_changes(spark, sf)
    classes = t.where((F.col("tile_id") + F.col("epoch")) % 3 != 0).select("tile_id", "epoch", "event_id", ((F.col("event_id") * 7 + F.col("epoch")) % 5).alias("class_id"))
    out = t.select("tile_id", "epoch", "event_id", "track_id").join(classes, ["tile_id", "epoch", "event_id"], "left")
    return out.withColumn("status", F.when(F.col("class_id").isNull(), "unclassified").otherwise("classified"))


@query("anti_new_work", s.sql(s.SCENES + """,
wn AS (SELECT DISTINCT site, platform, strftime(dt, '%Y-%m') AS month FROM sc),
wk AS (SELECT *, substr(sha256(concat_ws('|', site, platform, month, 'obs')), 1, 24) AS job_key FROM wn)""", "SELECT site, platform, month, job_key FROM wk WHERE site % 3 <> 0"))
def _(spark, sf):
    w = tables.scenes(spark, sf).select("site", "platform", F.date_format("dt", "yyyy-MM").alias("month")).distinct()
    keyed = w.withColumn("job_key", jobs.work_key(F.col("site").cast("string"), F.col("platform"), F.col("month"), F.lit("obs")))
    return jobs.pending(keyed, keyed.where("site % 3 = 0")).select("site", "platform", "month", "job_key")


@query("impact_align_join", s.sql(_IMPACT, f"""SELECT a.state || '_' || a.year || '_' || strftime(a.week_ending_date, '%Y-%m') AS key, {r6('a.poor_pct')} AS poor_pct, {r6('b.sev')} AS severity FROM imp a JOIN
  (SELECT state, year, strftime(week_ending_date, '%Y-%m') AS m, avg(loss / n) AS sev FROM imp WHERE n % 2 = 0 GROUP BY 1, 2, 3) b ON a.state = b.state AND a.year = b.year AND strftime(a.week_ending_date, '%Y-%m') = b.m"""))
def _(spark, sf):
    im = impacts(spark, sf)
    key = F.concat_ws("_", "state", "year", F.date_format("week_ending_date", "yyyy-MM"))
    scores = im.where("n % 2 = 0").groupBy(key.alias("key")).agg(F.avg(F.col("loss") / F.col("n")).alias("severity"))
    return im.withColumn("key", key).join(scores, "key").select("key", round6("poor_pct").alias("poor_pct"), round6("severity").alias("severity"))


_AB = ", ".join(f"('{m}', {w[0]}::DOUBLE, {w[1]}::DOUBLE, {w[2]}::DOUBLE, {w[3]}::DOUBLE)" for m, w in config.DROUGHT_ABLATION_MODES.items())
ABLATION = s.DROUGHTSCORE + f""",
mode(mode, wv, wp, ws, wt) AS (VALUES {_AB}),
abl AS (SELECT d.tile_id, d.epoch, d.row, d.col, d.reference, mode, {s.clip('wv * veg + wp * precip + ws * soil + wt * heat', 0, 1)} AS mscore FROM drought d, mode)"""


def ablated(scored):
    """Drought score under every modality mode (eight fixed rows)."""
    both = with_fixed_rows(scored.select(*CELL, "reference", "veg", "precip", "soil", "heat"), [(m, *w) for m, w in config.DROUGHT_ABLATION_MODES.items()],
                           ("mode", "wv", "wp", "ws", "wt"))
    return both.withColumn("mscore", drought.fuse_modalities("veg", "precip", "soil", "heat", "wv", "wp", "ws", "wt"))


@query("modality_broadcast", s.sql(ABLATION, f"SELECT tile_id, epoch, mode, {r6('avg(mscore)')} AS mean_score, {r6('max(mscore)')} AS max_score FROM abl GROUP BY 1, 2, 3"))
def _(spark, sf):
    a = ablated(scored_drought(tables.drought_inputs(tables.pixels(spark, sf))))
    return a.groupBy(*GRID, "mode").agg(round6(F.avg("mscore")).alias("mean_score"), round6(F.max("mscore")).alias("max_score"))
