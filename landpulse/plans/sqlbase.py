"""SQL building blocks mirroring ``landpulse.sources.tables`` for the oracle queries."""

from __future__ import annotations


def r6(expression: str) -> str:
    """Same six-decimal rounding as ``functions.core.round6``."""
    return f"(floor(({expression}) * 1000000.0 + 0.5001) / 1000000.0)"


def clip(x: str, low, high) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(least(({x}), CAST({high} AS DOUBLE)), CAST({low} AS DOUBLE)) END)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


SUMS = """sums AS (SELECT l_suppkey // 10 AS tile_id, CAST(year(l_shipdate) AS INTEGER) AS epoch,
  CAST(l_orderkey % 16 AS INTEGER) AS row, CAST(l_partkey % 16 AS INTEGER) AS col, count(*) AS n,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS sd, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS st,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sq, CAST(sum(l_partkey % 100) AS BIGINT) AS sp,
  CAST(sum(l_orderkey % 100) AS BIGINT) AS so, count(*) FILTER (WHERE l_returnflag = 'R') AS nr
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

PIX = SUMS + """,
pix AS (SELECT tile_id, epoch, row, col, n, sd / (100.0::DOUBLE * n) AS red, st / (100.0::DOUBLE * n) AS nir,
  sq / (50.0::DOUBLE * n) AS swir, sp / (1000.0::DOUBLE * n) AS blue, so / (1000.0::DOUBLE * n) AS green,
  CAST(sp % 12 AS INTEGER) AS scl, (so % 101) * (so % 101) / 10000.0::DOUBLE AS occurrence, (sq % 20) * 9 / 20.0::DOUBLE AS slope,
  (sp % 40) / 4.0::DOUBLE AS elevation, (2 * nr > n) AS reference FROM sums)"""

DENSE = PIX + """,
densepix AS (SELECT s.tile_id, s.epoch, s.row, s.col, p.n, p.red, p.nir, p.swir, p.blue, p.green, p.scl, p.occurrence,
  p.slope, p.elevation, p.reference
  FROM (SELECT t.tile_id, t.epoch, CAST(a.i AS INTEGER) AS row, CAST(b.i AS INTEGER) AS col
        FROM (SELECT DISTINCT tile_id, epoch FROM pix) t, range(16) a(i), range(16) b(i)) s
  LEFT JOIN pix p USING (tile_id, epoch, row, col))"""

INDEX = "CASE WHEN abs(nir + red) > 1e-8 THEN (nir - red) / (nir + red) END"

DELTA = PIX + f""",
idx AS (SELECT *, {INDEX} AS index FROM pix),
delta AS (SELECT e.tile_id, e.epoch, e.row, e.col, b.index AS index_b, e.index AS index_e, e.index - b.index AS delta
  FROM idx e JOIN idx b ON e.tile_id = b.tile_id AND e.row = b.row AND e.col = b.col AND e.epoch = b.epoch + 1)"""

FLOODIN = PIX + """,
fin AS (SELECT e.tile_id, e.epoch, e.row, e.col, b.swir * 0.3 AS vv_b, e.swir * e.swir * e.swir * 0.3 AS vv_e, b.red AS vh_b, e.red * e.red * 4.0 AS vh_e,
  e.green, e.nir, e.swir, e.scl, e.occurrence, e.slope, e.elevation, e.reference
  FROM pix e JOIN pix b ON e.tile_id = b.tile_id AND e.row = b.row AND e.col = b.col AND e.epoch = b.epoch + 1)"""


def _pol(before: str, event: str, ceiling: float, drop: str = "2.0") -> str:
    db = lambda x: f"10.0 * log10({clip(x, 1e-7, 10.0)})"
    d = clip(f"(({db(before)}) - ({db(event)}) - {drop}) / (6.0 - {drop})", 0, 1)
    a = clip(f"({ceiling} - ({db(event)})) / 8.0 + 0.5", 0, 1)
    return f"(0.6 * {d} + 0.4 * {a})"


SAR_OK = "(vv_b > 0 AND vv_e > 0 AND vh_b > 0 AND vh_e > 0)"
OPT_OK = "(green > 0 AND nir > 0 AND swir > 0 AND scl IN (4, 5, 6, 7))"


def sar_sql(drop: str = "2.0") -> str:
    return (f"CASE WHEN {SAR_OK} THEN "
            f"{clip('0.55 * ' + _pol('vv_b', 'vv_e', -14.0, drop) + ' + 0.45 * ' + _pol('vh_b', 'vh_e', -20.0), 0, 1)} ELSE 0.0 END")


def optical_sql() -> str:
    part = lambda o: clip(f"(green - {o}) / {clip('green + ' + o, 1e-4, 2.0)} / 0.5 + 0.5", 0, 1)
    return f"CASE WHEN {OPT_OK} THEN {clip('0.4 * ' + part('nir') + ' + 0.6 * ' + part('swir'), 0, 1)} ELSE 0.0 END"


def terrain_sql(full: str = "8.0", zero: str = "15.0") -> str:
    return f"CASE WHEN slope > {full} THEN {clip(f'1.0 - (slope - {full}) / ({zero} - {full})', 0, 1)} ELSE 1.0 END"


def novelty_sql(freq: str = "0.80") -> str:
    return clip(f"1.0 - occurrence / {freq}", 0, 1)


FLOODSCORE = FLOODIN + f""",
ev AS (SELECT *, {SAR_OK} AS sar_ok, {OPT_OK} AS opt_ok, {sar_sql()} AS sar, {optical_sql()} AS opt,
  {novelty_sql()} AS nov, {terrain_sql()} AS terr FROM fin),
flood AS (SELECT *, (sar_ok OR opt_ok) AS valid, CASE WHEN sar_ok OR opt_ok THEN
  {clip('''(CASE WHEN sar_ok AND opt_ok THEN (0.35 * sar + 0.25 * opt) / (0.35 + 0.25) WHEN sar_ok THEN sar ELSE opt END) * nov * terr''', 0, 1)}
  ELSE 0.0 END AS score FROM ev)"""


def z_sql(c: str, floor: float) -> str:
    return clip(f"({c} - {c}_m) / greatest({c}_s, {floor})", -4, 4)


NDVI = clip("CASE WHEN nir + red > 1e-6 THEN (nir - red) / (nir + red) ELSE 0.0 END", -1, 1)

DROUGHTIN = PIX + f""",
obs AS (SELECT tile_id, epoch, row, col, scl, reference, occurrence, {NDVI} AS ndvi, blue AS rain, green AS soil, swir AS heat FROM pix),
cl AS (SELECT tile_id, row, col, avg(ndvi) AS ndvi_m, stddev_pop(ndvi) AS ndvi_s, avg(rain) AS rain_m, stddev_pop(rain) AS rain_s,
  avg(soil) AS soil_m, stddev_pop(soil) AS soil_s, avg(heat) AS heat_m, stddev_pop(heat) AS heat_s,
  min(ndvi) AS ndvi_lo, max(ndvi) AS ndvi_hi FROM obs GROUP BY ALL),
zz AS (SELECT obs.*, ndvi_m, ndvi_lo, ndvi_hi, {z_sql('ndvi', 0.02)} AS z_ndvi, {z_sql('rain', 0.001)} AS z_rain,
  {z_sql('soil', 0.001)} AS z_soil, {z_sql('heat', 0.01)} AS z_heat FROM obs JOIN cl USING (tile_id, row, col)),
dz AS (SELECT tile_id, epoch, row, col, scl, reference, occurrence, ndvi, ndvi_m, ndvi_lo, ndvi_hi, z_ndvi AS veg_1m,
  avg(z_ndvi) OVER w3 AS veg_3m, avg(z_ndvi) OVER w6 AS veg_6m, z_rain AS precip_1m, avg(z_rain) OVER w3 AS precip_3m,
  avg(z_rain) OVER w6 AS precip_6m, z_soil AS soil_surface, avg(z_soil) OVER w3 AS soil_rootzone, z_heat AS thermal FROM zz
  WINDOW w3 AS (PARTITION BY tile_id, row, col ORDER BY epoch RANGE BETWEEN 2 PRECEDING AND CURRENT ROW),
         w6 AS (PARTITION BY tile_id, row, col ORDER BY epoch RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))"""


def ev_sql(z: str) -> str:
    return clip(f"-({z}) / 2.0", 0, 1)


VEG_EV = f"(0.25 * {ev_sql('veg_1m')} + 0.5 * {ev_sql('veg_3m')} + 0.25 * {ev_sql('veg_6m')})"
PRECIP_EV = f"(0.25 * {ev_sql('precip_1m')} + 0.5 * {ev_sql('precip_3m')} + 0.25 * {ev_sql('precip_6m')})"
SOIL_EV = f"(0.35 * {ev_sql('soil_surface')} + (1.0 - 0.35) * {ev_sql('soil_rootzone')})"
THERMAL_EV = clip("thermal / 2.0", 0, 1)

DROUGHTSCORE = DROUGHTIN + f""",
de AS (SELECT *, {VEG_EV} AS veg, {PRECIP_EV} AS precip, {SOIL_EV} AS soil, {THERMAL_EV} AS heat FROM dz),
drought AS (SELECT *, {clip('0.35 * veg + 0.30 * precip + 0.25 * soil + 0.10 * heat', 0, 1)} AS score FROM de)"""

STATION = """sd AS (SELECT user_id AS station, CAST(ts AS DATE) AS day, count(*) AS n,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sv, CAST(sum(event_id % 100) AS BIGINT) AS sk FROM events GROUP BY 1, 2),
stday AS (SELECT station, day, n, sv / 100.0::DOUBLE AS precip, sv / (n * 50000.0::DOUBLE) AS severity, sk / (n * 100.0::DOUBLE) AS soil FROM sd)"""

SCENES = """sc AS (SELECT o_orderkey AS scene_id, o_orderdate AS dt, (CAST(round(o_totalprice * 100) AS BIGINT) % 10000) / 100.0::DOUBLE AS cloud,
  o_orderstatus AS platform, CAST(o_custkey % 7 AS INTEGER) AS rel_orbit,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS direction, 'IW' AS mode,
  CASE WHEN o_orderkey % 3 = 0 THEN 'VV' ELSE 'VV+VH' END AS raw_polarization,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INTEGER) END AS slice_number,
  CAST(o_custkey % 50 AS INTEGER) AS site, CAST(o_custkey % 200 AS INTEGER) AS tile_ref FROM orders)"""

FIRE = """fp AS (SELECT event_id AS seq, printf('%.4f', 10.0::DOUBLE + (user_id % 25) * 0.01::DOUBLE + (event_id % 7) * 0.0005::DOUBLE) AS latitude,
  printf('%.4f', 70.0::DOUBLE + (user_id // 25) * 0.01::DOUBLE + (event_id % 5) * 0.0005::DOUBLE) AS longitude,
  strftime(ts, '%Y-%m-%d') AS acq_date, strftime(ts, '%H%M') AS acq_time, value AS frp,
  CASE WHEN event_id % 2 = 0 THEN 'VIIRS_SNPP_SP' ELSE 'VIIRS_NOAA20_SP' END AS source FROM events)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
