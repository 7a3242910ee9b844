"""Neighbourhood, component, event and tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions import flood, geo, indices
from landpulse.functions.core import round6
from landpulse.operators import components, events, fire, neighbours, tracking
from landpulse.operators.skew import salted_join
from landpulse.plans import sqlbase as s
from landpulse.plans.expressions import K, REGIMES, _MARINE, decided_drought, routed_tiles, scored_flood
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.session import cut_lineage, scratch_path
from landpulse.sources import tables
from landpulse.sources.files import write_features
from landpulse.sources.tables import CELL, PIXEL_M, SIDE

GRID = ["tile_id", "epoch"]
LABEL_BLOCK = SIDE // 2  # the tables' grids span several blocks, so the queries merge labels across borders


def components_sql(cand: str, out: str, conn: int = 8) -> str:
    """Recursive labelling: ``out`` gets tile, epoch, row, col, label for the cells of ``cand``."""
    near = "abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1" if conn == 8 else "abs(b.row - a.row) + abs(b.col - a.col) <= 1"
    return f"""{out}_c AS MATERIALIZED (SELECT tile_id, epoch, row, col, CAST(row AS BIGINT) * 4294967296 + col AS code FROM {cand}),
{out}_adj AS MATERIALIZED (SELECT a.tile_id, a.epoch, a.code, b.code AS code2 FROM {out}_c a JOIN {out}_c b ON a.tile_id = b.tile_id AND a.epoch = b.epoch AND {near}),
{out}_r AS (SELECT tile_id, epoch, code, code AS label FROM {out}_c UNION
  SELECT j.tile_id, j.epoch, j.code2, r.label FROM {out}_r r JOIN {out}_adj j ON j.tile_id = r.tile_id AND j.epoch = r.epoch AND j.code = r.code WHERE r.label < j.code2),
{out} AS (SELECT tile_id, epoch, CAST(code >> 32 AS INTEGER) AS row, CAST(code & 4294967295 AS INTEGER) AS col, min(label) AS label FROM {out}_r GROUP BY 1, 2, 3, 4)"""


def rsql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


_CHANGE = s.DELTA + f""",
scored AS (SELECT *, {s.clip('abs(delta) / 0.2', 0, 1)} AS score FROM delta),
cand AS (SELECT * FROM scored WHERE score >= 0.9)"""
_EVENTS = _CHANGE + "," + components_sql("cand", "lab") + """,
evt AS (SELECT tile_id, epoch, label, count(*) AS area_pixels, avg(delta) AS mean_change, avg(score) AS mean_score, min(row) AS min_row,
  min(col) AS min_col, max(row) AS max_row, max(col) AS max_col, avg(row) AS centroid_row, avg(col) AS centroid_col, max(abs(delta)) AS peak_change
  FROM lab JOIN cand USING (tile_id, epoch, row, col) GROUP BY 1, 2, 3 HAVING count(*) >= 9),
events_n AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile_id, epoch ORDER BY label) AS INTEGER) AS event_id FROM evt)"""


def change_events(spark, sf, keep=False):
    """Labelled candidate cells of the index change, and their events. ``keep`` writes the cells
    out for callers that read them several times."""
    scored = tables.index_delta(tables.pixels(spark, sf)).withColumn("score", indices.disturbance_score("delta", 0.2))
    labelled = events.label_candidates(scored, F.col("score") >= 0.9, ["delta", "score"], GRID, 8, LABEL_BLOCK)
    labelled = cut_lineage(labelled) if keep else labelled
    found = events.summarize(labelled, GRID, 9, [F.avg("delta").alias("mean_change"), F.avg("score").alias("mean_score"),
                                                 F.max(F.abs("delta")).alias("peak_change")])
    return labelled, events.with_area(found, PIXEL_M)


@query("event_attributes", rsql(_EVENTS, f"""SELECT tile_id, epoch, event_id, area_pixels, {r6('area_pixels * 100.0::DOUBLE / 10000.0')} AS area_ha,
  {r6('mean_change')} AS mean_change, {r6('mean_score')} AS mean_score, {r6('peak_change')} AS peak_change, min_row, min_col, max_row, max_col,
  {r6('centroid_row')} AS centroid_row, {r6('centroid_col')} AS centroid_col FROM events_n"""))
def _(spark, sf):
    _, found = change_events(spark, sf)
    return found.select(*GRID, "event_id", "area_pixels", *[round6(c).alias(c) for c in ("area_ha", "mean_change", "mean_score", "peak_change")],
                        "min_row", "min_col", "max_row", "max_col", *[round6(c).alias(c) for c in ("centroid_row", "centroid_col")])


@query("connected_components", rsql(_CHANGE + "," + components_sql("cand", "lab", 4), f"SELECT {K}, label FROM lab"))
def _(spark, sf):
    scored = tables.index_delta(tables.pixels(spark, sf)).withColumn("score", indices.disturbance_score("delta", 0.2))
    return components.label_cells(scored.where("score >= 0.9").select(*CELL), GRID, 4, LABEL_BLOCK).select(*CELL, "label")


@query("largest_object_screen", rsql(s.PIX + ", cand AS (SELECT * FROM pix WHERE reference)," + components_sql("cand", "lab") + """,
ob AS (SELECT tile_id, epoch, label, count(*) AS n FROM lab GROUP BY 1, 2, 3)""",
    f"SELECT tile_id, epoch, count(*) AS n_objects, max(n) AS max_pixels, {r6('max(n) * 100.0::DOUBLE / 10000.0')} AS max_area_ha FROM ob GROUP BY 1, 2"))
def _(spark, sf):
    cells = components.label_cells(tables.pixels(spark, sf).where("reference").select(*CELL), GRID, 8, LABEL_BLOCK)
    sizes = cells.groupBy(*GRID, "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*GRID).agg(F.count(F.lit(1)).alias("n_objects"), F.max("n").alias("max_pixels"),
                                    round6(F.max("n") * (PIXEL_M * PIXEL_M) / 10000.0).alias("max_area_ha"))


def _dil(cand, r, extra=""):
    return f"""SELECT DISTINCT a.tile_id, a.epoch{extra}, CAST(a.row + x.i AS INTEGER) AS row, CAST(a.col + y.i AS INTEGER) AS col FROM {cand} a,
  range(-{r}, {r + 1}) x(i), range(-{r}, {r + 1}) y(i) WHERE a.row + x.i BETWEEN 0 AND 15 AND a.col + y.i BETWEEN 0 AND 15"""


@query("dilate", s.sql(s.PIX, _dil("(SELECT * FROM pix WHERE occurrence >= 0.9)", 2)))
def _(spark, sf):
    return neighbours.dilate(tables.pixels(spark, sf).where("occurrence >= 0.9"), GRID, 2, SIDE, SIDE).select(*CELL)


@query("fringe", s.sql(s.PIX, f"SELECT * FROM ({_dil('(SELECT * FROM pix WHERE occurrence >= 0.9)', 1)}) EXCEPT SELECT {K} FROM pix WHERE occurrence >= 0.9"))
def _(spark, sf):
    return neighbours.fringe(tables.pixels(spark, sf).where("occurrence >= 0.9"), GRID, 1, SIDE, SIDE).select(*CELL)


def opening_sql(cand: str, out: str) -> str:
    return f"""{out}_b AS (SELECT a.tile_id, a.epoch, a.row - x.i AS row, a.col - y.i AS col FROM {cand} a, range(2) x(i), range(2) y(i) GROUP BY ALL HAVING count(*) = 4),
{out} AS (SELECT DISTINCT b.tile_id, b.epoch, CAST(b.row + x.i AS INTEGER) AS row, CAST(b.col + y.i AS INTEGER) AS col FROM {out}_b b, range(2) x(i), range(2) y(i))"""


@query("binary_opening", s.sql(s.FLOODSCORE + ", cand AS (SELECT * FROM flood WHERE valid AND score >= 0.2)," + opening_sql("cand", "opened"), f"SELECT {K} FROM opened"))
def _(spark, sf):
    scored = scored_flood(tables.flood_inputs(tables.pixels(spark, sf)))
    return neighbours.binary_opening(scored.where("valid AND score >= 0.2"), GRID).select(*CELL)


_VALLEY = "(coalesce(slope <= 5.0, false) OR coalesce(occurrence > 0.0, false))"
_OBS = s.DENSE + f""",
rel AS (SELECT *, {_VALLEY} AS valley, max(elevation) OVER h AS hi, min(elevation) OVER h AS lo FROM densepix
  WINDOW h AS (PARTITION BY tile_id, epoch, row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
rel2 AS (SELECT *, greatest(least(max(hi) OVER v - min(lo) OVER v, 150.0), 0.0) AS relief FROM rel
  WINDOW v AS (PARTITION BY tile_id, epoch, col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
dry AS (SELECT row, col, tile_id, epoch FROM rel2 WHERE NOT valley),
near1 AS (SELECT DISTINCT r.tile_id, r.epoch, r.row, r.col, max(CASE WHEN abs(d.row - r.row) + abs(d.col - r.col) <= 1 THEN 1 ELSE 0 END) AS direct
  FROM rel2 r JOIN dry d ON r.tile_id = d.tile_id AND r.epoch = d.epoch AND abs(d.row - r.row) <= 1 AND abs(d.col - r.col) <= 1 GROUP BY 1, 2, 3, 4),
ob AS (SELECT r.*, CASE WHEN NOT valley THEN 1.0::DOUBLE WHEN direct = 1 THEN 0.5::DOUBLE WHEN direct = 0 THEN sqrt(2.0) / 2.0 ELSE 1.0::DOUBLE END AS scale_factor
  FROM rel2 r LEFT JOIN near1 USING (tile_id, epoch, row, col))"""


@query("local_relief", s.sql(_OBS, f"SELECT {K}, {r6('relief')} AS relief_m FROM ob"))
def _(spark, sf):
    return neighbours.local_relief(tables.dense(tables.pixels(spark, sf)), "elevation").select(*CELL, round6("relief_m").alias("relief_m"))


@query("valley_scale", s.sql(_OBS, f"SELECT {K}, {r6('scale_factor')} AS scale_factor FROM ob"))
def _(spark, sf):
    d = neighbours.valley_scale(tables.dense(tables.pixels(spark, sf)), flood.is_valley("slope", "occurrence"))
    return d.select(*CELL, round6("scale_factor").alias("scale_factor"))


_GRAD = lambda low, high, has_low, has_high: f"CASE WHEN {has_low} AND {has_high} THEN ({high} - {low}) / 20.0 WHEN {has_high} THEN ({high} - elevation) / 10.0 ELSE (elevation - {low}) / 10.0 END"


@query("dem_slope", s.sql(s.DENSE + f""",
g AS (SELECT *, lag(elevation) OVER h AS w0, lead(elevation) OVER h AS w1, lag(elevation) OVER v AS n0, lead(elevation) OVER v AS n1 FROM densepix
  WINDOW h AS (PARTITION BY tile_id, epoch, row ORDER BY col), v AS (PARTITION BY tile_id, epoch, col ORDER BY row)),
gg AS (SELECT *, {_GRAD('w0', 'w1', 'col > 0', 'col < 15')} AS dx, {_GRAD('n0', 'n1', 'row > 0', 'row < 15')} AS dy FROM g)""",
    f"SELECT {K}, {r6('degrees(atan(sqrt(dx * dx + dy * dy)))')} AS slope_deg FROM gg"))
def _(spark, sf):
    d = neighbours.slope_degrees(tables.dense(tables.pixels(spark, sf)), "elevation", PIXEL_M, PIXEL_M)
    return d.select(*CELL, round6("slope_deg").alias("slope_deg"))


_O = s.clip(f"CASE WHEN n IS NOT NULL THEN 1.0 ELSE 0.0 END * {s.clip('1.0 - slope / 15.0', 0, 1)} * {s.clip('1.0 - relief / 150.0', 0, 1)} * "
            "CASE WHEN elevation <= 2.5 AND occurrence >= 0.10 AND occurrence < 0.70 THEN 0.35 ELSE 1.0 END * scale_factor", 0, 1)
OBSERVED = _OBS + f", observed AS (SELECT {K}, n IS NOT NULL AS valid, {_O} AS o FROM ob)"


def observed_flood(px):
    """Observability index on the dense grid; the columns of ``px`` stay."""
    d = neighbours.relief_and_valley(tables.dense(px.withColumn("_seen", F.lit(True))), "elevation", flood.is_valley("slope", "occurrence"))
    d = d.withColumn("observed", F.col("_seen").isNotNull()).drop("_seen")
    return d.withColumn("o", flood.observability("observed", "slope", "relief_m", "elevation", "occurrence", "scale_factor"))


@query("observability_flood", s.sql(OBSERVED, f"SELECT {K}, {r6('o')} AS observability FROM observed"))
def _(spark, sf):
    return observed_flood(tables.pixels(spark, sf)).select(*CELL, round6("o").alias("observability"))


TRISTATE = s.FLOODSCORE + "," + OBSERVED.split(s.PIX + ",", 1)[1] + """,
tri AS (SELECT o.tile_id, o.epoch, o.row, o.col, o.o, f.score, f.reference, coalesce(o.o >= 0.5 AND f.valid, false) AS seen
  FROM observed o LEFT JOIN flood f USING (tile_id, epoch, row, col)),
cand AS (SELECT * FROM tri WHERE seen AND score >= 0.2),""" + opening_sql("cand", "opened") + """,
tri2 AS (SELECT t.*, (p.row IS NOT NULL) AS is_flood FROM tri t LEFT JOIN opened p USING (tile_id, epoch, row, col))"""


def decided_flood(px):
    """Three-state flood decision. Cells removed by the opening are NO_FLOOD, so the states add up.

    Evidence, observability and opening form one chain over the grid lines; nothing is joined
    back.
    """
    scored = scored_flood(tables.flood_inputs(px, unpaired=True))
    scored = scored.select(*CELL, "slope", "elevation", "occurrence", "reference", F.when(F.col("paired"), F.col("score")).alias("score"),
                           (F.col("paired") & F.col("valid")).alias("has_evidence"))
    d = observed_flood(scored).withColumn("seen", F.coalesce((F.col("o") >= 0.5) & F.col("has_evidence"), F.lit(False)))
    d = neighbours.gray_opening(d.withColumn("_s", F.when(F.col("seen"), F.col("score"))), "_s", "_opened").drop("_s")
    flooded = F.coalesce(F.col("_opened") >= 0.2, F.lit(False))
    state = F.when(~F.col("seen"), "UNRESOLVED").when(flooded, "FLOOD").otherwise("NO_FLOOD")
    gone = F.coalesce(F.col("seen") & (F.col("score") >= 0.2) & ~flooded, F.lit(False))
    return d.withColumns({"state": state, "opened_away": gone}).drop("_opened")


@query("tristate_flood", s.sql(TRISTATE, f"SELECT {K}, CASE WHEN NOT seen THEN 'UNRESOLVED' WHEN is_flood THEN 'FLOOD' ELSE 'NO_FLOOD' END AS state, "
                                         "coalesce(seen AND score >= 0.2 AND NOT is_flood, false) AS opened_away FROM tri2"))
def _(spark, sf):
    return decided_flood(tables.pixels(spark, sf)).select(*CELL, "state", F.coalesce("opened_away", F.lit(False)).alias("opened_away"))


_SOFT = (f"CASE WHEN {_MARINE} THEN 0.0::DOUBLE WHEN elevation <= 6.0 AND slope <= 2.5 AND occurrence >= 0.05 AND occurrence < 0.80 THEN "
         f"{s.clip(s.clip('(elevation - 1.0) / 5.0', 0.35, 1) + ' * ' + s.clip('1.0 - occurrence / 0.80', 0.35, 1), 0.35, 0.85)} ELSE 1.0::DOUBLE END")


@query("coastal_suppression", s.sql(REGIMES + f""",
buf AS ({_dil('(SELECT * FROM flood WHERE ' + _MARINE + ')', 2)}),
cs AS (SELECT f.*, r.coastal, (b.row IS NOT NULL) AS buffered, {_SOFT} AS base FROM flood f JOIN feat2 r USING (tile_id, epoch) LEFT JOIN buf b USING (tile_id, epoch, row, col))""",
    f"""SELECT {K}, {r6(f"CASE WHEN NOT coastal THEN 1.0::DOUBLE WHEN buffered AND NOT {_MARINE} AND elevation <= 3.5 THEN greatest(0.35::DOUBLE, least(base, 0.50::DOUBLE)) ELSE base END")} AS multiplier FROM cs"""))
def _(spark, sf):
    inputs = tables.flood_inputs(tables.pixels(spark, sf))
    marine, _unused = flood.coastal_masks("occurrence", "elevation", "slope")
    routes = routed_tiles(inputs).select(*GRID, "coastal")
    buffer = neighbours.dilate(inputs.where(marine), GRID, 2, SIDE, SIDE).withColumn("buffered", F.lit(True))
    joined = salted_join(inputs, routes, GRID, ["row", "col"]).join(buffer, CELL, "left")
    return joined.select(*CELL, round6(flood.coastal_multiplier("occurrence", "elevation", "slope", "coastal", "buffered")).alias("multiplier"))


_FEV = s.FLOODSCORE + ", cand AS (SELECT * FROM flood WHERE valid AND score >= 0.2)," + components_sql("cand", "lab") + """,
evt AS (SELECT tile_id, epoch, label, count(*) AS n, avg(score) AS mean_score, max(score) AS peak FROM lab JOIN cand USING (tile_id, epoch, row, col) GROUP BY 1, 2, 3 HAVING count(*) >= 4),
events_n AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile_id, epoch ORDER BY label) AS INTEGER) AS event_id FROM evt),
ecell AS (SELECT tile_id, epoch, row, col, event_id FROM lab JOIN events_n USING (tile_id, epoch, label))"""


def flood_events(spark, sf, keep=False):
    scored = scored_flood(tables.flood_inputs(tables.pixels(spark, sf)))
    labelled = events.label_candidates(scored, F.col("valid") & (F.col("score") >= 0.2), ["score", "scl", "valid"], GRID, 8, LABEL_BLOCK)
    labelled = cut_lineage(labelled) if keep else labelled
    found = events.summarize(labelled, GRID, config.FLOOD.min_event_pixels, [F.avg("score").alias("mean_score"), F.max("score").alias("peak_score")])
    return scored, labelled, events.with_area(found, config.FLOOD.pixel_m)


@query("event_area_bounds", rsql(_FEV + f""",
own AS (SELECT e.tile_id, e.epoch, e.event_id, count(*) AS n_std, count(*) FILTER (WHERE f.score >= 0.4) AS n_high FROM ecell e JOIN flood f USING (tile_id, epoch, row, col) GROUP BY 1, 2, 3),
around AS ({_dil('ecell', 1, ', a.event_id')}),
loose AS (SELECT a.tile_id, a.epoch, a.event_id, count(*) AS n_low FROM around a JOIN flood f USING (tile_id, epoch, row, col) WHERE f.valid AND f.score >= 0.1 GROUP BY 1, 2, 3),
ab AS (SELECT *, n_std * 0.04::DOUBLE AS e, greatest(0.04::DOUBLE, n_high * 0.04::DOUBLE) AS lo, greatest(n_std * 0.04::DOUBLE, n_low * 0.04::DOUBLE) AS hi FROM own JOIN loose USING (tile_id, epoch, event_id))""",
    f"""SELECT tile_id, epoch, event_id, {r6('e')} AS area_expected_ha, {r6('lo')} AS area_low_ha, {r6('hi')} AS area_high_ha, {r6('(hi - lo) / 2.0')} AS area_margin_ha,
  {r6('(hi - lo) / 2.0 / greatest(0.1::DOUBLE, e) * 100.0')} AS area_margin_pct FROM ab"""))
def _(spark, sf):
    scored, labelled, found = flood_events(spark, sf, keep=True)
    cells = events.event_cells(labelled, found, GRID)
    out = events.area_bounds(scored, cells, "score", 0.1, 0.4, 0.04, SIDE, SIDE, F.col("valid"), GRID)
    return out.select(*GRID, "event_id", *[round6(c).alias(c) for c in ("area_expected_ha", "area_low_ha", "area_high_ha", "area_margin_ha", "area_margin_pct")])


@query("event_carbon", rsql(_EVENTS + """,
ecell AS (SELECT tile_id, epoch, row, col, event_id FROM lab JOIN events_n USING (tile_id, epoch, label)),
bio AS (SELECT e.tile_id, e.epoch, event_id, avg(b.swir * 200.0) AS before, avg(a.swir * 200.0) AS after FROM ecell e JOIN pix a USING (tile_id, epoch, row, col)
  JOIN pix b ON b.tile_id = e.tile_id AND b.row = e.row AND b.col = e.col AND b.epoch = e.epoch - 1 GROUP BY 1, 2, 3)""",
    f"""SELECT tile_id, epoch, event_id, {r6('before')} AS biomass_before, {r6('after')} AS biomass_after, {r6('after - before')} AS biomass_change,
  {r6('(after - before) * 0.47')} AS carbon_change, {r6('abs(after - before) * 0.2')} AS uncertainty FROM bio"""))
def _(spark, sf):
    labelled, found = change_events(spark, sf, keep=True)
    cells = events.event_cells(labelled.select(*CELL, "label"), found, GRID)
    px = tables.pixels(spark, sf).select(*CELL, (F.col("swir") * 200.0).alias("biomass"))
    both = tables.before_after(px, ["biomass"])
    return event_carbon(cells, both, 0.2)


def event_carbon(cells, biomass, uncertainty_fraction, carbon_fraction=0.47):
    """Mean biomass before and after inside each event, and the carbon change it implies."""
    if not 0 < carbon_fraction < 1:
        raise ValueError("carbon_fraction must lie between 0 and 1")
    both = biomass.where("biomass_b IS NOT NULL AND biomass_e IS NOT NULL")
    mean = cells.join(both, CELL).groupBy(*GRID, "event_id").agg(F.avg("biomass_b").alias("b"), F.avg("biomass_e").alias("a"))
    change = F.col("a") - F.col("b")
    return mean.select(*GRID, "event_id", round6("b").alias("biomass_before"), round6("a").alias("biomass_after"), round6(change).alias("biomass_change"),
                       round6(change * carbon_fraction).alias("carbon_change"), round6(F.abs(change) * uncertainty_fraction).alias("uncertainty"))


_THR = ", ".join(f"({t})" for t in config.ALARM_THRESHOLDS)


@query("multi_threshold_alarms", rsql(s.FLOODSCORE + f""",
cand AS (SELECT tile_id * 10 + k AS tile_id, epoch, row, col, score FROM flood, (VALUES (0, 0.18), (1, 0.30), (2, 0.50)) t(k, thr) WHERE valid AND score >= thr),""" + components_sql("cand", "lab") + """,
ob AS (SELECT tile_id, epoch, label, count(*) AS n, avg(score) AS mc, max(score) AS xc FROM lab JOIN cand USING (tile_id, epoch, row, col) GROUP BY 1, 2, 3 HAVING count(*) >= 4)""",
    f"""SELECT tile_id // 10 AS tile_id, epoch, CAST([0.18, 0.30, 0.50][tile_id % 10 + 1] AS DOUBLE) AS threshold, label, n AS area_pixels, {r6('n * 0.04::DOUBLE')} AS area_ha,
  {r6('mc')} AS mean_confidence, {r6('xc')} AS max_confidence FROM ob"""))
def _(spark, sf):
    scored = scored_flood(tables.flood_inputs(tables.pixels(spark, sf)))
    return multi_threshold(scored, "score", config.ALARM_THRESHOLDS, block=LABEL_BLOCK)


def multi_threshold(scored, score, thresholds, min_pixels=4, pixel_ha=0.04, block=components.BLOCK):
    """Alarm objects at several operating points in one labelling pass."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    cells = scored.where("valid").select(*CELL, F.col(score).alias("score"), levels.alias("threshold")).where("score >= threshold")
    keys = [*GRID, "threshold"]
    labelled = events.label_candidates(cells, F.lit(True), ["score"], keys, 8, block)
    found = (labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area_pixels"), F.avg("score").alias("mc"), F.max("score").alias("xc"))
             .where(F.col("area_pixels") >= min_pixels))
    return found.select(*keys, "label", "area_pixels", round6(F.col("area_pixels") * pixel_ha).alias("area_ha"),
                        round6("mc").alias("mean_confidence"), round6("xc").alias("max_confidence"))


@query("alert_package", rsql(_FEV, f"""SELECT tile_id, epoch, 'FLOOD_ALERT_TILE' || tile_id || '_' || epoch || '_' || substr(sha256('tile' || tile_id || '_' || epoch), 1, 8) AS alert_id,
  count(*) AS event_count, {r6('sum(n) * 0.04::DOUBLE')} AS total_area_ha, {r6('max(n) * 0.04::DOUBLE')} AS peak_area_ha, {r6('avg(mean_score)')} AS mean_confidence,
  CASE WHEN sum(n) * 0.04 >= 100 THEN 'CRITICAL' WHEN sum(n) * 0.04 >= 10 THEN 'WARNING' ELSE 'ADVISORY' END AS severity FROM events_n GROUP BY 1, 2"""))
def _(spark, sf):
    _, _, found = flood_events(spark, sf)
    return alert_package(found)


def alert_package(found):
    """One alert per area and date. Its events stay in the event table, keyed by area and date,
    so an alert never has to hold an unbounded list."""
    area = F.concat(F.lit("tile"), F.col("tile_id"))
    digest = F.substring(F.sha2(F.concat_ws("_", area, "epoch"), 256), 1, 8)
    out = found.groupBy(*GRID).agg(F.count(F.lit(1)).alias("event_count"), F.sum("area_ha").alias("_n"), F.max("area_ha").alias("_p"),
                                   F.avg("mean_score").alias("mean_confidence"))
    total = F.round("_n", 6)
    return out.select(*GRID, F.concat_ws("_", F.lit("FLOOD_ALERT"), F.upper(area), "epoch", digest).alias("alert_id"), "event_count",
                      round6(total).alias("total_area_ha"), round6("_p").alias("peak_area_ha"),
                      round6("mean_confidence").alias("mean_confidence"), flood.severity(total, payload=True).alias("severity"))


_TRK = _EVENTS + f""",
ecell AS (SELECT tile_id, epoch, row, col, event_id FROM lab JOIN events_n USING (tile_id, epoch, label)),
sh AS (SELECT a.tile_id, a.epoch, a.event_id AS p, b.event_id AS r, count(*) AS k FROM ecell a JOIN ecell b ON a.tile_id = b.tile_id AND a.row = b.row AND a.col = b.col
  AND a.epoch = b.epoch + 1 GROUP BY 1, 2, 3, 4),
pr AS (SELECT a.tile_id, a.epoch, a.event_id AS p, b.event_id AS r, coalesce(k / (a.area_pixels + b.area_pixels - k)::DOUBLE, 0.0) AS iou,
  sqrt((a.centroid_row - b.centroid_row) * (a.centroid_row - b.centroid_row) + (a.centroid_col - b.centroid_col) * (a.centroid_col - b.centroid_col)) * 0.5 AS km
  FROM events_n a JOIN events_n b ON a.tile_id = b.tile_id AND a.epoch = b.epoch + 1 LEFT JOIN sh ON sh.tile_id = a.tile_id AND sh.epoch = a.epoch AND sh.p = a.event_id AND sh.r = b.event_id),
lk AS (SELECT *, row_number() OVER (PARTITION BY tile_id, epoch, p ORDER BY iou + greatest(0.0::DOUBLE, 1.0 - km / 2.0) * 0.25 DESC, r) AS rn FROM pr WHERE iou >= 0.2 OR km <= 2.0),
tr AS (SELECT e.tile_id, e.epoch, e.event_id, e.epoch AS e0, e.event_id AS i0 FROM events_n e LEFT JOIN lk ON lk.tile_id = e.tile_id AND lk.epoch = e.epoch AND lk.p = e.event_id AND rn = 1 WHERE lk.p IS NULL
  UNION ALL SELECT lk.tile_id, lk.epoch, lk.p, tr.e0, tr.i0 FROM tr JOIN lk ON lk.rn = 1 AND lk.tile_id = tr.tile_id AND lk.epoch = tr.epoch + 1 AND lk.r = tr.event_id),
tracked AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY tile_id ORDER BY e0, i0) AS INTEGER) AS track_id FROM tr JOIN events_n USING (tile_id, epoch, event_id))"""


def tracked_changes(spark, sf):
    labelled, found = change_events(spark, sf, keep=True)
    found = cut_lineage(found)
    cells = cut_lineage(events.event_cells(labelled.select(*CELL, "label"), found, GRID))
    linked = tracking.link_by_overlap_or_distance(found, cells, 500.0)
    return tracking.chain_tracks(linked)


@query("track_link_iou", rsql(_TRK, "SELECT tile_id, epoch, event_id, track_id FROM tracked"))
def _(spark, sf):
    return tracked_changes(spark, sf).select("tile_id", "epoch", "event_id", "track_id")


@query("track_trajectory", rsql(_TRK, f"""SELECT tile_id, track_id, min(epoch) AS first_epoch, max(epoch) AS last_epoch, count(*) AS n_observations, {r6('sum(area_pixels) * 0.01::DOUBLE')} AS cumulative_area_ha,
  {r6('max(area_pixels) * 0.01::DOUBLE')} AS peak_area_ha, {r6('max(abs(mean_change))')} AS max_abs_change, {r6('avg(mean_score)')} AS mean_score FROM tracked GROUP BY 1, 2"""))
def _(spark, sf):
    t = tracking.track_summary(tracked_changes(spark, sf))
    return t.select("tile_id", "track_id", "first_epoch", "last_epoch", "n_observations",
                    *[round6(c).alias(c) for c in ("cumulative_area_ha", "peak_area_ha", "max_abs_change", "mean_score")])


@query("track_link_mask")
def _(spark, sf):
    d = decided_drought(tables.drought_inputs(tables.pixels(spark, sf)))
    labelled = cut_lineage(events.label_candidates(d, F.col("score") >= config.DROUGHT.watch, ["score"], GRID, 8, LABEL_BLOCK))
    found = cut_lineage(events.summarize(labelled, GRID, 4, [F.avg("score").alias("mean_severity"), F.max("score").alias("peak_severity")]))
    cells = cut_lineage(events.event_cells(labelled.select(*CELL, "label"), found, GRID))
    span = found.agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).first()
    epochs = list(range(span["a"], span["b"] + 1)) if span["a"] is not None else []
    linked = tracking.link_exclusive(found, cells, epochs)
    return linked.groupBy("tile_id", "track_id").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.count(F.lit(1)).alias("duration_epochs"),
        round6(F.max("area_pixels") * 0.04).alias("peak_area_ha"), round6(F.max("peak_severity")).alias("peak_severity"))


# greedy order inside groups of chained detections, one step per detection
_DEDUP = s.FIRE + """,
fq AS MATERIALIZED (SELECT seq, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon, acq_date, acq_time, latitude, longitude, frp, source,
  epoch(strptime(acq_date || ' ' || acq_time, '%Y-%m-%d %H%M')) AS t FROM fp),
fo AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, source, lat, lon, seq) AS o FROM fq),
nr AS MATERIALIZED (SELECT a.o AS a, b.o AS b FROM fo a JOIN fo b ON b.t BETWEEN a.t - 1800 AND a.t + 1800 AND abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01 AND
  2.0 * 6371008.8 * asin(sqrt(least(1.0::DOUBLE, sin((radians(b.lat) - radians(a.lat)) / 2.0) * sin((radians(b.lat) - radians(a.lat)) / 2.0) +
  cos(radians(a.lat)) * cos(radians(b.lat)) * sin((radians(b.lon) - radians(a.lon)) / 2.0) * sin((radians(b.lon) - radians(a.lon)) / 2.0)))) <= 250.0),
cr AS (SELECT o, o AS label FROM fo UNION SELECT n.b, c.label FROM cr c JOIN nr n ON n.a = c.o WHERE c.label < n.b),
cl AS MATERIALIZED (SELECT o, min(label) AS g FROM cr GROUP BY 1),
ix AS MATERIALIZED (SELECT cl.o, cl.g, row_number() OVER (PARTITION BY cl.g ORDER BY cl.o) AS i, list(n.b) AS near FROM cl LEFT JOIN nr n ON n.a = cl.o AND n.b < cl.o GROUP BY cl.o, cl.g),
kp AS (SELECT g, i, [o] AS kept FROM ix WHERE i = 1 UNION ALL SELECT x.g, x.i, CASE WHEN list_has_any(kp.kept, x.near) THEN kp.kept ELSE list_append(kp.kept, x.o) END FROM kp JOIN ix x ON x.g = kp.g AND x.i = kp.i + 1),
ks AS (SELECT UNNEST(arg_max(kept, i)) AS k FROM kp GROUP BY g),
hm AS (SELECT n.a, min(n.b) AS k FROM nr n JOIN ks ON ks.k = n.b GROUP BY 1),
mg AS (SELECT h.k, max(f.frp) AS frp, count(*) AS n_merged FROM hm h JOIN fo f ON f.o = h.a GROUP BY 1)"""


@query("fire_dedup", rsql(_DEDUP, f"SELECT seq, latitude, longitude, acq_date, acq_time, {r6('mg.frp')} AS frp, n_merged FROM mg JOIN fo ON fo.o = mg.k"))
def _(spark, sf):
    merged = fire.merge_duplicates(fire.parse_points(tables.fire_points(spark, sf)), ["ts", "source", "lat", "lon", "seq"])
    return merged.select("seq", "latitude", "longitude", "acq_date", "acq_time", round6("frp").alias("frp"), "n_merged")


@query("bbox_coverage", s.sql("""b AS (SELECT p_partkey, (p_partkey % 10)::DOUBLE AS l, (p_size % 10)::DOUBLE AS bt, (p_partkey % 10)::DOUBLE + 1 + p_size % 4 AS r, (p_size % 10)::DOUBLE + 1 + p_partkey % 5 AS t FROM part),
c AS (SELECT *, least(7.0, r) - greatest(2.0, l) AS w, least(8.0, t) - greatest(3.0, bt) AS h FROM b)""",
    f"SELECT p_partkey, {r6('CASE WHEN w > 0 AND h > 0 THEN w * h / 25.0::DOUBLE ELSE 0.0 END')} AS coverage FROM c"))
def _(spark, sf):
    p = tables.table(spark, sf, "part")
    left, bottom = (F.col("p_partkey") % 10).cast("double"), (F.col("p_size") % 10).cast("double")
    box = [left, bottom, left + 1 + F.col("p_size") % 4, bottom + 1 + F.col("p_partkey") % 5]
    return p.select("p_partkey", round6(geo.bbox_coverage([F.lit(2.0), F.lit(3.0), F.lit(7.0), F.lit(8.0)], box)).alias("coverage"))


@query("geodetic_pixel_area", s.sql("""b AS (SELECT DISTINCT l_suppkey // 10 AS tile_id FROM lineitem), g AS (SELECT tile_id, 60.0::DOUBLE + (tile_id % 360) * 0.16 AS w, (tile_id % 80)::DOUBLE AS s FROM b)""",
    f"SELECT tile_id, {r6('abs(6371007.181::DOUBLE * 6371007.181 * radians((w + 0.16) - w) * (sin(radians(s + 0.16)) - sin(radians(s)))) / 10000.0 / 256.0')} AS pixel_ha FROM g"))
def _(spark, sf):
    t = tables.table(spark, sf, "lineitem").select(F.expr("l_suppkey div 10").alias("tile_id")).distinct()
    west, south = 60.0 + (F.col("tile_id") % 360) * 0.16, (F.col("tile_id") % 80).cast("double")
    area = geo.zone_area_m2(west, south, west + 0.16, south + 0.16)
    return t.select("tile_id", round6(area / 10000.0 / (SIDE * SIDE)).alias("pixel_ha"))


@query("write_event_table", rsql(_FEV, "SELECT tile_id, epoch, event_id, count(*) AS area_pixels FROM ecell GROUP BY 1, 2, 3"))
def _(spark, sf):
    _, labelled, found = flood_events(spark, sf, keep=True)
    cells = events.event_cells(labelled.select(*CELL, "label"), found, GRID)
    path = scratch_path(spark, "features")
    write_features(events.event_features(cells, 0.0, 0.0, PIXEL_M, -PIXEL_M, GRID), path)
    back = spark.read.schema("tile_id bigint, epoch int, feature string").json(path)
    parsed = back.withColumn("_p", F.from_json("feature", "properties struct<event_id:int,area_pixels:bigint>")["properties"])
    return parsed.groupBy(*GRID, F.col("_p.event_id").alias("event_id")).agg(F.sum("_p.area_pixels").alias("area_pixels"))
