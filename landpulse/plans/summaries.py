"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions import drought, flood, geo, indices, metrics
from landpulse.functions.core import fixed_rows, round6, share, with_fixed_rows
from landpulse.operators import grid, neighbours
from landpulse.operators.ordered import exact_percentiles
from landpulse.plans import sqlbase as s
from landpulse.plans.alignment import RING, polygons
from landpulse.plans.detection import GRID
from landpulse.plans.expressions import (K, MODES_SQL, REGIMES, _flood, mode_evidence, routed_tiles, scored_drought, scored_flood)
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.sources import tables
from landpulse.sources.tables import CELL, SIDE

METRICS = ("precision", "recall", "specificity", "npv", "f1", "balanced_accuracy", "iou", "mcc", "area_bias", "prevalence")
_R = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END)"
_P, _RC, _SP = _R("tp", "tp + fp"), _R("tp", "tp + fn"), _R("tn", "tn + fp")
METRIC_SQL = {
    "precision": _P, "recall": _RC, "specificity": _SP, "npv": _R("tn", "tn + fn"), "f1": _R(f"2.0 * {_P} * {_RC}", f"{_P} + {_RC}"),
    "balanced_accuracy": f"0.5 * ({_RC} + {_SP})", "iou": _R("tp", "tp + fp + fn"),
    "mcc": _R("tp::DOUBLE * tn - fp::DOUBLE * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)"),
    "area_bias": _R("tp + fp", "tp + fn"), "prevalence": _R("tp + fn", "tp + fp + fn + tn")}


def metrics_sql(names=METRICS) -> str:
    return ", ".join(f"{r6(METRIC_SQL[n])} AS {n}" for n in names)


def count_sql(pred: str, ref: str) -> str:
    return (f"count(*) FILTER (WHERE {pred} AND {ref}) AS tp, count(*) FILTER (WHERE {pred} AND NOT {ref}) AS fp, "
            f"count(*) FILTER (WHERE NOT {pred} AND {ref}) AS fn, count(*) FILTER (WHERE NOT {pred} AND NOT {ref}) AS tn")


def with_metrics(df, names=METRICS):
    made = metrics.scores()
    return df.select("*", *[round6(made[n]).alias(n) for n in names])


@query("change_summary", s.sql(s.DELTA, f"""SELECT tile_id, epoch, {r6('coalesce(count(*) FILTER (WHERE abs(delta) >= 0.2) / count(delta)::DOUBLE, 0.0)')} AS changed_fraction,
  {r6('count(delta) / count(*)::DOUBLE')} AS valid_fraction, {r6('avg(delta)')} AS mean_delta, {r6('quantile_cont(delta, 0.5)')} AS median_delta FROM delta GROUP BY 1, 2"""))
def _(spark, sf):
    d = tables.index_delta(tables.pixels(spark, sf))
    changed = indices.is_changed("delta", 0.2)
    a = d.groupBy(*GRID).agg(F.coalesce(share(changed), F.lit(0.0)).alias("changed_fraction"), share(F.col("delta").isNotNull()).alias("valid_fraction"),
                             F.avg("delta").alias("mean_delta"))
    out = a.join(exact_percentiles(d, GRID, "delta", {"median_delta": 0.5}), GRID, "left")
    return out.select(*GRID, *[round6(c).alias(c) for c in ("changed_fraction", "valid_fraction", "mean_delta", "median_delta")])


_PAIRED = ("mean_b", "mean_e", "mean_delta", "median_delta", "p05", "p95", "f_up", "f_down", "ge_005", "ge_010")


@query("paired_delta_stats", s.sql(s.DELTA, f"""SELECT epoch, count(delta) AS valid_pixels, {r6('avg(index_b) FILTER (WHERE delta IS NOT NULL)')} AS mean_b, {r6('avg(index_e) FILTER (WHERE delta IS NOT NULL)')} AS mean_e, {r6('avg(delta)')} AS mean_delta,
  {r6('quantile_cont(delta, 0.5)')} AS median_delta, {r6('quantile_cont(delta, 0.05)')} AS p05, {r6('quantile_cont(delta, 0.95)')} AS p95, {r6('avg((delta > 0)::INT)')} AS f_up, {r6('avg((delta < 0)::INT)')} AS f_down,
  {r6('avg((abs(delta) >= 0.05)::INT)')} AS ge_005, {r6('avg((abs(delta) >= 0.10)::INT)')} AS ge_010 FROM delta GROUP BY 1"""))
def _(spark, sf):
    d = tables.index_delta(tables.pixels(spark, sf)).where("delta IS NOT NULL")
    v = F.col("delta")
    a = d.groupBy("epoch").agg(F.count(v).alias("valid_pixels"), F.avg("index_b").alias("mean_b"), F.avg("index_e").alias("mean_e"), F.avg(v).alias("mean_delta"),
                               share(v > 0).alias("f_up"), share(v < 0).alias("f_down"), share(F.abs(v) >= 0.05).alias("ge_005"), share(F.abs(v) >= 0.10).alias("ge_010"))
    out = a.join(exact_percentiles(d, ["epoch"], "delta", {"median_delta": 0.5, "p05": 0.05, "p95": 0.95}), "epoch")
    return out.select("epoch", "valid_pixels", *[round6(c).alias(c) for c in _PAIRED])


_SIGN = lambda c: f"CASE WHEN {c} > 0 THEN 'increase' WHEN {c} < 0 THEN 'decrease' ELSE 'zero' END"


def direction(x):
    x = F.col(x)
    return F.when(x > 0, "increase").when(x < 0, "decrease").otherwise("zero")


@query("multimodal_direction", s.sql(s.DELTA + """,
md AS (SELECT e.tile_id, e.epoch, avg(d.delta) AS nd, avg(e.swir - b.swir) AS vv, avg(e.red - b.red) AS vh FROM pix e JOIN pix b ON e.tile_id = b.tile_id AND e.row = b.row AND e.col = b.col AND e.epoch = b.epoch + 1
  JOIN delta d ON d.tile_id = e.tile_id AND d.epoch = e.epoch AND d.row = e.row AND d.col = e.col GROUP BY 1, 2)""",
    f"SELECT tile_id, epoch, {_SIGN('nd')} AS ndvi, {_SIGN('vv')} AS vv, {_SIGN('vh')} AS vh, (nd > 0 AND vv > 0 AND vh > 0) OR (nd < 0 AND vv < 0 AND vh < 0) AS all_same FROM md"))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumn("index", indices.normalized_difference("nir", "red"))
    p = tables.before_after(px, ["index", "swir", "red"])
    m = p.groupBy(*GRID).agg(*[F.avg(F.col(f"{c}_e") - F.col(f"{c}_b")).alias(n) for c, n in (("index", "nd"), ("swir", "v"), ("red", "h"))])
    up, down = [(F.col("nd") > 0) & (F.col("v") > 0) & (F.col("h") > 0)], [(F.col("nd") < 0) & (F.col("v") < 0) & (F.col("h") < 0)]
    return m.select(*GRID, direction("nd").alias("ndvi"), direction("v").alias("vv"), direction("h").alias("vh"), (up[0] | down[0]).alias("all_same"))


@query("temporal_median", s.sql(s.PIX, f"SELECT tile_id, row, col, count(*) AS n_dates, {r6('quantile_cont(swir, 0.5)')} AS swir, {r6('quantile_cont(nir, 0.5)')} AS nir FROM pix GROUP BY 1, 2, 3 HAVING count(*) >= 2"))
def _(spark, sf):
    g = tables.pixels(spark, sf).groupBy("tile_id", "row", "col").agg(
        F.count(F.lit(1)).alias("n_dates"), round6(F.percentile("swir", F.lit(0.5))).alias("swir"), round6(F.percentile("nir", F.lit(0.5))).alias("nir"))
    return g.where("n_dates >= 2")


_CLIM = ("mean", "std", "median", "p10", "p20", "p80", "p90", "iqr", "low", "high")


def climatology(px, value, keys):
    """Distribution per cell over years; groups are bounded by the number of years."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.2, 0.5, 0.8, 0.9)]))
    g = px.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p.alias("_p"), F.min(value).alias("low"), F.max(value).alias("high"),
                              F.count(value).alias("n_years"))
    at = lambda i: F.col("_p")[i]
    return g.select(*keys, "n_years", "mean", "std", at(2).alias("median"), at(0).alias("p10"), at(1).alias("p20"), at(3).alias("p80"), at(4).alias("p90"),
                    (at(3) - at(1)).alias("iqr"), "low", "high")


@query("climatology_fit", s.sql(s.PIX + f", nv AS (SELECT *, {s.NDVI} AS v FROM pix)", f"""SELECT tile_id, row, col, count(v) AS n_years, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std, {r6('quantile_cont(v, 0.5)')} AS median,
  {r6('quantile_cont(v, 0.1)')} AS p10, {r6('quantile_cont(v, 0.2)')} AS p20, {r6('quantile_cont(v, 0.8)')} AS p80, {r6('quantile_cont(v, 0.9)')} AS p90, {r6('quantile_cont(v, 0.8) - quantile_cont(v, 0.2)')} AS iqr,
  {r6('min(v)')} AS low, {r6('max(v)')} AS high FROM nv GROUP BY 1, 2, 3"""))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumn("v", indices.ndvi("nir", "red"))
    c = climatology(px, "v", ["tile_id", "row", "col"])
    return c.select("tile_id", "row", "col", "n_years", *[round6(x).alias(x) for x in _CLIM])


def leave_one_out(px, value, floor=0.03, min_years=2):
    """Baseline without the own year, anomaly and condition index, per cell and epoch. The
    values of one cell (one per year) travel together, so the years are never joined pairwise."""
    cell = ["tile_id", "row", "col"]
    own = F.col("_o")
    g = px.groupBy(*cell).agg(F.collect_list(F.struct("epoch", F.col(value).alias("v"))).alias("_all"))
    e = g.withColumn("_o", F.explode("_all")).where(own["v"].isNotNull())
    others = F.transform(F.filter("_all", lambda y: (y["epoch"] != own["epoch"]) & y["v"].isNotNull()), lambda y: y["v"])
    e = e.select(*cell, own["epoch"].alias("epoch"), own["v"].alias("v"), others.alias("_x")).withColumn("n", F.size("_x"))
    add = lambda f: F.aggregate("_x", F.lit(0.0), lambda a, x: a + f(x))
    e = e.withColumn("mean", F.when(F.col("n") >= min_years, add(lambda x: x) / F.col("n")))
    e = e.withColumn("std", F.sqrt(add(lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n")))
    root = F.sqrt(F.col("n").cast("double"))
    return e.select(*CELL, "n", "mean", "std", (F.col("std") / root).alias("se"), drought.z_anomaly("v", "mean", "std", floor, 6.0).alias("z"),
                    F.when(F.col("mean").isNotNull(), 1.0 / root).alias("se_z"),
                    F.when(F.col("mean").isNotNull(), drought.vci("v", F.array_min("_x"), F.array_max("_x"), scale=100.0)).alias("vci"))


_LOO = ("mean", "std", "se", "z", "se_z", "vci")


@query("leave_one_year_out", s.sql(s.PIX + f""", nv AS (SELECT *, {s.NDVI} AS v FROM pix),
lo AS (SELECT a.tile_id, a.epoch, a.row, a.col, a.v, count(b.v) AS n, CASE WHEN count(b.v) >= 2 THEN avg(b.v) END AS mean, CASE WHEN count(b.v) >= 2 THEN stddev_pop(b.v) END AS std, min(b.v) AS lo, max(b.v) AS hi
  FROM nv a LEFT JOIN nv b ON a.tile_id = b.tile_id AND a.row = b.row AND a.col = b.col AND a.epoch <> b.epoch GROUP BY 1, 2, 3, 4, 5)""",
    f"""SELECT {K}, CAST(n AS INTEGER) AS n, {r6('mean')} AS mean, {r6('std')} AS std, {r6('std / sqrt(n)')} AS se, {r6(s.clip('(v - mean) / greatest(std, 0.03)', -6, 6))} AS z,
  {r6('CASE WHEN mean IS NOT NULL THEN 1.0 / sqrt(n) END')} AS se_z, {r6('CASE WHEN mean IS NOT NULL THEN ' + s.clip('100.0 * (v - lo) / greatest(hi - lo, 1e-4)', 0, 100) + ' END')} AS vci FROM lo"""))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumn("v", indices.ndvi("nir", "red"))
    return leave_one_out(px, "v").select(*CELL, "n", *[round6(c).alias(c) for c in _LOO])


def scl_distribution(px, keys=GRID):
    pct = lambda *codes: share(F.col("scl").isin(*codes)) * 100.0
    g = px.groupBy(*keys).agg(pct(4).alias("veg"), pct(5).alias("soil"), pct(8, 9, 10).alias("cloud"), pct(3).alias("shadow"), pct(11).alias("snow"),
                              pct(6).alias("water"), pct(0, 1, 2, 7).alias("invalid"))
    land, bad = F.col("veg") + F.col("soil"), F.col("cloud") + F.col("shadow")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), land / 100.0 * (1.0 - bad / 100.0)))
    return g.withColumns({"observability": score, "usable_land": (bad < 30.0) & (land >= 40.0), "usable_water": (bad < 30.0) & (F.col("water") >= 40.0), "usable_any": bad < 30.0})


_PC = lambda *c: f"avg((scl IN ({', '.join(map(str, c))}))::INT) * 100.0"


@query("scl_distribution", s.sql(s.PIX + f""", sd AS (SELECT tile_id, epoch, {_PC(4)} AS veg, {_PC(5)} AS soil, {_PC(8, 9, 10)} AS cloud, {_PC(3)} AS shadow, {_PC(11)} AS snow, {_PC(6)} AS water, {_PC(0, 1, 2, 7)} AS invalid FROM pix GROUP BY 1, 2)""",
    f"""SELECT tile_id, epoch, {', '.join(r6(c) + ' AS ' + c for c in ('veg', 'soil', 'cloud', 'shadow', 'snow', 'water', 'invalid'))}, {r6('greatest(0.0::DOUBLE, least(1.0::DOUBLE, (veg + soil) / 100.0 * (1.0 - (cloud + shadow) / 100.0)))')} AS observability,
  cloud + shadow < 30 AND veg + soil >= 40 AS usable_land, cloud + shadow < 30 AND water >= 40 AS usable_water, cloud + shadow < 30 AS usable_any FROM sd"""))
def _(spark, sf):
    d = scl_distribution(tables.pixels(spark, sf))
    return d.select(*GRID, *[round6(c).alias(c) for c in ("veg", "soil", "cloud", "shadow", "snow", "water", "invalid", "observability")], "usable_land", "usable_water", "usable_any")


_FEAT = ("permanent", "seasonal", "dry", "mean_elev", "min_elev", "p10", "relief", "mean_slope", "flat", "steep", "marine", "intertidal")


@query("regime_profile_flood", s.sql(REGIMES, f"SELECT tile_id, epoch, coastal, {', '.join(r6(c) + ' AS ' + c for c in _FEAT)} FROM feat2"))
def _(spark, sf):
    return routed_tiles(_flood(spark, sf)).select(*GRID, "coastal", *[round6(c).alias(c) for c in _FEAT])


_WS = lambda name: "CASE regime " + " ".join(f"WHEN '{r}' THEN {getattr(st, name)}::DOUBLE" for r, st in config.FLOOD_REGIME_SETTINGS.items()) + " END"


@query("regime_route_flood", s.sql(REGIMES, f"SELECT tile_id, epoch, regime, {r6('confidence')} AS confidence, {r6('1.0 - confidence')} AS uncertainty, {_WS('w_sar')} AS w_sar, {_WS('permanent_freq')} AS permanent_freq FROM regime"))
def _(spark, sf):
    r = routed_tiles(_flood(spark, sf))
    settings = flood.regime_settings("regime")
    return r.select(*GRID, "regime", round6("confidence").alias("confidence"), round6(1.0 - F.col("confidence")).alias("uncertainty"),
                    settings["set_w_sar"].alias("w_sar"), settings["set_permanent_freq"].alias("permanent_freq"))


_RD = s.DROUGHTIN + f""", rd AS (SELECT tile_id, avg(ndvi) AS m, avg(ndvi_hi - ndvi_lo) AS a, avg((scl = 4)::INT) * (tile_id % 6) AS irr, avg((occurrence > 0.8)::INT) * (tile_id % 3) AS wat FROM dz GROUP BY tile_id),
rg AS (SELECT *, CASE WHEN wat >= 0.20 THEN 'WETLAND_HIGH_MOISTURE' WHEN irr >= 0.30 THEN 'IRRIGATED_AGRICULTURE' WHEN m < 0.20 AND a < 0.20 THEN 'DRYLAND_SPARSE' WHEN a >= 0.35 THEN 'RAINFED_AGRICULTURE'
  WHEN m >= 0.55 AND a < 0.30 THEN 'FOREST' ELSE 'GRASSLAND_SHRUBLAND' END AS regime FROM rd)"""
_CASE = lambda d: "CASE regime " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in d.items()) + " END"


@query("regime_route_drought", s.sql(_RD, f"SELECT tile_id, {r6('m')} AS mean_ndvi, {r6('a')} AS amplitude, regime, {_CASE(config.DROUGHT_REGIME_CONFIDENCE)} AS confidence, {_CASE({k: v[0] for k, v in config.DROUGHT_REGIME_WEIGHTS.items()})} AS w_vegetation FROM rg"))
def _(spark, sf):
    d = tables.drought_inputs(tables.pixels(spark, sf))
    t = d.groupBy("tile_id").agg(F.avg("ndvi").alias("m"), F.avg(F.col("ndvi_hi") - F.col("ndvi_lo")).alias("a"), share(F.col("scl") == 4).alias("_i"), share(F.col("occurrence") > 0.8).alias("_w"))
    t = t.withColumn("regime", drought.regime_from_features("m", "a", F.col("_i") * (F.col("tile_id") % 6), F.col("_w") * (F.col("tile_id") % 3)))
    return t.select("tile_id", round6("m").alias("mean_ndvi"), round6("a").alias("amplitude"), "regime", drought.regime_confidence("regime").alias("confidence"), drought.regime_weight("regime", 0).alias("w_vegetation"))


def model_family(features):
    """Model family for a set of available feature names."""
    f = F.col(features)
    has = lambda *names: F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(f, n))
    optical, sar = has("NDVI", "DELTA_NDVI"), has("VV", "VH")
    context = F.arrays_overlap(f, F.array(F.lit("landcover"), F.lit("elevation"), F.lit("weather")))
    return (F.when(optical & sar & context, "multimodal_context_classifier").when(optical & sar, "multimodal_classifier")
            .when(optical, "optical_temporal_classifier").when(sar, "sar_change_classifier").otherwise("insufficient_evidence"))


@query("model_route", s.sql(s.PIX + """,
av AS (SELECT tile_id, epoch, bool_or(scl IN (4, 5)) AND tile_id % 4 <> 0 AS o, epoch > 1995 AS d, bool_or(red > 0) AND tile_id % 5 <> 1 AS h, tile_id % 2 = 0 AS x FROM pix GROUP BY tile_id, epoch)""",
    """SELECT tile_id, epoch, CASE WHEN o AND d AND h AND x THEN 'multimodal_context_classifier' WHEN o AND d AND h THEN 'multimodal_classifier' WHEN o AND d THEN 'optical_temporal_classifier'
  WHEN h THEN 'sar_change_classifier' ELSE 'insufficient_evidence' END AS model_family FROM av"""))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    on = lambda cond, name: F.when(cond, F.lit(name))
    t = F.col("tile_id")
    names = F.array(on(F.col("scl").isin(4, 5) & (t % 4 != 0), "NDVI"), on(F.col("epoch") > 1995, "DELTA_NDVI"), on((F.col("red") > 0) & (t % 5 != 1), "VV"),
                    on((F.col("red") > 0) & (t % 5 != 1), "VH"), on(t % 2 == 0, "elevation"))
    have = px.select(*GRID, F.explode(names).alias("f")).groupBy(*GRID).agg(F.collect_set("f").alias("features"))
    return have.select(*GRID, model_family("features").alias("model_family"))


_REG = ", ".join(f"({i}, '{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for i, (k, v) in enumerate(config.RAIN_CLIMATOLOGY.items()))


@query("rainfall_metrics", s.sql(s.STATION + f""", rg(i, region, m, sd) AS (VALUES {_REG}),
ra AS (SELECT station, sum(sv)::BIGINT / 10000.0::DOUBLE AS mm, count(*) AS n_days, date_diff('day', arg_min(day, (-sv, day)), max(day)) * 24.0::DOUBLE AS hours FROM sd GROUP BY 1)""",
    f"SELECT station, region, {r6('mm')} AS accumulation_mm, {r6('(mm - m) / greatest(1.0::DOUBLE, rg.sd)')} AS anomaly_std, hours AS hours_since_peak, n_days * 24 AS window_hours FROM ra JOIN rg ON station % 5 = i"))
def _(spark, sf):
    regions = fixed_rows([(k, *v) for k, v in config.RAIN_CLIMATOLOGY.items()], ("region", "m", "sd"))
    days = tables.station_days(spark, sf).withColumn("c", F.round(F.col("precip") * 100).cast("bigint"))
    g = days.groupBy("station").agg((F.sum("c") / 10000.0).alias("mm"), F.count(F.lit(1)).alias("n_days"), F.max("day").alias("last"), F.min_by("day", F.struct(-F.col("c"), "day")).alias("peak"))
    j = g.withColumn("_r", F.element_at(regions, (F.col("station") % 5 + 1).cast("int"))).select("*", "_r.*")
    return j.select("station", "region", round6("mm").alias("accumulation_mm"), round6((F.col("mm") - F.col("m")) / F.greatest(F.lit(1.0), F.col("sd"))).alias("anomaly_std"),
                    (F.datediff("last", "peak") * 24.0).alias("hours_since_peak"), (F.col("n_days") * 24).alias("window_hours"))


_SHOE = "abs(" + " + ".join(f"(px[{i}] * py[{i % 4 + 1}] - px[{i % 4 + 1}] * py[{i}])" for i in range(1, 5)) + ") / 2.0"
_MORPH = s.PIX + "," + RING + f""",
ar AS (SELECT tile_id, ({_SHOE}) * 0.00000001 * 111319.5::DOUBLE * 111319.5 * cos(radians((tile_id % 60)::DOUBLE)) AS m2 FROM ring),
ag AS (SELECT tile_id, count(*) AS n, sum(m2) / 10000.0 AS total, quantile_cont(m2 / 10000.0, 0.5) AS med, quantile_cont(m2 / 10000.0, 0.1) AS p10, quantile_cont(m2 / 10000.0, 0.9) AS p90,
  quantile_cont(2.0 * sqrt(m2 / pi()), 0.5) AS width, avg((m2 / 10000.0 < 0.04)::INT) AS f1, avg((m2 / 10000.0 < 0.08)::INT) AS f2, avg((m2 / 10000.0 < 0.20)::INT) AS f5 FROM ar GROUP BY 1),
tt AS (SELECT tile_id, avg(slope) AS sl, avg((slope > 8.0)::INT) AS st, quantile_cont(elevation, 0.1) AS e10, quantile_cont(elevation, 0.9) AS e90, avg((occurrence >= 0.05 AND occurrence < 0.80)::INT) AS sea FROM pix GROUP BY 1),
mo AS (SELECT *, st * (e90 - e10) / 10.0 AS geom FROM ag JOIN tt USING (tile_id))"""


@query("polygon_morphometry", s.sql(_MORPH, f"""SELECT tile_id, n AS polygon_count, {r6('total')} AS total_ha, {r6('med')} AS median_ha, {r6('p10')} AS p10_ha, {r6('p90')} AS p90_ha, {r6('width')} AS median_width_m, {r6('f1')} AS sub_1px,
  {r6('f2')} AS sub_2px, {r6('f5')} AS sub_5px, {r6('geom')} AS occlusion, CASE WHEN geom > 1.5 OR (f2 > 0.40 AND sl > 3.0) THEN 'SENSOR_GEOMETRY' WHEN sea > 0.03 OR e10 <= 3.0 THEN 'HYDRO_COASTAL' WHEN f2 > 0.30 THEN 'SUBPIXEL' ELSE 'ALGORITHMIC' END AS mechanism FROM mo"""))
def _(spark, sf):
    polys = polygons(spark, sf)
    m2 = geo.degrees_to_m2(geo.ring_area("ring") * 0.00000001, (F.col("tile_id") % 60).cast("double"))
    a = polys.select("tile_id", m2.alias("m2")).withColumns({"ha": F.col("m2") / 10000.0, "width": geo.equivalent_width("m2")})
    g = a.groupBy("tile_id").agg(F.count(F.lit(1)).alias("polygon_count"), F.sum("ha").alias("total_ha"), share(F.col("ha") < 0.04).alias("sub_1px"),
                                 share(F.col("ha") < 0.08).alias("sub_2px"), share(F.col("ha") < 0.20).alias("sub_5px"))
    g = (g.join(exact_percentiles(a, ["tile_id"], "ha", {"median_ha": 0.5, "p10_ha": 0.1, "p90_ha": 0.9}), "tile_id")
         .join(exact_percentiles(a, ["tile_id"], "width", {"median_width_m": 0.5}), "tile_id"))
    px = tables.pixels(spark, sf)
    t = px.groupBy("tile_id").agg(F.avg("slope").alias("sl"), share(F.col("slope") > 8.0).alias("st"), share((F.col("occurrence") >= 0.05) & (F.col("occurrence") < 0.80)).alias("sea"))
    t = t.join(exact_percentiles(px, ["tile_id"], "elevation", {"e10": 0.1, "e90": 0.9}), "tile_id")
    j = g.join(t, "tile_id").withColumn("occlusion", F.col("st") * (F.col("e90") - F.col("e10")) / 10.0)
    mechanism = (F.when((F.col("occlusion") > 1.5) | ((F.col("sub_2px") > 0.40) & (F.col("sl") > 3.0)), "SENSOR_GEOMETRY")
                 .when((F.col("sea") > 0.03) | (F.col("e10") <= 3.0), "HYDRO_COASTAL").when(F.col("sub_2px") > 0.30, "SUBPIXEL").otherwise("ALGORITHMIC"))
    cols = ("total_ha", "median_ha", "p10_ha", "p90_ha", "median_width_m", "sub_1px", "sub_2px", "sub_5px", "occlusion")
    return j.select("tile_id", "polygon_count", *[round6(c).alias(c) for c in cols], mechanism.alias("mechanism"))


@query("block_aggregate", s.sql(s.PIX, f"SELECT tile_id, epoch, row // 5 AS row, col // 5 AS col, {r6('avg(swir)')} AS mean, {r6('avg((swir >= 0.5)::INT)')} AS fraction, count(*) AS n_cells, (avg(swir) >= 0.5)::INT::DOUBLE AS majority FROM pix GROUP BY 1, 2, 3, 4"))
def _(spark, sf):
    b = grid.block_aggregate(tables.pixels(spark, sf), 5, "swir", GRID)
    return b.select(*CELL, round6("mean").alias("mean"), round6("fraction").alias("fraction"), "n_cells", "majority")


@query("grid_sensitivity", s.sql(s.DROUGHTSCORE + f""",
gs AS (SELECT f, epoch, avg(score) AS p, avg(reference::INT) >= 0.5 AS ref FROM drought, (VALUES (1), (5), (10)) t(f) GROUP BY f, epoch, tile_id, row // f, col // f),
gc AS (SELECT f AS factor, count(*) AS n_cells, avg((p - ref::INT) * (p - ref::INT)) AS brier, {count_sql('p >= 0.25', 'ref')} FROM gs GROUP BY 1)""",
    f"SELECT factor, n_cells, {r6('brier')} AS brier, tp, fp, fn, tn, {metrics_sql()} FROM gc"))
def _(spark, sf):
    d = scored_drought(tables.drought_inputs(tables.pixels(spark, sf))).select(*CELL, "score", F.col("reference").cast("double").alias("ref"))
    long = d.withColumn("factor", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    cells = long.groupBy("factor", *GRID, F.floor(F.col("row") / F.col("factor")), F.floor(F.col("col") / F.col("factor"))).agg(F.avg("score").alias("p"), (F.avg("ref") >= 0.5).alias("ref"))
    err = F.col("p") - F.col("ref").cast("double")
    g = cells.groupBy("factor").agg(F.count(F.lit(1)).alias("n_cells"), round6(F.avg(err * err)).alias("brier"), *metrics.counts(F.col("p") >= 0.25, "ref"))
    return with_metrics(g)


@query("native_cell_agreement", s.sql(s.FLOODSCORE + f""",
nc AS (SELECT tile_id, epoch, row // 4 AS br, col // 4 AS bc, avg((valid AND score >= 0.4)::INT) AS frac, max(CASE WHEN reference THEN 1 ELSE 0 END) AS burned, sum(scl) % 16 AS qa FROM flood GROUP BY 1, 2, 3, 4),
nv AS (SELECT *, (qa & 1) = 1 AND ((qa >> 1) & 1) = 1 AS ok, (qa & 1) = 1 AND ((qa >> 1) & 1) = 1 AND ((qa >> 2) & 1) = 0 AND ((qa >> 3) & 1) = 0 AS hc FROM nc),
nx AS (SELECT count(*) AS n_cells, {count_sql('frac >= 0.20', '(burned = 1 AND hc)')} FROM nv WHERE ok)""",
    f"SELECT n_cells, tp, fp, fn, tn, {metrics_sql(('precision', 'recall', 'f1', 'mcc'))}, {r6('(tp + fp) * 21.466')} AS predicted_ha, {r6('(tp + fn) * 21.466')} AS reference_ha, {r6('(fp - fn) * 21.466::DOUBLE')} AS bias_ha FROM nx"))
def _(spark, sf):
    d = scored_flood(_flood(spark, sf))
    coarse = d.groupBy(*GRID, F.floor(F.col("row") / 4), F.floor(F.col("col") / 4)).agg(
        share(F.col("valid") & (F.col("score") >= 0.4)).alias("frac"), F.max(F.col("reference").cast("int")).alias("burned"), (F.sum("scl") % 16).alias("qa"))
    bits = indices.burn_quality("qa")
    ok = coarse.where(bits["is_land"] & bits["is_valid"])
    g = ok.agg(F.count(F.lit(1)).alias("n_cells"), *metrics.counts(F.col("frac") >= 0.20, (F.col("burned") == 1) & bits["high_confidence"]))
    ha = config.MODIS_CELL_HA
    out = with_metrics(g, ("precision", "recall", "f1", "mcc"))
    return out.withColumns({"predicted_ha": round6((F.col("tp") + F.col("fp")) * ha), "reference_ha": round6((F.col("tp") + F.col("fn")) * ha), "bias_ha": round6((F.col("fp") - F.col("fn")) * ha)})


@query("monthly_max_merge", """SELECT l_suppkey // 10 AS tile_id, CAST(l_orderkey % 16 AS INTEGER) AS row, CAST(l_partkey % 16 AS INTEGER) AS col, CAST(max(CASE WHEN l_returnflag = 'R' THEN dayofyear(l_shipdate) ELSE 0 END) AS INTEGER) AS burn_day,
  max(l_linenumber) AS qa FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    day = F.when(F.col("l_returnflag") == "R", F.dayofyear("l_shipdate")).otherwise(0)
    return li.groupBy(F.expr("l_suppkey div 10").alias("tile_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col")).agg(
        F.max(day).alias("burn_day"), F.max("l_linenumber").alias("qa"))


@query("lead_time", s.sql(MODES_SQL + """,
le AS (SELECT tile_id, epoch, mode, avg(e) AS e, avg(reference::INT) AS r FROM fm GROUP BY 1, 2, 3),
lt AS (SELECT tile_id, mode, min(CASE WHEN e > 0.15 THEN epoch END) AS first_evidence, min(CASE WHEN r > 0.19 THEN epoch END) AS first_reference FROM le GROUP BY 1, 2)""",
    "SELECT tile_id, mode, first_evidence, first_reference, date_diff('day', make_date(first_evidence, 1, 1), make_date(first_reference, 1, 1)) AS lead_days FROM lt"))
def _(spark, sf):
    m = mode_evidence(tables.drought_inputs(tables.pixels(spark, sf)))
    e = m.groupBy(*GRID, "mode").agg(F.avg("e").alias("e"), share("reference").alias("r"))
    t = e.groupBy("tile_id", "mode").agg(F.min(F.when(F.col("e") > 0.15, F.col("epoch"))).alias("first_evidence"), F.min(F.when(F.col("r") > 0.19, F.col("epoch"))).alias("first_reference"))
    start = lambda c: F.make_date(F.col(c), F.lit(1), F.lit(1))
    return t.withColumn("lead_days", F.datediff(start("first_reference"), start("first_evidence")))


@query("job_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return tables.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("by_sensor", "SELECT o_orderpriority AS sensor, CAST(o_custkey % 20 AS INTEGER) AS tile, count(*) AS n, count(DISTINCT o_custkey % 200) AS n_tiles FROM orders GROUP BY ROLLUP (1, 2)")
def _(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sensor"), (F.col("o_custkey") % 20).cast("int").alias("tile"), (F.col("o_custkey") % 200).alias("t"))
    return o.rollup("sensor", "tile").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("n_tiles"))


@query("replay_scorecard", s.sql(s.SCENES, f"""SELECT count(*) AS cycles, {r6("avg((platform <> 'P')::INT)")} AS discovery_rate, {r6("avg((slice_number IS NOT NULL)::INT) FILTER (WHERE platform <> 'P')")} AS pairing_rate, {r6("avg((platform = 'O')::INT)")} AS success_rate,
  {r6('quantile_cont(cloud, 0.5)')} AS median_s, {r6('quantile_cont(cloud, 0.95)')} AS p95_s, min(cloud) AS min_s, max(cloud) AS max_s FROM sc"""))
def _(spark, sf):
    sc = tables.scenes(spark, sf)
    found = F.col("platform") != "P"
    a = sc.agg(F.count(F.lit(1)).alias("cycles"), round6(share(found)).alias("discovery_rate"), round6(share(F.when(found, F.col("slice_number").isNotNull()))).alias("pairing_rate"),
               round6(share(F.col("platform") == "O")).alias("success_rate"), F.min("cloud").alias("min_s"), F.max("cloud").alias("max_s"))
    p = exact_percentiles(sc, [], "cloud", {"median_s": 0.5, "p95_s": 0.95})
    both = a.withColumn("_p", p.select(F.struct("median_s", "p95_s")).scalar())
    return both.withColumns({"median_s": round6("_p.median_s"), "p95_s": round6("_p.p95_s")}).drop("_p")


_CH = ", ".join(f"('{m}', {str('sar' in c).lower()}, {str('optical' in c).lower()}, {str('novelty' in c).lower()}, {str('terrain' in c).lower()}, {str('rainfall' in c).lower()})" for m, c in config.FLOOD_ABLATION_MODES.items())
_PRIM = "CASE WHEN so AND oo THEN (0.35 * sar + 0.25 * opt) / (0.35 + 0.25) WHEN so THEN sar ELSE opt END"
FLOOD_MODES = s.FLOODSCORE + f""",
mode(mode, u_s, u_o, u_n, u_t, u_r) AS (VALUES {_CH}),
mx AS (SELECT f.*, mode, u_n, u_t, u_r, sar_ok AND u_s AS so, opt_ok AND u_o AS oo FROM flood f, mode),
ms AS (SELECT tile_id, epoch, row, col, reference, mode, (so OR oo) AS ok, {s.clip(f'({_PRIM}) * CASE WHEN u_n THEN nov ELSE 1.0 END * CASE WHEN u_t THEN terr ELSE 1.0 END * CASE WHEN u_r THEN 0.70 + 0.30 * 0.5 ELSE 1.0 END', 0, 1)} AS g,
  (CASE WHEN so THEN sar * 0.35 ELSE 0 END + CASE WHEN oo THEN opt * 0.25 ELSE 0 END + CASE WHEN u_n THEN nov * 0.20 ELSE 0 END + CASE WHEN u_t THEN terr * 0.10 ELSE 0 END + CASE WHEN u_r THEN 0.05 ELSE 0 END) /
  nullif(CASE WHEN so THEN 0.35 ELSE 0 END + CASE WHEN oo THEN 0.25 ELSE 0 END + CASE WHEN u_n THEN 0.20 ELSE 0 END + CASE WHEN u_t THEN 0.10 ELSE 0 END + CASE WHEN u_r THEN 0.10 ELSE 0 END, 0) AS l FROM mx),
mscore AS (SELECT tile_id, epoch, row, col, reference, mode, 'gated' AS strategy, CASE WHEN ok THEN g ELSE 0.0 END AS score, ok FROM ms UNION ALL SELECT tile_id, epoch, row, col, reference, mode, 'linear', CASE WHEN ok THEN l ELSE 0.0 END, ok FROM ms)"""


def mode_scores(scored):
    """Flood score under every channel mode (6 fixed ones) and fusion strategy (columns gated and linear)."""
    rows = [(m, *[n in c for n in ("sar", "optical", "novelty", "terrain", "rainfall")]) for m, c in config.FLOOD_ABLATION_MODES.items()]
    x = with_fixed_rows(scored.select(*CELL, "reference", "sar", "sar_ok", "optical", "opt_ok", "novelty", "terrain"), rows, ("mode", "u_s", "u_o", "u_n", "u_t", "u_r"))
    x = x.withColumns({"so": F.col("sar_ok") & F.col("u_s"), "oo": F.col("opt_ok") & F.col("u_o"), "n": F.when(F.col("u_n"), F.col("novelty")), "t": F.when(F.col("u_t"), F.col("terrain")),
                       "r": F.when(F.col("u_r"), 0.5)})
    gated = flood.fuse_gated("sar", "so", "optical", "oo", "n", "t", "r")
    linear = flood.fuse_linear("sar", "so", "optical", "oo", "n", "u_n", "t", "u_t", "r")
    return x.where("so OR oo").select(*CELL, "reference", "mode", gated.alias("gated"), linear.alias("linear"))


def sweep(df, keys, score, thresholds, reference="reference"):
    """Confusion counts at several thresholds in one aggregation."""
    aggs = [c.alias(f"{n}_{i}") for i, t in enumerate(thresholds) for c, n in zip(metrics.counts(F.coalesce(F.col(score) >= t, F.lit(False)), reference), ("tp", "fp", "fn", "tn"))]
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])
    return g.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


@query("ablation_matrix", s.sql(FLOOD_MODES + f""",
thr(t) AS (VALUES (0.15), (0.20), (0.30), (0.50)),
cd AS (SELECT mode, strategy, t, tile_id, epoch, row, col, reference FROM mscore, thr WHERE ok AND score >= t),
ob AS (SELECT mode, strategy, t, tile_id, epoch, row - a.i AS br, col - b.i AS bc FROM cd, range(2) a(i), range(2) b(i) GROUP BY ALL HAVING count(*) = 4),
oc AS (SELECT DISTINCT mode, strategy, t, tile_id, epoch, CAST(br + a.i AS INTEGER) AS row, CAST(bc + b.i AS INTEGER) AS col FROM ob, range(2) a(i), range(2) b(i)),
am AS (SELECT mode, strategy, t AS threshold, {count_sql('(oc.row IS NOT NULL)', 'reference')} FROM (SELECT * FROM mscore, thr WHERE ok) LEFT JOIN oc USING (mode, strategy, t, tile_id, epoch, row, col) GROUP BY 1, 2, 3)""",
    f"SELECT mode, strategy, CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn, {metrics_sql(('precision', 'recall', 'f1', 'iou', 'mcc', 'area_bias'))} FROM am"))
def _(spark, sf):
    strategies = ("gated", "linear")
    opened = neighbours.gray_openings(mode_scores(scored_flood(_flood(spark, sf))), {n: f"{n}_opened" for n in strategies}, [*GRID, "mode"])
    # pixels collapse to the thresholds that they reach before the sweep
    reached = lambda n: F.array_max(F.array(*[F.when(F.col(f"{n}_opened") >= t, F.lit(float(t))) for t in config.SWEEP_THRESHOLDS]))
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), reached(n).alias("opened")) for n in strategies]))
    levels = opened.select("mode", "reference", both.alias("b")).groupBy("mode", "b.strategy", "b.opened", "reference").agg(F.count(F.lit(1)).alias("n"))
    alarm = [F.coalesce(F.col("opened") >= t, F.lit(False)) for t in config.SWEEP_THRESHOLDS]
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    true = F.col("reference")
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), part(a & true).alias("tp"), part(a & ~true).alias("fp"), part(~a & true).alias("fn"), part(~a & ~true).alias("tn"))
                     for t, a in zip(config.SWEEP_THRESHOLDS, alarm)])
    swept = levels.groupBy("mode", "strategy").agg(rows.alias("_r")).select("mode", "strategy", F.explode("_r").alias("_r")).select("mode", "strategy", "_r.*")
    return with_metrics(swept, ("precision", "recall", "f1", "iou", "mcc", "area_bias"))
