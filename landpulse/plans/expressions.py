"""Per-pixel expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions import drought, flood, indices
from landpulse.functions.core import clip, round6, share, with_fixed_rows
from landpulse.operators.skew import attach_stats, salted_join
from landpulse.plans import sqlbase as s
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.sources import tables
from landpulse.sources.tables import CELL

K = "tile_id, epoch, row, col"


@query("normalized_difference", s.sql(s.PIX, f"SELECT {K}, {r6(s.INDEX)} AS index FROM pix"))
def _(spark, sf):
    return tables.pixels(spark, sf).select(*CELL, round6(indices.normalized_difference("nir", "red")).alias("index"))


@query("ndvi", s.sql(s.PIX, f"SELECT {K}, {r6(s.NDVI)} AS ndvi FROM pix"))
def _(spark, sf):
    return tables.pixels(spark, sf).select(*CELL, round6(indices.ndvi("nir", "red")).alias("ndvi"))


def _bounded(a, b):
    return s.clip(f"CASE WHEN {a} + {b} > 1e-6 THEN ({a} - {b}) / ({a} + {b}) ELSE 0.0 END", -1, 1)


@query("ndre", s.sql(s.PIX, f"SELECT {K}, {r6(_bounded('nir', 'green'))} AS ndre FROM pix"))
def _(spark, sf):
    return tables.pixels(spark, sf).select(*CELL, round6(indices.ndre("nir", "green")).alias("ndre"))


@query("ndwi_moisture", s.sql(s.PIX, f"SELECT {K}, {r6(_bounded('nir', 'swir'))} AS ndwi FROM pix"))
def _(spark, sf):
    return tables.pixels(spark, sf).select(*CELL, round6(indices.ndwi_moisture("nir", "swir")).alias("ndwi"))


_EVI = s.clip("CASE WHEN nir / k + 6.0 * (red / k) - 7.5 * (blue / k) + 1.0 > 1e-6 THEN 2.5 * (nir / k - red / k) / "
              "(nir / k + 6.0 * (red / k) - 7.5 * (blue / k) + 1.0) ELSE 0.0 END", -1, 1.5)


@query("evi", s.sql(s.PIX + """,
dn AS (SELECT tile_id, epoch, row, col, nir * 200.0 AS nir, red * 200.0 AS red, blue * 200.0 AS blue FROM pix),
sc AS (SELECT *, CASE WHEN max(nir) OVER (PARTITION BY tile_id, epoch) > 10.0 THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM dn)""",
                    f"SELECT {K}, {r6(_EVI)} AS evi FROM sc"))
def _(spark, sf):
    bands = tables.pixels(spark, sf).select(*CELL, *[(F.col(b) * 200.0).alias(b) for b in ("nir", "red", "blue")])
    peaked = attach_stats(bands, ["tile_id", "epoch"], [F.max("nir").alias("max_nir")], ["row", "col"])
    return peaked.select(*CELL, round6(indices.evi("nir", "red", "blue", "max_nir")).alias("evi"))


@query("reflectance_scale", s.sql(s.SUMS, f"SELECT {K}, {r6('sp / 10000.0::DOUBLE')} AS reflectance FROM sums"))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumn("dn", F.round(F.col("blue") * 1000.0 * F.col("n")))
    return px.select(*CELL, round6(indices.reflectance("dn")).alias("reflectance"))


@query("scl_mask", s.sql(s.PIX, f"""SELECT {K}, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS ok_default,
  scl NOT IN (1, 3, 8, 9, 10, 11) AS ok_cloud, scl IN (4, 5) AS ok_terrestrial, scl IN (4, 5, 6, 7) AS ok_flood FROM pix"""))
def _(spark, sf):
    return tables.pixels(spark, sf).select(
        *CELL, *[indices.scl_usable("scl", p).alias(f"ok_{p}") for p in ("default", "cloud", "terrestrial", "flood")])


@query("sar_to_db", s.sql(s.PIX, f"SELECT {K}, {r6('CASE WHEN red > 0 THEN 10.0 * log10(red) END')} AS vh_db FROM pix"))
def _(spark, sf):
    return tables.pixels(spark, sf).select(*CELL, round6(indices.to_db("red")).alias("vh_db"))


@query("sar_dn_to_linear", s.sql(s.SUMS, f"""SELECT {K}, {r6('(sq / 475.0::DOUBLE) * (sq / 475.0::DOUBLE)')} AS vv,
  {r6('(sp / 530.0::DOUBLE) * (sp / 530.0::DOUBLE)')} AS vh FROM sums"""))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    return px.select(*CELL,
                     round6(indices.dn_to_linear(F.round(F.col("swir") * 50.0 * F.col("n")), config.VV_DN_SCALE)).alias("vv"),
                     round6(indices.dn_to_linear(F.round(F.col("blue") * 1000.0 * F.col("n")), config.VH_DN_SCALE)).alias("vh"))


@query("index_delta", s.sql(s.DELTA, f"SELECT {K}, {r6('delta')} AS delta, abs(delta) >= 0.2 AS changed FROM delta"))
def _(spark, sf):
    d = tables.index_delta(tables.pixels(spark, sf))
    return d.select(*CELL, round6("delta").alias("delta"), indices.is_changed("delta", 0.2).alias("changed"))


@query("disturbance_score", s.sql(s.DELTA, f"SELECT {K}, {r6(s.clip('abs(delta) / 0.2', 0, 1))} AS score FROM delta"))
def _(spark, sf):
    d = tables.index_delta(tables.pixels(spark, sf))
    return d.select(*CELL, round6(indices.disturbance_score("delta", 0.2)).alias("score"))


@query("joint_valid_label", s.sql(s.PIX, """SELECT e.tile_id, e.epoch, e.row, e.col,
  CAST(CASE WHEN NOT (b.scl NOT IN (0,1,3,8,9,10,11) AND e.scl NOT IN (0,1,3,8,9,10,11) AND b.n > 0 AND e.n > 0 AND b.red > 0 AND e.red > 0) THEN 255
       WHEN e.swir - b.swir > 0.15 OR 10.0 * log10(e.red) - 10.0 * log10(b.red) < -3.0 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM pix e JOIN pix b ON e.tile_id = b.tile_id AND e.row = b.row AND e.col = b.col AND e.epoch = b.epoch + 1"""))
def _(spark, sf):
    pairs = tables.before_after(tables.pixels(spark, sf), ["scl", "n", "red", "swir"])
    label = indices.joint_event_label("scl_b", "scl_e", "n_b", "n_e", "red_b", "red_e", "swir_b", "swir_e")
    return pairs.select(*CELL, label.alias("label"))


def _flood(spark, sf):
    return tables.flood_inputs(tables.pixels(spark, sf))


@query("sar_water_evidence", s.sql(s.FLOODSCORE, f"SELECT {K}, {r6('sar')} AS sar, sar_ok FROM ev"))
def _(spark, sf):
    bands = ("vv_b", "vv_e", "vh_b", "vh_e")
    return _flood(spark, sf).select(*CELL, round6(flood.sar_water(*bands)).alias("sar"),
                                    flood.sar_valid(*bands).alias("sar_ok"))


@query("optical_water_evidence", s.sql(s.FLOODSCORE, f"SELECT {K}, {r6('opt')} AS optical, opt_ok FROM ev"))
def _(spark, sf):
    bands = ("green", "nir", "swir", "scl")
    return _flood(spark, sf).select(*CELL, round6(flood.optical_water(*bands)).alias("optical"),
                                    flood.optical_valid(*bands).alias("opt_ok"))


@query("water_novelty", s.sql(s.FLOODSCORE, f"SELECT {K}, {r6(s.clip('sar * nov', 0, 1))} AS novelty FROM ev"))
def _(spark, sf):
    sar = flood.sar_water("vv_b", "vv_e", "vh_b", "vh_e")
    return _flood(spark, sf).select(*CELL, round6(flood.water_novelty(sar, "occurrence")).alias("novelty"))


_OCC = "CASE WHEN so % 120 <= 100 THEN (so % 120) / 100.0::DOUBLE END"


@query("normalize_occurrence", s.sql(s.SUMS, f"SELECT {K}, {r6(_OCC)} AS frequency FROM sums"))
def _(spark, sf):
    raw = tables.pixels(spark, sf).withColumn("percent", F.round(F.col("green") * 1000.0 * F.col("n")).cast("bigint") % 120)
    return raw.select(*CELL, round6(flood.normalize_occurrence("percent")).alias("frequency"))


@query("permanent_water", s.sql(s.PIX, f"SELECT {K}, occurrence >= 0.80 AS permanent FROM pix"))
def _(spark, sf):
    return tables.pixels(spark, sf).select(*CELL, flood.permanent_water("occurrence").alias("permanent"))


@query("terrain_plausibility", s.sql(s.FLOODSCORE, f"SELECT {K}, {r6('terr')} AS terrain FROM ev"))
def _(spark, sf):
    return _flood(spark, sf).select(*CELL, round6(flood.terrain_plausibility("slope")).alias("terrain"))


_RAIN = (f"CASE WHEN mm < 15.0 THEN 0.05::DOUBLE ELSE {s.clip('0.6 * ' + s.clip('mm / 100.0', 0, 1) + ' + 0.4 * ' + s.clip('(sigma + 1.0) / 4.0', 0, 1), 0, 1)}"
         " * (0.5 + 0.5 * exp(-greatest(0.0::DOUBLE, hours) / 72.0)) END")
_RAIN_AOI = s.STATION + """,
aoi AS (SELECT station, sum(sv) / 10000.0::DOUBLE AS mm, date_diff('day', arg_min(day, (-sv, day)), max(day)) * 24.0::DOUBLE AS hours
  FROM sd GROUP BY station),
rain AS (SELECT station, mm, (mm - 35.0) / 30.0 AS sigma, hours FROM aoi)"""


def _aoi_rain(spark, sf):
    """Rainfall per area: total, anomaly against the default region, hours since the first peak."""
    days = tables.station_days(spark, sf).withColumn("cents", F.round(F.col("precip") * 100.0).cast("bigint"))
    return (days.groupBy("station")
            .agg((F.sum("cents") / 10000.0).alias("mm"), F.max("day").alias("last"),
                 F.min_by("day", F.struct(-F.col("cents"), "day")).alias("peak"))
            .select("station", "mm", ((F.col("mm") - 35.0) / 30.0).alias("sigma"),
                    (F.datediff("last", "peak") * 24.0).alias("hours")))


@query("rainfall_context", s.sql(_RAIN_AOI, f"SELECT station, {r6(_RAIN)} AS rain FROM rain"))
def _(spark, sf):
    return _aoi_rain(spark, sf).select("station", round6(flood.rainfall_context("mm", "sigma", "hours")).alias("rain"))


def scored_flood(df, s_=config.FLOOD):
    """Evidence channels, validity and the gated score for flood inputs."""
    e = df.withColumns({"sar": flood.sar_water("vv_b", "vv_e", "vh_b", "vh_e", s_),
                        "sar_ok": flood.sar_valid("vv_b", "vv_e", "vh_b", "vh_e"),
                        "optical": flood.optical_water("green", "nir", "swir", "scl", s_),
                        "opt_ok": flood.optical_valid("green", "nir", "swir", "scl"),
                        "novelty": flood.novelty_multiplier("occurrence", s_),
                        "terrain": flood.terrain_plausibility("slope", s_)})
    return e.withColumns({"valid": F.col("sar_ok") | F.col("opt_ok"),
                          "score": flood.fuse_gated("sar", "sar_ok", "optical", "opt_ok", "novelty", "terrain", None, s_)})


@query("fuse_flood_gated", s.sql(s.FLOODSCORE, f"SELECT {K}, {r6('score')} AS score, valid FROM flood"))
def _(spark, sf):
    return scored_flood(_flood(spark, sf)).select(*CELL, round6("score").alias("score"), "valid")


_LIN = """CASE WHEN valid THEN (CASE WHEN sar_ok THEN sar * 0.35 ELSE 0 END + CASE WHEN opt_ok THEN opt * 0.25 ELSE 0 END + nov * 0.20 + terr * 0.10 + 0.5 * 0.10)
  / (CASE WHEN sar_ok THEN 0.35 ELSE 0 END + CASE WHEN opt_ok THEN 0.25 ELSE 0 END + 0.20 + 0.10 + 0.10) ELSE 0.0 END"""


@query("fuse_flood_linear", s.sql(s.FLOODSCORE, f"SELECT {K}, {r6(_LIN)} AS score FROM flood"))
def _(spark, sf):
    e = scored_flood(_flood(spark, sf))
    linear = flood.fuse_linear("sar", "sar_ok", "optical", "opt_ok", "novelty", F.lit(True), "terrain", F.lit(True), 0.5)
    return e.select(*CELL, round6(linear).alias("score"))


def flood_status(scored):
    """Per grid: status and the channels that are valid somewhere in it."""
    has = lambda c: F.bool_or(F.col(c))
    return (scored.groupBy("tile_id", "epoch")
            .agg(has("sar_ok").alias("_s"), has("opt_ok").alias("_o"), has("nov_ok").alias("_n"), has("terr_ok").alias("_t"),
                 share("valid").alias("valid_fraction"))
            .select("tile_id", "epoch", F.when(F.col("_s") | F.col("_o"), "accepted").otherwise("no_evidence").alias("status"),
                    F.concat_ws(",", F.when(F.col("_s"), "sar"), F.when(F.col("_o"), "optical"), F.when(F.col("_n"), "novelty"),
                                F.when(F.col("_t"), "terrain")).alias("channels"), "valid_fraction"))


@query("flood_channel_status", s.sql(s.FLOODSCORE, f"""SELECT tile_id, epoch, CASE WHEN bool_or(valid) THEN 'accepted' ELSE 'no_evidence' END AS status,
  concat_ws(',', CASE WHEN bool_or(sar_ok) THEN 'sar' END, CASE WHEN bool_or(opt_ok) THEN 'optical' END, 'novelty', 'terrain') AS channels,
  {r6('avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0.0 END)')} AS valid_fraction FROM flood GROUP BY 1, 2"""))
def _(spark, sf):
    scored = scored_flood(_flood(spark, sf)).withColumns({"nov_ok": F.col("occurrence").isNotNull(), "terr_ok": F.col("slope") >= 0})
    return flood_status(scored).withColumn("valid_fraction", round6("valid_fraction"))


def _tile_features(inputs, clip_extra=None):
    """Per-grid physical statistics used for routing."""
    from landpulse.operators.ordered import exact_percentiles

    grid = ["tile_id", "epoch"]
    marine, intertidal = flood.coastal_masks("occurrence", "elevation", "slope")
    occ, slope = F.col("occurrence"), F.col("slope")
    means = inputs.groupBy(*grid).agg(
        share(marine).alias("marine"), share(intertidal).alias("intertidal"),
        share(occ >= 0.80).alias("permanent"), share((occ >= 0.10) & (occ < 0.80)).alias("seasonal"),
        share(occ < 0.10).alias("dry"), F.avg("elevation").alias("mean_elev"), F.min("elevation").alias("min_elev"),
        F.avg("slope").alias("mean_slope"), share(slope <= 2.0).alias("flat"), share(slope > 8.0).alias("steep"))
    heights = exact_percentiles(inputs, grid, "elevation", {"p10": 0.1, "p90": 0.9})
    out = means.join(heights, grid)
    coastal = ((F.col("marine") > 0.05) | (F.col("intertidal") > 0.035)
               | ((F.col("p10") <= 2.5) & (F.col("marine") + F.col("intertidal") > 0.03)))
    return out.withColumns({"coastal": coastal, "relief": F.col("p90") - F.col("p10")})


def routed_tiles(inputs):
    """Flood regime, confidence and features per grid."""
    f = _tile_features(inputs)
    f = f.withColumn("regime", flood.regime_from_features("relief", "steep", "mean_elev", "coastal", "marine", "intertidal",
                                                          "p10", "flat", "dry", "seasonal"))
    return f.withColumn("confidence", flood.regime_confidence("regime", "relief", "marine", "intertidal", "flat"))


_MARINE = "(elevation <= 2.5 AND occurrence >= 0.80)"
_TIDAL = "(elevation <= 6.0 AND slope <= 2.5 AND occurrence >= 0.05 AND occurrence < 0.80)"
_B = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END)"
REGIMES = s.FLOODSCORE + f""",
feat AS (SELECT tile_id, epoch, {_B(_MARINE)} AS marine, {_B(_TIDAL)} AS intertidal, {_B('occurrence >= 0.80')} AS permanent,
  {_B('occurrence >= 0.10 AND occurrence < 0.80')} AS seasonal, {_B('occurrence < 0.10')} AS dry, avg(elevation) AS mean_elev,
  min(elevation) AS min_elev, avg(slope) AS mean_slope, {_B('slope <= 2.0')} AS flat, {_B('slope > 8.0')} AS steep,
  quantile_cont(elevation, 0.1) AS p10, quantile_cont(elevation, 0.9) AS p90 FROM flood GROUP BY 1, 2),
feat2 AS (SELECT *, p90 - p10 AS relief, (marine > 0.05 OR intertidal > 0.035 OR (p10 <= 2.5 AND marine + intertidal > 0.03)) AS coastal FROM feat),
reg AS (SELECT *, CASE WHEN relief > 60.0 OR steep > 0.10 OR (mean_elev > 50.0 AND steep > 0.05) THEN 'INLAND_RIVERINE_PLUVIAL'
  WHEN coastal AND (marine > 0.04 OR intertidal > 0.03 OR p10 <= 3.0) THEN 'COASTAL_ESTUARINE_TIDAL'
  WHEN flat >= 0.65 AND relief <= 60.0 AND dry >= 0.65 THEN 'INLAND_RIVERINE_MEGA' WHEN seasonal >= 0.20 THEN 'WETLAND_SEASONAL'
  ELSE 'MIXED_UNCERTAIN' END AS regime FROM feat2),
regime AS (SELECT *, CASE regime WHEN 'INLAND_RIVERINE_PLUVIAL' THEN {s.clip('0.70 + 0.30 * least(1.0::DOUBLE, relief / 200.0)', 0.70, 0.95)}
  WHEN 'COASTAL_ESTUARINE_TIDAL' THEN {s.clip('0.70 + 0.30 * (marine + intertidal)', 0.70, 0.95)}
  WHEN 'INLAND_RIVERINE_MEGA' THEN {s.clip('0.75 + 0.25 * flat', 0.75, 0.98)} WHEN 'WETLAND_SEASONAL' THEN 0.75::DOUBLE ELSE 0.50::DOUBLE END AS confidence FROM reg)"""
_SETTINGS = ", ".join(f"('{r}', {st.w_sar}, {st.w_optical}, {-st.vv_drop_db}, {st.permanent_freq}, {st.slope_full_deg}, {st.slope_zero_deg})"
                      for r, st in config.FLOOD_REGIME_SETTINGS.items())
_D = lambda c: f"CAST({c} AS DOUBLE)"
ROUTED = REGIMES + f""",
setting(regime, ws, wo, vdrop, pf, sf, sz) AS (VALUES {_SETTINGS}),
st AS (SELECT regime, {_D('ws')} AS ws, {_D('wo')} AS wo, {_D('vdrop')} AS vdrop, {_D('pf')} AS pf, {_D('sf')} AS sf, {_D('sz')} AS sz FROM setting),
rt AS (SELECT f.*, regime, confidence, ws, wo, {s.sar_sql('vdrop')} AS sar2, {s.novelty_sql('pf')} AS nov2, {s.terrain_sql('sf', 'sz')} AS terr2
  FROM flood f JOIN regime USING (tile_id, epoch) JOIN st USING (regime)),
routed AS (SELECT *, CASE WHEN valid THEN {s.clip('(CASE WHEN sar_ok AND opt_ok THEN (ws * sar2 + wo * opt) / (ws + wo) WHEN sar_ok THEN sar2 ELSE opt END) * nov2 * terr2', 0, 1)} ELSE 0.0 END AS routed_score FROM rt)"""


def routed_flood(scored):
    """Score under the settings of the grid's own regime, next to the global score.

    The routing table carries the settings as columns, one row per grid, so the evidence
    expression is planned once for all regimes.
    """
    routes = routed_tiles(scored).select("tile_id", "epoch", "regime", "confidence")
    routes = routes.withColumns(flood.regime_settings("regime"))
    joined = salted_join(scored, routes, ["tile_id", "epoch"], ["row", "col"])
    st = flood.row_settings()
    tuned = joined.withColumns({"_sar": flood.sar_water("vv_b", "vv_e", "vh_b", "vh_e", st),
                                "_novelty": flood.novelty_multiplier("occurrence", st),
                                "_terrain": flood.terrain_plausibility("slope", st)})
    fused = flood.fuse_gated("_sar", "sar_ok", "optical", "opt_ok", "_novelty", "_terrain", None, st)
    return tuned.withColumn("routed_score", fused).drop("_sar", "_novelty", "_terrain", *[f"set_{n}" for n in flood.TUNED])


@query("blend_regime_scores", s.sql(ROUTED, f"""SELECT {K}, regime, {r6("(1.0 - CASE WHEN regime = 'MIXED_UNCERTAIN' THEN 0.0 ELSE confidence END) * score + "
       "CASE WHEN regime = 'MIXED_UNCERTAIN' THEN 0.0 ELSE confidence END * routed_score")} AS score FROM routed"""))
def _(spark, sf):
    r = routed_flood(scored_flood(_flood(spark, sf)))
    return r.select(*CELL, "regime", round6(flood.blend_regime("score", "routed_score", "confidence", "regime")).alias("score"))


@query("z_anomaly", s.sql(s.DROUGHTIN, f"SELECT {K}, {', '.join(r6(c) + ' AS ' + c for c in ('veg_1m', 'veg_3m', 'veg_6m', 'precip_1m', 'precip_3m', 'precip_6m', 'soil_surface', 'soil_rootzone', 'thermal'))} FROM dz"))
def _(spark, sf):
    d = tables.drought_inputs(tables.pixels(spark, sf))
    channels = ("veg_1m", "veg_3m", "veg_6m", "precip_1m", "precip_3m", "precip_6m", "soil_surface", "soil_rootzone", "thermal")
    return d.select(*CELL, *[round6(c).alias(c) for c in channels])


_VCI = s.clip("(ndvi - ndvi_lo) / greatest(ndvi_hi - ndvi_lo, 1e-4)", 0, 1)
_VCI100 = s.clip("100.0 * (ndvi - ndvi_lo) / greatest(ndvi_hi - ndvi_lo, 1e-4)", 0, 100)


@query("vci", s.sql(s.DROUGHTIN, f"SELECT {K}, {r6(_VCI)} AS vci, {r6(_VCI100)} AS vci_pct FROM dz"))
def _(spark, sf):
    d = tables.drought_inputs(tables.pixels(spark, sf))
    return d.select(*CELL, round6(drought.vci("ndvi", "ndvi_lo", "ndvi_hi")).alias("vci"),
                    round6(drought.vci("ndvi", "ndvi_lo", "ndvi_hi", scale=100.0)).alias("vci_pct"))


@query("minmax_percentile", s.sql(s.DROUGHTIN, f"SELECT {K}, {r6(_VCI)} AS percentile FROM dz"))
def _(spark, sf):
    d = tables.drought_inputs(tables.pixels(spark, sf))
    return d.select(*CELL, round6(drought.minmax_percentile("ndvi", "ndvi_lo", "ndvi_hi")).alias("percentile"))


@query("z_to_evidence", s.sql(s.DROUGHTIN, f"SELECT {K}, {r6(s.ev_sql('veg_1m'))} AS evidence FROM dz"))
def _(spark, sf):
    return tables.drought_inputs(tables.pixels(spark, sf)).select(*CELL, round6(drought.z_to_evidence("veg_1m")).alias("evidence"))


def scored_drought(d, weights=config.DROUGHT.modality_weights):
    e = d.withColumns({"veg": drought.window_evidence("veg_1m", "veg_3m", "veg_6m"),
                       "precip": drought.window_evidence("precip_1m", "precip_3m", "precip_6m"),
                       "soil": drought.soil_evidence("soil_surface", "soil_rootzone"),
                       "heat": drought.thermal_evidence("thermal")})
    return e.withColumn("score", drought.fuse_modalities("veg", "precip", "soil", "heat", *[F.lit(w) for w in weights]))


@query("fuse_drought", s.sql(s.DROUGHTSCORE, f"SELECT {K}, {r6('veg')} AS veg, {r6('precip')} AS precip, {r6('soil')} AS soil, {r6('heat')} AS heat, {r6('score')} AS score FROM drought"))
def _(spark, sf):
    d = scored_drought(tables.drought_inputs(tables.pixels(spark, sf)))
    return d.select(*CELL, *[round6(c).alias(c) for c in ("veg", "precip", "soil", "heat", "score")])


_OPT = f"(0.40 * {s.ev_sql('veg_1m')} + 0.20 * {s.ev_sql('veg_3m')} + 0.20 * {s.ev_sql('veg_1m * 0.9')} + 0.20 * {s.ev_sql('veg_1m * 0.8')})"
_MODES = ", ".join(f"('{m}', {w[0]}::DOUBLE, {w[1]}::DOUBLE, {w[2]}::DOUBLE, {w[3]}::DOUBLE)" for m, w in config.INFERENCE_MODES.items())
MODES_SQL = s.DROUGHTIN + f""",
mode(mode, wo, wp, ws, wt) AS (VALUES {_MODES}),
me AS (SELECT tile_id, epoch, row, col, reference, {_OPT} AS eo, {s.PRECIP_EV} AS ep, 0.5 * {s.ev_sql('soil_surface')} + 0.5 * {s.ev_sql('soil_rootzone')} AS es,
  {s.ev_sql('-thermal')} AS et, CASE WHEN scl IN (4, 5, 6, 7) THEN 0.9::DOUBLE WHEN scl = 2 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS o FROM dz),
fm AS (SELECT me.*, mode, wo * eo + wp * ep + ws * es + wt * et AS e, {s.clip('greatest(0.0::DOUBLE, (eo - ep) * (1.0 - o))', 0, 1)} AS amb FROM me, mode)"""


def mode_evidence(d):
    """Five-mode inference: evidence, probability and state per pixel and mode."""
    e = d.select(*CELL, "reference", drought.optical_evidence("veg_1m", "veg_3m").alias("eo"),
                 drought.window_evidence("precip_1m", "precip_3m", "precip_6m").alias("ep"),
                 drought.soil_evidence("soil_surface", "soil_rootzone", 0.5).alias("es"),
                 drought.z_to_evidence(-F.col("thermal")).alias("et"),
                 F.when(F.col("scl").isin(4, 5, 6, 7), 0.9).when(F.col("scl") == 2, 0.5).otherwise(0.2).alias("o"))
    both = with_fixed_rows(e, [(m, *w) for m, w in config.INFERENCE_MODES.items()], ("mode", "wo", "wp", "ws", "wt"))
    evidence = F.col("wo") * F.col("eo") + F.col("wp") * F.col("ep") + F.col("ws") * F.col("es") + F.col("wt") * F.col("et")
    out = both.withColumns({"e": evidence, "amb": clip(F.greatest(F.lit(0.0), (F.col("eo") - F.col("ep")) * (1.0 - F.col("o"))), 0.0, 1.0)})
    return out.withColumns({"probability": drought.drought_probability("e"), "state": drought.inference_state("e", "o", "amb")})


@query("fuse_drought_modes", s.sql(MODES_SQL, f"""SELECT {K}, mode, {r6('e')} AS evidence, {r6('1.0 / (1.0 + exp(-4.0 * e))')} AS probability,
  CASE WHEN e > 0.25 AND o >= 0.35 AND amb < 0.5 THEN 'DROUGHT' WHEN e < -0.10 AND o >= 0.35 AND amb < 0.5 THEN 'NO_DROUGHT' ELSE 'UNRESOLVED' END AS state FROM fm"""))
def _(spark, sf):
    m = mode_evidence(tables.drought_inputs(tables.pixels(spark, sf)))
    return m.select(*CELL, "mode", round6("e").alias("evidence"), round6("probability").alias("probability"), "state")


_ODR = s.clip(f"CASE WHEN scl <> 0 THEN 1.0 ELSE 0.0 END * {s.clip('1.0 - (CASE WHEN scl IN (8, 9, 10) THEN 0.3 WHEN scl = 3 THEN 0.1 ELSE 0.0 END) / 0.40', 0, 1)} * "
              + s.clip("ndvi_m / 0.15", 0.25, 1), 0, 1)
_ADR = "greatest(CASE WHEN scl = 4 THEN 0.70::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN scl = 5 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END)"
DROUGHT_STATE = s.DROUGHTSCORE + f""",
dobs AS (SELECT *, {_ODR} AS o, {_ADR} AS a FROM drought),
dstate AS (SELECT *, CASE WHEN o >= 0.5 AND score >= 0.5 AND a < 0.8 THEN 'DROUGHT'
  WHEN o >= 0.5 AND score < 0.5 AND (CAST(veg < 0.35 AS INT) + CAST(precip < 0.35 AS INT) + CAST(soil < 0.35 AS INT)) >= 2 THEN 'NO_DROUGHT'
  ELSE 'UNRESOLVED' END AS state FROM dobs)"""


def decided_drought(d):
    """Score, observability, ambiguity and three-state decision."""
    e = scored_drought(d)
    cloud = F.when(F.col("scl").isin(8, 9, 10), 0.3).when(F.col("scl") == 3, 0.1).otherwise(0.0)
    e = e.withColumns({"o": drought.observability(F.col("scl") != 0, cloud, "ndvi_m"),
                       "a": drought.attribution_ambiguity(F.col("scl") == 4, F.col("scl") == 5)})
    return e.withColumn("state", drought.tristate("score", "veg", "precip", "soil", "o", "a"))


@query("observability_drought", s.sql(DROUGHT_STATE, f"SELECT {K}, {r6('o')} AS observability, {r6('a')} AS ambiguity FROM dstate"))
def _(spark, sf):
    d = decided_drought(tables.drought_inputs(tables.pixels(spark, sf)))
    return d.select(*CELL, round6("o").alias("observability"), round6("a").alias("ambiguity"))


@query("tristate_drought", s.sql(DROUGHT_STATE, f"SELECT {K}, state FROM dstate"))
def _(spark, sf):
    return decided_drought(tables.drought_inputs(tables.pixels(spark, sf))).select(*CELL, "state")


@query("confidence_to_uncertainty", s.sql(s.FLOODSCORE, f"SELECT {K}, {r6('1.0 - ' + s.clip('score', 0, 1))} AS uncertainty FROM flood"))
def _(spark, sf):
    return scored_flood(_flood(spark, sf)).select(*CELL, round6(1.0 - clip("score", 0.0, 1.0)).alias("uncertainty"))


@query("qa_bits", s.sql(s.SUMS, f"""SELECT {K}, (so & 1) = 1 AS is_land, ((so >> 1) & 1) = 1 AS is_valid, ((so >> 2) & 1) = 0 AS is_full_month,
  ((so >> 3) & 1) = 0 AS is_not_relabelled, (so & 1) = 1 AND ((so >> 1) & 1) = 1 AND ((so >> 2) & 1) = 0 AND ((so >> 3) & 1) = 0 AS high_confidence FROM sums"""))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumn("qa", F.round(F.col("green") * 1000.0 * F.col("n")).cast("bigint"))
    return px.select(*CELL, *[c.alias(k) for k, c in indices.burn_quality("qa").items()])


@query("severity_tier", s.sql(s.STATION, """SELECT station, day, CASE WHEN precip >= 100 THEN 'CRITICAL' WHEN precip >= 10 THEN 'WARNING' WHEN precip = 0 THEN 'RESOLVED' ELSE 'ADVISORY' END AS flood_tier,
  CASE WHEN precip >= 100 THEN 'CRITICAL' WHEN precip >= 10 THEN 'WARNING' ELSE 'ADVISORY' END AS payload_tier,
  CASE WHEN severity >= 0.75 THEN 'EXTREME' WHEN severity >= 0.60 THEN 'SEVERE' WHEN severity >= 0.45 THEN 'MODERATE' ELSE 'MILD' END AS drought_tier FROM stday"""))
def _(spark, sf):
    return tables.station_days(spark, sf).select("station", "day", flood.severity("precip").alias("flood_tier"),
                                                 flood.severity("precip", payload=True).alias("payload_tier"),
                                                 drought.severity_tier("severity").alias("drought_tier"))


@query("provenance_hash", s.sql(s.SCENES, """SELECT scene_id, sha256('{"mode":"' || mode || '","platform":"' || platform || '","rel_orbit":' || rel_orbit || ',"scene_id":' || scene_id || '}') AS digest FROM sc"""))
def _(spark, sf):
    sc = tables.scenes(spark, sf)
    payload = F.to_json(F.struct(*sorted(["scene_id", "platform", "mode", "rel_orbit"])))
    return sc.select("scene_id", F.sha2(payload, 256).alias("digest"))
