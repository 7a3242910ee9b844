"""Source, sink, filter, tiling and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions import indices
from landpulse.functions.core import fixed_rows, round6
from landpulse.functions.geo import bbox_coverage
from landpulse.operators import fire, jobs, neighbours, scenes
from landpulse.plans import sqlbase as s
from landpulse.plans.expressions import K
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.session import scratch_path
from landpulse.sources import files, tables
from landpulse.sources.tables import CELL


@query("scan_pixels", s.sql(s.PIX, f"SELECT {K}, {r6('red')} AS red, {r6('nir')} AS b08 FROM pix"))
def _(spark, sf):
    path = scratch_path(spark, "pixels")
    tables.pixels(spark, sf).write.parquet(path)
    scanned = files.scan_pixels(spark, path, ["red", "b08"], {"b08": "nir"})
    return scanned.select(*CELL, round6("red").alias("red"), round6("b08").alias("b08"))


@query("write_tile_output", s.sql(s.DELTA, f"SELECT tile_id, epoch, count(*) AS n, {r6('sum(delta)')} AS total FROM delta GROUP BY 1, 2"))
def _(spark, sf):
    path = scratch_path(spark, "tiles")
    files.write_tile_output(tables.index_delta(tables.pixels(spark, sf)).select(*CELL, "delta"), path)
    back = spark.read.schema("tile_id bigint, epoch int, row int, col int, delta double").parquet(path)
    return back.groupBy("tile_id", "epoch").agg(F.count(F.lit(1)).alias("n"), round6(F.sum("delta")).alias("total"))


_JSONL = "scene_id bigint, dt timestamp, cloud double, platform string, rel_orbit int"


def _jsonl(spark, sf):
    path = scratch_path(spark, "manifest")
    rows = tables.scenes(spark, sf).select("scene_id", "dt", "cloud", "platform", "rel_orbit")
    files.write_jsonl(rows.where("scene_id % 2 = 0"), path)
    files.write_jsonl(rows.where("scene_id % 2 = 1"), path)
    return files.read_jsonl(spark, path, _JSONL)


@query("read_jsonl", s.sql(s.SCENES, "SELECT scene_id, dt, cloud, platform, rel_orbit FROM sc"))
def _(spark, sf):
    return _jsonl(spark, sf)


@query("write_jsonl", s.sql(s.SCENES, f"SELECT platform, count(*) AS n, {r6('avg(cloud)')} AS mean_cloud FROM sc GROUP BY 1"))
def _(spark, sf):
    return _jsonl(spark, sf).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), round6(F.avg("cloud")).alias("mean_cloud"))


def catalog_pages(spark, sf):
    """Catalogue responses of at most 100 features, as JSON text."""
    sc = tables.scenes(spark, sf)
    asset = lambda name: F.struct(F.concat(F.lit(f"{name}/"), F.col("scene_id")).alias("href"))
    bands = F.map_filter(F.create_map(F.lit("B04"), asset("B04"), F.lit("b08"), asset("b08"), F.lit("SCL"), asset("SCL")),
                         lambda k, v: (k != "SCL") | (F.col("scene_id") % 4 != 0))
    west = (F.col("scene_id") % 90).cast("double")
    feature = F.struct(F.col("scene_id").cast("string").alias("id"), F.array(west, F.lit(10.0), west + 1.0, F.lit(11.0)).alias("bbox"),
                       F.struct(F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("cloud").alias("eo:cloud_cover"), "platform").alias("properties"),
                       bands.alias("assets"))
    return (sc.groupBy(F.expr("scene_id div 100").alias("page")).agg(F.collect_list(feature).alias("features"))
            .select(F.to_json(F.struct("features")).alias("value")))


@query("scan_catalog", s.sql(s.SCENES, "SELECT CAST(scene_id AS VARCHAR) AS scene_id, dt, cloud, platform, CASE WHEN scene_id % 4 = 0 THEN 2 ELSE 3 END AS n_assets, 'B04/' || scene_id AS b04, (scene_id % 90)::DOUBLE AS west FROM sc"))
def _(spark, sf):
    flat = scenes.flatten_catalog(catalog_pages(spark, sf))
    return flat.select("scene_id", "dt", "cloud", "platform", F.size("assets").alias("n_assets"), F.col("assets")["B04"].alias("b04"), F.col("bbox")[0].alias("west"))


@query("filter_required_assets", s.sql(s.SCENES, "SELECT CAST(scene_id AS VARCHAR) AS scene_id FROM sc WHERE scene_id % 4 <> 0"))
def _(spark, sf):
    flat = scenes.flatten_catalog(catalog_pages(spark, sf))
    return flat.where(scenes.has_assets(F.map_keys("assets"), ["B04", "B08", "scl"])).select("scene_id")


def radar_items(spark, sf):
    """Radar scene items with the mixed property keys of several providers."""
    sc, k = tables.scenes(spark, sf), F.col("scene_id")
    none = lambda t: F.lit(None).cast(t)
    sat = F.when(k % 2 == 0, "S1A").otherwise("S1B")
    name = F.concat(sat, F.lit("_IW_GRDH_1SDV_"), F.date_format("dt", "yyyyMMdd"), F.lit("_"), F.lpad((k % 90000 + 1000).cast("string"), 6, "0"), F.lit("_0A1B2C_3D4E"))
    short = F.concat(sat, F.lit("_IW_"), (k % 90000 + 10000).cast("string"), F.lit("_X"))
    pid = F.when(k % 10 == 0, short).otherwise(name)
    return sc.select(
        k.cast("string").alias("id"), F.when(k % 3 == 0, pid).alias("s1_product_id"), F.when(k % 3 != 0, pid).alias("product_identifier"),
        F.when(k % 2 == 0, F.date_format("dt", "yyyy-MM-dd")).alias("datetime"), F.date_format("dt", "yyyy-MM-dd").alias("start_datetime"),
        F.when(k % 4 == 0, F.col("platform")).alias("platform"), F.when(k % 4 == 1, F.lit("sentinel-1")).alias("constellation"),
        F.when(k % 2 == 0, F.col("direction")).alias("orbit_state"), F.col("direction").alias("orbit_direction"),
        F.when(k % 7 == 0, F.col("rel_orbit")).alias("relative_orbit"), none("int").alias("relative_orbit_number"),
        F.when(k % 2 == 1, F.col("mode")).alias("instrument_mode"), F.col("mode").alias("acquisition_mode"),
        F.when(k % 5 == 0, " vv, vh").when(k % 5 == 1, "HH/HV").when(k % 5 == 2, "VV").otherwise(none("string")).alias("s1_polarization"),
        F.col("raw_polarization").alias("polarization"), F.col("slice_number").cast("string").alias("s1_slice_number"),
        F.when(k % 6 == 0, "n/a").alias("slice_number"))


_ABS = "(CASE WHEN scene_id % 10 = 0 THEN scene_id % 90000 + 10000 ELSE scene_id % 90000 + 1000 END)"
_PID = """(CASE WHEN scene_id % 2 = 0 THEN 'S1A' ELSE 'S1B' END) || CASE WHEN scene_id % 10 = 0 THEN '_IW_' || (scene_id % 90000 + 10000) || '_X'
  ELSE '_IW_GRDH_1SDV_' || strftime(dt, '%Y%m%d') || '_' || lpad(CAST(scene_id % 90000 + 1000 AS VARCHAR), 6, '0') || '_0A1B2C_3D4E' END"""


@query("normalize_s1_scenes", s.sql(s.SCENES, f"""SELECT CAST(scene_id AS VARCHAR) AS id, {_PID} AS product_id, strftime(dt, '%Y-%m-%d') AS datetime,
  CASE WHEN scene_id % 4 = 0 THEN platform WHEN scene_id % 4 = 1 THEN 'sentinel-1' WHEN scene_id % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS platform, direction,
  CAST(CASE WHEN scene_id % 7 = 0 THEN rel_orbit WHEN scene_id % 2 = 0 AND {_ABS} <= 99999 THEN ({_ABS} - 73) % 175 + 1 END AS INTEGER) AS rel_orbit,
  CAST(CASE WHEN {_ABS} <= 99999 THEN {_ABS} END AS INTEGER) AS abs_orbit, mode,
  CASE scene_id % 5 WHEN 0 THEN 'DV' WHEN 1 THEN 'DH' WHEN 2 THEN 'SV' ELSE CASE WHEN scene_id % 3 = 0 THEN 'SV' ELSE 'DV' END END AS polarization, slice_number FROM sc"""))
def _(spark, sf):
    return scenes.normalize_radar_scenes(radar_items(spark, sf))


@query("dedup_catalog_ingest", s.sql(s.SCENES, "SELECT rel_orbit, count(*) AS n_new FROM sc WHERE scene_id % 3 <> 0 GROUP BY 1"))
def _(spark, sf):
    sc = tables.scenes(spark, sf).select("scene_id", "rel_orbit")
    arriving = sc.unionByName(sc.where("scene_id % 4 = 0"))
    return files.ingest_new(arriving, sc.where("scene_id % 3 = 0")).groupBy("rel_orbit").agg(F.count(F.lit(1)).alias("n_new"))


_CHUNK = "CAST(CAST(date_diff('day', DATE '2024-01-01', CAST(acq_date AS DATE)) AS INTEGER) // 5 AS INTEGER)"


@query("scan_fire_csv", s.sql(s.FIRE + f""",
ck AS (SELECT *, {_CHUNK} AS chunk FROM fp)""", """SELECT source AS firms_source, CASE WHEN (chunk % 2 = 0) THEN 'SP' ELSE 'NRT' END AS processing_tier, chunk,
  count(*) AS n, sum(CAST(round(frp * 100) AS BIGINT))::BIGINT AS frp_cents FROM ck GROUP BY 1, 2, 3"""))
def _(spark, sf):
    points = tables.fire_points(spark, sf).withColumnRenamed("source", "firms_source")
    columns = ["latitude", "longitude", "acq_date", "acq_time", "frp", "firms_source"]
    chunk = F.floor(F.datediff(F.to_date("acq_date"), F.lit("2024-01-01")) / 5).cast("int")
    sp_path, nrt_path = scratch_path(spark, "sp"), scratch_path(spark, "nrt")
    files.write_csv(points.where(chunk % 2 == 0).select(*columns), sp_path)
    files.write_csv(points.select(*columns), nrt_path)
    read = lambda p: files.read_csv(spark, p, files.FIRE_SCHEMA).withColumn("chunk", chunk)
    tagged = fire.with_fallback(read(sp_path), read(nrt_path), ["firms_source", "chunk"])
    return tagged.groupBy("firms_source", "processing_tier", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("frp") * 100).cast("bigint")).alias("frp_cents"))


def station_lines(spark, sf):
    """Daily station text lines of 28 tokens; every 13th line is cut short, some values are the
    negative sentinels."""
    d = tables.station_days(spark, sf).withColumn("cents", F.round(F.col("precip") * 100).cast("bigint"))
    sm = [F.when(F.col("cents") % (k + 2) == 0, "-99.0").otherwise(F.format_string("%.3f", (F.col("cents") % (50 + k)) / 100.0)) for k in range(5)]
    pad = lambda n: [F.lit("0")] * n
    temp = F.when(F.col("cents") % 11 == 0, "-9999.0").otherwise(F.format_string("%.1f", (F.col("cents") % 400) / 10.0))
    rain = F.when(F.col("cents") % 17 == 0, "-9999.0").otherwise(F.format_string("%.2f", F.col("precip")))
    full = F.concat_ws("  ", F.lit("53877"), F.date_format("day", "yyyyMMdd"), *pad(7), rain, *pad(4), temp, *pad(3), *sm, *pad(5))
    return d.select("station", F.when(F.col("cents") % 13 == 0, F.concat_ws(" ", F.lit("53877"), F.date_format("day", "yyyyMMdd"))).otherwise(full).alias("value"))


_SM = [f"(CASE WHEN sv % {k + 2} <> 0 THEN (sv % {50 + k}) / 100.0::DOUBLE END)" for k in range(5)]
STATION_SQL = s.STATION + f""",
sl AS (SELECT station, day, CASE WHEN sv % 17 = 0 THEN 0.0::DOUBLE ELSE precip END AS precip, {', '.join(f'{e} AS {n}' for e, n in zip(_SM, ('sm_5', 'sm_10', 'sm_20', 'sm_50', 'sm_100')))},
  CASE WHEN sv % 11 <> 0 THEN (sv % 400) / 10.0::DOUBLE END AS surface_temp FROM (SELECT d.*, precip FROM sd d JOIN stday USING (station, day)) WHERE sv % 13 <> 0),
slm AS (SELECT *, CASE WHEN (sm_5 IS NOT NULL)::INT + (sm_10 IS NOT NULL)::INT + (sm_20 IS NOT NULL)::INT + (sm_50 IS NOT NULL)::INT + (sm_100 IS NOT NULL)::INT > 0 THEN
  (coalesce(sm_5, 0) + coalesce(sm_10, 0) + coalesce(sm_20, 0) + coalesce(sm_50, 0) + coalesce(sm_100, 0)) /
  ((sm_5 IS NOT NULL)::INT + (sm_10 IS NOT NULL)::INT + (sm_20 IS NOT NULL)::INT + (sm_50 IS NOT NULL)::INT + (sm_100 IS NOT NULL)::INT) END AS sm_rootzone FROM sl)"""


@query("scan_station_daily", s.sql(STATION_SQL, f"SELECT station, day, {', '.join(r6(c) + ' AS ' + c for c in ('precip', 'sm_5', 'sm_10', 'sm_20', 'sm_50', 'sm_100', 'sm_rootzone', 'surface_temp'))} FROM slm"))
def _(spark, sf):
    d = files.parse_station_lines(station_lines(spark, sf))
    return d.select("station", "day", *[round6(c).alias(c) for c in ("precip", "sm_5", "sm_10", "sm_20", "sm_50", "sm_100", "sm_rootzone", "surface_temp")])


_STRESS = f"CASE WHEN p IS NOT NULL THEN {s.clip('p', 0, 1)} ELSE {s.clip('(0.36 - coalesce(c, t)) / (0.36 - 0.15)', 0, 1)} END"


@query("scan_station_weekly", s.sql(s.STATION + """,
wk AS (SELECT station, strftime(day, '%Y%m') AS month, CASE WHEN sv % 3 <> 0 THEN soil END AS c, CASE WHEN sv % 4 <> 0 THEN soil / 2 END AS t,
  CASE WHEN station % 3 = 0 THEN soil END AS p FROM (SELECT d.*, soil FROM sd d JOIN stday USING (station, day))),
mo AS (SELECT station, month, avg(c) AS c, avg(t) AS t, avg(p) AS p FROM wk GROUP BY 1, 2)""",
    f"SELECT station, month, {r6('coalesce(c, t)')} AS sm_column, {r6('coalesce(t, c)')} AS sm_5cm, {r6(_STRESS)} AS stress FROM mo WHERE c IS NOT NULL OR t IS NOT NULL"))
def _(spark, sf):
    d = tables.station_days(spark, sf).withColumn("cents", F.round(F.col("precip") * 100).cast("bigint"))
    text = lambda cond, v: F.when(cond, v.cast("string")).otherwise("")
    weekly = d.select("station", F.date_format("day", "yyyyMMdd").alias("USDM_WEEK"), text(F.col("cents") % 3 != 0, F.col("soil")).alias("SMVWC_COLUMN_CM_MEAN"),
                      text(F.col("cents") % 4 != 0, F.col("soil") / 2).alias("SMVWC_5_CM_MEAN"),
                      text(F.col("station") % 3 == 0, F.col("soil")).alias("SMPERC_COLUMN_CM_30COUNTS"), F.lit("").alias("SMPERC_5_CM_30COUNTS"))
    m = files.monthly_station_stress(weekly, ["station"])
    return m.select("station", "month", *[round6(c).alias(c) for c in ("sm_column", "sm_5cm", "stress")])


_IMPACT = """im AS (SELECT n_name AS state, year(o_orderdate) AS yr, CAST(date_trunc('month', o_orderdate) AS DATE) AS wk, count(*) AS n,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) FILTER (WHERE o_orderstatus = 'F') AS nf
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
imp AS (SELECT state, CAST(yr AS INTEGER) AS year, wk AS week_ending_date, n, cents, nf * 100.0::DOUBLE / n AS poor_pct, cents / 100.0::DOUBLE AS loss FROM im)"""


def impacts(spark, sf):
    """Monthly crop-condition and loss figures per state, from orders. Orders are reduced per
    customer before they meet the customer table, so a busy customer costs one row a month."""
    o = (tables.table(spark, sf, "orders").groupBy("o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("week_ending_date"))
         .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
              F.count_if(F.col("o_orderstatus") == "F").alias("nf")))
    c = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = tables.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    g = (o.join(c, "o_custkey").groupBy("n_nationkey", "week_ending_date").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.sum("nf").alias("nf"))
         .join(n, "n_nationkey"))
    return g.select("state", F.year("week_ending_date").alias("year"), "week_ending_date", "n", "cents",
                    (F.col("nf") * 100.0 / F.col("n")).alias("poor_pct"), (F.col("cents") / 100.0).alias("loss"))


@query("scan_impacts", s.sql(_IMPACT, f"SELECT c.state, c.year, count(*) AS n_weeks, {r6('avg(c.poor_pct)')} AS mean_poor, {r6('sum(cents) / 100.0::DOUBLE')} AS indemnity FROM imp c GROUP BY 1, 2"))
def _(spark, sf):
    im = impacts(spark, sf)
    a, b = scratch_path(spark, "condition"), scratch_path(spark, "indemnity")
    files.write_csv(im.select("state", "year", "week_ending_date", F.lit("CORN").alias("crop"), F.lit(0.0).alias("pct_very_poor"), F.lit(0.0).alias("pct_poor"),
                              F.col("poor_pct").alias("pct_poor_to_very_poor"), F.lit(0.0).alias("pct_fair"), F.lit(0.0).alias("pct_good"), F.lit(0.0).alias("pct_excellent")), a)
    files.write_csv(im.select("state", F.lit("ALL").alias("county_name"), "year", F.lit("Drought").alias("cause_of_loss"), F.lit("CORN").alias("crop"),
                              F.col("loss").alias("indemnity_amount_usd"), F.lit(0.0).alias("loss_ratio")), b)
    condition, indemnity = files.scan_impacts(spark, a, b)
    cond = condition.groupBy("state", "year").agg(F.count(F.lit(1)).alias("n_weeks"), round6(F.avg("pct_poor_to_very_poor")).alias("mean_poor"))
    loss = indemnity.groupBy("state", "year").agg(round6(F.sum("indemnity_amount_usd")).alias("indemnity"))
    return cond.join(loss, ["state", "year"])


@query("power_daily_pivot", s.sql(s.STATION, f"SELECT station, strftime(day, '%Y%m%d') AS date, {r6('precip')} AS precip, {r6('soil')} AS sm_rootzone, 0.5::DOUBLE AS sm_surface, "
                                              f"{r6('CASE WHEN n % 2 = 0 THEN severity ELSE 20.0 END')} AS skin_temp FROM stday WHERE n % 5 <> 0"))
def _(spark, sf):
    d = tables.station_days(spark, sf).withColumn("date", F.date_format("day", "yyyyMMdd"))
    row = lambda name, cond, v: d.where(cond).groupBy("station").agg(F.map_from_entries(F.collect_list(F.struct("date", v))).alias("series")).withColumn("parameter", F.lit(name))
    rain = row("PRECTOTCORR", F.lit(True), F.when(F.col("n") % 5 == 0, -999.0).otherwise(F.col("precip")))
    maps = rain.unionByName(row("GWETROOT", F.lit(True), F.col("soil"))).unionByName(row("TS", F.col("n") % 2 == 0, F.col("severity")))
    out = files.daily_parameters(maps, ["station"])
    return out.select("station", "date", *[round6(c).alias(c) for c in ("precip", "sm_rootzone", "sm_surface", "skin_temp")])


@query("file_checksum", s.sql(s.SCENES, """SELECT CAST(sum(length('{"scene_id":' || scene_id || ',"platform":"' || platform || '"}') + 1) AS BIGINT) AS total_bytes, true AS readable, true AS distinct_digests FROM sc"""))
def _(spark, sf):
    path = scratch_path(spark, "inputs")
    files.write_jsonl(tables.scenes(spark, sf).select("scene_id", "platform"), path)
    c = files.file_checksum(spark, path, "*.json")
    return c.agg(F.sum("bytes").alias("total_bytes"), F.bool_and("readable").alias("readable"),
                 (F.count_distinct("sha256") == F.count(F.when(F.length("sha256") == 64, 1))).alias("distinct_digests"))


# --- filters ----------------------------------------------------------------

@query("filter_bbox_time", s.sql(s.FIRE, "SELECT seq FROM fp WHERE CAST(longitude AS DOUBLE) BETWEEN 70.01 AND 70.04 AND CAST(latitude AS DOUBLE) BETWEEN 10.05 AND 10.15 AND acq_date BETWEEN '2024-01-05' AND '2024-01-20'"))
def _(spark, sf):
    p = fire.parse_points(tables.fire_points(spark, sf))
    return p.where(F.col("lon").between(70.01, 70.04) & F.col("lat").between(10.05, 10.15) & F.col("acq_date").between("2024-01-05", "2024-01-20")).select("seq")


def band_quality(px, bands):
    """Per grid and band: extremes, and a verdict rejecting empty, constant and all-zero bands."""
    long = px.select("tile_id", "epoch", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands])).alias("b"))
    st = long.select("tile_id", "epoch", "b.*").groupBy("tile_id", "epoch", "band").agg(
        F.count("v").alias("n_valid"), F.min("v").alias("low"), F.max("v").alias("high"))
    reason = (F.when(F.col("n_valid") == 0, "empty").when((F.col("low") == 0) & (F.col("high") == 0), "all_zero")
              .when(F.col("low") >= F.col("high"), "constant"))
    return st.withColumn("rejected", reason)


_QC = s.SUMS + """,
qb AS (SELECT tile_id, epoch, UNNEST([{'band': 'red', 'v': sd / (100.0::DOUBLE * n)}, {'band': 'flat', 'v': 1.0::DOUBLE}, {'band': 'zero', 'v': 0.0::DOUBLE},
  {'band': 'late', 'v': CASE WHEN epoch > 1997 THEN st / (100.0::DOUBLE * n) END}]) AS b FROM sums),
qc AS (SELECT tile_id, epoch, b.band AS band, count(b.v) AS n_valid, min(b.v) AS low, max(b.v) AS high FROM qb GROUP BY 1, 2, 3)"""


@query("qc_gate", s.sql(_QC, f"SELECT tile_id, epoch, band, n_valid, {r6('low')} AS low, {r6('high')} AS high, CASE WHEN n_valid = 0 THEN 'empty' WHEN low = 0 AND high = 0 THEN 'all_zero' WHEN low >= high THEN 'constant' END AS rejected FROM qc"))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumns({"flat": F.lit(1.0), "zero": F.lit(0.0), "late": F.when(F.col("epoch") > 1997, F.col("nir"))})
    q = band_quality(px, ["red", "flat", "zero", "late"])
    return q.withColumns({"low": round6("low"), "high": round6("high")})


@query("qc_s2_contract", s.sql(s.PIX, f"""SELECT tile_id, epoch, bool_and(scl BETWEEN 0 AND 11) AS scl_ok, bool_and(n % 2 IN (0, 1)) AS mask_ok, {r6('avg((n % 2)::DOUBLE)')} AS valid_fraction,
  count(red) > 0 AND min(red) < max(red) AND count(nir) > 0 AND min(nir) < max(nir) AS bands_ok, bool_and(scl BETWEEN 0 AND 11) AND sum(n % 2) > 0 AND min(red) < max(red) AND min(nir) < max(nir) AS accepted FROM pix GROUP BY 1, 2"""))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumn("mask", F.col("n") % 2)
    q = px.groupBy("tile_id", "epoch").agg(
        F.bool_and(F.col("scl").between(0, 11)).alias("scl_ok"), F.bool_and(F.col("mask").isin(0, 1)).alias("mask_ok"), F.avg("mask").alias("valid_fraction"),
        ((F.min("red") < F.max("red")) & (F.min("nir") < F.max("nir"))).alias("bands_ok"))
    return q.withColumn("accepted", F.col("scl_ok") & F.col("mask_ok") & F.col("bands_ok") & (F.col("valid_fraction") > 0)).withColumn("valid_fraction", round6("valid_fraction"))


@query("aoi_coverage_gate", s.sql(s.SCENES + """,
bx AS (SELECT scene_id, (scene_id % 10)::DOUBLE AS l, (scene_id % 7)::DOUBLE AS b, (scene_id % 10)::DOUBLE + 4 AS r, (scene_id % 7)::DOUBLE + 3 AS t FROM sc),
cv AS (SELECT scene_id, CASE WHEN least(8.0, r) > greatest(2.0, l) AND least(6.0, t) > greatest(1.0, b) THEN (least(8.0, r) - greatest(2.0, l)) * (least(6.0, t) - greatest(1.0, b)) / 30.0::DOUBLE ELSE 0.0 END AS c FROM bx)""",
    f"SELECT scene_id, {r6('c')} AS coverage, CASE WHEN c <= 0 THEN 'no_intersection' WHEN c < 0.3 THEN 'insufficient_coverage' END AS error FROM cv"))
def _(spark, sf):
    k = F.col("scene_id")
    left, bottom = (k % 10).cast("double"), (k % 7).cast("double")
    cover = bbox_coverage([F.lit(2.0), F.lit(1.0), F.lit(8.0), F.lit(6.0)], [left, bottom, left + 4, bottom + 3])
    out = tables.scenes(spark, sf).select("scene_id", cover.alias("_c"))
    return out.select("scene_id", round6("_c").alias("coverage"), F.when(F.col("_c") <= 0, "no_intersection").when(F.col("_c") < 0.3, "insufficient_coverage").alias("error"))


def spec_errors(specs):
    """Problems of each processing specification, in fixed order."""
    checks = F.array(F.when(~F.col("sensor").isin("S1", "S2"), "unsupported sensor"), F.when(F.col("resolution") <= 0, "resolution must be positive"),
                     F.when(~F.col("crs").startswith("EPSG:"), "crs must be an EPSG code"),
                     F.when(~F.col("resampling").isin("nearest", "bilinear", "average", "cubic"), "unsupported resampling"))
    return F.filter(checks, lambda x: x.isNotNull())


@query("spec_validate", """SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 3 = 2 THEN 'unsupported sensor' END, CASE WHEN p_size - 5 <= 0 THEN 'resolution must be positive' END,
  CASE WHEN p_partkey % 11 = 0 THEN 'crs must be an EPSG code' END, CASE WHEN p_partkey % 5 = 4 THEN 'unsupported resampling' END) AS errors FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    specs = tables.table(spark, sf, "part").select(
        "p_partkey", F.element_at(F.array(F.lit("S1"), F.lit("S2"), F.lit("S9")), (k % 3 + 1).cast("int")).alias("sensor"), (F.col("p_size") - 5).alias("resolution"),
        F.when(k % 11 == 0, "WGS84").otherwise("EPSG:32643").alias("crs"),
        F.element_at(F.array(*[F.lit(x) for x in ("nearest", "bilinear", "average", "cubic", "lanczos9")]), (k % 5 + 1).cast("int")).alias("resampling"))
    return specs.select("p_partkey", F.concat_ws("; ", spec_errors(specs)).alias("errors"))


@query("min_valid_gate", s.sql(s.PIX, "SELECT tile_id, epoch, count(*) FILTER (WHERE scl IN (4, 5, 6, 7)) AS n_valid FROM pix GROUP BY 1, 2 HAVING count(*) FILTER (WHERE scl IN (4, 5, 6, 7)) >= 80"))
def _(spark, sf):
    ok = tables.pixels(spark, sf).groupBy("tile_id", "epoch").agg(F.count_if(indices.scl_usable("scl", "flood")).alias("n_valid"))
    return ok.where("n_valid >= 80")


@query("epoch_guard", s.sql(s.PIX, "SELECT tile_id, count(*) AS n, count(DISTINCT epoch) AS n_epochs FROM pix WHERE epoch = 1998 GROUP BY 1"))
def _(spark, sf):
    return tables.pixels(spark, sf).where("epoch = 1998").groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("epoch").alias("n_epochs"))


@query("year_exclusion", s.sql(s.PIX, f"SELECT tile_id, row, col, count(DISTINCT epoch) AS n_years, {r6('avg(' + s.NDVI + ')')} AS mean_ndvi FROM pix WHERE epoch NOT IN (1998, 2001) GROUP BY 1, 2, 3 HAVING count(DISTINCT epoch) >= 3"))
def _(spark, sf):
    kept = tables.pixels(spark, sf).where(~F.col("epoch").isin(1998, 2001))
    out = kept.groupBy("tile_id", "row", "col").agg(F.count_distinct("epoch").alias("n_years"), round6(F.avg(indices.ndvi("nir", "red"))).alias("mean_ndvi"))
    return out.where("n_years >= 3")


_ROLES = ", ".join(f"('{r}', {str(v[0]).lower()}, {str(v[1]).lower()}, {i})" for i, (r, v) in enumerate(config.REFERENCE_ROLES.items()))


@query("governance_role_filter", s.sql(s.PIX + f", role(role, independent, pixel_allowed, i) AS (VALUES {_ROLES})",
       "SELECT role, independent, count(*) AS n_pixels, count(*) FILTER (WHERE reference) AS n_positive FROM pix JOIN role ON tile_id % 4 = i WHERE pixel_allowed GROUP BY 1, 2"))
def _(spark, sf):
    roles = fixed_rows([(r, *v) for r, v in config.REFERENCE_ROLES.items()], ("role", "independent", "pixel_allowed"))
    px = tables.pixels(spark, sf).withColumn("_r", F.element_at(roles, (F.col("tile_id") % 4 + 1).cast("int"))).select("reference", "_r.*")
    return (px.where("pixel_allowed").groupBy("role", "independent")
            .agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if("reference").alias("n_positive")))


def reference_flag(mask, ordinal, index, cut=2):
    """Binary reference from a mask, else ordinal class, else drought index."""
    return F.coalesce(F.col(mask), F.col(ordinal) >= cut, F.col(index) <= -1.25)


@query("reference_binarize", s.sql(s.DROUGHTIN, f"SELECT {K}, CASE WHEN scl < 4 THEN reference WHEN scl < 8 THEN scl % 5 >= 2 ELSE veg_1m <= -1.25 END AS is_drought, scl % 5 >= 3 AS d2_plus, scl % 5 >= 1 AS d0_plus FROM dz"))
def _(spark, sf):
    d = tables.drought_inputs(tables.pixels(spark, sf)).withColumns({
        "mask": F.when(F.col("scl") < 4, F.col("reference")), "ordinal": F.when(F.col("scl").between(4, 7), F.col("scl") % 5)})
    return d.select(*CELL, reference_flag("mask", "ordinal", "veg_1m").alias("is_drought"), (F.col("scl") % 5 >= 3).alias("d2_plus"), (F.col("scl") % 5 >= 1).alias("d0_plus"))


# --- top-k, sets, tiling ------------------------------------------------------

@query("top1_scene", s.sql(s.SCENES, "SELECT site, arg_min(scene_id, (cloud, scene_id)) AS scene_id, min(cloud) AS cloud FROM sc GROUP BY 1"))
def _(spark, sf):
    best = F.min_by(F.struct("scene_id", "cloud"), F.struct("cloud", "scene_id"))
    return tables.scenes(spark, sf).groupBy("site").agg(best.alias("b")).select("site", "b.scene_id", "b.cloud")


@query("class_balanced_cap", s.sql(s.PIX + """,
rn AS (SELECT *, row_number() OVER (PARTITION BY scl ORDER BY md5(concat_ws('|', tile_id, epoch, row, col, '42'))) AS k FROM pix)""", f"SELECT {K}, scl FROM rn WHERE k <= 500"))
def _(spark, sf):
    order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in CELL], F.lit("42")))
    return jobs.cap_per_class(tables.pixels(spark, sf).select(*CELL, "scl"), "scl", 500, order)


@query("pool_union", s.sql(s.PIX, """SELECT 'change_' || epoch || '_' || tile_id || '_' || row // 4 || '_' || col // 4 AS block, count(*) AS n FROM pix WHERE scl < 6 GROUP BY 1
  UNION ALL SELECT 'flood_' || epoch || '_' || tile_id || '_' || row // 4 || '_' || col // 4, count(*) FROM pix WHERE scl >= 6 GROUP BY 1"""))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    a, b = px.where("scl < 6").withColumn("event", F.lit("change")), px.where("scl >= 6").withColumn("event", F.lit("flood"))
    block = F.concat_ws("_", "event", "epoch", "tile_id", F.floor(F.col("row") / 4), F.floor(F.col("col") / 4))
    return a.unionByName(b).groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("cohort_dedup_union", s.sql(s.SCENES + """,
u AS (SELECT scene_id, site, 0 AS src, cloud FROM sc WHERE scene_id % 2 = 0 UNION ALL SELECT scene_id, site, 1, cloud + 100 FROM sc WHERE scene_id % 3 = 0)""",
    f"SELECT scene_id, arg_max(site, src) AS site, {r6('arg_max(cloud, src)')} AS cloud FROM u GROUP BY 1"))
def _(spark, sf):
    sc = tables.scenes(spark, sf)
    u = (sc.where("scene_id % 2 = 0").select("scene_id", "site", F.lit(0).alias("src"), "cloud")
         .unionByName(sc.where("scene_id % 3 = 0").select("scene_id", "site", F.lit(1).alias("src"), (F.col("cloud") + 100).alias("cloud"))))
    last = u.groupBy("scene_id").agg(F.max_by(F.struct("site", "cloud"), "src").alias("l"))
    return last.select("scene_id", "l.site", round6("l.cloud").alias("cloud"))


@query("mask_set_ops", s.sql(s.PIX, f"""SELECT 'and' AS op, {K} FROM pix WHERE reference AND occurrence >= 0.5 UNION ALL SELECT 'or', {K} FROM pix WHERE reference OR occurrence >= 0.5
  UNION ALL SELECT 'and_not', {K} FROM pix WHERE reference AND NOT occurrence >= 0.5"""))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    a, b = px.where("reference"), px.where("occurrence >= 0.5")
    parts = [neighbours.mask_algebra(a, b, how).select(F.lit(how).alias("op"), *CELL) for how in ("and", "or", "and_not")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scopes(spark, sf):
    """One scope box per customer nation with customers, sized by the nation key."""
    n = tables.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.lit("scope"), F.col("k")).alias("scope_id"), (F.col("k") * 2.0).alias("west"), (F.col("k") - 10.0).alias("south"),
                    (F.col("k") * 2.0 + 7 + F.col("n") % 5).alias("east"), (F.col("k") + 2.5).alias("north"))


_SCOPE = """nk AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
scope AS (SELECT 'scope' || k AS scope_id, k * 2.0::DOUBLE AS west, k - 10.0::DOUBLE AS south, k * 2.0::DOUBLE + 7 + n % 5 AS east, k + 2.5::DOUBLE AS north FROM nk),
dim AS (SELECT *, greatest(1, ceil((east - west) / 5.0))::BIGINT AS nc, greatest(1, ceil((north - south) / 5.0))::BIGINT AS nr FROM scope),
tl AS (SELECT scope_id, r.i AS row, c.i AS col, nc, west + c.i * 5.0::DOUBLE AS w, south + r.i * 5.0::DOUBLE AS s, east, north FROM dim, range(100) r(i), range(100) c(i) WHERE r.i < nr AND c.i < nc),
tile AS (SELECT scope_id, printf('%s:%04d:%04d', scope_id, row, col) AS tile_id, row, col, nc, w, s, least(east, w + 5.0) AS e, least(north, s + 5.0) AS n FROM tl)"""


@query("tile_scope", s.sql(_SCOPE, "SELECT scope_id, tile_id, w, s, e, n FROM tile"))
def _(spark, sf):
    return jobs.tile_scope(scopes(spark, sf)).select("scope_id", "tile_id", "w", "s", "e", "n")


_JOBS = _SCOPE + """,
job AS (SELECT scope_id, tile_id, sensor, CAST((row * nc + col) * 2 + i AS BIGINT) AS job_index, substr(sha256(concat_ws('|', tile_id, sensor, 'discover', '2024-01-01', '2024-02-01')), 1, 24) AS job_id
  FROM tile, (VALUES (0, 'S1'), (1, 'S2')) v(i, sensor))"""


def _jobs(spark, sf):
    return jobs.build_jobs(jobs.tile_scope(scopes(spark, sf)), ["S1", "S2"], "discover", "2024-01-01", "2024-02-01")


@query("build_jobs", s.sql(_JOBS, "SELECT * FROM job"))
def _(spark, sf):
    return _jobs(spark, sf)


@query("shard", s.sql(_JOBS, "SELECT tile_id, sensor, job_id FROM job WHERE job_index % 3 = 1"))
def _(spark, sf):
    return jobs.shard(_jobs(spark, sf), 3, 1).select("tile_id", "sensor", "job_id")


@query("rank_scenes", s.sql(s.SCENES + f""",
rk AS (SELECT *, (scene_id % 10)::DOUBLE AS l, (scene_id % 7)::DOUBLE AS b FROM sc),
rs AS (SELECT site, scene_id, 3.0 * CASE WHEN least(8.0, l + 4) > greatest(2.0, l) AND least(6.0, b + 3) > greatest(1.0, b) THEN (least(8.0, l + 4) - greatest(2.0, l)) * (least(6.0, b + 3) - greatest(1.0, b)) / 30.0::DOUBLE ELSE 0.0 END
  - cloud / 100.0 - 0.05 * least(abs(epoch(dt) - epoch(TIMESTAMP '1998-07-01')) / 86400.0, 30.0) AS score FROM rk)""",
    f"SELECT site, scene_id, {r6('score')} AS score, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, scene_id) AS INTEGER) AS rank FROM rs"))
def _(spark, sf):
    k = F.col("scene_id")
    left, bottom = (k % 10).cast("double"), (k % 7).cast("double")
    ranked = scenes.rank_scenes(tables.scenes(spark, sf), ["site"], [F.lit(2.0), F.lit(1.0), F.lit(8.0), F.lit(6.0)], [left, bottom, left + 4, bottom + 3],
                                F.lit("1998-07-01").cast("timestamp"))
    return ranked.select("site", "scene_id", round6("score").alias("score"), "rank")


@query("chunk_dates", s.sql(s.FIRE + """,
sp AS (SELECT source, min(CAST(acq_date AS DATE)) AS a, max(CAST(acq_date AS DATE)) AS b FROM fp GROUP BY 1),
ck AS (SELECT source, CAST(UNNEST(generate_series(a, b, INTERVAL 5 DAY)) AS DATE) AS chunk_start, b FROM sp)""",
    "SELECT source, chunk_start, least(chunk_start + 4, b) AS chunk_end, CAST(least(chunk_start + 4, b) - chunk_start + 1 AS INTEGER) AS n_days FROM ck"))
def _(spark, sf):
    span = tables.fire_points(spark, sf).groupBy("source").agg(F.min(F.to_date("acq_date")).alias("a"), F.max(F.to_date("acq_date")).alias("b"))
    return chunk_dates(span, 5)


def chunk_dates(span, days):
    """Chunks of ``days`` days from a to b; the last one may be shorter."""
    starts = F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {int(days)} DAYS")))
    c = span.withColumn("chunk_start", starts).withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("b")))
    return c.select("source", "chunk_start", "chunk_end", (F.datediff("chunk_end", "chunk_start") + 1).alias("n_days"))
