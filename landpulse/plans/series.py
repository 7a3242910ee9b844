"""Time-series and state queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landpulse.functions import flood, indices
from landpulse.functions.core import round6, with_fixed_rows
from landpulse.operators import jobs
from landpulse.operators.skew import attach_stats
from landpulse.plans import sqlbase as s
from landpulse.plans.detection import GRID, _FEV, flood_events, rsql
from landpulse.plans.expressions import _flood, scored_flood
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.session import scratch_path
from landpulse.sources import tables
from landpulse.streaming import streams, transitions


@query("rolling_sum_days", s.sql(s.STATION, f"""SELECT station, day, {r6('sum(sv) OVER (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) / 100.0')} AS sum_7d,
  {r6('sum(sv) OVER (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) / 100.0')} AS sum_30d FROM sd"""))
def _(spark, sf):
    d = tables.station_days(spark, sf).withColumns({"c": F.round(F.col("precip") * 100).cast("bigint"), "_d": F.datediff("day", F.lit("1970-01-01"))})
    w = Window.partitionBy("station").orderBy("_d")  # one row per day: as long as the calendar
    over = lambda k: F.sum("c").over(w.rangeBetween(-(k - 1), 0)) / 100.0
    return d.select("station", "day", round6(over(7)).alias("sum_7d"), round6(over(30)).alias("sum_30d"))


@query("monthly_mean", s.sql(s.STATION, f"SELECT station, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, {r6('avg(CASE WHEN n > 1 THEN soil END)')} AS soil, count(*) AS n_days FROM stday GROUP BY 1, 2, 3"))
def _(spark, sf):
    d = tables.station_days(spark, sf)
    return d.groupBy("station", F.year("day").alias("year"), F.month("day").alias("month")).agg(round6(F.avg(F.when(F.col("n") > 1, F.col("soil")))).alias("soil"), F.count(F.lit(1)).alias("n_days"))


def rolling_composites(px, value, valid):
    """Median of the last 2 and means of the last 6 and 12 epochs of each tile's stack, with
    clear counts; cells without a clear value become 0."""
    d = attach_stats(px, ["tile_id"], [F.max("epoch").alias("_last")], ["row", "col", "epoch"])
    recent = lambda k: F.when((F.col("epoch") > F.col("_last") - k) & valid, F.col(value))
    g = d.groupBy("tile_id", "row", "col").agg(F.percentile(recent(2), F.lit(0.5)).alias("m2"), F.avg(recent(6)).alias("m6"), F.avg(recent(12)).alias("m12"),
                                               *[F.count(recent(k)).alias(f"n_{k}") for k in (2, 6, 12)])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return g.select("tile_id", "row", "col", round6(zero("m2")).alias("short"), round6(zero("m6")).alias("medium"), round6(zero("m12")).alias("long"), "n_2", "n_6", "n_12",
                    F.col("m2").isNotNull().alias("valid"))


_RC = lambda k: f"CASE WHEN epoch > last - {k} AND scl IN (4, 5, 6, 7) THEN v END"


@query("rolling_composites", s.sql(s.PIX + f", rc AS (SELECT *, {s.NDVI} AS v, max(epoch) OVER (PARTITION BY tile_id) AS last FROM pix)",
    f"SELECT tile_id, row, col, {r6(f'coalesce(quantile_cont({_RC(2)}, 0.5), 0.0)')} AS short, {r6(f'coalesce(avg({_RC(6)}), 0.0)')} AS medium, {r6(f'coalesce(avg({_RC(12)}), 0.0)')} AS long, "
    f"count({_RC(2)}) AS n_2, count({_RC(6)}) AS n_6, count({_RC(12)}) AS n_12, count({_RC(2)}) > 0 AS valid FROM rc GROUP BY 1, 2, 3"))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumn("v", indices.ndvi("nir", "red"))
    return rolling_composites(px, "v", indices.scl_usable("scl", "flood"))


@query("area_delta", rsql(_FEV + """,
ha AS (SELECT tile_id, epoch, sum(n) * 0.04::DOUBLE AS ha FROM events_n GROUP BY 1, 2),
hl AS (SELECT *, lag(ha) OVER (PARTITION BY tile_id ORDER BY epoch) AS p FROM ha)""", f"SELECT tile_id, epoch, {r6('ha - p')} AS delta_ha, {r6('(ha - p) / greatest(0.1::DOUBLE, p) * 100.0')} AS delta_pct FROM hl"))
def _(spark, sf):
    _, _, found = flood_events(spark, sf)
    h = found.groupBy(*GRID).agg((F.sum("area_pixels") * 0.04).alias("ha"))
    p = F.lag("ha").over(Window.partitionBy("tile_id").orderBy("epoch"))  # one row per epoch
    h = h.withColumn("p", p)
    d = F.col("ha") - F.col("p")
    return h.select(*GRID, round6(d).alias("delta_ha"), round6(d / F.greatest(F.lit(0.1), F.col("p")) * 100.0).alias("delta_pct"))


# --- series with gaps ---------------------------------------------------------

def calendar_series(spark, sf):
    """One row per station and calendar day; days without observations are blackouts."""
    d = tables.station_days(spark, sf)
    span = d.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = (d.select("station").distinct().withColumn("_span", span.select(F.struct("a", "b")).scalar())
             .select("station", F.explode(F.sequence("_span.a", "_span.b")).alias("day"), F.col("_span.a").alias("first_day")))
    j = spine.join(d, ["station", "day"], "left")
    return j.select("station", "day", F.datediff("day", "first_day").alias("epoch"), F.least(F.lit(1.0), F.col("severity") * 5.0).alias("_s"), F.col("n").isNotNull().alias("resolvable")).select(
        "station", "day", "epoch", F.when(F.col("resolvable"), F.col("_s")).alias("severity"), "resolvable")


_SPINE = s.STATION + """,
sp AS (SELECT a.station, CAST(d.day AS DATE) AS day, CAST(date_diff('day', (SELECT min(day) FROM stday), CAST(d.day AS DATE)) AS INTEGER) AS epoch, least(1.0::DOUBLE, t.severity * 5.0) AS sev0, t.n IS NOT NULL AS ok
  FROM (SELECT DISTINCT station FROM stday) a CROSS JOIN (SELECT UNNEST(generate_series((SELECT min(day) FROM stday), (SELECT max(day) FROM stday), INTERVAL 1 DAY)) AS day) d
  LEFT JOIN stday t ON t.station = a.station AND t.day = CAST(d.day AS DATE)),
ser AS (SELECT station, day, epoch, CASE WHEN ok THEN sev0 END AS sev, ok FROM sp)"""
_DRY = "(x.sev >= 0.5)"
_INDRY = "(CASE WHEN r.stress + 1 < 2 THEN 'WATCH' WHEN r.stress + 1 < 4 THEN 'EMERGING' WHEN x.sev >= 0.7 AND x.sev > r.peak AND r.stress + 1 > 4 THEN 'PEAK' ELSE 'ACTIVE' END)"
_INWET = "(CASE WHEN r.state IN ('EMERGING', 'ACTIVE', 'PEAK', 'RECOVERY') THEN CASE WHEN r.normal + 1 < 3 THEN 'RECOVERY' ELSE 'RESOLVED' END ELSE 'NORMAL' END)"
_LIFE = _SPINE + f""",
life AS (SELECT DISTINCT station, CAST(-1 AS INTEGER) AS epoch, CAST('NORMAL' AS VARCHAR) AS state, CAST(0 AS INTEGER) AS stress, CAST(0 AS INTEGER) AS normal, CAST(0 AS DOUBLE) AS peak, CAST(0 AS INTEGER) AS total FROM ser
  UNION ALL SELECT x.station, x.epoch, CASE WHEN NOT x.ok THEN CASE WHEN r.state = 'NORMAL' THEN 'UNRESOLVED' ELSE r.state END WHEN {_DRY} THEN {_INDRY} ELSE {_INWET} END,
   CAST(CASE WHEN NOT x.ok THEN r.stress WHEN {_DRY} THEN r.stress + 1 ELSE 0 END AS INTEGER), CAST(CASE WHEN NOT x.ok THEN r.normal WHEN {_DRY} THEN 0 ELSE r.normal + 1 END AS INTEGER),
   CAST(CASE WHEN NOT x.ok THEN r.peak WHEN {_DRY} THEN greatest(r.peak, x.sev) WHEN {_INWET} IN ('NORMAL', 'RESOLVED') THEN 0.0 ELSE r.peak END AS DOUBLE),
   CAST(CASE WHEN NOT x.ok THEN r.total WHEN {_DRY} THEN r.total + 1 WHEN {_INWET} IN ('NORMAL', 'RESOLVED') THEN 0 ELSE r.total END AS INTEGER)
  FROM life r JOIN ser x ON x.station = r.station AND x.epoch = r.epoch + 1)"""
_LIFE_OUT = rsql(_LIFE, f"SELECT station, epoch, state, stress, normal, {r6('peak')} AS peak, total FROM life WHERE epoch >= 0")


@query("lifecycle_state", _LIFE_OUT)
def _(spark, sf):
    out = transitions.lifecycle_fold(calendar_series(spark, sf), ["station"], "epoch", "severity", "resolvable")
    return out.withColumn("peak", round6("peak"))


def _through_stream(spark, df, label, operator):
    """Stage the rows as a stream source, run the operator to completion, read the sink."""
    path = scratch_path(spark, f"{label}-out")
    out = operator(streams.stream_table(spark, df, label))
    streams.run_to_table(out, path, scratch_path(spark, f"{label}-cp"))
    return spark.read.schema(out.schema).parquet(path)


@query("lifecycle_stream", _LIFE_OUT)
def _(spark, sf):
    obs = calendar_series(spark, sf).select("station", "epoch", "severity", "resolvable")
    out = _through_stream(spark, obs, "lifecycle", lambda st: streams.lifecycle_stream(st, "station"))
    return out.where("NOT late").select("station", "epoch", "state", "stress", "normal", round6("peak").alias("peak"), "total")


def flood_observations(spark, sf):
    d = tables.station_days(spark, sf).withColumn("c", F.round(F.col("precip") * 100).cast("bigint"))
    k = F.round(F.col("soil") * 100 * F.col("n")).cast("bigint")
    ha = F.when(F.col("n") % 4 == 3, 0.0).otherwise((F.col("c") % 13000) / 100.0)
    return d.select(F.col("station").alias("aoi"), "day", F.lit(0).cast("bigint").alias("seq"), ha.alias("ha"),
                    F.sha2(F.concat_ws("_", F.month("day"), F.col("c") % 997), 256).alias("hash"), F.when(k % 9 == 0, "no_evidence").otherwise("completed").alias("status"))


_FA = s.STATION + """,
fo AS (SELECT station AS aoi, day, CASE WHEN n % 4 = 3 THEN 0.0::DOUBLE ELSE (sv % 13000) / 100.0::DOUBLE END AS ha, month(day) || '_' || sv % 997 AS hash, sk % 9 = 0 AS hold FROM sd),
fh AS (SELECT *, NOT hold AND row_number() OVER (PARTITION BY hash, hold ORDER BY day, aoi) = 1 AS fresh FROM fo),
f1 AS (SELECT *, last_value(CASE WHEN fresh THEN ha END IGNORE NULLS) OVER (PARTITION BY aoi ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fh),
f2 AS (SELECT *, CASE WHEN ha >= 100 THEN 'CRITICAL' WHEN ha >= 10 THEN 'WARNING' WHEN ha = 0 THEN 'RESOLVED' ELSE 'ADVISORY' END AS base,
  CASE WHEN ha = 0 OR (ha < 1 AND coalesce(p >= 5, false)) THEN 'RESOLVED' WHEN ha >= 100 THEN 'CRITICAL' WHEN ha >= 10 THEN 'WARNING' ELSE 'ADVISORY' END AS sev FROM f1),
f3 AS (SELECT *, last_value(CASE WHEN fresh THEN sev END IGNORE NULLS) OVER (PARTITION BY aoi ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps, round(ha - p, 2) AS d0 FROM f2),
f4 AS (SELECT *, ps IS NULL OR ps = 'RESOLVED' AS start, round(d0 / greatest(0.1::DOUBLE, p) * 100.0, 1) AS pct FROM f3),
f5 AS (SELECT *, CASE WHEN hold THEN 'DATA_BLACKOUT_HOLD' WHEN NOT fresh THEN 'DUPLICATE_SUPPRESSED' WHEN start AND ha > 0 THEN 'NEW_ALERT' WHEN start OR ha = 0 OR (ha < 1 AND p >= 5) THEN 'EVENT_RESOLVED'
  WHEN pct > 20 OR (base = 'CRITICAL' AND ps <> 'CRITICAL') THEN 'SEVERITY_ESCALATION' WHEN pct < -20 OR (ps = 'CRITICAL' AND base <> 'CRITICAL') THEN 'SEVERITY_DEESCALATION' ELSE 'ALERT_UPDATE' END AS transition,
  CASE WHEN hold OR NOT fresh THEN coalesce(ps, 'UNKNOWN') WHEN NOT start AND (ha = 0 OR (ha < 1 AND p >= 5)) THEN 'RESOLVED' ELSE base END AS severity FROM f4)"""


@query("flood_alert_state", s.sql(_FA, f"SELECT aoi, day, transition, severity, {r6('CASE WHEN hold THEN coalesce(p, 0.0) ELSE ha END')} AS area_ha, {r6('CASE WHEN NOT fresh THEN 0.0 WHEN start AND ha > 0 THEN ha WHEN start THEN 0.0 ELSE d0 END')} AS delta_ha, "
       f"{r6('CASE WHEN NOT fresh THEN 0.0 WHEN start AND ha > 0 THEN 100.0 WHEN start THEN 0.0 ELSE pct END')} AS delta_pct FROM f5"))
def _(spark, sf):
    a = transitions.flood_alerts(flood_observations(spark, sf))
    return a.select("aoi", "day", "transition", "severity", *[round6(c).alias(c) for c in ("area_ha", "delta_ha", "delta_pct")])


@query("flood_alert_stream", s.sql(_FA, "SELECT aoi, day, transition, severity FROM f5"))
def _(spark, sf):
    staged = streams.stream_table(spark, flood_observations(spark, sf), "flood-observations")
    path = scratch_path(spark, "flood-flagged")
    streams.flag_repeats(staged, "aoi", scratch_path(spark, "flood-hashes"), path, scratch_path(spark, "flood-hashes-cp"))
    flagged = spark.read.parquet(path).drop("batch")
    out = _through_stream(spark, flagged, "flood-alerts", lambda st: streams.flood_alert_stream(st, "aoi"))
    return out.select("aoi", "day", "transition", "severity")


_TIER = "(CASE WHEN x.sev >= 0.75 THEN 4 WHEN x.sev >= 0.60 THEN 3 WHEN x.sev >= 0.45 THEN 2 ELSE 1 END)"
_ACT = f"(CASE WHEN x.sev IS NULL THEN 'DATA_BLACKOUT_HOLD' WHEN r.n = 0 THEN 'NEW_ALERT' WHEN {_TIER} > r.rk THEN 'SEVERITY_ESCALATION' WHEN {_TIER} < r.rk THEN 'SEVERITY_DEESCALATION' WHEN x.epoch - r.last < 14 THEN 'DUPLICATE_SUPPRESSED' ELSE 'ALERT_UPDATE' END)"
_MOVED = f"{_ACT} NOT IN ('DATA_BLACKOUT_HOLD', 'DUPLICATE_SUPPRESSED')"
_DA = _SPINE + f""",
dal AS (SELECT DISTINCT station, CAST(-1 AS INTEGER) AS epoch, CAST('' AS VARCHAR) AS action, CAST(0 AS INTEGER) AS tr, CAST(0 AS INTEGER) AS rk, CAST(0 AS INTEGER) AS last, CAST(0 AS INTEGER) AS n FROM ser
  UNION ALL SELECT x.station, x.epoch, {_ACT}, CAST(CASE WHEN x.sev IS NULL THEN 0 ELSE {_TIER} END AS INTEGER), CAST(CASE WHEN {_MOVED} THEN {_TIER} ELSE r.rk END AS INTEGER), CAST(CASE WHEN {_MOVED} THEN x.epoch ELSE r.last END AS INTEGER),
   CAST(CASE WHEN {_MOVED} THEN r.n + 1 ELSE r.n END AS INTEGER) FROM dal r JOIN ser x ON x.station = r.station AND x.epoch = r.epoch + 1)"""
_DA_OUT = rsql(_DA, "SELECT station, CAST(epoch AS DOUBLE) AS day, action, (['UNKNOWN', 'MILD', 'MODERATE', 'SEVERE', 'EXTREME'])[tr + 1] AS tier, n AS alert_count FROM dal WHERE epoch >= 0")


def drought_observations(spark, sf):
    return calendar_series(spark, sf).select("station", F.col("epoch").cast("double").alias("day"), "severity", (~F.col("resolvable")).alias("blackout"))


@query("drought_alert_state", _DA_OUT)
def _(spark, sf):
    return transitions.drought_alerts(drought_observations(spark, sf), ["station"], "day", "severity", "blackout")


@query("drought_alert_stream", _DA_OUT)
def _(spark, sf):
    return _through_stream(spark, drought_observations(spark, sf), "drought-alerts", lambda st: streams.drought_alert_stream(st, "station"))


@query("idempotent_ingest", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1")
def _(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    twice = e.unionByName(e.where("event_id % 3 = 0"))
    out = _through_stream(spark, twice, "ingest", lambda st: streams.idempotent_ingest(st, "event_id", "ts", "60 days"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query("incremental_windows", s.sql(s.SCENES + """, wn AS (SELECT DISTINCT site, platform, strftime(dt, '%Y-%m') AS month FROM sc)""",
    "SELECT site, platform, month, substr(sha256(concat_ws('|', site, platform, month)), 1, 24) AS job_key FROM wn WHERE site % 4 <> 0"))
def _(spark, sf):
    w = tables.scenes(spark, sf).select("site", "platform", F.date_format("dt", "yyyy-MM").alias("month"))
    keys = ["site", "platform", "month"]
    ledger, output = scratch_path(spark, "ledger"), scratch_path(spark, "work")
    done = w.where("site % 4 = 0").distinct().select(jobs.work_key(*[F.col(c).cast("string") for c in keys]).alias("job_key"), F.lit(-1).alias("batch"))
    done.write.partitionBy("batch").parquet(ledger)
    streams.process_new_windows(streams.stream_table(spark, w, "windows"), keys, ledger, output, scratch_path(spark, "windows-cp"))
    return spark.read.schema("site int, platform string, month string, job_key string, batch int").parquet(output).select("site", "platform", "month", "job_key")


def every_epoch(spark, sf):
    e = tables.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return streams.all_epoch_windows(streams.stream_table(spark, e, "all-epochs"), "event_type", "ts", "cents", *[scratch_path(spark, f"all-epochs-{x}") for x in ("parts", "late", "cp")])


@query("tumbling_epoch_agg", f"SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS epoch_start, count(*) AS n, {r6('sum(CAST(round(value * 100) AS BIGINT)) / 100.0')} AS total, {r6('max(value)')} AS peak FROM events "
                             "GROUP BY 1, 2")
def _(spark, sf):
    out = every_epoch(spark, sf)
    return out.select("event_type", F.col("w.start").alias("epoch_start"), "n", round6(F.col("total") / 100.0).alias("total"), round6(F.col("peak") / 100.0).alias("peak"))


@query("tumbling_epoch_all", f"SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS epoch_start, count(*) AS n, {r6('sum(CAST(round(value * 100) AS BIGINT)) / 100.0')} AS total, {r6('max(value)')} AS peak, "
                             "date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS is_open FROM events GROUP BY 1, 2, 6")
def _(spark, sf):
    out = every_epoch(spark, sf)
    return out.select("event_type", F.col("w.start").alias("epoch_start"), "n", round6(F.col("total") / 100.0).alias("total"), round6(F.col("peak") / 100.0).alias("peak"), "is_open")


@query("blackout_detect", s.sql(_SPINE, "SELECT station, day, CASE WHEN ok THEN 'completed' ELSE 'cannot_evaluate' END AS status FROM sp"))
def _(spark, sf):
    return calendar_series(spark, sf).select("station", "day", F.when(F.col("resolvable"), "completed").otherwise("cannot_evaluate").alias("status"))


# scenario, sar, optical, novelty, terrain, rainfall, expected status
FAULTS = (("SAR_MISSING", False, True, True, True, True, "accepted"), ("OPTICAL_CLOUDED", True, False, True, True, True, "accepted"),
          ("DEM_UNAVAILABLE", True, True, True, False, True, "accepted"), ("OCCURRENCE_UNAVAILABLE", True, True, False, True, True, "accepted"),
          ("ALL_SENSORS_DOWN", False, False, True, True, True, "no_evidence"), ("SAR_ZERO_POWER", False, False, True, False, False, "no_evidence"),
          ("RAINFALL_MISSING", True, True, True, True, False, "accepted"))
_FLT = ", ".join(f"('{f[0]}', {', '.join(str(b).lower() for b in f[1:6])}, '{f[6]}')" for f in FAULTS)
_PRIM = "CASE WHEN so AND oo THEN (0.35 * sar + 0.25 * opt) / (0.35 + 0.25) WHEN so THEN sar WHEN oo THEN opt ELSE 0.0 END"


@query("robustness_matrix", s.sql(s.FLOODSCORE + f""",
fl(scenario, u_s, u_o, u_n, u_t, u_r, expected) AS (VALUES {_FLT}),
fx AS (SELECT f.*, scenario, expected, u_n, u_t, u_r, sar_ok AND u_s AS so, opt_ok AND u_o AS oo FROM flood f, fl),
fs AS (SELECT *, CASE WHEN so OR oo THEN {s.clip(f'({_PRIM}) * CASE WHEN u_n THEN nov ELSE 1.0 END * CASE WHEN u_t THEN terr ELSE 1.0 END * CASE WHEN u_r THEN 0.85 ELSE 1.0 END', 0, 1)} ELSE 0.0 END AS s2 FROM fx),
fr AS (SELECT scenario, any_value(expected) AS expected, CASE WHEN bool_or(so OR oo) THEN 'accepted' ELSE 'no_evidence' END AS actual, count(*) FILTER (WHERE (so OR oo) AND s2 >= 0.2) AS candidates, avg(s2) AS m FROM fs GROUP BY 1)""",
    f"SELECT scenario, expected, actual, expected = actual AND (actual = 'accepted' OR candidates = 0) AS is_safe, candidates, {r6('m')} AS mean_score FROM fr"))
def _(spark, sf):
    x = with_fixed_rows(scored_flood(_flood(spark, sf)).select("sar", "sar_ok", "optical", "opt_ok", "novelty", "terrain"), FAULTS,
                        ("scenario", "u_s", "u_o", "u_n", "u_t", "u_r", "expected"))
    so, oo = F.col("sar_ok") & F.col("u_s"), F.col("opt_ok") & F.col("u_o")
    gate = lambda u, c: F.when(F.col(u), c)
    x = x.withColumns({"ok": so | oo, "s": flood.fuse_gated("sar", so, "optical", oo, gate("u_n", F.col("novelty")), gate("u_t", F.col("terrain")), gate("u_r", F.lit(0.5)))})
    g = x.groupBy("scenario", "expected").agg(F.when(F.bool_or("ok"), "accepted").otherwise("no_evidence").alias("actual"), F.count_if(F.col("ok") & (F.col("s") >= 0.2)).alias("candidates"), F.avg("s").alias("m"))
    safe = (F.col("expected") == F.col("actual")) & ((F.col("actual") == "accepted") | (F.col("candidates") == 0))
    return g.select("scenario", "expected", "actual", safe.alias("is_safe"), "candidates", round6("m").alias("mean_score"))
