"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions import metrics as M
from landpulse.functions.core import round6, share, with_fixed_rows
from landpulse.operators import fire, matching, metrics
from landpulse.operators.ordered import correlation, exact_percentiles, rank_correlation
from landpulse.operators.replicates import weights_sql
from landpulse.plans import sqlbase as s
from landpulse.plans.alignment import ALARM_CELLS, LOCATED, OBJECTS, alarm_cells, located_points, object_cells
from landpulse.plans.catalog import _IMPACT, impacts
from landpulse.plans.detection import GRID, TRISTATE, decided_flood, rsql
from landpulse.plans.expressions import DROUGHT_STATE, K, ROUTED, _flood, decided_drought, routed_flood, scored_flood
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.plans.summaries import METRIC_SQL, count_sql, metrics_sql, sweep, with_metrics
from landpulse.session import cut_lineage, stored
from landpulse.sources import tables
from landpulse.sources.tables import CELL


def _scored(spark, sf):
    """Flood scores of the valid pixels."""
    return scored_flood(_flood(spark, sf)).where("valid")


_V = s.FLOODSCORE + ", sp AS (SELECT * FROM flood WHERE valid)"


@query("confusion_metrics", s.sql(_V + f", cm AS (SELECT epoch, {count_sql('score >= 0.2', 'reference')} FROM sp GROUP BY 1)", f"SELECT epoch, tp, fp, fn, tn, {metrics_sql()} FROM cm"))
def _(spark, sf):
    return with_metrics(_scored(spark, sf).groupBy("epoch").agg(*M.counts(F.col("score") >= 0.2, "reference")))


@query("tristate_confusion", s.sql(TRISTATE + """,
tc AS (SELECT epoch, count(*) AS total, count(*) FILTER (WHERE NOT seen) AS unresolved, count(*) FILTER (WHERE seen AND is_flood AND reference) AS tp, count(*) FILTER (WHERE seen AND is_flood AND NOT reference) AS fp,
  count(*) FILTER (WHERE seen AND NOT is_flood AND reference) AS fn, count(*) FILTER (WHERE seen AND NOT is_flood AND NOT reference) AS tn FROM tri2 GROUP BY 1)""",
    f"SELECT epoch, total, unresolved, tp, fp, fn, tn, total = unresolved + tp + fp + fn + tn AS closes, {metrics_sql(('precision', 'recall', 'f1'))} FROM tc"))
def _(spark, sf):
    d = decided_flood(tables.pixels(spark, sf))
    seen, flooded = F.col("state") != "UNRESOLVED", F.col("state") == "FLOOD"
    ref = F.coalesce("reference", F.lit(False))
    cell = lambda p, r: F.count_if(seen & p & r)
    g = d.groupBy("epoch").agg(F.count(F.lit(1)).alias("total"), F.count_if(~seen).alias("unresolved"), cell(flooded, ref).alias("tp"), cell(flooded, ~ref).alias("fp"),
                               cell(~flooded, ref).alias("fn"), cell(~flooded, ~ref).alias("tn"))
    g = g.withColumn("closes", F.col("total") == F.col("unresolved") + F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return with_metrics(g, ("precision", "recall", "f1"))


@query("kappa", s.sql(DROUGHT_STATE + f", cm AS (SELECT tile_id, {count_sql('score >= 0.35', 'reference')} FROM dstate GROUP BY 1), k AS (SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS po, "
       "((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / ((tp + fp + fn + tn)::DOUBLE * (tp + fp + fn + tn)) AS pe FROM cm)", f"SELECT tile_id, {r6('(po - pe) / greatest(1e-6, 1.0 - pe)')} AS kappa FROM k"))
def _(spark, sf):
    d = decided_drought(tables.drought_inputs(tables.pixels(spark, sf)))
    g = d.groupBy("tile_id").agg(*M.counts(F.col("score") >= 0.35, "reference"))
    return g.select("tile_id", round6(M.kappa()).alias("kappa"))


@query("brier", s.sql(_V, f"SELECT epoch, {r6('avg((score - reference::INT) * (score - reference::INT))')} AS brier FROM sp GROUP BY 1"))
def _(spark, sf):
    e = F.col("score") - F.col("reference").cast("double")
    return _scored(spark, sf).groupBy("epoch").agg(round6(F.avg(e * e)).alias("brier"))


@query("brier_skill", s.sql(_V + """,
rate AS (SELECT least(floor(score * 10), 9) AS b, avg(reference::INT) AS q FROM sp GROUP BY 1),
bs AS (SELECT epoch, avg((score - reference::INT) * (score - reference::INT)) AS raw, avg((q - reference::INT) * (q - reference::INT)) AS cal FROM sp JOIN rate ON least(floor(score * 10), 9) = b GROUP BY 1)""",
    f"SELECT epoch, {r6('raw')} AS brier_raw, {r6('cal')} AS brier_calibrated, {r6('(raw - cal) / greatest(0.001, raw)')} AS skill FROM bs"))
def _(spark, sf):
    d = _scored(spark, sf).withColumn("b", F.least(F.floor(F.col("score") * 10), F.lit(9)))
    rate = d.groupBy("b").agg(share("reference").alias("q"))  # ten rows
    j = d.join(F.broadcast(rate), "b")
    y = F.col("reference").cast("double")
    g = j.groupBy("epoch").agg(F.avg((F.col("score") - y) * (F.col("score") - y)).alias("raw"), F.avg((F.col("q") - y) * (F.col("q") - y)).alias("cal"))
    return g.select("epoch", round6("raw").alias("brier_raw"), round6("cal").alias("brier_calibrated"), round6((F.col("raw") - F.col("cal")) / F.greatest(F.lit(0.001), F.col("raw"))).alias("skill"))


_REL = _V + """,
rb AS (SELECT epoch, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mp, avg(reference::INT) AS rt FROM sp GROUP BY 1, 2),
rl AS (SELECT e.epoch, CAST(b.i AS INTEGER) AS bin, coalesce(n, 0) AS n, coalesce(mp, (b.i + 0.5) / 10) AS mean_p, coalesce(rt, 0.0) AS rate, CASE WHEN n > 0 THEN abs(mp - rt) ELSE 0.0 END AS gap
  FROM (SELECT DISTINCT epoch FROM sp) e CROSS JOIN range(10) b(i) LEFT JOIN rb ON rb.epoch = e.epoch AND rb.bin = b.i)"""


@query("reliability_bins", s.sql(_REL, f"SELECT epoch, bin, n, {r6('mean_p')} AS mean_p, {r6('rate')} AS rate, {r6('gap')} AS gap FROM rl"))
def _(spark, sf):
    b = metrics.reliability(_scored(spark, sf), ["epoch"], "score", "reference")
    return b.select("epoch", "bin", "n", *[round6(c).alias(c) for c in ("mean_p", "rate", "gap")])


@query("calibration_errors", s.sql(_REL, f"SELECT epoch, {r6('sum(n * gap) / sum(n)')} AS ece, {r6('max(gap)')} AS mce FROM rl GROUP BY 1"))
def _(spark, sf):
    e = metrics.calibration_errors(metrics.reliability(_scored(spark, sf), ["epoch"], "score", "reference"), ["epoch"])
    return e.select("epoch", round6("ece").alias("ece"), round6("mce").alias("mce"))


@query("calibration_slope", s.sql(_V + ", lg AS (SELECT epoch, ln(greatest(least(score, 1.0 - 1e-6), 1e-6) / (1.0 - greatest(least(score, 1.0 - 1e-6), 1e-6))) AS x, reference::INT::DOUBLE AS y FROM sp)",
    f"SELECT epoch, {r6('covar_samp(x, y) / var_samp(x)')} AS slope, {r6('avg(y) - covar_samp(x, y) / var_samp(x) * avg(x)')} AS intercept FROM lg GROUP BY 1"))
def _(spark, sf):
    d = _scored(spark, sf).select("epoch", metrics.logit("score").alias("x"), F.col("reference").cast("double").alias("y"))
    g = d.groupBy("epoch").agg((F.covar_samp("x", "y") / F.var_samp("x")).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return g.select("epoch", round6("b").alias("slope"), round6(F.col("my") - F.col("b") * F.col("mx")).alias("intercept"))


def auc_sql(src: str, keys: str, out: str = "auc", score: str = "score", label: str = "reference") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""{out}_h AS (SELECT {k}{score} AS sc, count(*) AS n, count(*) FILTER (WHERE {label}) AS pos FROM {src} GROUP BY {k}{score}),
{out}_c AS (SELECT *, sum(n) OVER ({part} ORDER BY sc DESC) AS cn, sum(pos) OVER ({part} ORDER BY sc DESC) AS cp, sum(n) OVER ({part}) AS an, sum(pos) OVER ({part}) AS ap FROM {out}_h),
{out} AS (SELECT {k}max(an)::BIGINT AS n_pixels, max(ap)::BIGINT AS n_positive, CASE WHEN max(ap) > 0 THEN sum(pos / ap::DOUBLE * (cp / cn::DOUBLE + CASE WHEN cn = n THEN 1.0::DOUBLE ELSE (cp - pos) / (cn - n)::DOUBLE END) / 2.0) END AS pr_auc,
  CASE WHEN max(ap) > 0 AND max(ap) < max(an) THEN sum((n - pos) / (an - ap)::DOUBLE * (cp / ap::DOUBLE + (cp - pos) / ap::DOUBLE) / 2.0) END AS roc_auc FROM {out}_c {grp})"""


@query("pr_auc_exact", s.sql(_V + "," + auc_sql("sp", "epoch"), f"SELECT epoch, n_pixels, n_positive, {r6('pr_auc')} AS pr_auc FROM auc"))
def _(spark, sf):
    a = metrics.curve_areas(_scored(spark, sf), ["epoch"], "score", "reference")
    return a.select("epoch", "n_pixels", "n_positive", round6("pr_auc").alias("pr_auc"))


@query("roc_auc", s.sql(_V + "," + auc_sql("sp", ""), f"SELECT n_pixels, n_positive, {r6('roc_auc')} AS roc_auc FROM auc"))
def _(spark, sf):
    a = metrics.curve_areas(_scored(spark, sf), [], "score", "reference")
    return a.select("n_pixels", "n_positive", round6("roc_auc").alias("roc_auc"))


@query("pr_auc_grid", s.sql(_V + """,
th AS (SELECT e.epoch, t.i / 100.0::DOUBLE AS t, count(*) FILTER (WHERE score >= t.i / 100.0::DOUBLE) AS pp, count(*) FILTER (WHERE score >= t.i / 100.0::DOUBLE AND reference) AS tp, count(*) FILTER (WHERE reference) AS p
  FROM sp e, range(101) t(i) GROUP BY 1, 2),
pc AS (SELECT epoch, p, tp / greatest(1, pp)::DOUBLE AS pr, tp / greatest(1, p)::DOUBLE AS rc FROM th),
pe AS (SELECT *, max(pr) OVER (PARTITION BY epoch ORDER BY rc, pr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM pc),
pa AS (SELECT *, 0.5 * (env + lag(env) OVER w) * (rc - lag(rc) OVER w) AS a FROM pe WINDOW w AS (PARTITION BY epoch ORDER BY rc, pr))""",
    f"SELECT epoch, max(p) AS n_positive, {r6('CASE WHEN max(p) > 0 THEN sum(a) ELSE 0.0 END')} AS pr_auc_grid FROM pa GROUP BY 1"))
def _(spark, sf):
    a = metrics.grid_pr_auc(_scored(spark, sf), ["epoch"], "score", "reference")
    return a.select("epoch", "n_positive", round6("pr_auc_grid").alias("pr_auc_grid"))


_GAIN = TRISTATE + f", tv AS (SELECT tile_id, tile_id % 3 AS cohort, score, reference, o >= 0.5 AS resolvable FROM tri WHERE score IS NOT NULL)," + auc_sql("tv", "tile_id, cohort", "fullauc") + \
    ", tvr AS (SELECT * FROM tv WHERE resolvable)," + auc_sql("tvr", "tile_id, cohort", "resauc")


@query("resolvable_gain", s.sql(_GAIN, f"SELECT f.cohort, count(*) AS n_tiles, {r6('avg(f.pr_auc)')} AS full_auc, {r6('avg(r.pr_auc)')} AS resolvable_auc, {r6('avg(r.pr_auc) - avg(f.pr_auc)')} AS gain, {r6('(avg(r.pr_auc) - avg(f.pr_auc)) / avg(f.pr_auc) * 100.0')} AS gain_pct "
                                       "FROM fullauc f JOIN resauc r USING (tile_id) GROUP BY 1"))
def _(spark, sf):
    d = decided_flood(tables.pixels(spark, sf)).where("score IS NOT NULL").select("tile_id", (F.col("tile_id") % 3).alias("cohort"), "score", "reference", (F.col("o") >= 0.5).alias("ok"))
    # both domains in one ranking: the resolvable pixels count again under their own key
    both = d.withColumn("domain", F.explode(F.when(F.col("ok"), F.array(F.lit("full"), F.lit("res"))).otherwise(F.array(F.lit("full")))))
    a = metrics.curve_areas(both, ["tile_id", "cohort", "domain"], "score", "reference")
    per = a.groupBy("tile_id", "cohort").agg(F.max(F.when(F.col("domain") == "full", F.col("pr_auc"))).alias("f"), F.max(F.when(F.col("domain") == "res", F.col("pr_auc"))).alias("r"),
                                             F.count(F.lit(1)).alias("k")).where("k = 2")
    g = per.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_tiles"), F.avg("f").alias("f"), F.avg("r").alias("r"))
    gain = F.col("r") - F.col("f")
    return g.select("cohort", "n_tiles", round6("f").alias("full_auc"), round6("r").alias("resolvable_auc"), round6(gain).alias("gain"), round6(gain / F.col("f") * 100.0).alias("gain_pct"))


_OB = "CASE WHEN o < 0.2 THEN 0 WHEN o < 0.4 THEN 1 WHEN o < 0.6 THEN 2 WHEN o < 0.8 THEN 3 ELSE 4 END"
_OBIN = TRISTATE + f", ov AS (SELECT CAST({_OB} AS INTEGER) AS bin, tile_id, epoch, row, col, score, reference FROM tri WHERE score IS NOT NULL)"


def observability_binned(spark, sf):
    d = decided_flood(tables.pixels(spark, sf)).where("score IS NOT NULL")
    b = None
    for i, (low, high) in enumerate(config.OBSERVABILITY_BINS):
        inside = (F.col("o") >= low) & (F.col("o") < high)
        b = F.when(inside, i) if b is None else b.when(inside, i)
    return d.select(*CELL, b.alias("bin"), "score", "reference")


@query("observability_bins", s.sql(_OBIN + "," + auc_sql("ov", "bin") + f""",
bm AS (SELECT bin, count(*) AS n, avg((score - reference::INT) * (score - reference::INT)) AS brier, {count_sql('score >= 0.2', 'reference')} FROM ov GROUP BY 1),
bp AS (SELECT *, {METRIC_SQL['precision']} AS pr FROM bm)""",
    f"SELECT bin, n, {metrics_sql(('precision', 'recall', 'f1'))}, {r6('pr_auc')} AS pr_auc, {r6('brier')} AS brier, coalesce(pr >= lag(pr) OVER (ORDER BY bin), true) AS monotone FROM bp JOIN auc USING (bin)"))
def _(spark, sf):
    from pyspark.sql import Window

    d = observability_binned(spark, sf)
    g = metrics.curve_areas(d, ["bin"], "score", "reference", 0.2).withColumnRenamed("n_pixels", "n")
    made = M.scores()
    g = g.withColumns({n: made[n] for n in ("precision", "recall", "f1")})
    order = Window.partitionBy(F.lit(0)).orderBy("bin")  # five rows
    g = g.withColumn("monotone", F.coalesce(F.col("precision") >= F.lag("precision").over(order), F.lit(True)))
    return g.select("bin", "n", *[round6(c).alias(c) for c in ("precision", "recall", "f1", "pr_auc", "brier")], "monotone")


_PAIR = s.STATION + f", st AS (SELECT station, {r6('avg(severity)')} AS x, {r6('avg(soil)')} AS y, count(*) AS n FROM stday GROUP BY 1)"


def station_pairs(spark, sf):
    d = tables.station_days(spark, sf).groupBy("station").agg(round6(F.avg("severity")).alias("x"), round6(F.avg("soil")).alias("y"), F.count(F.lit(1)).alias("n"))
    return d


_RANK = lambda c: f"(rank() OVER (PARTITION BY g ORDER BY {c}) + (count(*) OVER (PARTITION BY g, {c}) - 1) / 2.0)"


@query("rank_correlation", """WITH pr AS (SELECT c_nationkey AS g, c_acctbal AS x, CAST(c_custkey % 37 AS DOUBLE) AS y FROM customer),
rk AS (SELECT g, x, y, """ + _RANK("x") + " AS rx, " + _RANK("y") + f" AS ry FROM pr) SELECT g AS nation, count(*) AS n_pairs, {r6('corr(x, y)')} AS pearson_r, {r6('corr(rx, ry)')} AS spearman_rho FROM rk GROUP BY 1")
def _(spark, sf):
    c = tables.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"))
    r = rank_correlation(c, ["nation"], "x", "y")
    return r.select("nation", "n_pairs", round6("pearson_r").alias("pearson_r"), round6("spearman_rho").alias("spearman_rho"))


@query("station_errors", s.sql(s.STATION, f"SELECT station, count(*) AS n, {r6('sqrt(avg((severity - soil) * (severity - soil)))')} AS rmse, {r6('avg(abs(severity - soil))')} AS mae, {r6('avg(severity - soil)')} AS bias, "
       f"{r6('CASE WHEN stddev_pop(severity) > 1e-6 AND stddev_pop(soil) > 1e-6 THEN corr(severity, soil) ELSE 0.0 END')} AS pearson_r FROM stday GROUP BY 1"))
def _(spark, sf):
    e = F.col("severity") - F.col("soil")
    g = tables.station_days(spark, sf).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
                                                              F.coalesce(correlation("severity", "soil"), F.lit(0.0)).alias("pearson_r"))
    return g.select("station", "n", *[round6(c).alias(c) for c in ("rmse", "mae", "bias", "pearson_r")])


def leave_one_station(pairs, group, x, y):
    """Correlation and error without each group: totals minus the group's own moments, so no
    row is copied per held-out group."""
    X, Y = F.col(x), F.col(y)
    parts = {"n": F.count(F.lit(1)), "sx": F.sum(X), "sy": F.sum(Y), "sxx": F.sum(X * X), "syy": F.sum(Y * Y), "sxy": F.sum(X * Y), "se": F.sum((X - Y) * (X - Y))}
    own = pairs.groupBy(group).agg(*[e.alias(f"o_{k}") for k, e in parts.items()])
    total = own.agg(F.struct(*[F.sum(f"o_{k}").alias(f"t_{k}") for k in parts], F.count(F.lit(1)).alias("n_groups")).alias("_t"))
    j = own.withColumn("_t", total.scalar()).select("*", "_t.*")
    rest = {k: F.col(f"t_{k}") - F.col(f"o_{k}") for k in parts}

    def r(v):
        vx, vy = v["n"] * v["sxx"] - v["sx"] * v["sx"], v["n"] * v["syy"] - v["sy"] * v["sy"]
        return F.when((vx > 1e-9) & (vy > 1e-9), (v["n"] * v["sxy"] - v["sx"] * v["sy"]) / F.sqrt(vx) / F.sqrt(vy)).otherwise(0.0)

    whole = r({k: F.col(f"t_{k}") for k in parts})
    out = F.when(rest["n"] >= 3, r(rest)).otherwise(0.0)
    return j.select(group, (F.col("n_groups") - 1).alias("remaining_stations"), rest["n"].alias("remaining_pairs"), out.alias("pearson_r"),
                    F.when(rest["n"] >= 3, F.sqrt(rest["se"] / rest["n"])).otherwise(0.0).alias("rmse"), (out - whole).alias("delta_r"))


@query("leave_one_station_out", s.sql(s.STATION + """, al AS (SELECT corr(severity, soil) AS r0, count(DISTINCT station) AS k FROM stday),
lo AS (SELECT h.station, count(*) AS n, corr(severity, soil) AS r, sqrt(avg((severity - soil) * (severity - soil))) AS rmse FROM (SELECT DISTINCT station FROM stday) h JOIN stday d ON d.station <> h.station GROUP BY 1)""",
    f"SELECT station, k - 1 AS remaining_stations, n AS remaining_pairs, {r6('r')} AS pearson_r, {r6('rmse')} AS rmse, {r6('r - r0')} AS delta_r FROM lo, al"))
def _(spark, sf):
    out = leave_one_station(tables.station_days(spark, sf), "station", "severity", "soil")
    return out.select("station", "remaining_stations", "remaining_pairs", *[round6(c).alias(c) for c in ("pearson_r", "rmse", "delta_r")])


@query("bootstrap_ci", s.sql(_PAIR + f""",
un AS (SELECT station::VARCHAR AS unit FROM st), {weights_sql("un", "wt")},
bs AS (SELECT b, x, y, w FROM st JOIN wt ON unit = station::VARCHAR),
mo AS (SELECT b, sum(w)::DOUBLE AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM bs GROUP BY 1),
rr AS (SELECT CASE WHEN n * sxx - sx * sx > 1e-12 AND n * syy - sy * sy > 1e-12 THEN (n * sxy - sx * sy) / sqrt(n * sxx - sx * sx) / sqrt(n * syy - sy * sy) END AS r FROM mo)""",
    f"SELECT {r6('quantile_cont(r, 0.025)')} AS low, {r6('quantile_cont(r, 0.5)')} AS mid, {r6('quantile_cont(r, 0.975)')} AS high, count(r) AS n_replicates FROM rr"))
def _(spark, sf):
    b = metrics.bootstrap_correlation(station_pairs(spark, sf), "station", "x", "y")
    return b.select(round6("low").alias("low"), round6("mid").alias("mid"), round6("high").alias("high"), "n_replicates")


_BLK = "concat_ws('_', tile_id, epoch, row // 8, col // 8)"
_QQ = lambda c, n: f"{r6(f'quantile_cont({c}, 0.025)')} AS {n}_low, {r6(f'quantile_cont({c}, 0.975)')} AS {n}_high"


@query("block_bootstrap_ci", s.sql(_OBIN + f""",
bk AS MATERIALIZED (SELECT {_BLK} AS block, bin, least(greatest(floor(score * 100 + 1e-6::DOUBLE), 0), 100) AS level, count(*) FILTER (WHERE reference) AS pos, count(*) FILTER (WHERE NOT reference) AS neg FROM ov GROUP BY 1, 2, 3),
un AS (SELECT DISTINCT block AS unit FROM bk), {weights_sql("un", "wt")},
sm AS MATERIALIZED (SELECT b, bin, level, sum(w * pos)::DOUBLE AS pos, sum(w * neg)::DOUBLE AS neg FROM bk JOIN wt ON unit = block GROUP BY 1, 2, 3),
cv AS (SELECT *, sum(pos) OVER d AS cp, sum(pos + neg) OVER d AS cn, sum(pos) OVER (PARTITION BY b, bin) AS ap FROM sm WINDOW d AS (PARTITION BY b, bin ORDER BY level DESC)),
ea AS (SELECT b, bin, coalesce(sum(pos) FILTER (level >= 20), 0) AS tp, coalesce(sum(neg) FILTER (level >= 20), 0) AS fp, max(ap) AS ap,
  sum(CASE WHEN ap > 0 AND cn > 0 THEN pos / ap * (cp / cn + CASE WHEN cn - pos - neg > 0 THEN (cp - pos) / (cn - pos - neg) ELSE 1.0 END) / 2.0 ELSE 0.0 END) AS area FROM cv GROUP BY 1, 2),
eb AS (SELECT bin, area, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS r FROM ea),
ec AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f FROM eb)""",
    f"SELECT bin, {_QQ('p', 'precision')}, {_QQ('r', 'recall')}, {_QQ('f', 'f1')}, {_QQ('area', 'pr_auc')} FROM ec GROUP BY 1"))
def _(spark, sf):
    block = F.concat_ws("_", "tile_id", "epoch", F.floor(F.col("row") / 8), F.floor(F.col("col") / 8))
    out = metrics.block_bootstrap(observability_binned(spark, sf), block, "bin", "score", "reference", 0.2)
    return out.select("bin", *[round6(c).alias(c) for c in out.columns[1:]])


_SW = ", ".join(f"({t})" for t in config.SWEEP_THRESHOLDS)


@query("threshold_sweep", s.sql(_V + f", sw AS (SELECT epoch, t::DOUBLE AS threshold, {count_sql('score >= t', 'reference')} FROM sp, (VALUES {_SW}) v(t) GROUP BY 1, 2)",
    f"SELECT epoch, threshold, tp, fp, fn, tn, {metrics_sql()}, {r6('(tp + fp) * 0.04')} AS predicted_ha FROM sw"))
def _(spark, sf):
    out = with_metrics(sweep(_scored(spark, sf), ["epoch"], "score", config.SWEEP_THRESHOLDS))
    return out.withColumn("predicted_ha", round6((F.col("tp") + F.col("fp")) * 0.04))


@query("score_separation", s.sql(_V + ", ss AS (SELECT epoch, avg(score) FILTER (WHERE reference) AS r, avg(score) FILTER (WHERE NOT reference) AS b, avg(reference::INT) AS p FROM sp GROUP BY 1)",
    f"SELECT epoch, {r6('r')} AS reference_mean, {r6('b')} AS background_mean, {r6('r / greatest(1e-5, b)')} AS ratio, {r6('p')} AS prevalence FROM ss"))
def _(spark, sf):
    g = _scored(spark, sf).groupBy("epoch").agg(F.avg(F.when(F.col("reference"), F.col("score"))).alias("r"), F.avg(F.when(~F.col("reference"), F.col("score"))).alias("b"), share("reference").alias("p"))
    return g.select("epoch", round6("r").alias("reference_mean"), round6("b").alias("background_mean"), round6(F.col("r") / F.greatest(F.lit(1e-5), F.col("b"))).alias("ratio"), round6("p").alias("prevalence"))


_RDL = ROUTED + f""",
rv AS (SELECT tile_id, 'global' AS strategy, score, reference FROM routed WHERE valid UNION ALL SELECT tile_id, 'routed', routed_score, reference FROM routed WHERE valid),""" + auc_sql("rv", "tile_id, strategy") + f""",
rc AS (SELECT tile_id, strategy, {count_sql('score >= 0.2', 'reference')} FROM rv GROUP BY 1, 2),
rm AS (SELECT *, {METRIC_SQL['precision']} AS pr, {METRIC_SQL['f1']} AS f1, {METRIC_SQL['area_bias']} AS bias FROM rc JOIN auc USING (tile_id, strategy))"""


@query("routing_delta", s.sql(_RDL, f"""SELECT g.tile_id, {r6('r.pr_auc - g.pr_auc')} AS delta_pr_auc, {r6('r.pr - g.pr')} AS delta_precision, {r6('r.f1 - g.f1')} AS delta_f1, {r6('r.bias - g.bias')} AS delta_bias,
  {r6('CASE WHEN g.fp > 0 THEN (g.fp - r.fp) / g.fp::DOUBLE * 100.0 ELSE 0.0 END')} AS fp_reduction_pct, {r6('CASE WHEN g.tp > 0 THEN r.tp / g.tp::DOUBLE ELSE 0.0 END')} AS tp_retention FROM rm g JOIN rm r USING (tile_id) WHERE g.strategy = 'global' AND r.strategy = 'routed'"""))
def _(spark, sf):
    d = routed_flood(stored(scored_flood(_flood(spark, sf)), "scored")).where("valid")
    both = F.explode(F.array(F.struct(F.lit("global").alias("strategy"), F.col("score").alias("score")), F.struct(F.lit("routed").alias("strategy"), F.col("routed_score").alias("score"))))
    long = d.select("tile_id", "reference", both.alias("b")).select("tile_id", "reference", "b.*")
    keys = ["tile_id", "strategy"]
    m = metrics.curve_areas(long, keys, "score", "reference", 0.2)
    made = M.scores()
    m = m.select(*keys, "tp", "fp", "pr_auc", *[made[n].alias(n) for n in ("precision", "f1", "area_bias")])
    pick = lambda st, c: F.max(F.when(F.col("strategy") == st, F.col(c)))
    names = ("tp", "fp", "pr_auc", "precision", "f1", "area_bias")
    w = m.groupBy("tile_id").agg(*[pick(st, c).alias(f"{st[0]}_{c}") for st in ("global", "routed") for c in names])
    diff = lambda c: round6(F.col(f"r_{c}") - F.col(f"g_{c}"))
    return w.select("tile_id", diff("pr_auc").alias("delta_pr_auc"), diff("precision").alias("delta_precision"), diff("f1").alias("delta_f1"), diff("area_bias").alias("delta_bias"),
                    round6(F.when(F.col("g_fp") > 0, (F.col("g_fp") - F.col("r_fp")) / F.col("g_fp") * 100.0).otherwise(0.0)).alias("fp_reduction_pct"),
                    round6(F.when(F.col("g_tp") > 0, F.col("r_tp") / F.col("g_tp")).otherwise(0.0)).alias("tp_retention"))


@query("cohort_macro", s.sql(ROUTED + f""",
cm AS (SELECT tile_id, epoch, any_value(regime) AS regime, CASE WHEN epoch < 1999 THEN 'development' ELSE 'unseen' END AS era, {count_sql('score >= 0.2', 'reference')} FROM routed WHERE valid GROUP BY tile_id, epoch),
cr AS (SELECT *, {METRIC_SQL['precision']} AS pr, {METRIC_SQL['recall']} AS rc, {METRIC_SQL['f1']} AS f FROM cm)""",
    f"SELECT regime, era, count(*) AS n, {r6('avg(pr)')} AS macro_precision, {r6('avg(rc)')} AS macro_recall, {r6('avg(f)')} AS macro_f1 FROM cr GROUP BY ROLLUP (regime, era)"))
def _(spark, sf):
    d = routed_flood(scored_flood(_flood(spark, sf))).where("valid")
    g = d.groupBy("tile_id", "epoch").agg(F.first("regime").alias("regime"), *M.counts(F.col("score") >= 0.2, "reference"))
    made = M.scores()
    g = g.select("regime", F.when(F.col("epoch") < 1999, "development").otherwise("unseen").alias("era"), *[made[n].alias(n) for n in ("precision", "recall", "f1")])
    return g.rollup("regime", "era").agg(F.count(F.lit(1)).alias("n"), *[round6(F.avg(n)).alias(f"macro_{n}") for n in ("precision", "recall", "f1")])


@query("cross_site_spread", s.sql(_V + ", cs AS (SELECT tile_id, epoch, avg(score) AS m FROM sp GROUP BY 1, 2)",
    f"SELECT epoch, count(*) AS n_sites, {r6('quantile_cont(m, 0.5)')} AS median, {r6('quantile_cont(m, 0.75) - quantile_cont(m, 0.25)')} AS iqr, {r6('max(m) - min(m)')} AS range FROM cs GROUP BY 1"))
def _(spark, sf):
    m = _scored(spark, sf).groupBy("tile_id", "epoch").agg(F.avg("score").alias("m"))
    a = m.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_sites"), (F.max("m") - F.min("m")).alias("range"))
    p = exact_percentiles(m, ["epoch"], "m", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return a.join(p, "epoch").select("epoch", "n_sites", round6("median").alias("median"), round6(F.col("q3") - F.col("q1")).alias("iqr"), round6("range").alias("range"))


@query("failure_cases", s.sql(_V, f"""SELECT {K}, CASE WHEN reference THEN 'missed' ELSE 'false_alarm' END AS kind, CASE WHEN reference AND nov < 0.3 THEN 'permanent_water_baseline' WHEN reference AND NOT opt_ok THEN 'no_optical' WHEN reference THEN 'weak_signal'
  WHEN occurrence >= 0.1 THEN 'seasonal_water' ELSE 'low_backscatter' END AS cause FROM sp WHERE (score >= 0.2) <> reference"""))
def _(spark, sf):
    d = _scored(spark, sf).where((F.col("score") >= 0.2) != F.col("reference"))
    ref = F.col("reference")
    cause = (F.when(ref & (F.col("novelty") < 0.3), "permanent_water_baseline").when(ref & ~F.col("opt_ok"), "no_optical").when(ref, "weak_signal")
             .when(F.col("occurrence") >= 0.1, "seasonal_water").otherwise("low_backscatter"))
    return d.select(*CELL, F.when(ref, "missed").otherwise("false_alarm").alias("kind"), cause.alias("cause"))


def leakage_audit(manifests):
    """Leak flags of run manifests: baseline_years, eval_year, inputs, comparator_inputs, scene_ids, mode."""
    synthetic = F.exists("scene_ids", lambda x: F.upper(x).contains("SYNTHETIC"))
    real = F.col("mode") == "REAL_OBSERVATION"
    return manifests.select("*", F.array_contains("baseline_years", F.col("eval_year")).alias("target_in_baseline"),
                            F.arrays_overlap("inputs", "comparator_inputs").alias("inputs_overlap"),
                            (real & ((F.size("scene_ids") == 0) | synthetic)).alias("synthetic_in_real"))


@query("manifest_leakage_audit", s.sql(s.PIX + """,
mf AS (SELECT tile_id, list_sort(coalesce(list(DISTINCT epoch) FILTER (WHERE tile_id % 4 = 3 OR epoch <> 1995 + tile_id % 8), [])) AS yrs, 1995 + tile_id % 8 AS ey, CASE WHEN tile_id % 2 = 0 THEN 'REAL_OBSERVATION' ELSE 'TEST_FIXTURE' END AS mode FROM pix GROUP BY tile_id)""",
    """SELECT tile_id, CAST(ey AS INTEGER) AS eval_year, list_contains(yrs, ey) AS target_in_baseline, tile_id % 3 = 0 AS inputs_overlap, mode = 'REAL_OBSERVATION' AND tile_id % 5 = 4 AS synthetic_in_real,
  sha256('{"baseline_years":[' || array_to_string(yrs, ',') || '],"eval_year":' || ey || ',"mode":"' || mode || '"}') AS digest FROM mf"""))
def _(spark, sf):
    t = F.col("tile_id")
    # every fourth tile leaves its evaluation year in its baseline
    baseline = F.when((t % 4 == 3) | (F.col("epoch") != 1995 + t % 8), F.col("epoch"))
    m = tables.pixels(spark, sf).groupBy("tile_id").agg(F.sort_array(F.collect_set(baseline)).alias("baseline_years"))
    m = m.select("tile_id", "baseline_years", (1995 + t % 8).cast("int").alias("eval_year"), F.array(F.lit("SPI_3M"), F.lit("NDVI")).alias("inputs"),
                 F.when(t % 3 == 0, F.array(F.lit("SPI_3M"))).otherwise(F.array(F.lit("STREAMFLOW"))).alias("comparator_inputs"),
                 F.when(t % 5 == 4, F.array(F.lit("S2A_1"), F.lit("Synthetic_7"))).otherwise(F.array(F.lit("S2A_1"))).alias("scene_ids"),
                 F.when(t % 2 == 0, "REAL_OBSERVATION").otherwise("TEST_FIXTURE").alias("mode"))
    a = leakage_audit(m)
    digest = F.sha2(F.to_json(F.struct("baseline_years", "eval_year", "mode")), 256)
    return a.select("tile_id", "eval_year", "target_in_baseline", "inputs_overlap", "synthetic_in_real", digest.alias("digest"))


@query("impact_corroboration", s.sql(_IMPACT + f""",
ip AS (SELECT state AS g, poor_pct AS x, {r6('loss / n')} AS y, cents, week_ending_date FROM imp),
ik AS (SELECT *, {_RANK('x')} AS rx, {_RANK('y')} AS ry FROM ip),
im2 AS (SELECT g, sum(cents)::BIGINT / 100.0::DOUBLE AS total, min(CASE WHEN x >= 60 THEN week_ending_date END) AS d1, min(CASE WHEN y >= 300000 THEN week_ending_date END) AS d2 FROM ip GROUP BY 1)""",
    f"SELECT g AS state, {r6('corr(rx, ry)')} AS spearman_rho, {r6('any_value(total)')} AS total_loss, any_value(date_diff('day', d2, d1)) AS onset_delay_days FROM ik JOIN im2 USING (g) GROUP BY 1"))
def _(spark, sf):
    im = impacts(spark, sf).withColumn("y", round6(F.col("loss") / F.col("n")))
    rho = rank_correlation(im, ["state"], "poor_pct", "y").select("state", round6("spearman_rho").alias("spearman_rho"))
    first = lambda cond: F.min(F.when(cond, F.col("week_ending_date")))
    tot = im.groupBy("state").agg((F.sum("cents") / 100.0).alias("t"), first(F.col("poor_pct") >= 60).alias("d1"), first(F.col("y") >= 300000).alias("d2"))
    return rho.join(tot, "state").select("state", "spearman_rho", round6("t").alias("total_loss"), F.datediff("d1", "d2").alias("onset_delay_days"))


def object_scores(pairs, size_p, size_r, thresholds, pixel_ha=0.04, small=0.70, medium=3.50):
    """Object precision, recall, F1, IoU and size-stratified recall per IoU threshold.

    All thresholds are matched in one pass, each under its own key.
    """
    taus = [(float(t),) for t in thresholds]
    eligible = with_fixed_rows(pairs, taus, ("tau",)).where(F.col("iou") >= F.col("tau"))
    won = cut_lineage(matching.assign_one_to_one(eligible, [*GRID, "tau"]))
    on = [*GRID, "tau"]
    ref = with_fixed_rows(size_r, taus, ("tau",)).join(won.select(*on, "r", F.col("iou").alias("_iou")), [*on, "r"], "left").withColumn("ha", F.col("n_r") * pixel_ha)
    hit = F.col("_iou").isNotNull()
    rate = lambda cond: F.coalesce(share(F.when(cond, hit)), F.lit(0.0))
    cells = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    a = ref.groupBy("tau").agg(
        F.count(F.lit(1)).alias("n_reference"), F.count_if(hit).alias("n_matched"), F.coalesce(F.avg("_iou"), F.lit(0.0)).alias("mean_iou"),
        rate(F.col("ha") < small).alias("recall_small"), rate((F.col("ha") >= small) & (F.col("ha") < medium)).alias("recall_medium"), rate(F.col("ha") >= medium).alias("recall_large"),
        cells(hit, "n_r").alias("_m"), cells(~hit, "n_r").alias("_x"))
    alarm = with_fixed_rows(size_p, taus, ("tau",)).join(won.select(*on, "p", F.lit(True).alias("_hit")), [*on, "p"], "left")
    b = alarm.groupBy("tau").agg(F.count(F.lit(1)).alias("n_predicted"), cells(F.col("_hit").isNull(), "n_p").alias("_f"))
    j = a.join(b, "tau").join(exact_percentiles(won, ["tau"], "iou", {"median_iou": 0.5}), "tau", "left").fillna(0.0, ["median_iou"])
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    j = j.withColumns({"precision": ratio("n_matched", "n_predicted"), "recall": ratio("n_matched", "n_reference")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    ha = lambda c: round6(F.col(c) * pixel_ha)
    return j.select("tau", "n_predicted", "n_reference", "n_matched", round6("precision").alias("precision"), round6("recall").alias("recall"), round6(f1).alias("f1"),
                    *[round6(c).alias(c) for c in ("mean_iou", "median_iou", "recall_small", "recall_medium", "recall_large")],
                    ha("_m").alias("matched_ha"), ha("_x").alias("missed_ha"), ha("_f").alias("false_alarm_ha"))


@query("object_match")
def _(spark, sf):
    p, r = object_cells(spark, sf)
    pairs = cut_lineage(matching.overlap_pairs(p, r, GRID))
    size_p, size_r = p.groupBy(*GRID, "p").agg(F.count(F.lit(1)).alias("n_p")), r.groupBy(*GRID, "r").agg(F.count(F.lit(1)).alias("n_r"))
    return object_scores(pairs.select(*GRID, "p", "r", "iou"), size_p, size_r, (0.10, 0.30, 0.50))


# competing pairs: groups by reachability, then every set of pairs without a shared end, one pair a step
_MATCHED = OBJECTS + f""",
el AS MATERIALIZED (SELECT tile_id, epoch, p, r, iou, iou + {matching.TIE_STEP}::DOUBLE * ((p * 31 + r * 17) % 1009) AS w, count(*) OVER (PARTITION BY tile_id, epoch, p) AS dp, count(*) OVER (PARTITION BY tile_id, epoch, r) AS dr FROM pairs WHERE iou > 0.3),
ct AS MATERIALIZED (SELECT * FROM el WHERE dp > 1 OR dr > 1),
rea AS (SELECT tile_id, epoch, p AS a, p AS b FROM ct UNION SELECT q.tile_id, q.epoch, q.a, y.p FROM rea q JOIN ct x ON x.tile_id = q.tile_id AND x.epoch = q.epoch AND x.p = q.b JOIN ct y ON y.tile_id = x.tile_id AND y.epoch = x.epoch AND y.r = x.r),
gp AS (SELECT tile_id, epoch, a AS p, min(b) AS g FROM rea GROUP BY 1, 2, 3),
np AS MATERIALIZED (SELECT c.*, g, row_number() OVER (PARTITION BY c.tile_id, c.epoch, g ORDER BY c.p, c.r) AS i FROM ct c JOIN gp USING (tile_id, epoch, p)),
sets AS (SELECT DISTINCT tile_id, epoch, g, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS rs, 0.0::DOUBLE AS w FROM np
  UNION ALL SELECT s.tile_id, s.epoch, s.g, n.i, CASE WHEN k.take THEN list_append(ps, n.p) ELSE ps END, CASE WHEN k.take THEN list_append(rs, n.r) ELSE rs END, s.w + CASE WHEN k.take THEN n.w ELSE 0 END
  FROM sets s JOIN np n ON n.tile_id = s.tile_id AND n.epoch = s.epoch AND n.g = s.g AND n.i = s.i + 1, (VALUES (true), (false)) k(take) WHERE NOT k.take OR NOT (list_contains(ps, n.p) OR list_contains(rs, n.r))),
best AS (SELECT tile_id, epoch, g, arg_max(ps, (len(ps), w)) AS ps, arg_max(rs, (len(rs), w)) AS rs FROM sets s WHERE i = (SELECT max(i) FROM np n WHERE n.tile_id = s.tile_id AND n.epoch = s.epoch AND n.g = s.g) GROUP BY 1, 2, 3),
wn AS (SELECT tile_id, epoch, p, r, iou FROM el WHERE dp = 1 AND dr = 1 UNION ALL
  SELECT e.tile_id, e.epoch, e.p, e.r, e.iou FROM (SELECT tile_id, epoch, UNNEST(ps) AS p, UNNEST(rs) AS r FROM best) b JOIN el e USING (tile_id, epoch, p, r))"""


@query("object_match_strict", rsql(_MATCHED, f"SELECT tile_id, epoch, p, r, {r6('iou')} AS iou FROM wn"))
def _(spark, sf):
    p, r = object_cells(spark, sf)
    pairs = cut_lineage(matching.overlap_pairs(p, r, GRID).where("iou > 0.3"))
    return matching.assign_one_to_one(pairs, GRID).select(*GRID, "p", "r", round6("iou").alias("iou"))


@query("object_recall_union", rsql(OBJECTS + """,
un AS (SELECT r.tile_id, r.epoch, r.r, r.n_r, coalesce(sum(n_shared), 0) AS i, coalesce(sum(n_p), 0) AS np FROM rsz r LEFT JOIN pairs p ON p.tile_id = r.tile_id AND p.epoch = r.epoch AND p.r = r.r GROUP BY 1, 2, 3, 4)""",
    f"SELECT tile_id, count(*) AS n_reference, count(*) FILTER (WHERE i / (n_r + np - i)::DOUBLE >= 0.10) AS n_matched, {r6('avg((i / (n_r + np - i)::DOUBLE >= 0.10)::INT)')} AS object_recall FROM un GROUP BY 1"))
def _(spark, sf):
    p, r = object_cells(spark, sf)
    pairs = matching.overlap_pairs(p, r, GRID)
    touched = pairs.groupBy(*GRID, "r").agg(F.sum("n_shared").alias("i"), F.sum("n_p").alias("np"))
    ref = r.groupBy(*GRID, "r").agg(F.count(F.lit(1)).alias("n_r")).join(touched, [*GRID, "r"], "left").fillna(0, ["i", "np"])
    hit = F.col("i") / (F.col("n_r") + F.col("np") - F.col("i")) >= 0.10
    return ref.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_reference"), F.count_if(hit).alias("n_matched"), round6(share(hit)).alias("object_recall"))


# the test tables' detections fill four weeks: epoch 1996 is paired with the first five days, 1997 with the next, and so on
_EPOCH_DAYS = 5
_BY_EPOCH = ALARM_CELLS + s.FIRE + f""",
pt AS (SELECT *, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon FROM fp), ml AS (SELECT avg(lat) AS m FROM pt),
ae AS (SELECT *, CAST(split_part(alarm_id, '_', 2) AS INTEGER) AS epoch FROM ac),
wd AS (SELECT epoch, count(DISTINCT alarm_id) AS n_alarms, DATE '2024-01-01' + (epoch - 1996) * {_EPOCH_DAYS} AS d0 FROM ae GROUP BY 1),
pw AS (SELECT p.*, epoch FROM pt p JOIN wd ON CAST(acq_date AS DATE) BETWEEN d0 AND d0 + {_EPOCH_DAYS - 1}),
ds AS (SELECT p.seq, c.alarm_id, sqrt(pow((p.lon - c.lon) * (111320.0 * (SELECT cos(radians(m)) FROM ml)), 2) + pow((p.lat - c.lat) * 110750.0, 2)) AS d FROM pw p JOIN ae c ON p.epoch = c.epoch AND abs(p.lon - c.lon) < 0.011 AND abs(p.lat - c.lat) < 0.011),
nd AS (SELECT seq, min(d) AS d, arg_min(alarm_id, (round(d, 4), alarm_id)) AS alarm_id FROM ds WHERE d <= 1000.0 GROUP BY 1),
rd(r) AS (VALUES (375.0::DOUBLE), (500.0::DOUBLE), (1000.0::DOUBLE))"""


def epoch_windows(cells):
    """First and last day of each epoch that has alarms."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("epoch") - 1996) * _EPOCH_DAYS)
    return cells.select("epoch").distinct().withColumns({"from_day": start, "to_day": F.date_add(start, _EPOCH_DAYS - 1)})


@query("fire_corroboration", rsql(_BY_EPOCH + """,
fc AS (SELECT r AS radius_m, (SELECT sum(n_alarms) FROM wd)::BIGINT AS n_alarms, count(p.seq) AS n_points, count(*) FILTER (WHERE d <= r) AS h, count(DISTINCT CASE WHEN d <= r THEN alarm_id END) AS a,
  coalesce(avg((coalesce(d <= r, false))::INT) FILTER (WHERE frp >= 5), 0.0) AS f FROM rd CROSS JOIN pw p LEFT JOIN nd USING (seq) GROUP BY 1)""",
    f"SELECT radius_m, n_points, n_alarms, h AS recovered_points, a AS corroborated_alarms, {r6('h / n_points::DOUBLE')} AS recovery_rate, {r6('CASE WHEN n_alarms > 0 THEN a / n_alarms::DOUBLE ELSE 0 END')} AS corroboration_rate, {r6('f')} AS high_frp_recovery FROM fc"))
def _(spark, sf):
    cells = cut_lineage(alarm_cells(spark, sf))
    c = fire.corroboration_over_epochs(fire.parse_points(tables.fire_points(spark, sf)), cells, epoch_windows(cells))
    return c.select("radius_m", "n_points", "n_alarms", "recovered_points", "corroborated_alarms",
                    *[round6(x).alias(x) for x in ("recovery_rate", "corroboration_rate", "high_frp_recovery")])


@query("fire_corroboration_by_epoch", rsql(_BY_EPOCH + f""",
fc AS (SELECT w.epoch, r AS radius_m, n_alarms, count(p.seq) AS n_points, count(*) FILTER (WHERE d <= r) AS h, count(DISTINCT CASE WHEN d <= r THEN alarm_id END) AS a, coalesce(avg((coalesce(d <= r, false))::INT) FILTER (WHERE frp >= 5), 0.0) AS f
  FROM wd w CROSS JOIN rd LEFT JOIN pw p ON p.epoch = w.epoch LEFT JOIN nd USING (seq) GROUP BY 1, 2, 3)""",
    f"SELECT epoch, radius_m, n_points, n_alarms, h AS recovered_points, a AS corroborated_alarms, {r6('CASE WHEN n_points > 0 THEN h / n_points::DOUBLE ELSE 0 END')} AS recovery_rate, {r6('a / n_alarms::DOUBLE')} AS corroboration_rate, {r6('f')} AS high_frp_recovery FROM fc"))
def _(spark, sf):
    cells = cut_lineage(alarm_cells(spark, sf))
    c = fire.corroboration_by_epoch(fire.parse_points(tables.fire_points(spark, sf)), cells, epoch_windows(cells))
    return c.select("epoch", "radius_m", "n_points", "n_alarms", "recovered_points", "corroborated_alarms",
                    *[round6(x).alias(x) for x in ("recovery_rate", "corroboration_rate", "high_frp_recovery")])


@query("fire_lag_recovery", rsql(LOCATED + """,
lb(lag_from, lag_to) AS (VALUES (0, 30), (31, 90), (91, 180), (181, 365)),
lg AS (SELECT *, date_diff('day', DATE '2023-12-12', CAST(acq_date AS DATE)) AS d FROM loc)""",
    f"SELECT lag_from, lag_to, count(d) AS n_points, {r6('coalesce(avg((coalesce(dist_m <= 375, false))::INT) FILTER (WHERE d IS NOT NULL), 0.0)')} AS recovery_rate FROM lb LEFT JOIN lg ON d BETWEEN lag_from AND lag_to GROUP BY 1, 2"))
def _(spark, sf):
    located, _cells = located_points(spark, sf)
    lag = located.withColumn("lag_days", F.datediff(F.to_date("acq_date"), F.lit("2023-12-12")))
    return fire.lag_recovery(lag, "lag_days").select("lag_from", "lag_to", "n_points", round6("recovery_rate").alias("recovery_rate"))


def compare(df, observed, expected, keys, tolerance):
    e = F.col(observed) - F.col(expected)
    both = df.where(F.col(observed).isNotNull() & F.col(expected).isNotNull())
    g = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid_pixels"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_abs"),
                                F.when((F.stddev_pop(observed) > 0) & (F.stddev_pop(expected) > 0), F.corr(observed, expected)).alias("correlation"))
    return g.withColumn("passed", F.col("rmse") <= tolerance)


@query("raster_compare", s.sql(s.PIX, f"SELECT tile_id, epoch, count(*) AS valid_pixels, {r6('sqrt(avg((red - nir) * (red - nir)))')} AS rmse, {r6('avg(abs(red - nir))')} AS mae, {r6('max(abs(red - nir))')} AS max_abs, {r6('corr(red, nir)')} AS correlation, "
       "sqrt(avg((red - nir) * (red - nir))) <= 0.03 AS passed FROM pix GROUP BY 1, 2"))
def _(spark, sf):
    c = compare(tables.pixels(spark, sf), "red", "nir", GRID, 0.03)
    return c.select(*GRID, "valid_pixels", *[round6(x).alias(x) for x in ("rmse", "mae", "max_abs", "correlation")], "passed")


@query("change_reconstruction", s.sql(s.DELTA + f", ch AS (SELECT tile_id, epoch, (index_e - index_b) - {r6('delta')} AS e FROM delta WHERE delta IS NOT NULL)",
    f"SELECT tile_id, epoch, count(*) AS valid_pixels, {r6('max(abs(e))')} AS max_abs, max(abs(e)) <= 1e-6 AS passed FROM ch GROUP BY 1, 2"))
def _(spark, sf):
    d = tables.index_delta(tables.pixels(spark, sf)).withColumn("archived", round6("delta"))
    e = (F.col("index_e") - F.col("index_b")) - F.col("archived")
    g = d.where("delta IS NOT NULL").groupBy(*GRID).agg(F.count(F.lit(1)).alias("valid_pixels"), F.max(F.abs(e)).alias("m"))
    return g.select(*GRID, "valid_pixels", round6("m").alias("max_abs"), (F.col("m") <= 1e-6).alias("passed"))


@query("sign_agreement", s.sql(s.PIX + """, sg AS (SELECT e.tile_id, e.epoch, e.red - b.red AS o, e.nir - b.nir AS r FROM pix e JOIN pix b ON e.tile_id = b.tile_id AND e.row = b.row AND e.col = b.col AND e.epoch = b.epoch + 1)""",
    f"SELECT tile_id, epoch, count(*) AS valid_pixels, {r6('avg((sign(o) = sign(r))::INT)')} AS agreement, {r6('avg((abs(o - r) <= 0.02)::INT)')} AS within_tolerance, {r6('avg((o > 0)::INT)')} AS observed_positive, {r6('avg((r > 0)::INT)')} AS reference_positive FROM sg GROUP BY 1, 2"))
def _(spark, sf):
    p = tables.before_after(tables.pixels(spark, sf), ["red", "nir"])
    o, r = F.col("red_e") - F.col("red_b"), F.col("nir_e") - F.col("nir_b")
    return p.groupBy(*GRID).agg(F.count(F.lit(1)).alias("valid_pixels"), round6(share(F.signum(o) == F.signum(r))).alias("agreement"), round6(share(F.abs(o - r) <= 0.02)).alias("within_tolerance"),
                                round6(share(o > 0)).alias("observed_positive"), round6(share(r > 0)).alias("reference_positive"))


@query("evidence_tier", s.sql(s.PIX + """, et AS (SELECT tile_id, epoch, count(*) > 240 AS real, avg(swir) > 0.4 AS rep, avg(reference::INT) > 0.18 AS ind, tile_id % 2 = 0 AS e2e FROM pix GROUP BY tile_id, epoch)""",
    """SELECT tile_id, epoch, CASE WHEN e2e AND real AND rep AND ind THEN 'END_TO_END_VALIDATED' WHEN ind AND real AND rep THEN 'INDEPENDENT_REFERENCE_VALIDATED' WHEN real AND rep THEN 'REAL_DATA_VALIDATED'
  WHEN rep THEN 'INTERNAL_REPRODUCIBILITY' ELSE 'NOT_VALIDATED' END AS status FROM et"""))
def _(spark, sf):
    g = tables.pixels(spark, sf).groupBy(*GRID).agg((F.count(F.lit(1)) > 240).alias("a"), (F.avg("swir") > 0.4).alias("b"), (share("reference") > 0.18).alias("c"))
    return g.select(*GRID, M.evidence_tier("a", "b", "c", F.col("tile_id") % 2 == 0).alias("status"))


@query("gate_balanced_accuracy", s.sql(_V + f", cm AS (SELECT tile_id, {count_sql('score >= 0.3', 'reference')} FROM sp GROUP BY 1)", f"SELECT tile_id, {metrics_sql(('balanced_accuracy',))}, CASE WHEN {METRIC_SQL['balanced_accuracy']} >= 0.60 THEN 'candidate' ELSE 'rejected' END AS gate FROM cm"))
def _(spark, sf):
    g = _scored(spark, sf).groupBy("tile_id").agg(*M.counts(F.col("score") >= 0.3, "reference"))
    ba = M.scores()["balanced_accuracy"]
    return g.select("tile_id", round6(ba).alias("balanced_accuracy"), M.accuracy_gate(ba).alias("gate"))
