"""Classifier and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landpulse.functions import indices
from landpulse.functions.core import round6
from landpulse.operators import jobs, learning
from landpulse.plans import sqlbase as s
from landpulse.plans.expressions import _flood, scored_flood
from landpulse.plans.registry import query
from landpulse.plans.sqlbase import r6
from landpulse.session import cut_lineage
from landpulse.sources import tables
from landpulse.sources.tables import CELL

FEATURES = ["index", "swir", "red", "green", "blue", "slope"]


def samples(spark, sf):
    """Pixel features with class 1 (dry), 2 (moist) or 3 (reference disturbance)."""
    px = tables.pixels(spark, sf).withColumn("index", indices.normalized_difference("nir", "red"))
    label = F.when(F.col("reference"), 3).when(F.col("swir") > 0.5, 2).otherwise(1)
    return px.select(*CELL, *FEATURES, label.alias("label"))


def key():
    return F.concat_ws("|", *[F.col(c).cast("string") for c in CELL])


TRAINING_ROWS_PER_CLASS = 10_000  # training takes a bounded sample of labelled rows per class
QUERY_DEPTH = 10  # of the forests in the queries; the operator grows to 30 by default


def split_samples(spark, sf):
    rows = learning.labelled_rows(samples(spark, sf), FEATURES, "label")
    capped = jobs.cap_per_class(rows, "label", TRAINING_ROWS_PER_CLASS, F.md5(F.concat_ws("|", key(), F.lit("42"))))
    return cut_lineage(learning.stratified_split(capped, "label", key()))


@query("train_rf")
def _(spark, sf):
    rows = split_samples(spark, sf)
    model = learning.train_forest(rows.where("NOT is_test"), FEATURES, "label", depth=QUERY_DEPTH)
    scored = learning.predict(model, rows.where("is_test"), FEATURES)
    return learning.classification_report(scored, [], "label", "predicted")


@query("infer_rf")
def _(spark, sf):
    model = learning.train_forest(split_samples(spark, sf).where("NOT is_test"), FEATURES, "label", depth=QUERY_DEPTH)
    scored = learning.predict(model, samples(spark, sf), FEATURES)
    return scored.select(*CELL, "predicted", round6("confidence").alias("confidence"))


@query("spatial_block_split", s.sql(s.PIX + f""",
bk AS (SELECT tile_id, row // 4 AS br, col // 4 AS bc, md5(concat_ws('|', tile_id, row // 4, col // 4, '42')) AS h FROM pix GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (ORDER BY h) <= greatest(1, round(count(*) OVER () * 0.2)) AS is_test FROM bk)""",
    "SELECT p.tile_id, p.row // 4 AS br, p.col // 4 AS bc, any_value(is_test) AS is_test, count(*) AS n FROM pix p JOIN rk ON rk.tile_id = p.tile_id AND rk.br = p.row // 4 AND rk.bc = p.col // 4 GROUP BY 1, 2, 3"))
def _(spark, sf):
    px = tables.pixels(spark, sf).withColumns({"br": F.floor(F.col("row") / 4).cast("int"), "bc": F.floor(F.col("col") / 4).cast("int")})
    split = jobs.split_blocks(px, ["tile_id", "br", "bc"], 0.2, 42)
    return split.groupBy("tile_id", "br", "bc").agg(F.first("is_test").alias("is_test"), F.count(F.lit(1)).alias("n"))


@query("classification_report", s.sql(s.PIX + """,
cr AS (SELECT epoch, scl % 3 AS t, (scl + CASE WHEN swir > 0.6 THEN 1 ELSE 0 END) % 3 AS p FROM pix),
cs AS (SELECT epoch, c.i AS cls, count(*) FILTER (WHERE t = c.i) AS sup, count(*) FILTER (WHERE p = c.i) AS shown, count(*) FILTER (WHERE t = c.i AND p = c.i) AS hit FROM cr, range(3) c(i) GROUP BY 1, 2),
cp AS (SELECT *, CASE WHEN shown > 0 THEN hit / shown::DOUBLE ELSE 0.0 END AS pr, CASE WHEN sup > 0 THEN hit / sup::DOUBLE ELSE 0.0 END AS rc FROM cs),
cf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2.0 * pr * rc / (pr + rc) ELSE 0.0 END AS f FROM cp)""",
    f"SELECT epoch, sum(sup)::BIGINT AS n, {r6('sum(hit) / sum(sup)')} AS accuracy, {r6('avg(rc)')} AS balanced_accuracy, {r6('avg(f)')} AS macro_f1, {r6('sum(f * sup) / sum(sup)')} AS weighted_f1, {r6('avg(pr)')} AS macro_precision FROM cf GROUP BY 1"))
def _(spark, sf):
    px = tables.pixels(spark, sf).select("epoch", (F.col("scl") % 3).alias("t"), ((F.col("scl") + F.when(F.col("swir") > 0.6, 1).otherwise(0)) % 3).alias("p"))
    return learning.classification_report(px, ["epoch"], "t", "p")


@query("temporal_holdout")
def _(spark, sf):
    rows = cut_lineage(learning.labelled_rows(samples(spark, sf), FEATURES, "label"))
    model = learning.train_forest(rows.where("epoch <= 1998"), FEATURES, "label", depth=QUERY_DEPTH)
    later = learning.predict(model, rows.where("epoch > 1998"), FEATURES)
    return learning.classification_report(later, ["epoch"], "label", "predicted")


@query("isotonic_calibration")
def _(spark, sf):
    d = cut_lineage(scored_flood(_flood(spark, sf)).where("valid").select("epoch", "score", F.col("reference").cast("double").alias("y")))
    model = learning.isotonic_fit(d.where("epoch <= 1998"), "score", F.col("y"))
    out = learning.isotonic_apply(model, d.where("epoch > 1998"), "score")
    err = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    return out.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), round6(err("score")).alias("brier_raw"), round6(err("calibrated")).alias("brier_calibrated"),
                                    round6(F.avg("calibrated")).alias("mean_calibrated"))
