import random

from pyspark.sql import functions as F

from landpulse.functions import metrics as M
from landpulse.operators import metrics, ordered


def scored(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 9 else f"g{i % 5}", rng.choice([None, 0.2, round(rng.random(), 3)]), rng.choice([True, False, None])) for i in range(6000)]
    return spark.createDataFrame(rows, "g string, s double, y boolean")


def test_counts_come_with_the_areas(spark):
    df = scored(spark)
    want = {r["g"]: r for r in df.where("s IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), *M.counts(F.col("s") >= 0.2, "y"), F.avg(F.pow(F.col("s") - F.col("y").cast("double"), 2)).alias("brier")).collect()}
    plain = {r["g"]: r for r in metrics.curve_areas(df, ["g"], "s", "y").collect()}
    got = metrics.curve_areas(df, ["g"], "s", "y", 0.2).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["g"]]
        assert all(r[c] == w[c] for c in ("tp", "fp", "fn", "tn")) and r["n_pixels"] == w["n"] and abs(r["brier"] - w["brier"]) < 1e-9
        assert r["pr_auc"] == plain[r["g"]]["pr_auc"]


def test_ranges_number_the_values_of_every_group(spark):
    df = scored(spark).where("s IS NOT NULL")
    out = ordered.ranked_counts(df, ["g"], "s", descending=True)
    assert "percentile_approx" not in out._jdf.queryExecution().toString()
    got = {(r["g"], r["s"]): (r["n"], r["cum_n"], r["all_n"]) for r in out.collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r["g"], []).append(r["s"])
    for (g, s), (n, cum, whole) in got.items():
        assert (n, cum, whole) == (values[g].count(s), sum(v >= s for v in values[g]), len(values[g]))
