import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpulse.operators import metrics, replicates


def test_poisson_weights_have_mean_and_variance_one():
    units = np.random.default_rng(1).integers(0, 1 << 32, 4000)
    w = replicates.poisson_weights(units, 200)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and w.max() >= 8
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25
    for k in range(4):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)


def test_replicate_sums_equal_weighted_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(f"b{i % 37}", int(g), int(lv), float(v), None if i % 11 == 0 else float(v * 2)) for i, (g, lv, v) in
            enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 5, 900), rng.integers(0, 50, 900)))]
    df = spark.createDataFrame(rows, "block string, bin int, level int, a double, b double").repartition(5)
    got = {(r["bin"], r["level"]): (r["a"], r["b"]) for r in replicates.replicate_sums(df, [F.col("block")], ["bin", "level"], ["a", "b"], 40).collect()}
    names = spark.createDataFrame([(f"b{i}",) for i in range(37)], "block string").select("block", replicates.unit_number([F.col("block")], 42).alias("u")).collect()
    weight = {r["block"]: replicates.poisson_weights(np.array([r["u"]]), 40)[0] for r in names}
    for key in {r[1:3] for r in rows}:
        own = [r for r in rows if r[1:3] == key]
        assert np.allclose(got[key][0], sum(weight[r[0]] * r[3] for r in own))
        assert np.allclose(got[key][1], sum(weight[r[0]] * (r[4] or 0.0) for r in own))


def test_curve_measures_by_hand():
    level, pos, neg = np.array([10, 50, 70, 90]), np.array([[0], [1], [0], [3.0]]), np.array([[5.0], [1], [0], [0]])
    found = replicates.curve_measures(20)({"level": level, "pos": pos, "neg": neg})
    assert found["precision"][0] == 0.8 and found["recall"][0] == 1.0 and found["f1"][0] == pytest.approx(8 / 9)
    assert found["pr_auc"][0] == pytest.approx(0.75 * 1.0 + 0.25 * (0.8 + 1.0) / 2)
    nothing = replicates.curve_measures(20)({"level": level, "pos": 0 * pos, "neg": neg})
    assert nothing["pr_auc"][0] == nothing["recall"][0] == 0.0


def test_block_bootstrap_brackets_the_estimate(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 60), int(i % 2), float(s), bool(rng.random() < s)) for i, s in enumerate(rng.random(6000))]
    df = spark.createDataFrame(rows, "block int, bin int, score double, reference boolean")
    out = {r["bin"]: r for r in metrics.block_bootstrap(df, F.col("block"), "bin", "score", "reference", 0.2, replicates=300).collect()}
    for b in (0, 1):
        own = [(s, y) for _, k, s, y in rows if k == b]
        precision = np.mean([y for s, y in own if s >= 0.2])
        order = sorted(own, reverse=True)
        hits = np.cumsum([y for _, y in order])
        area = sum(h / (i + 1) for i, (h, (_, y)) in enumerate(zip(hits, order)) if y) / hits[-1]
        assert out[b]["precision_low"] < precision < out[b]["precision_high"]
        assert out[b]["pr_auc_low"] < area < out[b]["pr_auc_high"] and out[b]["pr_auc_high"] - out[b]["pr_auc_low"] < 0.15
    assert metrics.block_bootstrap(df.where("bin = 9"), F.col("block"), "bin", "score", "reference", 0.2).count() == 0


def test_plan_holds_no_row_per_replicate(spark):
    df = spark.range(64).select(F.col("id").alias("block"), F.lit(0).alias("bin"), (F.col("id") / 64).alias("score"), (F.col("id") % 2 == 0).alias("reference"))
    out = metrics.block_bootstrap(df, F.col("block"), "bin", "score", "reference", 0.2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sequence(1, 1000" not in plan and "Generate" not in plan
    one = metrics.bootstrap_correlation(df.withColumn("y", F.col("score") * 2), "block", "score", "y").first()
    assert one["low"] == pytest.approx(1.0) and one["n_replicates"] == 1000
