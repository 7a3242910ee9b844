"""Small inputs with known results."""

from pyspark.sql import functions as F

from landpulse.functions import drought, flood, indices, metrics
from landpulse.streaming import transitions as t


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_normalized_difference_is_null_without_signal(spark):
    df = spark.createDataFrame([(0.4, 0.2), (0.0, 0.0), (None, 0.2)], "a double, b double")
    got = [r[0] for r in df.select(indices.normalized_difference("a", "b")).collect()]
    assert abs(got[0] - 1 / 3) < 1e-12 and got[1] is None and got[2] is None


def test_bounded_index_is_zero_without_signal_and_null_without_data(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 0.2), (2.0, -1.0)], "a double, b double")
    assert [r[0] for r in df.select(indices.ndvi("a", "b")).collect()] == [0.0, None, 1.0]


def test_sar_evidence_separates_flooded_from_dry(spark):
    df = spark.createDataFrame([(0.10, 0.008, 0.02, 0.0015), (0.10, 0.11, 0.02, 0.021), (0.1, 0.0, 0.02, 0.02)],
                               "vb double, ve double, hb double, he double")
    rows = df.select(flood.sar_water("vb", "ve", "hb", "he").alias("s"), flood.sar_valid("vb", "ve", "hb", "he").alias("ok")).collect()
    assert rows[0]["s"] > 0.70 and rows[1]["s"] < 0.30
    assert rows[2]["s"] == 0.0 and not rows[2]["ok"]


def test_cloudy_pixel_is_invalid_not_dry(spark):
    df = spark.createDataFrame([(0.30, 0.05, 0.02, 6), (0.30, 0.05, 0.02, 9)], "g double, n double, s double, scl int")
    rows = df.select(flood.optical_water("g", "n", "s", "scl").alias("v"), flood.optical_valid("g", "n", "s", "scl").alias("ok")).collect()
    assert rows[0]["v"] > 0.70 and rows[0]["ok"] and not rows[1]["ok"]


def test_novelty_terrain_and_rain_limits(spark):
    df = one(spark, score=0.9, freq=0.95, steep=25.0, mm=5.0)
    assert value(df, flood.water_novelty("score", "freq")) == 0.0
    assert value(df, flood.terrain_plausibility("steep")) == 0.0
    assert value(df, flood.rainfall_context("mm", F.lit(0.0), F.lit(12.0))) <= 0.10


def test_absent_gate_is_neutral(spark):
    df = one(spark, sar=0.8)
    fused = flood.fuse_gated("sar", F.lit(True), F.lit(0.0), F.lit(False), F.lit(None).cast("double"), None, None)
    assert value(df, fused) == 0.8


def test_observability_of_steep_ground_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (25.0,)], "slope double")
    o = flood.observability(F.lit(True), "slope", F.lit(0.0), F.lit(50.0), F.lit(0.0), F.lit(1.0))
    flat, steep = [r[0] for r in df.select(o).collect()]
    assert flat >= 0.70 and steep == 0.0


def test_missing_evidence_is_never_no_drought(spark):
    df = one(spark, s=0.1)
    none = F.lit(None).cast("double")
    assert value(df, drought.tristate(none, none, none, none, F.lit(0.9), F.lit(0.0))) == "UNRESOLVED"
    assert value(df, drought.tristate(F.lit(0.1), F.lit(0.1), F.lit(0.1), none, F.lit(0.9), F.lit(0.0))) == "NO_DROUGHT"
    assert value(df, drought.tristate(F.lit(0.9), F.lit(0.9), F.lit(0.9), F.lit(0.9), F.lit(0.9), F.lit(0.85))) == "UNRESOLVED"
    assert value(df, drought.inference_state(none, F.lit(0.9), F.lit(0.0))) == "UNRESOLVED"


def test_scores_of_empty_counts_are_zero(spark):
    df = one(spark, tp=0, fp=0, fn=0, tn=0)
    row = df.select(*[c.alias(n) for n, c in metrics.scores().items()]).first().asDict()
    assert set(row.values()) == {0.0}


LIFE = [([0.1, 0.6, 0.7, 0.75, 0.85, 0.90, 0.4, 0.3, 0.2, 0.1], [True] * 10,
         ["NORMAL", "WATCH", "EMERGING", "EMERGING", "ACTIVE", "PEAK", "RECOVERY", "RECOVERY", "RESOLVED", "NORMAL"]),
        ([0.1, 0.8, 0.85, 0.0, 0.0], [True, True, True, False, False], ["NORMAL", "WATCH", "EMERGING", "EMERGING", "EMERGING"])]


def test_lifecycle_sequences_batch_and_step(spark):
    rows = [(k, i, s, r) for k, (sev, res, _) in enumerate(LIFE) for i, (s, r) in enumerate(zip(sev, res))]
    df = spark.createDataFrame(rows, "unit int, epoch int, severity double, resolvable boolean")
    out = t.lifecycle_fold(df, ["unit"], "epoch", "severity", "resolvable").orderBy("unit", "epoch").collect()
    for k, (sev, res, want) in enumerate(LIFE):
        assert [r["state"] for r in out if r["unit"] == k] == want
        state, seen = dict(t.LIFECYCLE_START), []
        for s, r in zip(sev, res):
            state = t.lifecycle_step(state, s, r)
            seen.append(state["state"])
        assert seen == want


def test_drought_alert_timeline(spark):
    rows = [(201, 1.0, 0.48, False), (201, 2.0, 0.48, False), (201, 5.0, 0.50, False), (201, 8.0, 0.68, False), (201, 10.0, 0.68, False),
            (201, 12.0, 0.68, True), (201, 23.0, 0.68, False), (201, 25.0, 0.48, False)]
    df = spark.createDataFrame(rows, "event bigint, day double, severity double, blackout boolean")
    got = t.drought_alerts(df, ["event"], "day", "severity", "blackout").orderBy("day").collect()
    assert [r["action"] for r in got] == ["NEW_ALERT", "DUPLICATE_SUPPRESSED", "DUPLICATE_SUPPRESSED", "SEVERITY_ESCALATION", "DUPLICATE_SUPPRESSED",
                                          "DATA_BLACKOUT_HOLD", "ALERT_UPDATE", "SEVERITY_DEESCALATION"]
    assert got[3]["tier"] == "SEVERE" and got[0]["tier"] == "MODERATE"
    state, seen = None, []
    for _, day, severity, blackout in rows:
        state, action, _tier = t.drought_step(state, day, severity, blackout)
        seen.append(action)
    assert seen == [r["action"] for r in got]


def test_flood_alert_lifecycle(spark):
    rows = [("aoi", "2022-08-27", 0, 15.0, "a", "completed"), ("aoi", "2022-08-27", 1, 15.0, "a", "completed"), ("aoi", "2022-09-08", 0, 125.0, "b", "completed"),
            ("aoi", "2022-09-10", 0, None, None, "cannot_evaluate"), ("aoi", "2022-09-15", 0, 45.0, "c", "completed"), ("aoi", "2022-10-25", 0, 0.0, "d", "completed")]
    df = spark.createDataFrame(rows, "aoi string, day string, seq bigint, ha double, hash string, status string").withColumn("day", F.to_date("day"))
    got = t.flood_alerts(df).orderBy("day", "seq").collect()
    assert [r["transition"] for r in got] == ["NEW_ALERT", "DUPLICATE_SUPPRESSED", "SEVERITY_ESCALATION", "DATA_BLACKOUT_HOLD", "SEVERITY_DEESCALATION", "EVENT_RESOLVED"]
    assert [r["severity"] for r in got] == ["WARNING", "WARNING", "CRITICAL", "CRITICAL", "WARNING", "RESOLVED"]
    assert [r["dispatch"] for r in got] == [True, False, True, False, True, True]
    assert got[3]["area_ha"] == 125.0
