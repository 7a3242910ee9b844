import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from landpulse.operators import learning

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 2)).round(2).tolist()
    return spark.createDataFrame([(i, a, b, 3 if a + b > 1.2 else 1 if a > b else 2) for i, (a, b) in enumerate(x)], "id int, a double, b double, label int")


def test_forest_in_passes_votes_like_the_library(spark, rows, monkeypatch):
    monkeypatch.setattr(learning, "STATE_BYTES", 400 * learning.STATE_PER_TREE * 10)
    model = learning.train_forest(rows, NAMES, "label", trees=25, depth=5)
    assert [p.getNumTrees for p in model.parts] == [10, 10, 5]
    plain = VectorAssembler(inputCols=NAMES, outputCol="_features").transform(rows)
    raw = sum(np.array([r["raw"].toArray() for r in p.setRawPredictionCol("raw").transform(plain).orderBy("id").collect()]) for p in model.parts)
    share = (raw / raw.sum(axis=1, keepdims=True))[:, :3]
    got = learning.predict(model, rows, NAMES).orderBy("id").collect()
    assert [r["predicted"] for r in got] == [int(model.labels[i]) for i in share.argmax(axis=1)]
    assert np.allclose([r["confidence"] for r in got], share.max(axis=1), atol=1e-12)


def test_rows_are_scored_in_blocks_not_one_by_one(spark, rows):
    model = learning.train_forest(rows, NAMES, "label", trees=3, depth=3)
    odd = spark.createDataFrame([(1, None, 0.5, "x"), (2, float("nan"), 0.5, "y"), (3, 0.9, 0.9, None)], "id int, a double, b double, note string")
    out = learning.predict(model, odd, NAMES)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert out.columns == ["id", "a", "b", "note", "predicted", "confidence"]
    assert got[1]["predicted"] is None and got[2]["confidence"] is None and got[1]["note"] == "x" and got[3]["predicted"] == 3
