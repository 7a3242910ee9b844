import numpy as np
import pytest
from pyspark.sql import functions as F

from landpulse.operators import forests, learning

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def many(spark):
    """60,000 rows, whose label depends on two of three features."""
    u = lambda seed: F.round(F.rand(seed), 3)
    df = spark.range(60_000, numPartitions=3).select(F.col("id"), u(1).alias("a"), u(2).alias("b"), u(3).alias("c"))
    return df.withColumn("label", F.when(F.col("a") + F.col("b") > 1.2, 3).when(F.col("a") > F.col("b"), 10).otherwise(2)).cache()


def coded_rows(n, n_features, seed=7):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, forests.BINS, (n_features, n))
    label = np.where(rng.random(n) < 0.2, 2, (codes[0] + codes[-1] > 30).astype(int))
    layout = forests.Layout(n_features, 3)
    return layout, codes, label, layout.coded(codes, label)


def grown(layout, rows, depth=6, seed=3):
    space = [forests._space(layout.words, rows.shape[1]) for _ in range(2)]
    return forests.grow(rows, space, layout, np.array([1.0, 0.5, 2.0]), depth, np.random.Generator(np.random.SFC64(seed)))


def gain(stats):
    gini = lambda s: 1 - (s / s.sum()) @ (s / s.sum())
    left, right = stats
    both = left + right
    return gini(both) - left.sum() / both.sum() * gini(left) - right.sum() / both.sum() * gini(right)


@pytest.mark.parametrize("n_features", [6, 15])  # in one number and in two
def test_splits_are_the_best_of_the_tried_features(monkeypatch, n_features):
    copies = np.random.default_rng(1).integers(0, 4, 6000)
    monkeypatch.setattr(forests, "CHUNK", 10_000)
    monkeypatch.setattr(forests, "SMALL", 700)
    monkeypatch.setattr(forests, "_drawn", lambda rng, n, *_: copies.astype(np.uint8))
    layout, codes, label, rows = coded_rows(6000, n_features)
    assert layout.words == (1 if n_features == 6 else 2)
    feature, cut, first, stats = grown(layout, rows)
    tried, weights = int(np.ceil(np.sqrt(n_features))), np.array([1.0, 0.5, 2.0])
    bag = lambda at: np.bincount(label[at], weights=copies[at], minlength=3)
    todo, seen = [(0, np.arange(6000))], 0
    while todo:
        node, at = todo.pop()
        assert stats[node][:3].tolist() == bag(at).tolist()
        if first[node] < 0:
            continue
        best = []
        for f in range(n_features):
            sides = [np.array([bag(at[codes[f, at] <= c]), bag(at[codes[f, at] > c])]) for c in range(forests.BINS - 1)]
            best.append(max((gain(s * weights) for s in sides if s.sum(axis=1).all()), default=-1.0))
        left = codes[feature[node], at] <= cut[node]
        own = gain(np.array([bag(at[left]), bag(at[~left])]) * weights)
        assert own == pytest.approx(best[feature[node]]) and sum(g <= own + 1e-9 for g in best) >= tried
        todo += [(first[node], at[left]), (first[node] + 1, at[~left])]
        seen += 1
    assert seen > 20


def test_trees_do_not_depend_on_how_nodes_are_handled(monkeypatch):
    layout, _, _, rows = coded_rows(20_000, 6)
    plain = grown(layout, rows, 9)
    for settings in ({"SMALL": 1}, {"SMALL": 1 << 30}, {"SMALL": 1 << 30, "TOGETHER": 3}, {"SMALL": 300, "FULL": 0}, {"SMALL": 300}, {"HELD_ROWS": 0}):
        with monkeypatch.context() as patch:
            for name, value in settings.items():
                patch.setattr(forests, name, value)
            assert all(np.array_equal(x, y) for x, y in zip(plain, grown(layout, rows, 9)))


def test_rows_of_one_class_are_a_leaf():
    layout, codes, label, _ = coded_rows(500, 6)
    feature, cut, first, stats = grown(layout, layout.coded(codes, np.ones_like(label)))
    assert first.tolist() == [-1] and stats[0, 1] == stats.sum() > 0


def test_bags_are_poisson():
    drawn = forests._drawn(np.random.Generator(np.random.SFC64(1)), 1_000_000, *forests._copies())
    share = np.bincount(drawn, minlength=5)[:5] / len(drawn)
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6, 24]), atol=0.002)


def test_rows_are_ordered_by_themselves():
    for n_features in (6, 15):
        layout, _, _, rows = coded_rows(3000, n_features)
        one, other = rows.copy(), rows[:, ::-1].copy()
        forests._order(one), forests._order(other)
        assert np.array_equal(one, other) and sorted(zip(*one.tolist())) == sorted(zip(*rows.tolist()))


def test_cut_points_of_sketches():
    values = np.random.default_rng(2).random(100_000)
    cuts = forests.cut_points(*forests._sketched(values))
    assert len(cuts) == 31 and np.allclose(cuts, np.arange(1, 32) / 32, atol=0.01)
    assert forests.cut_points(np.array([1.0, 2.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.5, 3.0]
    assert len(forests.cut_points(np.array([1.0, 1.0]), np.ones(2))) == 0


def test_many_rows_are_not_trained_by_the_library(many, monkeypatch):
    monkeypatch.setattr(learning, "RandomForestClassifier", None)
    model = learning.train_forest(many, NAMES, "label", trees=9, depth=8)
    assert model.labels == ["10", "2", "3"] and [len(p) for p in model.parts] == [9]
    got = learning.predict(model, many, NAMES)
    assert got.where("predicted = label").count() > 0.97 * 60_000 and got.where("confidence < 0.33 OR confidence > 1").count() == 0
    again = learning.train_forest(many.orderBy(F.desc("c")).repartition(7), NAMES, "label", trees=9, depth=8)
    assert all(np.array_equal(x, y) for one, other in zip(model.parts[0], again.parts[0]) for x, y in zip(one, other))


def test_votes_agree_with_the_library(many, monkeypatch):
    model = learning.train_forest(many, NAMES, "label", trees=20, depth=5)
    monkeypatch.setattr(learning, "LIBRARY_ROWS", 100_000)
    library = learning.train_forest(many, NAMES, "label", trees=20, depth=5)
    mine, theirs = (learning.predict(m, many.where("id < 5000"), NAMES).orderBy("id").toPandas() for m in (model, library))
    assert (mine.predicted == theirs.predicted).mean() > 0.95 and abs(mine.confidence - theirs.confidence).mean() < 0.05


def test_rows_without_label_or_feature(many):
    no_label = many.withColumn("label", F.when(F.col("id") >= 100, F.col("label")))
    model = learning.train_forest(no_label, NAMES, "label", trees=2, depth=3)
    assert model.labels == ["10", "2", "3"]
    with pytest.raises(Exception, match="must be present"):
        learning.train_forest(many.withColumn("b", F.when(F.col("id") != 7, F.col("b"))), NAMES, "label", trees=2, depth=3)


def test_walk_over_several_numbers():
    layout, _, _, rows = coded_rows(4000, 15)
    cuts, weights = [np.arange(31) + 0.5] * 15, np.array([1.0, 0.5, 2.0])
    trees = []
    for seed in range(8):
        feature, cut, first, stats = grown(layout, rows, 8, seed)
        trees.append(forests._flat(cuts, weights, feature, cut, first, stats[:, :3]))
    values = np.random.default_rng(4).integers(0, 32, (15, 50)).astype(float)
    walk = learning._Walk(trees, 15)
    assert walk.word[-1] == 1
    votes = np.zeros((50, 3))
    for goes_by, cut, first, share, _ in trees:
        for i in range(50):
            at = 0
            while first[at] >= 0:
                at = first[at] + (values[goes_by[at], i] > cut[at])
            votes[i] += share[at]
    assert np.allclose(walk.votes(values), votes)
