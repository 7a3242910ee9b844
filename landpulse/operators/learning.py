"""Classifiers and calibration on pixel tables with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landpulse.functions.core import round6
from landpulse.operators import forests
from landpulse.session import cut_lineage, scratch_path


def labelled_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with a positive label and all features present."""
    present = F.col(label) > 0
    for f in features:
        present = present & F.col(f).isNotNull() & ~F.isnan(f)
    return df.where(present)


def stratified_split(df: DataFrame, label: str, key: Column, test_share: float = 0.2) -> DataFrame:
    """Adds ``is_test`` by the hash of the key, so every class loses about the same share."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(label).cast("string"), key)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("is_test", u < test_share)


STATE_BYTES, STATE_PER_TREE, FEWEST_TREES = 4 << 30, 12, 10  # what bags and node ids of one training pass may take, for a row and tree
PARTITION_ROWS = 1_000_000
LIBRARY_ROWS = 50_000  # more rows are not trained by the library, which shuffles the statistics of all open nodes and visits rows one by one
BLOCK_ROWS = 1 << 14  # rows that walk down a tree together


class Forest:
    """Labels in the order of their probabilities and the fitted parts of one forest: models of the library,
    or lists of flat trees."""

    def __init__(self, labels: Sequence[str], parts: Sequence[RandomForestClassificationModel | list[tuple]]):
        self.labels, self.parts = list(labels), list(parts)


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 300, depth: int = 30, seed: int = 42) -> Forest:
    """Class-balanced random forest. At least two classes are required. ``depth`` is at the library's limit
    by default; a tenth of the nodes and a third of the time remain at 10 (figures in the README).

    The library holds a bag count and node ids for every row and tree. Where these would take more than
    ``STATE_BYTES``, the trees are grown in several passes over all rows, so that they stay in memory. More
    than ``LIBRARY_ROWS`` rows go to ``forests.train``, which grows the same kind of forest tree by tree.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k")).first()
    if total["_k"] < 2:
        raise ValueError("At least two labelled classes are required.")
    if total["_all"] > LIBRARY_ROWS:
        of = {str(name): n for name, n in counts.where(F.col(label).isNotNull()).select(F.col(label).cast("string"), "_n").orderBy(F.col(label).cast("string")).collect()}
        weights = {name: total["_all"] / (total["_k"] * n) for name, n in of.items()}
        return Forest(list(of), [forests.train(df, features, label, of, weights, trees, depth, seed)])
    weighted = df.join(counts, label).withColumn("_w", F.lit(float(total["_all"])) / (F.lit(float(total["_k"])) * F.col("_n")))
    # every partition holds and sends statistics of all open nodes: as many partitions as cores, more only for their size
    weighted = weighted.repartition(max(df.sparkSession.sparkContext.defaultParallelism, total["_all"] // PARTITION_ROWS + 1))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(weighted)
    rows = VectorAssembler(inputCols=list(features), outputCol="_features").transform(indexer.transform(weighted))
    at_once = min(trees, max(FEWEST_TREES, STATE_BYTES // (STATE_PER_TREE * total["_all"])))
    if at_once < trees:
        rows = cut_lineage(rows.select("_features", "_label", "_w"))
    parts = []
    for first in range(0, trees, at_once):
        forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="_w", numTrees=min(at_once, trees - first), maxDepth=depth,
                                        featureSubsetStrategy="sqrt", seed=seed + first, maxMemoryInMB=1024, cacheNodeIds=True)
        parts.append(forest.fit(rows))
    return Forest(indexer.labelsArray[0], parts)


def _flat_trees(model: RandomForestClassificationModel, spark: SparkSession) -> list[tuple]:
    """(feature, threshold, first child, class shares, depth) of each tree; the second child follows the
    first, a leaf has -1."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    table = node.select("treeID", "id", "leftChild", "rightChild", "split.featureIndex", "split.numCategories", "impurityStats",
                        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).toArrow().combine_chunks()
    table = table.sort_by([("treeID", "ascending"), ("id", "ascending")])
    tree, left, right, feature, kinds = (table.column(c).to_numpy() for c in ("treeID", "leftChild", "rightChild", "featureIndex", "numCategories"))
    if (kinds[left >= 0] >= 0).any():
        raise ValueError("Only splits of continuous features can be applied.")
    threshold = table.column("threshold").to_numpy()
    stats = table.column("impurityStats").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    total = stats.sum(axis=1, keepdims=True)
    shares = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    out = []
    for part in np.split(np.arange(len(tree)), np.flatnonzero(np.diff(tree)) + 1):
        inner = np.flatnonzero(left[part] >= 0)
        name = np.zeros(len(part), np.int64)  # children side by side, the root first
        name[left[part][inner]], name[right[part][inner]] = 2 * np.arange(len(inner)) + 1, 2 * np.arange(len(inner)) + 2
        first, goes_by, cut, share = np.full(len(part), -1), np.zeros(len(part), np.int64), np.full(len(part), np.inf), np.empty((len(part), stats.shape[1]))
        first[name[inner]], goes_by[name[inner]], cut[name[inner]] = 2 * np.arange(len(inner)) + 1, feature[part][inner], threshold[part][inner]
        share[name] = shares[part]
        depth, level = 0, np.zeros(1, np.int64)
        while len(level := first[level][first[level] >= 0]):
            level, depth = np.concatenate([level, level + 1]), depth + 1
        out.append((goes_by, cut, first, share, depth))
    return out


class _Walk:
    """Trees over rows whose features are coded to positions among the cut points, side by side in as few
    numbers as hold them. A value is at most the k-th cut point exactly if at most k cut points lie below it."""

    def __init__(self, trees: Sequence[tuple], n_features: int):
        self.cuts = [np.unique(np.concatenate([cut[(first >= 0) & (goes_by == f)] for goes_by, cut, first, _, _ in trees])) for f in range(n_features)]
        self.word, self.shift, used = np.zeros(n_features, np.int64), np.zeros(n_features, np.int64), 0
        for f, points in enumerate(self.cuts):
            bits = len(points).bit_length()
            if used + bits > 63:
                self.word[f:], used = self.word[f] + 1, 0
            self.shift[f], used = used, used + bits
        self.trees = []
        for goes_by, cut, first, share, depth in trees:
            mask, most, inner = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), first >= 0
            for f, points in enumerate(self.cuts):
                own = inner & (goes_by == f)
                mask[own] = ((1 << len(points).bit_length()) - 1) << self.shift[f]
                most[own] = np.searchsorted(points, cut[own]) << self.shift[f]
            word = np.where(inner, self.word[goes_by], 0) if self.word[-1] else None
            self.trees.append((word, mask, most, np.where(inner, first, np.arange(len(first))), np.asfortranarray(share), depth))  # a leaf is its own child

    def votes(self, values: np.ndarray) -> np.ndarray:
        """Class shares of the leaves that each column of ``values`` reaches, summed over the trees."""
        rows = values.shape[1]
        codes = np.zeros((self.word[-1] + 1, rows), np.int64)
        for f, (points, of) in enumerate(zip(self.cuts, values)):
            codes[self.word[f]] |= np.searchsorted(points, of) << self.shift[f]
        flat, base = codes.ravel(), np.arange(rows)
        total = np.zeros((self.trees[0][4].shape[1], rows))
        at, code, bound = (np.empty(rows, np.int64) for _ in range(3))
        for word, mask, most, first, share, depth in self.trees:
            at[:] = 0
            for _ in range(depth):
                mask.take(at, out=code, mode="clip")  # no place is out of bounds, and clipping is the faster way to take
                code &= flat if word is None else flat.take(word.take(at) * rows + base)
                beyond = code > most.take(at, out=bound, mode="clip")
                first.take(at, out=code, mode="clip")
                np.add(code, beyond, out=at)
            for of, part in zip(total, share.T):
                of += part.take(at, mode="clip")
        return total.T


def predict(model: Forest, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``predicted`` and ``confidence``; both NULL where a feature is missing.

    The trees become flat arrays, and blocks of rows walk down one tree after the other: a tree then stays
    in the processor's cache, which a whole forest visited row by row does not.
    """
    spark, names = df.sparkSession, list(features)
    flat = [t for part in model.parts for t in (part if isinstance(part, list) else _flat_trees(part, spark))]
    shared = spark.sparkContext.broadcast(_Walk(flat, len(names)))
    labels = np.array([int(x) for x in model.labels], np.int32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(begin, BLOCK_ROWS)
                values = np.stack([rows.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in names])
                missing = np.isnan(values).any(axis=0)
                share = shared.value.votes(np.where(np.isnan(values), 0.0, values))
                share = (share / share.sum(axis=1, keepdims=True))[:, :len(labels)]
                best = share.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(labels[best], pa.int32(), mask=missing),
                                                  pa.array(share[np.arange(len(best)), best], pa.float64(), mask=missing)], schema.names)

    schema = T.StructType([*df.schema.fields, T.StructField("predicted", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
    return df.mapInArrow(score, schema)


def classification_report(df: DataFrame, keys: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy and averaged F1 from the confusion table."""
    cells = df.groupBy(*keys, F.col(label).alias("_t"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(*keys, "_t", "_p", "_n", F.explode(F.when(F.col("_t") == F.col("_p"), F.array(F.struct(F.col("_t").alias("c"), F.lit(1).alias("t"), F.lit(1).alias("p")))).otherwise(
        F.array(F.struct(F.col("_t").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("_p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"))))).alias("s"))
    per = sides.groupBy(*keys, F.col("s.c").alias("cls")).agg(F.sum(F.col("_n") * F.col("s.t")).alias("support"), F.sum(F.col("_n") * F.col("s.p")).alias("shown"),
                                                             F.sum(F.col("_n") * F.col("s.t") * F.col("s.p")).alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"pr": ratio(F.col("hit"), F.col("shown")), "rc": ratio(F.col("hit"), F.col("support"))})
    per = per.withColumn("f", ratio(2.0 * F.col("pr") * F.col("rc"), F.col("pr") + F.col("rc")))
    g = per.groupBy(*keys) if keys else per.groupBy()
    return g.agg(F.sum("support").alias("n"), round6(F.sum("hit") / F.sum("support")).alias("accuracy"),
                 round6(F.avg(F.when(F.col("support") > 0, F.col("rc")))).alias("balanced_accuracy"), round6(F.avg("f")).alias("macro_f1"),
                 round6(F.sum(F.col("f") * F.col("support")) / F.sum("support")).alias("weighted_f1"), round6(F.avg("pr")).alias("macro_precision"))


def isotonic_fit(df: DataFrame, score: str, target: Column):
    """Isotonic model. Scores are pooled to six decimals first: at most a million weighted points
    reach the final pooling step, however many pixels there are."""
    points = (df.where(F.col(score).isNotNull()).groupBy(round6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))).alias("x"))
              .agg(F.avg(target).alias("y"), F.count(F.lit(1)).cast("double").alias("w")))
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", predictionCol="calibrated").fit(points)


def isotonic_apply(model, df: DataFrame, score: str) -> DataFrame:
    """Adds ``calibrated``, bounded to [0, 1]; scores outside the fitted range take its ends."""
    out = model.transform(df.withColumn("x", F.col(score)))
    return out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))).drop("x")
