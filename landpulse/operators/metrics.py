"""Validation metrics over scored pixels, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landpulse.functions.core import as_col
from landpulse.operators.ordered import ranked_counts
from landpulse.operators.replicates import REPLICATES, correlation_measure, curve_measures, replicate_intervals, replicate_sums


def curve_areas(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float | None = None) -> DataFrame:
    """Exact PR-AUC and ROC-AUC per group by the trapezoid rule over all distinct scores.

    The PR curve ends at (recall 0, precision 1). Areas are NULL for a group with one class. With
    ``threshold`` the confusion counts of scores from there on (tp, fp, fn, tn) and the ``brier`` score come
    along from the same counted scores, so that ``df`` is computed once.
    """
    told = [] if threshold is None else [F.count_if(~as_col(label)).alias("neg")]
    ranked = ranked_counts(df, keys, score, [F.count_if(label).alias("pos"), *told], descending=True)
    n, pos = F.col("n"), F.col("pos")
    tp, shown, positives = F.col("cum_pos"), F.col("cum_n"), F.col("all_pos")
    negatives = F.col("all_n") - positives
    before = F.when(shown == n, 1.0).otherwise((tp - pos) / (shown - n))
    pr = F.sum(pos / positives * (tp / shown + before) / 2.0)
    roc = F.sum((n - pos) / negatives * (tp / positives + (tp - pos) / positives) / 2.0)
    aggs = [F.max("all_n").alias("n_pixels"), F.max("all_pos").alias("n_positive"), pr.alias("_pr"), roc.alias("_roc")]
    more = []
    if threshold is not None:
        s, alarm, neg = F.col(score), F.col(score) >= threshold, F.col("neg")
        part = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
        aggs += [part(alarm, pos).alias("tp"), part(alarm, neg).alias("fp"), part(~alarm, pos).alias("fn"), part(~alarm, neg).alias("tn"),
                 (F.sum(pos * (s - 1.0) * (s - 1.0) + neg * s * s) / F.sum(pos + neg)).alias("brier")]
        more = ["tp", "fp", "fn", "tn", "brier"]
    g = ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)
    return g.select(*keys, *more, "n_pixels", "n_positive", F.when(F.col("n_positive") > 0, F.col("_pr")).alias("pr_auc"),
                    F.when((F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_pixels")), F.col("_roc")).alias("roc_auc"))


def grid_pr_auc(df: DataFrame, keys: Sequence[str], score: str, label: str, steps: int = 100) -> DataFrame:
    """PR-AUC on a fixed grid of thresholds with the precision envelope; 0 without positives.

    Pixels collapse to one row per threshold first, so the windows run over 101 rows a group.
    """
    x = as_col(score)
    guess = F.floor(x * steps)
    level = F.when((guess + 1) / float(steps) <= x, guess + 1).when(guess / float(steps) > x, guess - 1).otherwise(guess)
    level = F.least(F.greatest(level, F.lit(-1)), F.lit(steps)).cast("int")
    hist = df.groupBy(*keys, level.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("pos"))
    spine = hist.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(-1), F.lit(steps))))
    full = spine.join(hist, [*keys, "t"], "left").fillna(0, ["n", "pos"])
    group = list(keys) or [F.lit(0)]
    down = Window.partitionBy(*group).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*group)
    c = full.withColumns({"pp": F.sum("n").over(down), "tp": F.sum("pos").over(down), "p": F.sum("pos").over(every)}).where("t >= 0")
    c = c.withColumns({"precision": F.col("tp") / F.greatest(F.lit(1), F.col("pp")), "recall": F.col("tp") / F.greatest(F.lit(1), F.col("p"))})
    order = Window.partitionBy(*group).orderBy("recall", "precision")
    c = c.withColumn("env", F.max("precision").over(order.rowsBetween(0, Window.unboundedFollowing)))
    c = c.withColumn("_a", 0.5 * (F.col("env") + F.lag("env").over(order)) * (F.col("recall") - F.lag("recall").over(order)))
    g = c.groupBy(*keys).agg(F.max("p").alias("n_positive"), F.coalesce(F.sum("_a"), F.lit(0.0)).alias("pr_auc_grid"))
    return g.withColumn("pr_auc_grid", F.when(F.col("n_positive") > 0, F.col("pr_auc_grid")).otherwise(0.0))


def reliability(df: DataFrame, keys: Sequence[str], probability: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width reliability bins, the last one closed; empty bins report their midpoint."""
    p = F.col(probability)
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    got = (df.where(p.isNotNull()).groupBy(*keys, b.alias("bin"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate")))
    spine = got.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(got, [*keys, "bin"], "left").fillna(0, ["n"])
    return full.select(*keys, "bin", "n", F.coalesce("mean_p", (F.col("bin") + 0.5) / bins).alias("mean_p"), F.coalesce("rate", F.lit(0.0)).alias("rate"),
                       F.when(F.col("n") > 0, F.abs(F.col("mean_p") - F.col("rate"))).otherwise(0.0).alias("gap"))


def calibration_errors(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    aggs = [(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce")]
    return bins.groupBy(*keys).agg(*aggs) if keys else bins.agg(*aggs)


def logit(p) -> Column:
    p = F.least(F.greatest(as_col(p), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return F.log(p / (1.0 - p))


def bootstrap_correlation(units: DataFrame, unit: str, x: str, y: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Percentile interval of Pearson r over resamples of the units: low, mid, high, n_replicates."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    moments = {"n": F.lit(1.0), "x": X, "y": Y, "xx": X * X, "yy": Y * Y, "xy": X * Y}
    rows = units.where(X.isNotNull() & Y.isNotNull()).select(F.col(unit).cast("string").alias("_name"), *[e.alias(k) for k, e in moments.items()])
    sums = replicate_sums(rows, [F.col("_name")], [], list(moments), replicates, seed)
    out = replicate_intervals(sums, [], correlation_measure, ["r"], {"low": 0.025, "mid": 0.5, "high": 0.975})
    return out.select(F.col("r_low").alias("low"), F.col("r_mid").alias("mid"), F.col("r_high").alias("high"), F.col("r_n").alias("n_replicates"))


def block_bootstrap(scored: DataFrame, block: Column, group: str, score: str, label: str, threshold: float, levels: int = 100,
                    replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Per group 95 % intervals of precision, recall, F1 and PR-AUC over resampled spatial blocks.

    Pixels collapse to positive and negative counts per block, group and score level; the replicates
    are weighted sums of these counts. A score within 1e-8 below a level belongs to it; alarms are
    the levels from ``threshold`` on.
    """
    at = F.least(F.greatest(F.floor(F.col(score) * levels + 1e-6), F.lit(0)), F.lit(levels)).cast("int")
    counts = (scored.where(F.col(score).isNotNull()).groupBy(block.cast("string").alias("block"), group, at.alias("level"))
              .agg(F.count_if(label).alias("pos"), F.count_if(~as_col(label)).alias("neg")))
    sums = replicate_sums(counts, [F.col("block")], [group, "level"], ["pos", "neg"], replicates, seed)
    names = ["precision", "recall", "f1", "pr_auc"]
    out = replicate_intervals(sums, [group], curve_measures(round(threshold * levels)), names, {"low": 0.025, "high": 0.975}, order="level")
    return out.select(group, *[f"{n}_{e}" for n in names for e in ("low", "high")])
