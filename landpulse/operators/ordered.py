"""Order statistics over groups of any size.

A plain window would sort each group in a single task. Here equal values are counted first,
the distinct values are cut into buckets of about equal size, and only per-bucket totals are
accumulated across buckets, so one huge group spreads over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landpulse.operators.skew import salted_join
from landpulse.session import cut_lineage

BUCKETS = 64
WHOLE = 256  # a group of at most so many rows is sorted in one piece


def bucketed(distinct: DataFrame, keys: Sequence[str], value: str, name: str = "_bucket") -> DataFrame:
    """Adds a bucket number that agrees with the order of ``value``.

    Every group of more than ``WHOLE`` rows is cut at its own approximate quantiles, so a large group
    spreads over many buckets however narrow its range; smaller groups and NULL values are bucket 0.
    A group gets 64 buckets, or as many as the session has shuffle partitions.
    """
    x = F.col(value).cast("double")
    count = max(BUCKETS, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.array_distinct(F.percentile_approx(x, [i / count for i in range(1, count)], 20 * count)).alias("_cuts")
    stats = distinct.groupBy(*keys).agg(cuts, F.count(x).alias("_rows")).where(F.col("_rows") > WHOLE).drop("_rows")
    below = F.size(F.filter("_cuts", lambda c: c <= x))
    known = F.col("_cuts").isNotNull() & x.isNotNull()
    return salted_join(distinct, stats, keys, [value], how="left").withColumn(name, F.when(known, below).otherwise(0)).drop("_cuts")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: str,
                   values: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds ``cum_<v>`` (inclusive running sum) and ``all_<v>`` (group total) per value column.

    ``bucket`` must agree with ``order``: a row of a lower bucket comes first.
    """
    group = list(keys) or [F.lit(0)]
    within = (Window.partitionBy(*keys, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bucket_order = F.desc(bucket) if descending else F.asc(bucket)
    before = Window.partitionBy(*group).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = sums.select(
        *keys, bucket,
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"all_{v}") for v in values])
    local = df.withColumns({f"_c_{v}": F.sum(v).over(within) for v in values})
    joined = local.join(offsets, [*keys, bucket])
    return (joined.withColumns({f"cum_{v}": F.col(f"_c_{v}") + F.col(f"_o_{v}") for v in values})
            .drop(*[f"_c_{v}" for v in values], *[f"_o_{v}" for v in values]))


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = (),
                  descending: bool = False) -> DataFrame:
    """One row per (keys, distinct value) with its count and the running count.

    The counted table is dealt by ranges of (keys, value): a large group spreads over many ranges, small
    ones share a range, and the range's number is the bucket. It is checkpointed because bucket totals
    and the running counts are both read from it.
    """
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
               .agg(F.count(F.lit(1)).alias("n"), *extra))
    counted = cut_lineage(counted.repartitionByRange(*keys, value).withColumn("_bucket", F.spark_partition_id()))
    names = ["n"] + [c for c in counted.columns if c not in (*keys, value, "n", "_bucket")]
    order = [F.desc(value) if descending else F.asc(value)]
    return running_totals(counted, keys, order, "_bucket", names, descending).drop("_bucket")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      wanted: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles, exact for groups of any size."""
    ranked = ranked_counts(df, keys, value)
    start, end = F.col("cum_n") - F.col("n"), F.col("cum_n")
    parts, result = [], []
    for i, (name, p) in enumerate(wanted.items()):
        position = (F.col("all_n") - 1) * F.lit(float(p))
        for side, k in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            parts.append(F.max(F.when((start <= k) & (k < end), F.col(value))).alias(f"_{side}{i}"))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        whole = (F.col("_n") - 1) * F.lit(float(p))
        result.append((lo + (hi - lo) * (whole - F.floor(whole))).alias(name))
    parts.append(F.max("all_n").alias("_n"))
    picked = ranked.groupBy(*keys).agg(*parts) if keys else ranked.agg(*parts)
    return picked.select(*keys, *result)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, value, rank) with ties sharing their mean rank."""
    ranked = ranked_counts(df, keys, value)
    return ranked.select(*keys, value, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name))


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (mean ranks for ties) per group; NULL without variance.

    The rank tables hold one row per distinct value and can be as large as the data, so they are
    joined plainly; adaptive execution splits a value shared by very many rows.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = pairs.join(average_ranks(pairs, keys, x, "_rx"), [*keys, x]).join(average_ranks(pairs, keys, y, "_ry"), [*keys, y])
    stats = [F.count(F.lit(1)).alias("n_pairs"), correlation(x, y).alias("pearson_r"),
             correlation("_rx", "_ry").alias("spearman_rho")]
    return ranked.groupBy(*keys).agg(*stats) if keys else ranked.agg(*stats)


def correlation(x: str, y: str) -> Column:
    """Pearson r, NULL where either side is (about) constant."""
    return F.when((F.stddev_pop(x) > 1e-6) & (F.stddev_pop(y) > 1e-6), F.corr(x, y))


def bucketed_row_number(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column],
                        name: str) -> DataFrame:
    """``row_number`` per group where ``bucket`` agrees with ``order`` and splits large groups."""
    one = df.withColumn("_one", F.lit(1))
    numbered = running_totals(one, keys, order, bucket, ["_one"])
    return numbered.withColumn(name, F.col("cum__one").cast("int")).drop("_one", "cum__one", "all__one")


def last_before(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: Column,
                name: str) -> DataFrame:
    """Adds the nearest earlier non-null ``value`` of the group, cut at bucket borders.

    Rows are sorted inside (keys, bucket) only; what earlier buckets hand over comes from a table
    of one row per bucket.
    """
    marked = df.withColumn("_v", value)
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = marked.withColumns({
        "_near": F.last("_v", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)),
        "_rn": F.row_number().over(within)})
    ends = local.where("_v IS NOT NULL").groupBy(*keys, bucket).agg(F.max_by("_v", "_rn").alias("_end"))
    spine = local.select(*keys, bucket).distinct().join(ends, [*keys, bucket], "left")
    per_key = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = spine.select(*keys, bucket, F.last("_end", ignorenulls=True).over(per_key).alias("_carry"))
    return local.join(carry, [*keys, bucket]).withColumn(name, F.coalesce("_near", "_carry")).drop("_v", "_near", "_rn", "_carry")
