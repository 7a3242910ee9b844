"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows to a one-row-per-key table, splitting each key over ``salts`` partitions.

    ``spread`` names columns of ``big`` that differ inside a key. Every row of ``small`` is
    copied once per salt, so the result equals the plain join. Meant for tables far smaller than
    ``big``, such as one row per grid. When the copied side turns out small at run time, adaptive
    execution broadcasts it; nothing is broadcast unchecked.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def attach_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[Column],
                 spread: Sequence[str]) -> DataFrame:
    """Add per-group statistics to every row, like an unordered window but without pulling a
    whole group into one task: partial aggregation first, then a salted join."""
    return salted_join(df, df.groupBy(*keys).agg(*stats), keys, spread, how="left")
