"""Tiling, work keys and pending windows as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landpulse.operators.ordered import bucketed_row_number


def tile_scope(scopes: DataFrame, width_deg: float = 5.0, height_deg: float = 5.0) -> DataFrame:
    """Deterministic tiles of each scope box (scope_id, west, south, east, north)."""
    if width_deg <= 0 or height_deg <= 0:
        raise ValueError("Tile dimensions must be positive")
    n_cols = F.greatest(F.lit(1), F.ceil((F.col("east") - F.col("west")) / width_deg)).cast("int")
    n_rows = F.greatest(F.lit(1), F.ceil((F.col("north") - F.col("south")) / height_deg)).cast("int")
    t = scopes.withColumns({"n_cols": n_cols, "n_rows": n_rows})
    t = (t.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
         .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))))
    south, west = F.col("south") + F.col("row") * height_deg, F.col("west") + F.col("col") * width_deg
    return t.select("scope_id", F.format_string("%s:%04d:%04d", "scope_id", "row", "col").alias("tile_id"), "row", "col", "n_cols",
                    west.alias("w"), south.alias("s"), F.least(F.col("east"), west + width_deg).alias("e"),
                    F.least(F.col("north"), south + height_deg).alias("n"))


def work_key(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def build_jobs(tiles: DataFrame, sensors: Sequence[str], operation: str, start: str, end: str) -> DataFrame:
    """Tiles x sensors with a stable id and the position in scope order."""
    listed = F.posexplode(F.array(*[F.lit(s) for s in sensors])).alias("_i", "sensor")
    jobs = tiles.select("*", listed)
    index = (F.col("row") * F.col("n_cols") + F.col("col")) * len(sensors) + F.col("_i")
    return jobs.select("scope_id", "tile_id", "sensor", index.cast("bigint").alias("job_index"),
                       work_key(F.col("tile_id"), F.col("sensor"), F.lit(operation), F.lit(start), F.lit(end)).alias("job_id"))


def shard(jobs: DataFrame, count: int, index: int) -> DataFrame:
    if count <= 0 or not 0 <= index < count:
        raise ValueError("Invalid shard count or index")
    return jobs.where(F.pmod("job_index", F.lit(count)) == index)


def pending(windows: DataFrame, ledger: DataFrame, key: str = "job_key") -> DataFrame:
    """Windows whose key is not in the ledger."""
    return windows.join(ledger.select(key), key, "left_anti")


def cap_per_class(rows: DataFrame, label: str, limit: int, order, salts: int = 16) -> DataFrame:
    """At most ``limit`` rows per class in ``order``. Each salt of a class keeps its first
    ``limit`` rows, then the survivors are ranked, so a dominant class is cut in parallel."""
    salted = rows.withColumns({"_o": order, "_salt": F.pmod(F.xxhash64(order), F.lit(salts))})
    first = Window.partitionBy(label, "_salt").orderBy("_o")
    final = Window.partitionBy(label).orderBy("_o")
    kept = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= limit)
    return (kept.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= limit).drop("_o", "_salt", "_rn"))


def split_blocks(rows: DataFrame, block: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Adds ``is_test``: whole blocks, in hash order, go to the test side until the share is met
    (at least one block)."""
    blocks = rows.select(*block).distinct().withColumn("_h", F.md5(F.concat_ws("|", *[F.col(b).cast("string") for b in block], F.lit(str(seed)))))
    blocks = blocks.withColumn("_p", F.substring("_h", 1, 2))
    ranked = bucketed_row_number(blocks, [], "_p", [F.asc("_h")], "_rn")
    wanted = blocks.agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * fraction)).alias("_n"))
    chosen = ranked.select(*block, (F.col("_rn") <= wanted.scalar()).alias("is_test"))
    return rows.join(chosen, list(block))
