"""Adapters that shape the shared star-schema tables into monitoring inputs.

A cell of the pixel grid collects the line items of one (supplier group, ship year,
order key mod 16, part key mod 16). Tiles grow with the number of suppliers, so tables and
grids scale together. Sums are taken over integers and divided once, so every engine gets
the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landpulse.functions import indices
from landpulse.functions.drought import z_anomaly

SIDE = 16
CELL = ["tile_id", "epoch", "row", "col"]
PIXEL_M = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _whole(column: str) -> Column:
    return F.round(F.col(column) * 100.0).cast("bigint")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pixel table: bands, static layers, and a reference flag per cell."""
    sums = (table(spark, sf_dir, "lineitem")
            .groupBy(F.expr("l_suppkey div 10").alias("tile_id"), F.year("l_shipdate").alias("epoch"),
                     (F.col("l_orderkey") % SIDE).cast("int").alias("row"),
                     (F.col("l_partkey") % SIDE).cast("int").alias("col"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(_whole("l_discount")).alias("sd"),
                 F.sum(_whole("l_tax")).alias("st"), F.sum(F.col("l_quantity").cast("bigint")).alias("sq"),
                 F.sum(F.col("l_partkey") % 100).alias("sp"), F.sum(F.col("l_orderkey") % 100).alias("so"),
                 F.count_if(F.col("l_returnflag") == "R").alias("nr")))
    n = F.col("n")
    return sums.select(
        *CELL, "n",
        (F.col("sd") / (100.0 * n)).alias("red"), (F.col("st") / (100.0 * n)).alias("nir"),
        (F.col("sq") / (50.0 * n)).alias("swir"), (F.col("sp") / (1000.0 * n)).alias("blue"),
        (F.col("so") / (1000.0 * n)).alias("green"),
        (F.col("sp") % 12).cast("int").alias("scl"), ((F.col("so") % 101) * (F.col("so") % 101) / 10000.0).alias("occurrence"),
        ((F.col("sq") % 20) * 9 / 20.0).alias("slope"), ((F.col("sp") % 40) / 4.0).alias("elevation"),
        (2 * F.col("nr") > n).alias("reference"))


def grids(px: DataFrame) -> DataFrame:
    """Grid dimension table: one row per tile."""
    return (px.select("tile_id").distinct()
            .select("tile_id", F.lit("EPSG:32643").alias("crs"), (F.col("tile_id") * SIDE * PIXEL_M).alias("x0"),
                    F.lit(PIXEL_M).alias("dx"), F.lit(0.0).alias("y0"), F.lit(-PIXEL_M).alias("dy"),
                    F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"),
                    F.lit(PIXEL_M * PIXEL_M / 10000.0).alias("pixel_area_ha")))


def dense(px: DataFrame) -> DataFrame:
    """Every cell of every observed (tile, epoch); empty cells carry NULL bands."""
    line = F.sequence(F.lit(0), F.lit(SIDE - 1))
    spine = (px.select("tile_id", "epoch").distinct()
             .withColumn("row", F.explode(line)).withColumn("col", F.explode(line)))
    return spine.join(px, CELL, "left")


def before_after(px: DataFrame, columns: list[str], static: list[str] | None = None, unpaired: bool = False) -> DataFrame:
    """Each cell next to the same cell one epoch earlier: ``<c>_b`` and ``<c>_e``.

    A lag over the cell's own epochs: one shuffle by cell, no self-join. With ``unpaired`` the
    cells without an earlier epoch stay, with NULL before values.
    """
    static = static or []
    history = Window.partitionBy("tile_id", "row", "col").orderBy("epoch")
    packed = px.select(*CELL, *static, F.struct("epoch", *columns).alias("_now"))
    paired = packed.withColumn("_prev", F.lag("_now").over(history))
    adjacent = F.col("_prev.epoch") == F.col("epoch") - 1
    paired = paired.withColumn("_prev", F.when(adjacent, F.col("_prev"))) if unpaired else paired.where(adjacent)
    return paired.select(*CELL, *static, *[F.col(f"_prev.{c}").alias(f"{c}_b") for c in columns],
                         *[F.col(f"_now.{c}").alias(f"{c}_e") for c in columns])


def index_delta(px: DataFrame) -> DataFrame:
    """Greenness before, after and their difference where both are defined."""
    index = indices.normalized_difference("nir", "red")
    pairs = before_after(px.withColumn("index", index), ["index"])
    return pairs.withColumn("delta", F.col("index_e") - F.col("index_b"))


def flood_inputs(px: DataFrame, unpaired: bool = False) -> DataFrame:
    """Radar before/event, optical bands, class, and static layers per cell. ``paired`` tells
    whether the cell has an earlier epoch."""
    pairs = before_after(px, ["swir", "red"], ["green", "nir", "swir", "scl", "occurrence", "slope",
                                               "elevation", "reference"], unpaired)
    return pairs.select(*CELL, F.col("swir_b").isNotNull().alias("paired"), (F.col("swir_b") * 0.3).alias("vv_b"),
                        (F.col("swir_e") * F.col("swir_e") * F.col("swir_e") * 0.3).alias("vv_e"),
                        F.col("red_b").alias("vh_b"), (F.col("red_e") * F.col("red_e") * 4.0).alias("vh_e"), "green", "nir", "swir", "scl",
                        "occurrence", "slope", "elevation", "reference")


def drought_inputs(px: DataFrame) -> DataFrame:
    """Nine anomaly channels per cell and epoch, standardised against the cell's own history."""
    cell = ["tile_id", "row", "col"]
    obs = px.select(*CELL, "scl", "reference", "occurrence", indices.ndvi("nir", "red").alias("ndvi"),
                    F.col("blue").alias("rain"), F.col("green").alias("soil"), F.col("swir").alias("heat"))
    names = ["ndvi", "rain", "soil", "heat"]
    history = Window.partitionBy(*cell)  # one row per year: one shuffle by cell serves all windows
    joined = obs.withColumns({**{f"{c}_m": F.avg(c).over(history) for c in names},
                              **{f"{c}_s": F.stddev_pop(c).over(history) for c in names},
                              "ndvi_lo": F.min("ndvi").over(history), "ndvi_hi": F.max("ndvi").over(history)})
    floors = {"ndvi": 0.02, "rain": 0.001, "soil": 0.001, "heat": 0.01}
    z = joined.select(*CELL, "scl", "reference", "occurrence", "ndvi", "ndvi_m", "ndvi_lo", "ndvi_hi",
                      *[z_anomaly(c, f"{c}_m", f"{c}_s", floors[c]).alias(f"z_{c}") for c in names])
    w = Window.partitionBy(*cell).orderBy("epoch")
    over = lambda c, k: F.avg(c).over(w.rangeBetween(-(k - 1), 0))
    return z.select(*CELL, "scl", "reference", "occurrence", "ndvi", "ndvi_m", "ndvi_lo", "ndvi_hi",
                    F.col("z_ndvi").alias("veg_1m"), over("z_ndvi", 3).alias("veg_3m"), over("z_ndvi", 6).alias("veg_6m"),
                    F.col("z_rain").alias("precip_1m"), over("z_rain", 3).alias("precip_3m"),
                    over("z_rain", 6).alias("precip_6m"),
                    F.col("z_soil").alias("soil_surface"), over("z_soil", 3).alias("soil_rootzone"),
                    F.col("z_heat").alias("thermal"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue rows from orders."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("scene_id"), F.col("o_orderdate").alias("dt"),
        (F.round(F.col("o_totalprice") * 100.0).cast("bigint") % 10000 / 100.0).alias("cloud"),
        F.col("o_orderstatus").alias("platform"), (F.col("o_custkey") % 7).cast("int").alias("rel_orbit"),
        F.when(key % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("direction"),
        F.lit("IW").alias("mode"), F.when(key % 3 == 0, "VV").otherwise("VV+VH").alias("raw_polarization"),
        F.when(key % 5 == 0, F.lit(None).cast("int")).otherwise((key % 4).cast("int")).alias("slice_number"),
        (F.col("o_custkey") % 50).cast("int").alias("site"), (F.col("o_custkey") % 200).cast("int").alias("tile_ref"))


def fire_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot-spot detections from events, as the text columns a detection file has."""
    user, event = F.col("user_id"), F.col("event_id")
    lat = 10.0 + (user % 25) * 0.01 + (event % 7) * 0.0005
    lon = 70.0 + F.expr("user_id div 25") * 0.01 + (event % 5) * 0.0005
    return table(spark, sf_dir, "events").select(
        event.alias("seq"), F.format_string("%.4f", lat).alias("latitude"), F.format_string("%.4f", lon).alias("longitude"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), F.date_format("ts", "HHmm").alias("acq_time"),
        F.col("value").alias("frp"), F.when(event % 2 == 0, "VIIRS_SNPP_SP").otherwise("VIIRS_NOAA20_SP").alias("source"))


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals per station from events, pre-aggregated to one row per station and day."""
    whole = F.round(F.col("value") * 100.0).cast("bigint")
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").alias("station"), F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("sv"), F.sum(F.col("event_id") % 100).alias("sk"))
            .select("station", "day", "n", (F.col("sv") / 100.0).alias("precip"),
                    (F.col("sv") / (F.col("n") * 50000.0)).alias("severity"), (F.col("sk") / (F.col("n") * 100.0)).alias("soil")))
