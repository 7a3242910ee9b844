"""Active-fire detections: ingest tiers, de-duplication, corroboration."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landpulse import config
from landpulse.functions.core import share
from landpulse.functions.geo import EARTH_RADIUS_M
from landpulse.operators.groups import whole_groups
from landpulse.session import stored


def parse_points(raw: DataFrame) -> DataFrame:
    """Typed position and time; rows that do not parse keep NULLs."""
    text_time = F.concat(F.trim("acq_date"), F.lit(" "), F.lpad(F.trim("acq_time"), 4, "0"))
    return raw.withColumns({"lat": F.expr("try_cast(latitude AS double)"), "lon": F.expr("try_cast(longitude AS double)"),
                            "ts": F.try_to_timestamp(text_time, F.lit("yyyy-MM-dd HHmm"))})


UNDECIDED, KEPT, DROPPED = 0, 1, 2
SIDE, SPAN, FINER = 32, 480, 8  # block side in radii, its time in tolerances, and parts a side of a crowded block
CROWDED = 20_000


def merge_duplicates(points: DataFrame, order: Sequence[str], radius_m: float = 250.0,
                     minutes: int = 30, crowded: int = CROWDED) -> DataFrame:
    """Drop detections within ``radius_m`` and ``minutes`` of an earlier kept one.

    Records are taken in the given order, then by position and time; the earliest kept neighbour
    inherits the largest frp of its duplicates; unparsed rows are kept. Adds ``n_merged``.

    Records equal in position and time collapse first, so repeated copies cost one row. The others are
    dealt to blocks of space and time, with a copy in every block that lies within the tolerance.
    Blocks are cubes in space, so that the poles and the date line are places like any other; one of
    more than ``crowded`` records is cut finer. Each block walks through its records in order and
    decides all whose earlier neighbours are decided, so a chain of records at one place takes a single
    round; only blocks that wait for a neighbour's decision run again.
    """
    columns = points.columns
    parsed = points.withColumn("_row", F.struct(*columns))
    bad = parsed.where("lat IS NULL OR lon IS NULL OR ts IS NULL")
    good = parsed.where("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL")
    # dealt as they are, so that copies are sorted and collapsed once, not before and after the shuffle
    sites = good.repartition("lat", "lon", "ts").groupBy("lat", "lon", "ts").agg(F.min(F.struct(*order)).alias("_ord"), F.min_by("_row", F.struct(*order)).alias("_row"), F.max("frp").alias("_frp"),
                                                 F.count(F.lit(1)).alias("_copies"))
    # a straight line is never longer than the arc, so cubes of the tolerance reach far enough
    lat, lon = F.radians("lat"), F.radians("lon")
    scale = EARTH_RADIUS_M / (radius_m * (1.0 + 1e-9))
    sites = stored(sites.withColumns({"_x": F.cos(lat) * F.cos(lon) * scale, "_y": F.cos(lat) * F.sin(lon) * scale, "_z": F.sin(lat) * scale,
                                      "_t": F.unix_timestamp("ts") / float(minutes * 60), "_site": F.monotonically_increasing_id()}), "sites")
    copies = stored(_with_halo(sites.select("_site", "_ord", "lat", "lon", "ts", "_x", "_y", "_z", "_t"), crowded), "copies")
    homes = _decide(copies, radius_m, minutes)
    merged = (homes.join(sites.select("_site", "_frp", "_copies"), "_site").groupBy(F.col("_keeper").alias("_site"))
              .agg(F.max("_frp").alias("_best"), F.sum("_copies").alias("n_merged")))
    survivors = sites.select("_site", "_row").join(merged, "_site")
    best = [F.col("_best").alias(c) if c == "frp" else F.col(f"_row.{c}").alias(c) for c in columns]
    return survivors.select(*best, "n_merged").unionByName(bad.select(*columns, F.lit(1).cast("bigint").alias("n_merged")))


def _block(x, y, z, t, parts: int = 1) -> Column:
    return F.xxhash64(F.lit(parts), *[F.floor(c * (parts / SIDE)) for c in (x, y, z)], F.floor(t * (parts / SPAN)))


def _with_halo(sites: DataFrame, crowded: int) -> DataFrame:
    """A copy of each record for every block within one unit of it: ``_block``, and ``_own`` for the block
    that holds it. A block is larger than two units, so the corners of the unit box tell all of them."""
    at = [F.col(c) for c in ("_x", "_y", "_z", "_t")]
    corners = [[c + d for c, d in zip(at, ((i >> k & 1) * 2 - 1 for k in range(4)))] for i in range(16)]
    crowds = sites.groupBy(_block(*at).alias("_whole")).count().where(F.col("count") > crowded).select("_whole", F.lit(True).alias("_cut"))
    if crowds.isEmpty():
        near = F.array_distinct(F.array(*[_block(*c) for c in corners]))
        return sites.withColumn("_own_block", _block(*at)).withColumn("_block", F.explode(near)).withColumn("_own", F.expr("_block = _own_block")).drop("_own_block")
    pair = lambda c: F.struct(_block(*c).alias("_whole"), _block(*c, parts=FINER).alias("_part"))
    spread = sites.withColumn("_home", pair(at)).withColumn("_b", F.explode(F.array_distinct(F.array(*map(pair, corners)))))
    spread = spread.select(*sites.columns, "_home", "_b._whole", "_b._part").join(crowds, "_whole", "left")
    block = lambda whole, part: F.when(F.col("_cut"), F.col(part)).otherwise(F.col(whole))
    own = F.col("_home._whole") == F.col("_whole")
    placed = spread.withColumns({"_block": block("_whole", "_part"), "_own": own & (F.col("_cut").isNull() | (F.col("_home._part") == F.col("_part")))})
    return placed.select(*sites.columns, "_block", "_own").distinct()


def _decide(copies: DataFrame, radius_m: float, minutes: int) -> DataFrame:
    """(_site, _keeper) of every record: itself where kept, else its earliest kept neighbour."""
    schema = "_site long, _block long, _status int, _keeper long"
    by = ["_block"]

    def walk(table: pa.Table, group: np.ndarray) -> pa.Table:
        site, own, status = (table.column(c).to_numpy().copy() for c in ("_site", "_own", "_status"))
        keeper = site.copy()
        lat, lon, seconds = np.radians(table.column("lat").to_numpy()), np.radians(table.column("lon").to_numpy()), table.column("_s").to_numpy().tolist()
        cosine, lat, lon = np.cos(lat).tolist(), lat.tolist(), lon.tolist()
        cells = list(zip(*(np.floor(table.column(c).to_numpy()).astype(np.int64).tolist() for c in ("_x", "_y", "_z", "_t"))))
        open_before = own & (status == UNDECIDED)

        def close(i: int, j: int) -> bool:
            if abs(seconds[i] - seconds[j]) > minutes * 60:
                return False
            h = math.sin((lat[j] - lat[i]) / 2.0) ** 2 + cosine[i] * cosine[j] * math.sin((lon[j] - lon[i]) / 2.0) ** 2
            return 2.0 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h))) <= radius_m

        held: dict[tuple, list[int]] = {}
        for i, here in enumerate(cells):
            if i and group[i] != group[i - 1]:
                held = {}
            if open_before[i]:
                first = -1  # the earliest neighbour that is kept or may still be
                for a in (here[0] - 1, here[0], here[0] + 1):
                    for b in (here[1] - 1, here[1], here[1] + 1):
                        for c in (here[2] - 1, here[2], here[2] + 1):
                            for d in (here[3] - 1, here[3], here[3] + 1):
                                for j in held.get((a, b, c, d), ()):
                                    if 0 <= first < j:
                                        break
                                    if close(i, j):
                                        first = j
                                        break
                if first < 0:
                    status[i] = KEPT
                elif status[first] == KEPT:
                    status[i], keeper[i] = DROPPED, site[first]
            if status[i] != DROPPED:
                held.setdefault(here, []).append(i)
        at = np.flatnonzero(open_before)
        return pa.table([pa.array(site[at]), table.column("_block").take(pa.array(at)), pa.array(status[at], pa.int32()), pa.array(keeper[at])],
                        names=["_site", "_block", "_status", "_keeper"])

    def run(rows: DataFrame) -> DataFrame:
        ready = rows.withColumn("_s", F.unix_timestamp("ts")).repartition(*by).sortWithinPartitions(*by, "_ord", "lat", "lon", "ts")
        needed = ["_site", "_block", "_own", "_status", "lat", "lon", "_s", "_x", "_y", "_z", "_t"]
        return stored(ready.select(*needed).mapInArrow(whole_groups(by, walk), schema), "decided")

    found = run(copies.withColumn("_status", F.lit(UNDECIDED)))
    settled = [found.where(F.col("_status") != UNDECIDED)]
    waiting = found.where(F.col("_status") == UNDECIDED)
    while not waiting.isEmpty():
        known = settled[0]
        for part in settled[1:]:
            known = known.unionByName(part)
        again = copies.join(waiting.select("_block").distinct(), "_block", "left_semi").join(known.select("_site", "_status"), "_site", "left")
        found = run(again.withColumn("_status", F.coalesce("_status", F.lit(UNDECIDED))))
        settled.append(found.where(F.col("_status") != UNDECIDED))
        waiting = found.where(F.col("_status") == UNDECIDED)
    homes = settled[0]
    for part in settled[1:]:
        homes = homes.unionByName(part)
    return homes.select("_site", "_keeper")


def with_fallback(standard: DataFrame, near_real_time: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """Standard-processing rows, and near-real-time rows for chunks without any."""
    covered = standard.select(*chunk).distinct()
    gaps = near_real_time.join(covered, list(chunk), "left_anti")
    return (standard.withColumn("processing_tier", F.lit("SP"))
            .unionByName(gaps.withColumn("processing_tier", F.lit("NRT"))))


def nearest_alarm(points: DataFrame, alarms: DataFrame, reach_m: float, mean_lat: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``dist_m`` and ``alarm_id`` of the nearest alarm cell within ``reach_m`` (else NULL; ties
    go to the smallest id, distances within 0.1 mm count as equal), among those with equal columns ``by``. Degrees become metres at ``mean_lat``, by default the points' mean latitude.

    Points meet only alarm cells of the 3x3 buckets around them. Alarm cells sit on a grid and cells of
    one place count once, so the candidates per point are bounded by the reach, not by the data.
    """
    if mean_lat is None:
        mean_lat = points.agg(F.avg("lat")).first()[0] or 0.0
    mx = config.METERS_PER_DEG_LON * math.cos(math.radians(mean_lat))
    my = config.METERS_PER_DEG_LAT
    px = points.withColumns({"_x": F.col("lon") * mx, "_y": F.col("lat") * my})
    places = alarms.groupBy("lon", "lat", *by).agg(F.min("alarm_id").alias("alarm_id"))
    al = places.select(*by, "alarm_id", (F.col("lon") * mx).alias("_ax"), (F.col("lat") * my).alias("_ay"))
    bucket = lambda c: F.floor(F.col(c) / reach_m)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = al.withColumn("_n", around).select(*by, "alarm_id", "_ax", "_ay", (bucket("_ax") + F.col("_n.a")).alias("_bx"),
                                                (bucket("_ay") + F.col("_n.b")).alias("_by"))
    sites = px.select(*by, "_x", "_y").distinct().withColumns({"_bx": bucket("_x"), "_by": bucket("_y")})
    dx, dy = F.col("_x") - F.col("_ax"), F.col("_y") - F.col("_ay")
    met = lambda some: some.join(spread, [*by, "_bx", "_by"]).withColumn("dist_m", F.sqrt(dx * dx + dy * dy)).where(F.col("dist_m") <= reach_m)
    # the least distance first, a plain number that is kept in a hash table: the candidates are never sorted
    least = met(sites).groupBy(*by, "_x", "_y").agg(F.min(F.round("dist_m", 4)).alias("_least"))
    best = (met(sites.join(least, [*by, "_x", "_y"])).where(F.round("dist_m", 4) == F.col("_least")).groupBy(*by, "_x", "_y")
            .agg(F.min(F.struct("alarm_id", "dist_m")).alias("_near")))
    joined = px.join(best, [*by, "_x", "_y"], "left")
    return joined.withColumns({"dist_m": F.col("_near.dist_m"), "alarm_id": F.col("_near.alarm_id")}).drop("_near", "_x", "_y")


def corroboration(located: DataFrame, n_alarms: DataFrame, radii: Sequence[float] = config.FIRE_RADII_M, by: Sequence[str] = ()) -> DataFrame:
    """Recovery and corroboration rates per radius. ``n_alarms``: one row with column n_alarms, or
    with ``by`` one row for each of these keys, all of which are returned."""
    hit = lambda r: F.coalesce(F.col("dist_m") <= r, F.lit(False))
    per = located.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"), *[e for i, r in enumerate(radii) for e in (
        F.count_if(hit(r)).alias(f"h{i}"), F.count_distinct(F.when(hit(r), F.col("alarm_id"))).alias(f"a{i}"),
        share(F.when(F.col("frp") >= 5.0, hit(r))).alias(f"f{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius_m"), F.col(f"h{i}").alias("recovered_points"),
                                        F.col(f"a{i}").alias("corroborated_alarms"), F.col(f"f{i}").alias("high_frp_recovery"))
                               for i, r in enumerate(radii)]))
    if by:
        per = n_alarms.join(per, list(by), "left").fillna(0, ["n_points", *[f"{c}{i}" for i in range(len(radii)) for c in "ha"]])
    else:
        per = per.withColumn("n_alarms", n_alarms.scalar())
    flat = per.select(*by, "n_points", "n_alarms", rows.alias("_r")).select(*by, "n_points", "n_alarms", "_r.*")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return flat.withColumns({"recovery_rate": ratio("recovered_points", "n_points"),
                             "corroboration_rate": ratio("corroborated_alarms", "n_alarms"),
                             "high_frp_recovery": F.coalesce("high_frp_recovery", F.lit(0.0))})


def corroboration_by_epoch(points: DataFrame, alarms: DataFrame, windows: DataFrame, radii: Sequence[float] = config.FIRE_RADII_M) -> DataFrame:
    """Rates per epoch and radius: the points inside an epoch's time window against the alarms of that epoch.

    ``alarms``: alarm_id, epoch, lon, lat. ``windows``: one row per epoch with from_day and to_day, both
    inside. Every epoch of ``windows`` is returned.
    """
    n_alarms = alarms.groupBy("epoch").agg(F.count_distinct("alarm_id").alias("n_alarms"))
    located = _located_by_epoch(points, alarms, windows, max(radii))
    return corroboration(located, windows.select("epoch").join(n_alarms, "epoch", "left").fillna(0, ["n_alarms"]), radii, ["epoch"])


def corroboration_over_epochs(points: DataFrame, alarms: DataFrame, windows: DataFrame, radii: Sequence[float] = config.FIRE_RADII_M) -> DataFrame:
    """Rates per radius over all epochs: each point counts in the epochs whose window holds its day, and an
    alarm only for points of its own epoch. Arguments as in ``corroboration_by_epoch``."""
    located = _located_by_epoch(points, alarms, windows, max(radii))
    return corroboration(located, alarms.agg(F.count_distinct("alarm_id").alias("n_alarms")), radii)


def _located_by_epoch(points: DataFrame, alarms: DataFrame, windows: DataFrame, reach_m: float) -> DataFrame:
    """Points with the nearest alarm of their epochs. Windows are listed by day, so the join is on the day."""
    days = windows.select("epoch", F.explode(F.sequence("from_day", "to_day")).alias("_day"))
    inside = points.withColumn("_day", F.to_date("ts")).join(F.broadcast(days), "_day").drop("_day")  # a row per day of an epoch, however many points
    return nearest_alarm(inside, alarms, reach_m, points.agg(F.avg("lat")).first()[0], ["epoch"])


def lag_recovery(located: DataFrame, lag: str, radius_m: float = 375.0) -> DataFrame:
    """Points and recovery rate per lag interval, intervals without points included."""
    spark = located.sparkSession
    bins = spark.createDataFrame(list(config.LAG_BINS_DAYS), "lag_from int, lag_to int")
    name = None
    for low, high in config.LAG_BINS_DAYS:
        inside = F.col(lag).between(low, high)
        name = F.when(inside, low) if name is None else name.when(inside, low)
    hit = F.coalesce(F.col("dist_m") <= radius_m, F.lit(False))
    got = (located.withColumn("lag_from", name).where("lag_from IS NOT NULL").groupBy("lag_from")
           .agg(F.count(F.lit(1)).alias("n_points"), share(hit).alias("recovery_rate")))
    return (F.broadcast(bins).join(got, "lag_from", "left").fillna(0, ["n_points"]).fillna(0.0, ["recovery_rate"]))
