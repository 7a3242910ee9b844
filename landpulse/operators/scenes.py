"""Scene catalogue: flattening, normalisation, pairing and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landpulse.functions.core import as_col
from landpulse.functions.geo import bbox_coverage
from landpulse.operators.ordered import bucketed, bucketed_row_number
from landpulse.session import cut_lineage

FEATURE_SCHEMA = ("features array<struct<id:string,bbox:array<double>,properties:struct<datetime:string,"
                  "`eo:cloud_cover`:double,platform:string>,assets:map<string,struct<href:string>>>>")


def flatten_catalog(pages: DataFrame, column: str = "value") -> DataFrame:
    """Catalogue response pages (JSON text) to one row per scene."""
    parsed = pages.select(F.explode(F.from_json(column, FEATURE_SCHEMA)["features"]).alias("f"))
    return parsed.select(F.col("f.id").alias("scene_id"), F.to_timestamp("f.properties.datetime").alias("dt"),
                         F.col("f.properties.`eo:cloud_cover`").alias("cloud"), F.col("f.properties.platform").alias("platform"),
                         F.col("f.bbox").alias("bbox"), F.transform_values("f.assets", lambda _, v: v["href"]).alias("assets"))


def polarization(value) -> Column:
    """Canonical code of a polarisation text."""
    raw = as_col(value)
    text = F.regexp_replace(F.regexp_replace(F.upper(F.trim(raw)), " ", ""), "[,/]", "+")
    return (F.when(text.isin("DV", "VV+VH", "VH+VV"), "DV").when(text.isin("SV", "VV"), "SV")
            .when(text.isin("SH", "HH"), "SH").when(text.isin("DH", "HH+HV", "HV+HH"), "DH").otherwise(raw))


def absolute_orbit(product_id) -> Column:
    """Orbit number of a radar product name; without a canonical name, the last bare 5..7 digit
    token below 100000."""
    pid = as_col(product_id)
    canonical = F.regexp_extract(pid, r"_([0-9]{6})_[0-9A-F]{6}_[0-9A-F]{4}(?:\.SAFE)?$", 1)
    bare = F.filter(F.split(pid, "_"), lambda t: t.rlike("^[0-9]{5,7}$") & (t.cast("int").between(1000, 99999)))
    return F.when(canonical != "", canonical.cast("int")).otherwise(F.when(F.size(bare) > 0, F.element_at(bare, -1).cast("int")))


def normalize_radar_scenes(items: DataFrame) -> DataFrame:
    """One row per radar scene from the alternative property keys providers use."""
    first = lambda *names: F.coalesce(*[F.col(n) for n in names])
    pid = first("s1_product_id", "product_identifier", "id")
    absolute = absolute_orbit(pid)
    derived = F.when(F.substring(pid, 1, 3) == "S1A", F.pmod(absolute - 73, F.lit(175)) + 1)
    return items.select("id", pid.alias("product_id"), first("datetime", "start_datetime").alias("datetime"),
                        F.coalesce(first("platform", "constellation"), F.substring(pid, 1, 3)).alias("platform"),
                        first("orbit_state", "orbit_direction").alias("direction"),
                        F.coalesce(first("relative_orbit", "relative_orbit_number"), derived).cast("int").alias("rel_orbit"),
                        absolute.alias("abs_orbit"), first("instrument_mode", "acquisition_mode").alias("mode"),
                        polarization(first("s1_polarization", "polarization")).alias("polarization"),
                        F.expr("try_cast(coalesce(s1_slice_number, slice_number) AS int)").alias("slice_number"))


def has_assets(keys, required: Sequence[str]) -> Column:
    """All required asset keys present, whatever their case."""
    upper = F.transform(as_col(keys), lambda k: F.upper(k))
    return F.forall(F.array(*[F.lit(r.upper()) for r in required]), lambda r: F.array_contains(upper, r))


def neighbours_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                       payload: Sequence[str], bucket_days: int = 30) -> DataFrame:
    """Adds ``before`` (latest right row at or before the left time) and ``after`` (next one).

    Right times must be unique per key. Both sides are sorted together inside (key, time bucket);
    the nearest rows of other buckets come from a table of one row per bucket, so a busy key is
    split over its buckets and no pairs are listed.
    """
    keys = list(keys)
    pack = F.struct(F.col(right_time).alias("t"), *payload)
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (bucket_days * 86400))
    rights = right.select(*keys, F.col(right_time).alias("_t"), bucket(right_time).alias("_b"), F.lit(0).alias("_side"), pack.alias("_p"))
    lefts = left.select(*keys, F.col(left_time).alias("_t"), bucket(left_time).alias("_b"), F.lit(1).alias("_side"),
                        F.struct(*left.columns).alias("_l"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side")
    local = both.withColumns({
        "_prev": F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.first("_p", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("_side = 1")
    ends = both.groupBy(*keys, "_b").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
    per_key = Window.partitionBy(*keys).orderBy("_b")
    carry = ends.select(*keys, "_b",
                        F.last("_last", ignorenulls=True).over(per_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
                        F.first("_first", ignorenulls=True).over(per_key.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"))
    out = local.join(carry, [*keys, "_b"])
    return out.select("_l.*", F.coalesce("_prev", "_cp").alias("before"), F.coalesce("_next", "_cn").alias("after"))


def nearest_scene(targets: DataFrame, scenes: DataFrame, keys: Sequence[str], target_time: str = "target") -> DataFrame:
    """Closest scene in time per target; ties by cloud (missing = 999), then id."""
    order = F.struct(F.coalesce("cloud", F.lit(999.0)), F.col("scene_id"))
    per_time = scenes.groupBy(*keys, "dt").agg(F.min_by(F.struct("cloud", "scene_id"), order).alias("_s"))
    per_time = per_time.select(*keys, "dt", F.col("_s.cloud").alias("cloud"), F.col("_s.scene_id").alias("scene_id"))
    both = neighbours_in_time(targets, per_time, keys, target_time, "dt", ["cloud", "scene_id"])
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1000000.0
    gap = lambda side: F.abs(seconds(f"{side}.t") - seconds(target_time)) / 86400.0
    key = lambda side: F.struct(gap(side).alias("gap"), F.coalesce(F.col(f"{side}.cloud"), F.lit(999.0)).alias("c"), F.col(f"{side}.scene_id").alias("scene_id"))
    best = F.array_min(F.filter(F.array(F.when(F.col("before").isNotNull(), key("before")), F.when(F.col("after").isNotNull(), key("after"))),
                                lambda x: x.isNotNull()))
    return both.withColumn("_b", best).select(*targets.columns, F.col("_b.scene_id").alias("scene_id"), F.col("_b.gap").alias("gap_days"))


def best_pair(before: DataFrame, after: DataFrame, keys: Sequence[str], preferred_orbit: int | None = None,
              max_days: int = 400) -> DataFrame:
    """Strongest geometry-matched pair per key group.

    Direction, mode and relative orbit must agree and both scenes must be dual-polarised. The
    score rewards equal platform, equal slice and the preferred orbit, and falls with the
    distance of the gap from one year. For each of the four ways platform and slice can agree,
    only the two scenes next to the ideal time can win, so each scene meets at most eight
    partners instead of its whole orbit.
    """
    hard = [*keys, "direction", "mode", "rel_orbit"]
    usable = lambda d: d.where((F.col("pol") == "DV") & F.col("rel_orbit").isNotNull() & F.col("dt").isNotNull())
    b, a = usable(before), usable(after)
    ideal = a.withColumn("_ideal", F.timestamp_seconds(F.unix_seconds(F.col("dt").cast("timestamp")) - F.lit(int(365.25 * 86400))))
    # the ways platform and slice can agree, as extra key columns; "*" agrees with everything
    any_, plat, slc = F.lit("*"), F.col("platform").cast("string"), F.col("slice_number").cast("string")
    ways = F.array(*[F.struct(F.lit(i).alias("_way"), x.alias("_plat"), y.alias("_slice"))
                     for i, (x, y) in enumerate(((any_, any_), (plat, any_), (any_, slc), (plat, slc)))])
    known = F.filter(ways, lambda w: w["_plat"].isNotNull() & w["_slice"].isNotNull())
    spread = lambda d: d.withColumn("_w", F.explode(known)).select("*", "_w.*").drop("_w")
    on = [*hard, "_way", "_plat", "_slice"]
    rights = spread(b).groupBy(*on, "dt").agg(F.min("scene_id").alias("before_id"),
                                              *[F.min_by(c, "scene_id").alias(f"b_{c}") for c in ("platform", "slice_number")])
    near = neighbours_in_time(spread(ideal), rights, on, "_ideal", "dt", ["before_id", "b_platform", "b_slice_number"], 90)
    found = F.explode(F.filter(F.array("before", "after"), lambda x: x.isNotNull()))
    pairs = near.select(*hard, F.col("scene_id").alias("after_id"), "dt", "platform", "slice_number", found.alias("_f")).select("*", "_f.*").drop("_f")
    pairs = pairs.withColumnRenamed("t", "before_dt")
    gap = F.abs(F.unix_seconds(F.col("dt").cast("timestamp")) - F.unix_seconds(F.col("before_dt").cast("timestamp"))) / 86400.0
    flag = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0.0)
    preferred = flag(F.col("rel_orbit") == preferred_orbit, 3.0) if preferred_orbit else F.lit(0.0)
    score = (2.0 + flag(F.col("platform") == F.col("b_platform"), 1.0) + flag(F.col("slice_number") == F.col("b_slice_number"), 2.0)
             + preferred - F.abs(gap - 365.25) / 365.25)
    scored = pairs.withColumn("gap_days", gap).where(F.col("gap_days") <= max_days).withColumn("score", score)
    best = F.min_by(F.struct("before_id", "after_id", "rel_orbit", "gap_days", "score"),
                    F.struct(-F.col("score"), F.col("before_id"), F.col("after_id")))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def best_in_windows(targets: DataFrame, scenes: DataFrame, keys: Sequence[str], offset_days: int, half_days: int,
                    order: Sequence[Column], name: str) -> DataFrame:
    """Best scene within ``half_days`` of target - ``offset_days``, per target.

    Targets are regular calendar dates per key. Scenes are sent to the few dates they can serve
    through day buckets of the window's width, and the winner is kept by partial aggregation.
    """
    width = 2 * half_days + 1
    day = F.datediff(F.to_date("dt"), F.lit("1970-01-01"))
    center = F.datediff(F.to_date("target"), F.lit("1970-01-01")) - offset_days
    t = targets.withColumn("_center", center).withColumn("_b", F.explode(F.sequence(
        F.floor((F.col("_center") - half_days) / width), F.floor((F.col("_center") + half_days) / width))))
    sc = scenes.withColumns({"_day": day, "_b": F.floor(day / width)})
    hit = sc.join(t, [*keys, "_b"]).where(F.abs(F.col("_day") - F.col("_center")) <= half_days)
    return hit.groupBy(*keys, "target").agg(F.min_by(F.struct("scene_id", "cloud", "tile_ref"), F.struct(*order)).alias(name))


def rank_scenes(scenes: DataFrame, keys: Sequence[str], reference_box: list, box: list, target) -> DataFrame:
    """Score and rank per key: coverage, cloud and temporal distance. Ranks run over score
    buckets, so one area with very many scenes is not sorted in a single task."""
    gap = F.abs(F.unix_seconds(F.col("dt").cast("timestamp")) - F.unix_seconds(as_col(target).cast("timestamp"))) / 86400.0
    cover = bbox_coverage(reference_box, box)
    scored = scenes.withColumn("score", 3.0 * cover - F.coalesce("cloud", F.lit(100.0)) / 100.0 - 0.05 * F.least(gap, F.lit(30.0)))
    scored = cut_lineage(scored.withColumn("_neg", -F.col("score")))
    return bucketed_row_number(bucketed(scored, keys, "_neg", "_b"), keys, "_b", [F.asc("_neg"), F.asc("scene_id")], "rank").drop("_b", "_neg")
