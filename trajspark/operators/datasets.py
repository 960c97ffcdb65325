"""Splits and injected anomalies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions import geo

from .movement import movement_features, quality_flags

TYPES = ("route_deviation", "abnormal_speed", "long_stop", "direction_change")


def user_splits(users: DataFrame, seed: int = 42, all_splits: bool = False) -> DataFrame:
    """Users in hashed order, 60/20/20; all rows of a user stay together.

    Validation and test get a fifth each, rounded half to even, at least one user. With fewer than three users train (then validation) stays empty;
    with all_splits that is an error, raised inside the job. Hashes are even, so users are ranked within the 256 parts of their first byte, and no task orders them all.
    """
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "user_id"), 256)
    ranked = users.select("user_id").distinct().withColumn("k", key).withColumn("part", F.substring("k", 1, 2))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy("part").agg(F.count("*").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("below"), F.sum("own").over(Window.partitionBy()).alias("n"))
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("k", "user_id")))
    ranked = ranked.join(F.broadcast(parts), "part").withColumn("i", F.col("i") + F.col("below"))  # 256 rows at most
    fifth = F.greatest(F.lit(1), F.bround(F.col("n") * 0.2))
    name = F.when(F.col("i") <= F.col("n") - 2 * fifth, "train").when(F.col("i") <= F.col("n") - fifth, "val").otherwise("test")
    if all_splits:
        name = F.when(F.col("n") < 3, F.raise_error(F.lit("fewer than three users: a split would be empty"))).otherwise(name)
    return ranked.select("user_id", name.alias("dataset_split"))


def segments(points: DataFrame, seed: int = 42) -> DataFrame:
    """Per trajectory and anomaly type: the segment's first index and length, drawn by hash: 10 to 30 points, at most all but two, and never
    the first or the last point. Shorter trajectories than 12 points have none. Indices count from 0 without holes."""
    t = points.groupBy("trajectory_id").agg(F.count("*").alias("n")).where("n >= 12")
    t = t.withColumn("anomaly_type", F.explode(F.lit(list(TYPES))))
    parts = (F.lit(seed), F.col("trajectory_id"), F.col("anomaly_type"))
    t = t.withColumn("segment_length", (10 + geo.hash_draw(1, F.least(F.lit(30), F.col("n") - 2) - 9, *parts)).cast("bigint"))
    return t.withColumn("segment_start", (1 + geo.hash_draw(2, F.col("n") - F.col("segment_length") - 1, *parts)).cast("bigint"))


def inject(features: DataFrame, seed: int = 42) -> DataFrame:
    """A labelled copy of every trajectory for each anomaly type, its positions or times changed within the segment; no features yet.

    route_deviation: moved across the chord of the segment by 100 to 300 m, half-sine weights. abnormal_speed: steps take the time of a
    target speed, 3 to 5 times the segment's median speed (3 m/s if it stands) within 10 to 45 m/s; later points move along in time. long_stop:
    extended to 120 s where the trajectory has them, then held with 1 m of jitter. direction_change: alternately 15 to 40 m north and south.
    trajectory_id names the copy, source_trajectory_id its source. The windows of a copy share one shuffle.
    """
    j = features.drop("anomaly_label").join(segments(features, seed), "trajectory_id")
    i, start, kind = F.col("source_point_index"), F.col("segment_start"), F.col("anomaly_type")
    whole = Window.partitionBy("trajectory_id", "anomaly_type")
    own = whole.orderBy("source_point_index")
    at = lambda c, index: F.max(F.when(i == index, F.col(c))).over(whole)
    far = (i >= start + F.col("segment_length") - 1) & (F.col("elapsed_us") - F.col("_t") >= 120_000_000)
    j = j.withColumn("_t", at("elapsed_us", start)).withColumn("_reach", F.min(F.when(far, i)).over(whole))
    end = F.when(kind == "long_stop", F.least(F.col("n") - 1, F.coalesce(F.col("_reach") + 1, F.col("n") - 1))).otherwise(start + F.col("segment_length"))
    j = j.withColumn("segment_end", end)
    stop = F.col("segment_end")
    inside = (i >= start) & (i < stop)
    share = lambda k, *more: geo.hash_draw(k, F.lit(1_000_000), F.lit(seed), F.col("trajectory_id"), kind, *more) / 1e6
    j = j.withColumns({
        "_inside": inside, "_u": share(3), "_v": share(4, i),
        "_lat": at("latitude", start), "_lon": at("longitude", start), "_lat_e": at("latitude", stop - 1), "_lon_e": at("longitude", stop - 1),
        "_median": F.percentile(F.when(inside & (F.col("speed") > 0), F.col("speed")), 0.5).over(whole),
    })
    inside, u, v = F.col("_inside"), F.col("_u"), F.col("_v")
    heading = F.atan2(F.col("_lat_e") - F.col("_lat"), (F.col("_lon_e") - F.col("_lon")) * F.cos(F.radians("_lat")))
    push = (100 + 200 * u) * F.sin(3.141592653589793 * (i - start) / F.greatest(stop - start - 1, F.lit(1)))
    target = F.least(F.lit(45.0), F.greatest(F.lit(10.0), F.coalesce("_median", F.lit(3.0)) * (3 + 2 * u)))
    sign = F.when((i - start) % 2 == 0, 1).otherwise(-1)
    lat = F.when(~inside, F.col("latitude")).when(kind == "route_deviation", F.col("latitude") - F.cos(heading) * push / geo.METRES_PER_DEGREE)
    lat = lat.when(kind == "long_stop", F.col("_lat") + (2 * v - 1) / geo.METRES_PER_DEGREE).when(kind == "direction_change", F.col("latitude") + sign * (15 + 25 * u) / geo.METRES_PER_DEGREE).otherwise(F.col("latitude"))
    fast = F.round(F.greatest(F.greatest("distance", F.lit(0.001)) / target, F.lit(0.001)) * 1e6).cast("bigint")
    step = F.when(inside & (kind == "abnormal_speed"), fast).otherwise(F.coalesce(F.col("elapsed_us") - F.lag("elapsed_us").over(own), F.lit(0)))
    j = j.withColumns({"_new": lat, "_step": step})
    wide = lambda c: geo.METRES_PER_DEGREE * F.greatest(F.lit(1e-6), F.cos(F.radians(c)))
    lon = F.when(inside & (kind == "route_deviation"), F.col("longitude") + F.sin(heading) * push / wide("_new"))
    lon = lon.when(inside & (kind == "long_stop"), F.col("_lon") + (2 * v - 1) / wide("_lat")).otherwise(F.col("longitude"))
    j = j.withColumns({"longitude": lon, "elapsed_us": F.min("elapsed_us").over(whole) + F.sum("_step").over(own), "anomaly_label": inside.cast("int")})
    kept = [c for c in ("user_id", "dataset_split", "score") if c in features.columns]
    name = F.concat_ws("__", "trajectory_id", "anomaly_type", F.lit("01"))
    return j.select(*kept, name.alias("trajectory_id"), F.col("trajectory_id").alias("source_trajectory_id"), "anomaly_type", "source_point_index", "anomaly_label", "segment_start", "segment_end", "elapsed_us", F.col("_new").alias("latitude"), "longitude")


def injected(features: DataFrame, seed: int = 42) -> DataFrame:
    """The copies of `inject` with movement features and quality flags of their own points."""
    return quality_flags(movement_features(inject(features, seed)))


def rotated(points: DataFrame, metres: float) -> DataFrame:
    """The points turned about the earth's axis so that each trajectory's first point moves by `metres`: an isometry of the sphere."""
    first = points.groupBy("trajectory_id").agg(F.min_by("latitude", F.struct("elapsed_us", "source_point_index")).alias("_lat0"))
    angle = F.degrees(2 * F.asin(math.sin(metres / (2 * geo.EARTH_RADIUS_M)) / F.cos(F.radians("_lat0"))))
    moved = points.join(first, "trajectory_id")
    return moved.withColumn("longitude", F.pmod(F.col("longitude") + angle + 180.0, F.lit(360.0)) - 180.0).drop("_lat0")


def copy_completeness(points: DataFrame, copies: DataFrame) -> DataFrame:
    """Per source trajectory: has it a copy of all types, one of each, and as many points in each."""
    s = copies.groupBy("source_trajectory_id").agg(F.countDistinct("anomaly_type").alias("types"), F.countDistinct("trajectory_id").alias("samples"), F.count("*").alias("points"))
    o = points.groupBy(F.col("trajectory_id").alias("source_trajectory_id")).agg(F.count("*").alias("n"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return o.join(s, "source_trajectory_id", "left").select("source_trajectory_id", (z("types") == len(TYPES)).alias("all_types"), (z("samples") == z("types")).alias("one_each"), (z("points") == len(TYPES) * F.col("n")).alias("same_points"))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer join on keys with the side of each row: both, left_only or right_only. Null keys equal each other."""
    a, b = left.withColumn("_l", F.lit(1)).alias("a"), right.withColumn("_r", F.lit(1)).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    rest = [F.col(f"a.{c}") for c in left.columns if c not in keys] + [F.col(f"b.{c}") for c in right.columns if c not in keys and c not in left.columns]
    return a.join(b, same, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *rest, side.alias("side"))
