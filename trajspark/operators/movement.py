"""Movement features, quality flags and trajectory summaries. One window order per trajectory serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions import geo

from . import audits, folds

LONG_GAP_S, MAX_SPEED, JUMP_M, JUMP_S = 300.0, 50.0, 1000.0, 60.0
STOP_M, STOP_SPEED, MOVE_M = 3.0, 0.5, 1.0
MIN_POINTS, MAX_LOW_RATIO = 100, 0.05


def order(*extra: str):
    return Window.partitionBy("trajectory_id").orderBy("elapsed_us", "source_point_index", *extra)


def clean_points(raw: DataFrame) -> DataFrame:
    """Drops null or out-of-range points and, of equal (trajectory, time), all but the first line."""
    ok = raw.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("elapsed_us").isNotNull())
    w = Window.partitionBy("trajectory_id", "elapsed_us").orderBy("source_point_index")
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def positive_intervals(points: DataFrame) -> DataFrame:
    """Drops points that are not later than the one before."""
    gap = F.col("elapsed_us") - F.lag("elapsed_us").over(order())
    return points.withColumn("_gap", gap).where("_gap is null or _gap > 0").drop("_gap")


def movement_features(points: DataFrame) -> DataFrame:
    """dt, step distance, speed, acceleration, bearing (kept while the step is under 1 m), turn and stop duration; zero at the first point."""
    w = order()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumns({"_lat": F.lag("latitude").over(w), "_lon": F.lag("longitude").over(w), "_t": F.lag("elapsed_us").over(w)})
    at = [F.col(c) for c in ("_lat", "_lon", "latitude", "longitude")]
    p = p.withColumns({"dt": F.coalesce((F.col("elapsed_us") - F.col("_t")) / 1e6, F.lit(0.0)), "distance": F.coalesce(geo.haversine(*at), F.lit(0.0)), "_b": geo.bearing(*at)})
    p = p.withColumns({"speed": F.when(F.col("dt") > 0, F.col("distance") / F.col("dt")).otherwise(0.0), "bearing": F.coalesce(F.last(F.when(F.col("distance") >= MOVE_M, F.col("_b")), ignorenulls=True).over(past), F.lit(0.0))})
    p = p.withColumns({
        "acceleration": F.coalesce(F.when(F.col("dt") > 0, (F.col("speed") - F.lag("speed").over(w)) / F.col("dt")), F.lit(0.0)),
        "turn": F.coalesce(geo.angle_difference(F.lag("bearing").over(w), F.col("bearing")), F.lit(0.0)),
        "_stop": (F.col("_t").isNotNull() & (F.col("distance") <= STOP_M) & (F.col("speed") <= STOP_SPEED)).cast("int"),
    })
    p = p.withColumn("_run", F.sum(1 - F.col("_stop")).over(past))
    run = Window.partitionBy("trajectory_id", "_run").orderBy("elapsed_us", "source_point_index").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("stop_s", F.when(F.col("_stop") == 1, F.sum(F.col("dt") * F.col("_stop")).over(run)).otherwise(0.0))
    return p.drop("_lat", "_lon", "_t", "_b", "_stop", "_run")


def quality_flags(features: DataFrame) -> DataFrame:
    first = F.row_number().over(order()) == 1
    f = features.withColumns({
        "is_invalid_time": (F.col("dt") <= 0) & ~first,
        "is_long_gap": F.col("dt") > LONG_GAP_S,
        "is_unrealistic_speed": F.col("speed") > MAX_SPEED,
        "is_gps_jump": (F.col("distance") > JUMP_M) & (F.col("dt") > 0) & (F.col("dt") <= JUMP_S),
        "is_first": first,
    })
    names = ("invalid_time", "long_gap", "unrealistic_speed", "gps_jump")
    low = F.col("is_invalid_time") | F.col("is_long_gap") | F.col("is_unrealistic_speed") | F.col("is_gps_jump")
    return f.withColumns({
        "is_low_quality": low,
        "quality_reason": F.concat_ws(";", *[F.when(F.col(f"is_{n}"), n) for n in names]),
        "is_training_eligible": ~low & ~F.col("is_first"),
    })


def trajectory_quality(flagged: DataFrame) -> DataFrame:
    """Points, low-quality share and eligibility of each trajectory, with the reasons against it."""
    s = flagged.groupBy("user_id", "trajectory_id").agg(
        F.count("*").alias("points"),
        F.count_if("is_low_quality").alias("low_quality_points"),
        F.count_if("is_invalid_time").alias("invalid_times"),
        F.count_if(F.isnan("speed") | F.isnan("distance")).alias("undefined"),
    )
    s = s.withColumn("low_quality_ratio", F.round(F.col("low_quality_points") / F.col("points"), 6))
    reasons = F.concat_ws(";", F.when(F.col("points") < MIN_POINTS, "too_few_points"), F.when(F.col("low_quality_points") > MAX_LOW_RATIO * F.col("points"), "low_quality_ratio"), F.when(F.col("invalid_times") > 0, "time_order"), F.when(F.col("undefined") > 0, "undefined_features"))
    return s.withColumn("exclusion_reason", reasons).withColumn("eligible", F.col("exclusion_reason") == "")


def route_summary(flagged: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 4)
    return flagged.groupBy("trajectory_id").agg(
        F.count("*").alias("points"),
        r((F.max("elapsed_us") - F.min("elapsed_us")) / 1e6).alias("duration_s"),
        r(F.sum("distance")).alias("total_distance_m"),
        r(F.avg("speed")).alias("mean_speed"),
        r(F.max("speed")).alias("max_speed"),
        r(F.min("acceleration")).alias("min_acceleration"),
        r(F.max("acceleration")).alias("max_acceleration"),
        r(F.max("dt")).alias("max_gap_s"),
        F.count_if(F.col("turn") > 90).alias("sharp_turns"),
        F.count_if(F.col("stop_s") > 0).alias("stop_points"),
    )


def full_route_summary(flagged: DataFrame, user: str = "user_id") -> DataFrame:
    """The statistics of one trajectory each: points, first and last time, duration, distance, speeds, accelerations, turns, stop and gap, and limits passed."""
    r = lambda c: F.round(c, 4)
    return flagged.groupBy(user, "trajectory_id").agg(
        F.count("*").alias("points"), F.min("elapsed_us").alias("start_us"), F.max("elapsed_us").alias("end_us"), r((F.max("elapsed_us") - F.min("elapsed_us")) / 1e6).alias("duration_s"), r(F.sum("distance")).alias("total_distance_m"),
        r(F.avg("speed")).alias("mean_speed"), r(F.max("speed")).alias("max_speed"), r(F.min("acceleration")).alias("min_acceleration"), r(F.max("acceleration")).alias("max_acceleration"), r(F.avg("turn")).alias("mean_turn"), r(F.max("turn")).alias("max_turn"),
        r(F.max("stop_s")).alias("max_stop_s"), r(F.max("dt")).alias("max_gap_s"), F.count_if(F.col("speed") > MAX_SPEED).alias("speed_over_50"), F.count_if(F.col("dt") > LONG_GAP_S).alias("gap_over_300"), F.count_if(F.col("stop_s") >= 60).alias("stop_over_60"),
    )


def fingerprints(points: DataFrame) -> DataFrame:
    """SHA-256 of a trajectory's points in time order, the times counted from its first one: copies shifted in time agree. See folds.fingerprints."""
    return folds.fingerprints(points)


def deduplicate(manifest: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Keeps the first trajectory of each fingerprint; earlier cohorts win. Blank fingerprints are never duplicates."""
    w = Window.partitionBy("fingerprint").orderBy("trajectory_id")
    m = manifest.withColumn("copy_number", F.row_number().over(w))
    m = m.join(prior.select("fingerprint").distinct().withColumn("_seen", F.lit(True)), "fingerprint", "left") if prior is not None else m.withColumn("_seen", F.lit(None).cast("boolean"))
    blank = F.coalesce(F.col("fingerprint"), F.lit("")) == ""
    reason = F.when(blank, "").when(F.col("_seen"), "seen_in_earlier_cohort").when(F.col("copy_number") > 1, "duplicate_in_cohort").otherwise("")
    return m.withColumn("exclusion_reason", reason).drop("_seen")


def standard_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population mean and deviation of each column, long form."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("scale")).alias(c) for c in columns])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.scale").alias("scale")) for c in columns])))


def statistical_rule(train: DataFrame, columns: list[str]) -> DataFrame:
    """Median and robust scale of each feature: IQR / 1.349, else the population deviation, else a tiny number."""
    deviations = train.agg(*[F.stddev_pop(c).alias(c) for c in columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])))
    values = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))
    q = audits.percentiles(values, (0.25, 0.5, 0.75), "feature").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("share", "percentile"))).alias("q"))  # three a feature
    iqr, median = (F.col("q")[0.75] - F.col("q")[0.25]) / 1.349, F.col("q")[0.5]
    tiny = 1e-9 * F.greatest(F.lit(1.0), F.abs(median))
    scale = F.when(iqr > 0, iqr).when(F.col("s") > 0, F.col("s")).otherwise(tiny)
    return deviations.join(F.broadcast(q), "feature", "left").select("feature", median.alias("median"), scale.alias("scale"))


def rule_score(df: DataFrame, rule: DataFrame, columns: list[str]) -> DataFrame:
    """Largest |x - median| / scale over the features; the rule is a row per feature, so it is broadcast."""
    wide = rule.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.struct("median", "scale"))).alias(f"_{c}") for c in columns])
    scored = df.join(F.broadcast(wide), F.lit(True))
    parts = [F.abs(F.col(c) - F.col(f"_{c}.median")) / F.col(f"_{c}.scale") for c in columns]
    return scored.withColumn("rule_score", F.greatest(*parts) if len(parts) > 1 else parts[0]).drop(*[f"_{c}" for c in columns])


def marked_points(flagged: DataFrame, turn: float = 120.0, stop_s: float = 60.0) -> DataFrame:
    """The points that a data check would mark, with their marks in order of precedence."""
    marks = {"jump": F.col("is_gps_jump"), "speed": F.col("is_unrealistic_speed"), "gap": F.col("is_long_gap"), "turn": F.col("turn") > turn, "stop": F.col("stop_s") > stop_s}
    p = flagged.select("trajectory_id", "source_point_index", F.concat_ws(";", *[F.when(c, name) for name, c in marks.items()]).alias("markers"))
    return p.where("markers <> ''")


def one_trajectory(points: DataFrame, trajectory_id: str) -> DataFrame:
    """A trajectory's points by time; an unknown one raises, naming some that there are."""
    found = points.where(F.col("trajectory_id") == trajectory_id)
    if found.isEmpty():
        known = [r[0] for r in points.select("trajectory_id").distinct().limit(10).collect()]
        raise ValueError(f"no trajectory {trajectory_id}; there are {', '.join(sorted(map(str, known)))}")
    return found.orderBy(F.asc_nulls_last("elapsed_us"), F.asc_nulls_last("source_point_index"))


def observable(points: DataFrame) -> DataFrame:
    """What a scorer may see: identity, index, time and place, no label."""
    return points.select("user_id", "trajectory_id", "source_point_index", "elapsed_us", "latitude", "longitude")


def thinned(points: DataFrame, every: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("trajectory_id").orderBy("source_point_index"))
    return points.withColumn("_n", n).where((F.col("_n") - 1) % every == 0).drop("_n")


def sliding_windows(points: DataFrame, widths: tuple[int, ...], stride: int) -> DataFrame:
    """Windows of each width that start at every stride-th index, as arrays of (lat_udeg, lon_udeg); only rows that end a window gather one."""
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index")
    at = F.struct("lat_udeg", "lon_udeg")
    ends = lambda n: (F.col("source_point_index") - n + 1) % stride == 0
    p = points.withColumns({f"_w{n}": F.when(ends(n), F.collect_list(at).over(w.rowsBetween(1 - n, 0))) for n in widths})
    rows = F.array(*[F.struct(F.lit(n).alias("width"), F.col(f"_w{n}").alias("w")) for n in widths])
    p = p.select("trajectory_id", F.col("source_point_index").alias("end_index"), F.inline(rows))
    return p.withColumn("start_index", F.col("end_index") - F.col("width") + 1).where((F.size("w") == F.col("width")) & (F.col("start_index") % stride == 0))
