"""Audits of injected copies against their sources: lineage joins, deltas, segment structure, identifiability tiers and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions import geo

from .guards import exact_join

#: The model features compared between a copy and its source.
MODEL = ("dt", "distance", "speed", "acceleration", "turn", "stop_s", "bearing_sin", "bearing_cos")
COORD_ATOL_M, FEATURE_ATOL, FEATURE_RTOL = 1e-6, 1e-5, 1e-8
TIERS = ("tier1", "tier2", "tier3", "tier4")


def with_bearing_parts(features: DataFrame) -> DataFrame:
    sine, cosine = geo.bearing_sin_cos(F.col("bearing"))
    return features.withColumns({"bearing_sin": sine, "bearing_cos": cosine})


def attach_source_quality(copies: DataFrame, originals: DataFrame) -> DataFrame:
    """source_quality_valid of the original point of each copied one, from the original and not from the copy; null where no original stands."""
    source = originals.select(F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index", F.col("is_training_eligible").alias("source_quality_valid"))
    return copies.join(source, ["source_trajectory_id", "source_point_index"], "left")


def attach_by_position(copies: DataFrame, originals: DataFrame) -> DataFrame:
    """The same by the rank of a point in its trajectory, for copies whose times and indices differ from the original's."""
    rank = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("elapsed_us", "source_point_index"))
    source = originals.select(F.col("trajectory_id").alias("source_trajectory_id"), rank("trajectory_id").alias("_nth"), F.col("is_training_eligible").alias("source_quality_valid"))
    return copies.withColumn("_nth", rank("trajectory_id")).join(source, ["source_trajectory_id", "_nth"], "left").drop("_nth")


def aligned(copies: DataFrame, originals: DataFrame) -> DataFrame:
    """Each copied point with its original, whose columns get the prefix original_; many copies to one original. A copy without one fails the job."""
    columns = ["user_id", "elapsed_us", "latitude", "longitude", "bearing", "is_training_eligible", *MODEL]
    source = originals.select(F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index", *[F.col(c).alias(f"original_{c}") for c in columns])
    return exact_join(copies, source, ["source_trajectory_id", "source_point_index"])


def point_deltas(pairs: DataFrame) -> DataFrame:
    """Displacement, time and feature differences of copied points, with the feature count changed beyond tolerance."""
    p = pairs.withColumns({
        "displacement_m": geo.haversine(*[F.col(c) for c in ("original_latitude", "original_longitude", "latitude", "longitude")]),
        "time_delta_s": (F.col("elapsed_us") - F.col("original_elapsed_us")) / 1e6,
        "coordinate_changed": (F.col("latitude") != F.col("original_latitude")) | (F.col("longitude") != F.col("original_longitude")),
        **{f"{c}_delta": F.col(c) - F.col(f"original_{c}") for c in MODEL},
        **{f"{c}_changed": ~geo.nearly_equal(F.col(c), F.col(f"original_{c}"), FEATURE_ATOL, FEATURE_RTOL) for c in MODEL},
    })
    number = sum((F.col(f"{c}_changed").cast("int") for c in MODEL), F.lit(0))
    p = p.withColumns({"displaced": F.col("displacement_m") > COORD_ATOL_M, "changed_features": number})
    return p.withColumns({"feature_category": geo.feature_category(F.col("changed_features")), "displacement_bin": geo.displacement_bin(F.col("displacement_m"))})


def segment_structure(deltas: DataFrame) -> DataFrame:
    """Label runs of full copies: position, length, boundary, progression bucket, and what neighbours and the past were displaced."""
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("anomaly_label") == 1
    start = (on & ~F.coalesce(F.lag("anomaly_label").over(w) == 1, F.lit(False))).cast("int")
    p = deltas.withColumns({
        "previous_displaced": F.coalesce(F.lag("displaced").over(w), F.lit(False)),
        "next_displaced": F.coalesce(F.lead("displaced").over(w), F.lit(False)),
        "past_displaced": F.coalesce(F.sum(F.col("displaced").cast("int")).over(past), F.lit(0)).cast("bigint"),
        "propagated_only": ~F.col("displaced") & (F.col("changed_features") > 0),
        "_run": F.sum(start).over(w),
    })
    run = Window.partitionBy("trajectory_id", "anomaly_label", "_run")
    position = F.row_number().over(run.orderBy("source_point_index")) - 1
    length = F.count("*").over(run)
    p = p.withColumns({"segment_position": F.when(on, position).otherwise(-1).cast("bigint"), "segment_length": F.when(on, length).otherwise(0).cast("bigint"), "label_run": F.when(on, F.col("_run")).cast("bigint")})
    relative = geo.relative_position(F.col("segment_position"), F.col("segment_length"))
    at = F.col("segment_position")
    edge = F.when(F.col("segment_length") == 1, "singleton").when(at == 0, "start").when(at == F.col("segment_length") - 1, "end").otherwise("interior")
    return p.withColumns({"relative_position": F.when(on, relative), "boundary": F.when(on, edge).otherwise("outside"), "bucket": F.when(on, geo.position_bucket(relative)).otherwise("outside")}).drop("_run")


def tiers(points: DataFrame, signals: tuple[str, ...], atol: float = 1e-5, rtol: float = 1e-8) -> DataFrame:
    """identifiability_tier: 1 displaced, 2 a derived feature changed, 3 a context score changed, 4 nothing did.

    signals name pairs of columns <s>_synthetic_m and <s>_original_m. A point whose context can't be compared is no tier 4: its tier is null.
    """
    changed, complete = F.lit(False), F.lit(True)
    for s in signals:
        a, b = F.col(f"{s}_synthetic_m"), F.col(f"{s}_original_m")
        known = a.isNotNull() & b.isNotNull()
        changed = changed | F.coalesce(known & ~geo.nearly_equal(a, b, atol, rtol), F.lit(False))
        complete = complete & known
    tier = F.when(F.col("displaced"), "tier1").when(F.col("changed_features") > 0, "tier2").when(changed, "tier3").when(complete, "tier4")
    return points.withColumns({"context_changed": changed, "context_complete": complete, "identifiability_tier": tier, "observable": F.coalesce(tier != "tier4", F.lit(False))})


def unpivoted_deltas(deltas: DataFrame) -> DataFrame:
    """(feature, delta, changed): one row for each point and feature."""
    return deltas.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_delta").alias("delta"), F.col(f"{c}_changed").alias("changed")) for c in MODEL])))


def counts_by(points: DataFrame, column: str, values: tuple[str, ...], prefix: str = "") -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]


def segment_audit(structured: DataFrame) -> DataFrame:
    """Per copy: labelled points, zero and largest displacement, unlabelled changes, speeds and jumps inside the segment."""
    on = F.col("anomaly_label") == 1
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index")
    at = [F.col(c) for c in ("latitude", "longitude")]
    before = [F.lag(c).over(w) for c in ("latitude", "longitude")]
    p = structured.withColumn("step_m", F.coalesce(geo.haversine(*before, *at), F.lit(0.0)))
    inside = lambda c: F.count_if(on & c)
    return p.groupBy("trajectory_id", "anomaly_type").agg(
        F.count("*").alias("points"), F.count_if(on).alias("labelled"), F.min(F.when(on, F.col("source_point_index"))).alias("first_index"), F.max(F.when(on, F.col("source_point_index"))).alias("last_index"),
        inside(F.col("is_training_eligible")).alias("evaluated"), inside(~F.col("displaced")).alias("zero_displacement"), inside(F.col("changed_features") == 0).alias("near_identical"),
        F.count_if(~on & F.col("displaced")).alias("unlabelled_displaced"), F.count_if(~on & (F.col("changed_features") > 0)).alias("unlabelled_changed"),
        F.round(F.max(F.when(on, F.col("displacement_m"))), 4).alias("max_displacement_m"), inside(F.col("speed") > 50).alias("fast"), inside((F.col("step_m") > 1000) & (F.col("dt") <= 60)).alias("jumps"),
    )


def contingency(points: DataFrame, label: str, other: str) -> DataFrame:
    """Counts of all four cells of two flags; cells without rows count 0."""
    grid = points.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (False, True)], f"{label} int, {other} boolean")
    found = points.groupBy(label, other).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(found, [label, other], "left").select(label, other, F.coalesce("n", F.lit(0)).alias("points"))  # four rows
