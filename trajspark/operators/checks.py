"""Expectations: each returns counts of violations from one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import null_safe


def regression(new: DataFrame, old: DataFrame, keys: tuple[str, ...], value: str, before: str, tolerance: float) -> DataFrame:
    """Rows of two metric tables by key (nulls equal): same, changed beyond tolerance (null against number too), missing in old or added to it."""
    j = null_safe(new.withColumn("_new", F.lit(1)), old.withColumn("_old", F.lit(1)), keys, "full")
    near = F.coalesce(F.abs(F.col(value) - F.col(before)) <= tolerance, F.col(value).isNull() & F.col(before).isNull())
    status = F.when(F.col("_old").isNull(), "missing").when(F.col("_new").isNull(), "added").when(near, "same").otherwise("changed")
    return j.withColumn("status", status).drop("_new", "_old")


def input_violations(points: DataFrame) -> DataFrame:
    n = F.count_if
    return points.agg(F.count("*").alias("points"), n(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("missing_coordinates"), n(F.col("elapsed_us").isNull()).alias("missing_times"), n(F.abs("latitude") > 90).alias("bad_latitude"), n(F.abs("longitude") > 180).alias("bad_longitude"))


def file_audit(raw: DataFrame) -> DataFrame:
    """Per trajectory file: raw, invalid, reversed and cleaned rows; a file without a valid row keeps its line."""
    ok = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("elapsed_us").isNotNull(), F.lit(False))
    before = F.lag("elapsed_us").over(Window.partitionBy("trajectory_id").orderBy("source_point_index"))
    r = raw.withColumns({"_ok": ok, "_before": before}).groupBy("trajectory_id")
    return r.agg(F.count("*").alias("raw_rows"), F.count_if(~F.col("_ok")).alias("invalid_rows"), F.count_if(F.col("elapsed_us") < F.col("_before")).alias("reversed_times"), F.countDistinct(F.when(F.col("_ok"), F.col("elapsed_us"))).alias("cleaned_rows"), F.when(F.count_if("_ok") == 0, "all_rows_invalid").otherwise("loaded").alias("load_status"))


def feature_ranges(features: DataFrame) -> DataFrame:
    infinite = lambda c: F.abs(c) == float("inf")
    r = lambda c: F.round(c, 4)
    whole = F.max("source_point_index") - F.min("source_point_index") + 1 == F.count("*")
    return features.groupBy("trajectory_id").agg(F.count("*").alias("points"), F.count_if(infinite("speed") | infinite("distance") | infinite("acceleration")).alias("infinite"), r(F.min("speed")).alias("min_speed"), r(F.max("speed")).alias("max_speed"), r(F.min("turn")).alias("min_turn"), r(F.max("turn")).alias("max_turn"), whole.alias("whole_index"))


def key_violations(points: DataFrame, entity: str, index: str) -> DataFrame:
    """Missing, negative and repeated (entity, index) keys; repeats are counted by partial sums, not gathered."""
    keys = points.groupBy(entity, index).agg(F.count("*").alias("n"))
    some = F.when(F.col(entity).isNull() | F.col(index).isNull(), F.col("n")).otherwise(0)
    return keys.agg(F.coalesce(F.sum(some), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col(index) < 0, F.col("n")).otherwise(0)), F.lit(0)).alias("negative"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def user_id_violations(users: DataFrame) -> DataFrame:
    """Ids that are not three ASCII digits, and repeated ones."""
    return users.agg(F.count("*").alias("users"), F.count_if(~F.col("user_id").rlike("^[0-9]{3}$")).alias("malformed"), (F.count("*") - F.countDistinct("user_id")).alias("repeated"))


def split_overlap(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key column: its values, and those that stand in more than one split."""
    long = rows.select("dataset_split", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys]))).distinct()
    n = long.groupBy("key", "value").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("in_several"))


def reference_violations(rows: DataFrame) -> DataFrame:
    """What bars rows from a reference set: another split, low quality, no eligibility; and the train sources there are."""
    return rows.agg(F.count("*").alias("points"), F.count_if(F.col("dataset_split") != "train").alias("foreign_split"), F.count_if("is_low_quality").alias("low_quality"), F.count_if(~F.col("is_training_eligible")).alias("not_eligible"), F.countDistinct(F.when(F.col("dataset_split") == "train", F.col("trajectory_id"))).alias("train_sources"))


def split_violations(rows: DataFrame) -> DataFrame:
    """What must be 0 of rows with dataset_split, user_id, source_trajectory_id, trajectory_id, is_synthetic, anomaly_label: users, sources and samples in several
    splits, synthetic or labelled rows in train, and splits but train that lack a class. And the rows and splits there are."""
    several = [F.count_if(F.col("key") == k).alias(f"{name}_in_several") for k, name in (("user_id", "users"), ("source_trajectory_id", "sources"), ("trajectory_id", "samples"))]
    keys = ("user_id", "source_trajectory_id", "trajectory_id")
    long = rows.select("dataset_split", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys]))).distinct().groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1").agg(*several)
    train, label = F.col("dataset_split") == "train", F.col("anomaly_label") == 1
    g = rows.groupBy("dataset_split").agg(F.count("*").alias("n"), F.count_if(train & F.col("is_synthetic")).alias("s"), F.count_if(train & label).alias("l"), F.count_if(label).alias("a"), F.count_if(~label).alias("b"))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    own = g.agg(z("n").alias("rows"), F.count("*").alias("splits"), z("s").alias("train_synthetic"), z("l").alias("train_labelled"), F.count_if((F.col("dataset_split") != "train") & ((F.col("a") == 0) | (F.col("b") == 0))).alias("splits_lacking_a_class"))
    return own.join(F.broadcast(long), F.lit(True))  # one row each


def reference_set(rows: DataFrame, allowed: DataFrame, fingerprints: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts of what bars rows from a reference set: other splits, synthetic, low quality or not eligible rows, users that are not allowed, trajectories of equal
    fingerprints, and expected (trajectory_id, points) that are missing or have other counts."""
    known = allowed.select("user_id").distinct().withColumn("_known", F.lit(True))
    a = rows.join(known, "user_id", "left").agg(
        F.count("*").alias("points"), F.count_if(F.col("dataset_split") != "train").alias("foreign_split"), F.count_if("is_synthetic").alias("synthetic"), F.count_if("is_low_quality").alias("low_quality"), F.count_if(~F.col("is_training_eligible")).alias("not_eligible"), F.count_if(F.col("_known").isNull()).alias("not_allowed"),
    )
    counts = rows.groupBy("trajectory_id").agg(F.count("*").alias("n"))
    twice = fingerprints.join(counts, "trajectory_id", "left_semi").groupBy("fingerprint").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    whole = expected.join(counts, "trajectory_id", "full").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("points").isNull()).alias("unexpected"), F.count_if(F.col("n") != F.col("points")).alias("other_counts"))
    return a.join(F.broadcast(twice), F.lit(True)).join(F.broadcast(whole), F.lit(True))  # one row each


def causality_violations(nearest: DataFrame) -> DataFrame:
    """Chosen references that are not strictly earlier than their query."""
    return nearest.agg(F.count("*").alias("points"), F.count("nearest_us").alias("found"), F.count_if(F.col("nearest_us") >= F.col("elapsed_us")).alias("violations"))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with repeats) of one side that the other lacks; none: the sets are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left_only")).union(right.exceptAll(left).withColumn("side", F.lit("right_only")))


def manifest(quality: DataFrame, splits: DataFrame) -> DataFrame:
    """One row a trajectory: its quality and its user's split (a row a user, broadcast)."""
    return quality.join(F.broadcast(splits), "user_id", "left").select("trajectory_id", "user_id", "dataset_split", "points", F.col("low_quality_points").alias("low"), "eligible")


def row_digest(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Count and a digest of a set of rows in any order: exclusive or of the rows' hashes, combined before the shuffle."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("digest"))
