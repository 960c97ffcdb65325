"""Queries through files: written by the sinks into the shared folder and read again by the strict readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import alerts, datasets, guards, movement, routes, runs, stored_runs
from trajspark.sources import sinks, strict
from trajspark.sources.gps import gps_points
from trajspark.sources.scratch import saved, shared_folder

from . import models, sql
from .catalog import flagged, register, split_flagged
from .runs import _scored as _scored_sql
from .runs import _RUNS

DATASET = {"user_id": "string", "trajectory_id": "string", "source_point_index": "bigint", "timestamp": "timestamp", "latitude": "double", "longitude": "double", "is_low_quality": "boolean", "quality_reason": "string", "anomaly_label": "int"}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _dataset(points: DataFrame) -> DataFrame:
    return points.withColumn("timestamp", F.timestamp_micros("elapsed_us").cast("timestamp_ntz")).select(*DATASET)


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@register("s7_dataset_csv", sql.FEATURES, "SELECT user_id, trajectory_id, source_point_index, elapsed_us, lat_udeg, lon_udeg, is_low_quality, quality_reason, anomaly_label FROM flagged")
def _(spark, d):
    """S7 and S12: the flagged points as sorted CSV and back, every line typed or the job fails."""
    path = _folder(spark, "dataset")
    sinks.write_sorted_csv(_dataset(flagged(spark, d)), path, list(DATASET), ["trajectory_id", "source_point_index"])
    back = strict.strict(strict.read_dataset_csv(spark, path, DATASET, required=("user_id", "trajectory_id", "timestamp")))
    degree = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    return back.select("user_id", "trajectory_id", "source_point_index", _micros("timestamp").alias("elapsed_us"), degree("latitude").alias("lat_udeg"), degree("longitude").alias("lon_udeg"), "is_low_quality", "quality_reason", "anomaly_label")


@register("s6_file_report", sql.GPS, "SELECT CAST(count(*) AS BIGINT) AS lines, count_if(source_point_index % 40 = 7) AS bad_lines FROM gps")
def _(spark, d):
    """Lines with a broken field are named file by file; the report's sums over all files."""
    path = _folder(spark, "broken")
    p = gps_points(spark, d).withColumns({"timestamp": F.timestamp_micros("elapsed_us").cast("timestamp_ntz"), "latitude": F.when(F.col("source_point_index") % 40 == 7, F.lit("north")).otherwise(F.col("latitude").cast("string"))})
    names = ["user_id", "trajectory_id", "source_point_index", "timestamp", "latitude", "longitude"]
    sinks.write_sorted_csv(p, path, names, ["trajectory_id", "source_point_index"])
    report = strict.file_report(strict.read_dataset_csv(spark, path, {c: DATASET[c] for c in names}))
    return report.agg(F.sum("lines").alias("lines"), F.sum("bad_lines").alias("bad_lines"))


@register("s8_split_load", sql.FEATURES + sql.SPLITS, "SELECT trajectory_id, source_point_index, dataset_split, round(sin(radians(bearing)), 6) + 0.0 AS bearing_sin, round(cos(radians(bearing)), 6) + 0.0 AS bearing_cos FROM flagged JOIN split USING (user_id) WHERE dataset_split = 'test'")
def _(spark, d):
    root = _folder(spark, "splits")
    p = saved(split_flagged(spark, d).select("user_id", "trajectory_id", "source_point_index", "anomaly_label", "is_training_eligible", "bearing", "dataset_split"), "points")
    p.write.partitionBy("dataset_split").parquet(root)
    manifest = p.groupBy("trajectory_id", "dataset_split").agg(F.count("*").alias("points"))
    got = strict.load_split(spark, root, "test", manifest, p)
    return got.select("trajectory_id", "source_point_index", "dataset_split", (F.round("bearing_sin", 6) + 0.0).alias("bearing_sin"), (F.round("bearing_cos", 6) + 0.0).alias("bearing_cos"))


@register("s13_verified_tables", sql.GPS + sql.SPLITS, "SELECT dataset_split, trajectory_id, count(*) AS points FROM gps JOIN split USING (user_id) GROUP BY ALL")
def _(spark, d):
    p = gps_points(spark, d)
    out = sinks.write_verified({"points": p, "splits": datasets.user_splits(p)}, _folder(spark, "tables"))
    return guards.exact_join(out["points"].select("user_id", "trajectory_id"), out["splits"], ["user_id"], whole_right=True).groupBy("dataset_split", "trajectory_id").agg(F.count("*").alias("points"))


@register("s14_window_blocks", sql.GPS, " UNION ALL ".join(f"SELECT {n} AS width, count(*) AS windows FROM (SELECT source_point_index - {n - 1} AS i, count(*) OVER (PARTITION BY trajectory_id ORDER BY source_point_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS n FROM gps) WHERE n = {n} AND i % 10 = 0" for n in (10, 25, 50)))
def _(spark, d):
    """One block a width; the first is written twice, as by a run that was started again."""
    path = _folder(spark, "blocks")
    for n in (10, 25, 50, 10):
        sinks.append_blocks(movement.sliding_windows(gps_points(spark, d), (n,), 10).select("width", "trajectory_id", "start_index", "end_index"), path, ["width"])
    return spark.read.parquet(path).groupBy("width").agg(F.count("*").alias("windows"))


@register("j18_score_attach", sql.FEATURES + sql.SPLITS + f", {_RUNS}, own AS (SELECT f.*, dataset_split FROM flagged f JOIN split USING (user_id) WHERE dataset_split <> 'train'), {_scored_sql('own', 'ro')}", "SELECT trajectory_id, source_point_index, dataset_split, round(run_score, 4) AS run_score, predicted FROM ro WHERE run_no = 3")
def _(spark, d):
    """Every evaluation point with the score of one run; keys, times and places must be those that were scored."""
    own = split_flagged(spark, d).where("dataset_split <> 'train'").select("trajectory_id", "source_point_index", "dataset_split", "elapsed_us", "latitude", "longitude")
    scores = runs.detector_runs(gps_points(spark, d)).where("run = 3").select("trajectory_id", "source_point_index", "elapsed_us", "latitude", "longitude", "run_score", "predicted")
    j = guards.attach_scores(own, scores, ["trajectory_id", "source_point_index"], ["elapsed_us", "latitude", "longitude"])
    return j.select("trajectory_id", "source_point_index", "dataset_split", F.round("run_score", 4).alias("run_score"), "predicted")


@register("d16_scored_csv")
def _(spark, d):
    """D16 on S9: the test users' points as CSV, read with defaults, featured, flagged, scored by all runs, and 2 of 3 votes with a minute's cooldown.

    Points of low quality have no prediction; status and notified as in d16_end_to_end.
    """
    path = _folder(spark, "demo")
    names = ["user_id", "trajectory_id", "timestamp", "latitude", "longitude"]
    test = split_flagged(spark, d).where("dataset_split = 'test'").withColumn("timestamp", F.timestamp_micros("elapsed_us").cast("timestamp_ntz"))
    sinks.write_sorted_csv(test, path, names, ["trajectory_id", "timestamp"])
    read = strict.demo_points(strict.strict(strict.read_dataset_csv(spark, path, {c: DATASET[c] for c in names})))
    return score_points(spark, d, read)


def score_points(spark: SparkSession, d: str, points: DataFrame) -> DataFrame:
    """Points as of demo_points under every run of the store of d: score, prediction, status and notification."""
    from pyspark.sql import Window

    w = Window.partitionBy("trajectory_id").orderBy("timestamp")
    p = points.withColumns({"elapsed_us": _micros("timestamp"), "source_point_index": (F.row_number().over(w) - 1).cast("bigint")})
    f = routes.with_bearing_parts(movement.quality_flags(movement.movement_features(p)))
    s = models.store(spark, d)
    scored = stored_runs.scored(f, s.models, models.MODEL).join(F.broadcast(s.thresholds.select("run", "threshold")), "run")  # a row a run
    scored = saved(scored.withColumn("predicted", F.coalesce((F.col("run_score") > F.col("threshold")).cast("int"), F.lit(0))), "scored")
    streams = scored.select(F.concat_ws("|", F.col("run").cast("string"), "trajectory_id").alias("stream"), "*")
    emitted = alerts.cooldown(alerts.vote_gate(streams.drop("trajectory_id").withColumnRenamed("stream", "trajectory_id"), 3, 2), 60).where("emitted").select(F.col("trajectory_id").alias("stream"), "source_point_index", F.lit(True).alias("_emitted"))
    low = F.col("is_low_quality")
    out = streams.join(emitted, ["stream", "source_point_index"], "left")
    return out.select("model", "seed", "user_id", "trajectory_id", "source_point_index", F.round("run_score", 6).alias("run_score"), F.when(~low, F.col("predicted")).alias("prediction"), F.when(low, "quality_unknown").otherwise("scored").alias("status"), (F.coalesce("_emitted", F.lit(False)) & ~low).alias("notified"))
