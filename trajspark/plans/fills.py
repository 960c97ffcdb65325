"""Queries that take an operator to its full extent: all features, all users, all statistics, all checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import checks, datasets, evaluation, movement, routes
from trajspark.sources.gps import gps_points

from . import sql
from .catalog import copies, features, flagged, register, split_flagged
from .labels import _COHORTS, MODEL
from .points import _FP
from .runs import _COPIED, _copy_runs, _own_runs

_TRAIN = "SELECT * FROM tr WHERE anomaly_label = 0"


@register("d8_train_scaler", _COHORTS, " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0 AS mean, round(stddev_pop({c}), 6) AS scale FROM ({_TRAIN})" for c in MODEL))
def _(spark, d):
    """All eight features, fitted on the training users' normal rows alone."""
    train = routes.with_bearing_parts(split_flagged(spark, d).where("dataset_split = 'train' and is_training_eligible and anomaly_label = 0"))
    return movement.standard_scaler(train, list(MODEL)).select("feature", (F.round("mean", 6) + 0.0).alias("mean"), F.round("scale", 6).alias("scale"))


@register("a5_full_route_summary", sql.FEATURES, """SELECT user_id, trajectory_id, count(*) AS points, min(elapsed_us) AS start_us, max(elapsed_us) AS end_us, round((max(elapsed_us) - min(elapsed_us)) / 1e6, 4) AS duration_s, round(sum(distance), 4) AS total_distance_m, round(avg(speed), 4) AS mean_speed, round(max(speed), 4) AS max_speed,
  round(min(acceleration), 4) AS min_acceleration, round(max(acceleration), 4) AS max_acceleration, round(avg(turn), 4) AS mean_turn, round(max(turn), 4) AS max_turn, round(max(stop_s), 4) AS max_stop_s, round(max(dt), 4) AS max_gap_s, count_if(speed > 50) AS speed_over_50, count_if(dt > 300) AS gap_over_300, count_if(stop_s >= 60) AS stop_over_60 FROM flagged GROUP BY ALL""")
def _(spark, d):
    return movement.full_route_summary(flagged(spark, d))


@register("a12_all_users", sql.FEATURES + sql.SPLITS + """, ev AS (SELECT f.* FROM flagged f JOIN split USING (user_id) WHERE dataset_split = 'test' AND is_training_eligible),
c AS (SELECT s.user_id, s.dataset_split, count_if(anomaly_label = 1 AND predicted = 1) AS tp, count_if(anomaly_label = 0 AND predicted = 1) AS fp, count_if(anomaly_label = 0 AND predicted = 0) AS tn, count_if(anomaly_label = 1 AND predicted = 0) AS fn FROM split s LEFT JOIN ev USING (user_id) GROUP BY ALL)""", """SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr, CASE WHEN tp + fp + tn + fn = 0 THEN 'no_rows' ELSE '' END AS reason FROM c""")
def _(spark, d):
    """Every user of every split, those without evaluated rows with counts of 0, undefined ratios and a reason."""
    p = gps_points(spark, d)
    own = evaluation.confusion(split_flagged(spark, d).where("dataset_split = 'test' and is_training_eligible"), "user_id").drop("accuracy")
    j = datasets.user_splits(p).join(own, "user_id", "left").fillna(0, ["tp", "fp", "tn", "fn"])
    return j.withColumn("reason", F.when(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") == 0, "no_rows").otherwise(""))


_TYPE_ROWS = _COPIED + """, ty AS (SELECT DISTINCT anomaly_type FROM rc), rk AS (SELECT run_no, anomaly_type, run_score, 1 AS y FROM rc WHERE anomaly_label = 1 AND source_quality_valid AND NOT is_low_quality UNION ALL SELECT run_no, anomaly_type, run_score, 0 FROM ro, ty WHERE is_training_eligible),
h AS (SELECT run_no, anomaly_type, run_score, count_if(y = 1) AS p, count_if(y = 0) AS n FROM rk GROUP BY ALL), s AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY run_no, anomaly_type ORDER BY run_score DESC)),
q AS (SELECT run_no, anomaly_type, round(quantile_cont(run_score, 0.99), 4) AS score_p99 FROM rk WHERE y = 1 GROUP BY ALL)"""


@register("a13_type_ranking", _TYPE_ROWS, "SELECT run_no AS run, anomaly_type, CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision, '' AS reason, any_value(score_p99) AS score_p99 FROM s JOIN q USING (run_no, anomaly_type) GROUP BY ALL")
def _(spark, d):
    """Per run and type against the common normal rows: ranking metrics and the 99th percentile of the labelled scores."""
    pos = _copy_runs(spark, d).where("anomaly_label = 1 and source_quality_valid and not is_low_quality").select("run", "anomaly_type", "run_score", F.lit(1).alias("y"))
    neg = _own_runs(spark, d).where("is_training_eligible").select("run", F.explode(F.lit(list(datasets.TYPES))).alias("anomaly_type"), "run_score", F.lit(0).alias("y"))
    p99 = pos.groupBy("run", "anomaly_type").agg(F.round(F.percentile("run_score", 0.99), 4).alias("score_p99"))
    return evaluation.grouped_ranking(pos.unionByName(neg), "run", "anomaly_type", label="y", score="run_score").join(p99, ["run", "anomaly_type"])


_EVERY = sql.COPIED + """, sp AS (SELECT f.user_id, dataset_split, f.trajectory_id AS source_trajectory_id, f.trajectory_id, false AS is_synthetic, anomaly_label FROM flagged f JOIN split USING (user_id) UNION ALL SELECT user_id, dataset_split, source_trajectory_id, trajectory_id, true, anomaly_label FROM copies),
kv AS (SELECT key, value FROM (SELECT DISTINCT dataset_split, 'user_id' AS key, user_id AS value FROM sp UNION ALL SELECT DISTINCT dataset_split, 'source_trajectory_id', source_trajectory_id FROM sp UNION ALL SELECT DISTINCT dataset_split, 'trajectory_id', trajectory_id FROM sp) GROUP BY ALL HAVING count(*) > 1),
cl AS (SELECT dataset_split, count_if(anomaly_label = 1) AS a, count_if(anomaly_label <> 1) AS b FROM sp GROUP BY 1)"""


@register("v5_split_checks", _EVERY, """SELECT count(*) AS rows, count(DISTINCT dataset_split) AS splits, count_if(dataset_split = 'train' AND is_synthetic) AS train_synthetic, count_if(dataset_split = 'train' AND anomaly_label = 1) AS train_labelled, (SELECT count_if(dataset_split <> 'train' AND (a = 0 OR b = 0)) FROM cl) AS splits_lacking_a_class,
  (SELECT count_if(key = 'user_id') FROM kv) AS users_in_several, (SELECT count_if(key = 'source_trajectory_id') FROM kv) AS sources_in_several, (SELECT count_if(key = 'trajectory_id') FROM kv) AS samples_in_several FROM sp""")
def _(spark, d):
    own = split_flagged(spark, d).withColumns({"source_trajectory_id": F.col("trajectory_id"), "is_synthetic": F.lit(False)})
    names = ["user_id", "dataset_split", "source_trajectory_id", "trajectory_id", "is_synthetic", "anomaly_label"]
    return checks.split_violations(own.select(*names).unionByName(copies(spark, d).withColumn("is_synthetic", F.lit(True)).select(*names)))


@register("v8_reference_set", _FP.replace(sql.GPS, sql.FEATURES, 1) + sql.SPLITS + """, rs AS (SELECT f.*, dataset_split FROM flagged f JOIN split USING (user_id) WHERE dataset_split = 'train' OR f.source_point_index % 50 = 7), al AS (SELECT user_id FROM split WHERE dataset_split = 'train'), ct AS (SELECT trajectory_id, count(*) AS n FROM rs GROUP BY 1),
ex AS (SELECT trajectory_id, count(*) AS points FROM flagged JOIN split USING (user_id) WHERE dataset_split = 'train' GROUP BY 1)""", """SELECT count(*) AS points, count_if(dataset_split <> 'train') AS foreign_split, 0::BIGINT AS synthetic, count_if(is_low_quality) AS low_quality, count_if(NOT is_training_eligible) AS not_eligible, count_if(user_id NOT IN (SELECT user_id FROM al)) AS not_allowed,
  (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM fp WHERE trajectory_id IN (SELECT trajectory_id FROM ct) GROUP BY fingerprint)) AS duplicates, (SELECT count_if(n IS NULL) FROM ex LEFT JOIN ct USING (trajectory_id)) AS missing, (SELECT count_if(points IS NULL) FROM ct LEFT JOIN ex USING (trajectory_id)) AS unexpected, (SELECT count_if(n <> points) FROM ex JOIN ct USING (trajectory_id)) AS other_counts FROM rs""")
def _(spark, d):
    """The train rows with every fiftieth point of the others mixed in, which the checks must see."""
    p = split_flagged(spark, d).withColumn("is_synthetic", F.lit(False))
    train = p.where("dataset_split = 'train'")
    return checks.reference_set(p.where("dataset_split = 'train' or source_point_index % 50 = 7"), train, movement.fingerprints(gps_points(spark, d)), train.groupBy("trajectory_id").agg(F.count("*").alias("points")))


_ISO = sql.FEATURES + f""", first AS (SELECT trajectory_id, arg_min(latitude, row(elapsed_us, source_point_index)) AS lat0 FROM gps GROUP BY 1), ang AS (SELECT trajectory_id, degrees(2 * asin(sin(200.0 / (2 * 6371000.0)) / cos(radians(lat0)))) AS angle FROM first),
moved AS (SELECT gps.* EXCLUDE (longitude), {sql.pmod("longitude + angle + 180.0", "360.0")} - 180.0 AS longitude FROM gps JOIN ang USING (trajectory_id))""" + sql.features("moved", "m_")
_SINCOS = {"bearing_sin": "sin(radians({t}.bearing))", "bearing_cos": "cos(radians({t}.bearing))"}


@register("d15_isometry_all_features", _ISO, "SELECT a.trajectory_id, count(*) AS points, " + ", ".join(f"round(max(abs({_SINCOS.get(c, '{t}.' + c).format(t='a')} - {_SINCOS.get(c, '{t}.' + c).format(t='b')})), 3) AS {c}_delta" for c in MODEL) + " FROM flagged a JOIN m_flagged b USING (trajectory_id, source_point_index) GROUP BY 1")
def _(spark, d):
    moved = routes.with_bearing_parts(movement.movement_features(datasets.rotated(gps_points(spark, d), 200.0))).select("trajectory_id", "source_point_index", *[F.col(c).alias(f"_{c}") for c in MODEL])
    j = routes.with_bearing_parts(features(spark, d)).join(moved, ["trajectory_id", "source_point_index"])
    return j.groupBy("trajectory_id").agg(F.count("*").alias("points"), *[F.round(F.max(F.abs(F.col(c) - F.col(f"_{c}"))), 3).alias(f"{c}_delta") for c in MODEL])
