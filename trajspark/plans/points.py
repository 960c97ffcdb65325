"""Named queries of the trajectory operators and their SQL, over the GPS points derived from the events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.operators import alerts, audits, datasets, detectors, evaluation, movement, similarity, spatial
from trajspark.sources.gps import gps_points
from trajspark.sources.scratch import saved

from . import sql
from .catalog import features, flagged, once, register

ROUNDED = ("distance", "speed", "acceleration", "bearing", "turn", "stop_s")


@register("s_gps_points", sql.GPS, "SELECT user_id, trajectory_id, source_point_index, elapsed_us, lat_udeg, lon_udeg, anomaly_label, predicted FROM gps")
def _(spark, d):
    return gps_points(spark, d).select("user_id", "trajectory_id", "source_point_index", "elapsed_us", "lat_udeg", "lon_udeg", "anomaly_label", "predicted")


@register("f1_clean_points", sql.GPS, """, twice AS (SELECT *, 0 AS c FROM gps UNION ALL SELECT *, 1 AS c FROM gps WHERE source_point_index % 7 = 0)
SELECT trajectory_id, elapsed_us, min(source_point_index) AS source_point_index FROM twice WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY ALL""")
def _(spark, d):
    p = gps_points(spark, d)
    return movement.clean_points(p.union(p.where("source_point_index % 7 = 0"))).select("trajectory_id", "elapsed_us", "source_point_index")


@register("f2_positive_intervals", sql.GPS, """, g AS (SELECT *, elapsed_us - lag(elapsed_us) OVER (PARTITION BY trajectory_id ORDER BY elapsed_us, source_point_index) AS gap FROM gps)
SELECT trajectory_id, source_point_index, elapsed_us FROM g WHERE gap IS NULL OR gap > 0""")
def _(spark, d):
    return movement.positive_intervals(gps_points(spark, d)).select("trajectory_id", "source_point_index", "elapsed_us")


@register("w1_movement_features", sql.FEATURES, f"SELECT trajectory_id, source_point_index, dt, {', '.join(f'round({c}, 4) AS {c}' for c in ROUNDED)} FROM feat")
def _(spark, d):
    return features(spark, d).select("trajectory_id", "source_point_index", "dt", *[F.round(c, 4).alias(c) for c in ROUNDED])


@register("f3_quality_flags", sql.FEATURES, "SELECT trajectory_id, source_point_index, is_invalid_time, is_long_gap, is_unrealistic_speed, is_gps_jump, is_low_quality, quality_reason, is_training_eligible FROM flagged")
def _(spark, d):
    return flagged(spark, d).select("trajectory_id", "source_point_index", "is_invalid_time", "is_long_gap", "is_unrealistic_speed", "is_gps_jump", "is_low_quality", "quality_reason", "is_training_eligible")


@register("f6_training_rows", sql.FEATURES, "SELECT trajectory_id, source_point_index FROM flagged WHERE anomaly_label = 0 AND is_training_eligible")
def _(spark, d):
    return flagged(spark, d).where("anomaly_label = 0 and is_training_eligible").select("trajectory_id", "source_point_index")


@register("f9_decisions", sql.GPS, "SELECT trajectory_id, source_point_index, CAST(score > 150 AS INTEGER) AS decision FROM gps")
def _(spark, d):
    return gps_points(spark, d).select("trajectory_id", "source_point_index", (F.col("score") > 150).cast("int").alias("decision"))


@register("f10_abstention", sql.FEATURES, """SELECT trajectory_id, source_point_index, CASE WHEN is_low_quality THEN NULL ELSE predicted END AS prediction,
  CASE WHEN is_low_quality THEN 'quality_unknown' ELSE 'scored' END AS status FROM flagged""")
def _(spark, d):
    low = F.col("is_low_quality")
    return flagged(spark, d).select("trajectory_id", "source_point_index", F.when(~low, F.col("predicted")).alias("prediction"), F.when(low, "quality_unknown").otherwise("scored").alias("status"))


@register("v2_result_checks", sql.FEATURES, """SELECT count(*) AS points, count_if(isnan(speed) OR isnan(distance)) AS undefined, count_if(distance < 0) AS negative_distance,
  count_if(bearing < 0 OR bearing >= 360) AS bad_bearing, count_if(turn < 0 OR turn > 180) AS bad_turn, count_if(speed > 50) AS fast FROM feat""")
def _(spark, d):
    c = F.count_if
    return features(spark, d).agg(F.count("*").alias("points"), c(F.isnan("speed") | F.isnan("distance")).alias("undefined"), c(F.col("distance") < 0).alias("negative_distance"), c((F.col("bearing") < 0) | (F.col("bearing") >= 360)).alias("bad_bearing"), c((F.col("turn") < 0) | (F.col("turn") > 180)).alias("bad_turn"), c(F.col("speed") > 50).alias("fast"))


@register("v3_lineage_keys", sql.GPS, """SELECT count(*) AS repeated_keys FROM (SELECT trajectory_id, source_point_index FROM gps GROUP BY ALL HAVING count(*) > 1)""")
def _(spark, d):
    keys = gps_points(spark, d).groupBy("trajectory_id", "source_point_index").count().where("count > 1")
    return keys.agg(F.count("*").alias("repeated_keys"))


@register("v7_stream_validity", sql.LINKED, "SELECT trajectory_id, count_if(gap_us <= 0) AS time_order, count_if(NOT linked) AS unlinked, count(DISTINCT user_id) AS users FROM linked GROUP BY 1")
def _(spark, d):
    p = alerts.links(gps_points(spark, d))
    return p.groupBy("trajectory_id").agg(F.count_if(F.col("gap_us") <= 0).alias("time_order"), F.count_if(~F.col("linked")).alias("unlinked"), F.countDistinct("user_id").alias("users"))


@register("v11_undefined_cells", sql.FEATURES, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS nulls, count_if(isinf({c})) AS infinite FROM feat" for c in ROUNDED))
def _(spark, d):
    f = features(spark, d).select(*ROUNDED).unpivot([], list(ROUNDED), "column_name", "x")
    return f.groupBy("column_name").agg(F.count_if(F.col("x").isNull()).alias("nulls"), F.count_if(F.abs("x") == float("inf")).alias("infinite"))


@register("x3_angle_difference", sql.FEATURES, f"SELECT trajectory_id, source_point_index, round(abs({sql.pmod('bearing - 350.0 + 180.0', '360.0')} - 180.0), 4) AS difference FROM feat")
def _(spark, d):
    return features(spark, d).select("trajectory_id", "source_point_index", F.round(geo.angle_difference(F.lit(350.0), F.col("bearing")), 4).alias("difference"))


@register("x7_displacement_bins", sql.FEATURES, """SELECT CASE WHEN distance <= 1e-6 THEN 'zero' WHEN distance < 10 THEN '0-10' WHEN distance < 25 THEN '10-25' WHEN distance < 50 THEN '25-50' WHEN distance < 100 THEN '50-100'
  WHEN distance < 200 THEN '100-200' ELSE '200+' END AS bin, count(*) AS points FROM feat GROUP BY 1""")
def _(spark, d):
    return features(spark, d).groupBy(geo.displacement_bin(F.col("distance")).alias("bin")).agg(F.count("*").alias("points"))


@register("x16_speed_classes", sql.FEATURES, "SELECT CASE WHEN speed < 10 THEN '<10' WHEN speed < 20 THEN '10-20' WHEN speed < 30 THEN '20-30' ELSE '>=30' END AS speed_class, count(*) AS points FROM feat GROUP BY 1")
def _(spark, d):
    return features(spark, d).groupBy(geo.speed_class(F.col("speed")).alias("speed_class")).agg(F.count("*").alias("points"))


@register("w5_links", sql.LINKED, "SELECT trajectory_id, source_point_index, linked FROM linked")
def _(spark, d):
    return alerts.links(gps_points(spark, d)).select("trajectory_id", "source_point_index", "linked")


@register("w6_positive_runs", sql.LINKED + sql.runs("r", "predicted"), "SELECT * FROM r")
def _(spark, d):
    return alerts.positive_runs(gps_points(spark, d))


for _window, _votes in alerts.GATES:

    @register(f"w7_gate_{_votes}of{_window}", sql.gate(_window, _votes), "SELECT trajectory_id, source_point_index, votes, supported, gate, candidate FROM gated")
    def _(spark, d, window=_window, votes=_votes):
        return alerts.vote_gate(gps_points(spark, d), window, votes).select("trajectory_id", "source_point_index", "votes", "supported", "gate", "candidate")


for _seconds in alerts.COOLDOWNS:

    @register(f"w9_cooldown_{_seconds}s", sql.gate(3, 2) + sql.cooled(_seconds), "SELECT trajectory_id, source_point_index, elapsed_us, emitted, suppressor_index FROM cooled", recursive=True)
    def _(spark, d, seconds=_seconds):
        return alerts.cooldown(alerts.vote_gate(gps_points(spark, d), 3, 2), seconds)


@register("w10_suppression_reasons", sql.gate(5, 3), """SELECT trajectory_id, source_point_index, CASE WHEN gate OR predicted = 0 THEN '' WHEN NOT supported THEN 'warm_up' ELSE 'vote_requirement' END AS reason FROM gated""")
def _(spark, d):
    return alerts.suppression_reason(alerts.vote_gate(gps_points(spark, d), 5, 3), 5, 3).select("trajectory_id", "source_point_index", "reason")


@register("w11_exposure", sql.LINKED, """SELECT trajectory_id, CAST(coalesce(sum(CASE WHEN linked THEN gap_us END), 0) AS BIGINT) AS exposure_us, count_if(linked) AS linked_intervals,
  count_if(NOT linked AND gap_us IS NOT NULL) AS excluded_intervals FROM linked GROUP BY 1""")
def _(spark, d):
    return alerts.exposure(gps_points(spark, d))


@register("w13_trajectory_order", sql.GPS, """, t AS (SELECT user_id, trajectory_id, min(elapsed_us) AS start_us, max(elapsed_us) AS end_us, count(*) AS points FROM gps GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_us, trajectory_id) AS INTEGER) AS nth FROM t""")
def _(spark, d):
    return spatial.trajectory_order(gps_points(spark, d))


@register("w14_past_labelled", sql.GPS, """SELECT trajectory_id, source_point_index, CAST(coalesce(sum(anomaly_label) OVER (PARTITION BY trajectory_id ORDER BY source_point_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past FROM gps""")
def _(spark, d):
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index").rowsBetween(Window.unboundedPreceding, -1)
    return gps_points(spark, d).select("trajectory_id", "source_point_index", F.coalesce(F.sum("anomaly_label").over(w), F.lit(0)).alias("past"))


@register("w17_sliding_windows", sql.GPS, """, a AS (SELECT trajectory_id, source_point_index, count(*) OVER w AS n, min(lat_udeg) OVER w AS low, max(lat_udeg) OVER w AS high FROM gps
  WINDOW w AS (PARTITION BY trajectory_id ORDER BY source_point_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT trajectory_id, source_point_index - 9 AS start_index, source_point_index AS end_index, low, high FROM a WHERE n = 10 AND (source_point_index - 9) % 10 = 0""")
def _(spark, d):
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index").rowsBetween(-9, 0)
    p = gps_points(spark, d).withColumn("c", F.collect_list(F.struct("lat_udeg", "lon_udeg")).over(w)).where((F.size("c") == 10) & ((F.col("source_point_index") - 9) % 10 == 0))
    return p.select("trajectory_id", (F.col("source_point_index") - 9).alias("start_index"), F.col("source_point_index").alias("end_index"), F.array_min("c.lat_udeg").alias("low"), F.array_max("c.lat_udeg").alias("high"))


@register("j8_event_points", sql.LINKED + sql.runs("ev", "anomaly_label"), """SELECT g.trajectory_id, e.start_index, count(*) AS points, CAST(sum(g.predicted) AS BIGINT) AS detected
  FROM gps g JOIN ev e ON g.trajectory_id = e.trajectory_id AND g.source_point_index BETWEEN e.start_index AND e.end_index GROUP BY ALL""")
def _(spark, d):
    p = gps_points(spark, d)
    e = alerts.positive_runs(p, "anomaly_label").select("trajectory_id", "start_index", "end_index")
    j = p.join(e, "trajectory_id").where(F.col("source_point_index").between(F.col("start_index"), F.col("end_index")))
    return j.groupBy("trajectory_id", "start_index").agg(F.count("*").alias("points"), F.sum("predicted").alias("detected"))


@register("j9_as_of", sql.GPS, """SELECT l.trajectory_id, l.elapsed_us, l.source_point_index, r.source_point_index AS last_positive
  FROM gps l ASOF LEFT JOIN (SELECT * FROM gps WHERE predicted = 1) r ON l.trajectory_id = r.trajectory_id AND l.elapsed_us > r.elapsed_us""")
def _(spark, d):
    p = gps_points(spark, d)
    right = p.where("predicted = 1").select("trajectory_id", "elapsed_us", F.col("source_point_index").alias("last_positive"))
    return spatial.as_of(p.select("trajectory_id", "elapsed_us", "source_point_index"), right, "trajectory_id", "elapsed_us", "last_positive")


_NEAR = sql.GPS + sql.SPLITS + f""", q AS (SELECT gps.* FROM gps JOIN split USING (user_id) WHERE dataset_split <> 'train'),
ref AS (SELECT latitude AS rl, longitude AS ro, min(trajectory_id) AS rt FROM gps JOIN split USING (user_id) WHERE dataset_split = 'train' GROUP BY ALL),
pairs AS (SELECT q.user_id, q.trajectory_id, q.source_point_index, CASE WHEN rl IS NOT NULL THEN {sql.haversine("latitude", "longitude", "rl", "ro")} END AS m, rl, ro, rt FROM q LEFT JOIN ref ON true),
near AS (SELECT user_id, trajectory_id, source_point_index, min(m) AS nearest_m, arg_min(rt, row(m, rl, ro, rt)) AS nearest_trajectory FROM pairs GROUP BY ALL)"""


def _split_points(spark, d):
    p = gps_points(spark, d)
    return p.join(datasets.user_splits(p), "user_id")


def _nearest(spark, d):
    p = _split_points(spark, d)
    return spatial.nearest_reference(p.where("dataset_split <> 'train'").drop("dataset_split"), p.where("dataset_split = 'train'"))


@register("j10_nearest_reference", _NEAR, "SELECT trajectory_id, source_point_index, round(nearest_m, 4) AS nearest_m FROM near")
def _(spark, d):
    return _nearest(spark, d).select("trajectory_id", "source_point_index", F.round("nearest_m", 4).alias("nearest_m"))


@register("j11_prior_context", sql.GPS, """, t AS (SELECT user_id, trajectory_id, min(elapsed_us) AS s, max(elapsed_us) AS e, count(*) AS n FROM gps GROUP BY ALL)
SELECT a.trajectory_id, count(b.trajectory_id) AS prior_trajectories, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS prior_points FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.e < a.s GROUP BY 1""")
def _(spark, d):
    return spatial.prior_context(gps_points(spark, d))


@register("a1_trajectory_quality", sql.FEATURES, """, s AS (SELECT user_id, trajectory_id, count(*) AS points, count_if(is_low_quality) AS low_quality_points, count_if(is_invalid_time) AS invalid_times, count_if(isnan(speed) OR isnan(distance)) AS undefined FROM flagged GROUP BY ALL),
r AS (SELECT *, round(low_quality_points / points, 6) AS low_quality_ratio, concat_ws(';', CASE WHEN points < 100 THEN 'too_few_points' END, CASE WHEN low_quality_points > 0.05 * points THEN 'low_quality_ratio' END,
  CASE WHEN invalid_times > 0 THEN 'time_order' END, CASE WHEN undefined > 0 THEN 'undefined_features' END) AS exclusion_reason FROM s)
SELECT *, exclusion_reason = '' AS eligible FROM r""")
def _(spark, d):
    return movement.trajectory_quality(flagged(spark, d))


@register("a2_quality_counts", sql.FEATURES, "SELECT count_if(is_invalid_time) AS invalid_time, count_if(is_long_gap) AS long_gap, count_if(is_unrealistic_speed) AS unrealistic_speed, count_if(is_gps_jump) AS gps_jump FROM flagged")
def _(spark, d):
    return flagged(spark, d).agg(*[F.count_if(f"is_{c}").alias(c) for c in ("invalid_time", "long_gap", "unrealistic_speed", "gps_jump")])


@register("a3_user_quality", sql.FEATURES, "SELECT user_id, count(DISTINCT trajectory_id) AS trajectories, count(*) AS points, count_if(is_low_quality) AS low_quality_points FROM flagged GROUP BY 1")
def _(spark, d):
    return flagged(spark, d).groupBy("user_id").agg(F.countDistinct("trajectory_id").alias("trajectories"), F.count("*").alias("points"), F.count_if("is_low_quality").alias("low_quality_points"))


@register("a5_route_summary", sql.FEATURES, """SELECT trajectory_id, count(*) AS points, round((max(elapsed_us) - min(elapsed_us)) / 1e6, 4) AS duration_s, round(sum(distance), 4) AS total_distance_m, round(avg(speed), 4) AS mean_speed,
  round(max(speed), 4) AS max_speed, round(min(acceleration), 4) AS min_acceleration, round(max(acceleration), 4) AS max_acceleration, round(max(dt), 4) AS max_gap_s, count_if(turn > 90) AS sharp_turns, count_if(stop_s > 0) AS stop_points FROM flagged GROUP BY 1""")
def _(spark, d):
    return movement.route_summary(flagged(spark, d))


_FP = sql.GPS + """, fp AS (SELECT user_id, trajectory_id, sha256(string_agg(CAST(lat_udeg AS VARCHAR) || ',' || CAST(lon_udeg AS VARCHAR) || ',' || CAST(elapsed_us - s AS VARCHAR), chr(10) ORDER BY elapsed_us, source_point_index)) AS fingerprint
  FROM (SELECT *, min(elapsed_us) OVER (PARTITION BY trajectory_id) AS s FROM gps) GROUP BY ALL)"""


@register("a6_fingerprints", _FP, "SELECT * FROM fp")
def _(spark, d):
    return movement.fingerprints(gps_points(spark, d))


@register("a7_deduplication", _FP, """, m AS (SELECT fingerprint, user_id, trajectory_id FROM fp UNION ALL SELECT fingerprint, user_id, trajectory_id || 'c' FROM fp WHERE CAST(split_part(trajectory_id, '__', 2) AS INTEGER) % 7 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY trajectory_id) AS INTEGER) AS copy_number FROM m)
SELECT *, CASE WHEN copy_number > 1 THEN 'duplicate_in_cohort' ELSE '' END AS exclusion_reason FROM r""")
def _(spark, d):
    f = movement.fingerprints(gps_points(spark, d))
    copies = f.where(F.substring_index("trajectory_id", "__", -1).cast("int") % 7 == 0).withColumn("trajectory_id", F.concat("trajectory_id", F.lit("c")))
    return movement.deduplicate(f.union(copies))


_CONFUSION = """count_if(anomaly_label = 1 AND predicted = 1) AS tp, count_if(anomaly_label <> 1 AND predicted = 1) AS fp, count_if(anomaly_label <> 1 AND predicted <> 1) AS tn, count_if(anomaly_label = 1 AND predicted <> 1) AS fn"""
_RATIOS = """round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr"""


@register("a9_confusion", sql.GPS, f", c AS (SELECT {_CONFUSION} FROM gps) SELECT *, {_RATIOS} FROM c")
def _(spark, d):
    return evaluation.confusion(gps_points(spark, d))


@register("a12_user_metrics", sql.GPS, f", c AS (SELECT user_id, {_CONFUSION} FROM gps GROUP BY 1) SELECT *, {_RATIOS} FROM c")
def _(spark, d):
    return evaluation.confusion(gps_points(spark, d), "user_id")


_STEPS = sql.GPS + """, h AS (SELECT score AS threshold, count_if(anomaly_label = 1) AS p, count_if(anomaly_label <> 1) AS n FROM gps GROUP BY 1),
s AS (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM h WINDOW w AS (ORDER BY threshold DESC)), t AS (SELECT CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg FROM h)"""


@register("a10_ranking", _STEPS, "SELECT pos, neg, round(sum(n * (tp - p / 2)) / (pos * neg), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / pos, 6) AS average_precision FROM s, t GROUP BY pos, neg")
def _(spark, d):
    return evaluation.ranking_metrics(gps_points(spark, d))


@register("a11_curve", _STEPS, "SELECT threshold, tp, fp, round(tp / pos, 6) AS tpr, round(fp / neg, 6) AS fpr FROM s, t")
def _(spark, d):
    return evaluation.curve(gps_points(spark, d))


@register("a16_descriptive", sql.FEATURES, """, q AS (SELECT user_id, count(speed) AS n, round(avg(speed), 6) AS mean, round(stddev_samp(speed), 6) AS std, quantile_cont(speed, [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM feat GROUP BY 1)
SELECT user_id, n, mean, std, round(q[1], 6) AS p01, round(q[2], 6) AS p25, round(q[3], 6) AS median, round(q[4], 6) AS p75, round(q[5], 6) AS p95, round(q[6], 6) AS p99, round(q[4] - q[2], 6) AS iqr FROM q""")
def _(spark, d):
    return evaluation.descriptive(features(spark, d), "speed", "user_id")


_EVENTS = sql.LINKED + sql.runs("ev", "anomaly_label")


@register("a17_event_catalog", _EVENTS, "SELECT *, trajectory_id || '#' || CAST(start_index AS VARCHAR) AS event_id FROM ev")
def _(spark, d):
    return evaluation.event_catalog(gps_points(spark, d))


_DETECT = _EVENTS + """, j AS (SELECT e.trajectory_id || '#' || CAST(e.start_index AS VARCHAR) AS event_id, e.trajectory_id, e.start_index, e.end_index, e.points AS event_points,
  CAST(sum(predicted) AS BIGINT) AS detected_points, min(CASE WHEN predicted = 1 THEN source_point_index END) AS first_index FROM ev e JOIN gps g ON g.trajectory_id = e.trajectory_id AND g.source_point_index BETWEEN e.start_index AND e.end_index GROUP BY ALL),
det AS (SELECT *, first_index - start_index AS delay_points, first_index IS NOT NULL AS hit, round(detected_points / event_points, 6) AS coverage,
  coalesce((first_index - start_index) / greatest(event_points - 1, 1) <= 0.10, false) AS early_10, coalesce((first_index - start_index) / greatest(event_points - 1, 1) <= 0.25, false) AS early_25,
  coalesce((first_index - start_index) / greatest(event_points - 1, 1) <= 0.5, false) AS early_50 FROM j)"""


def _detections(spark, d):
    p = gps_points(spark, d)
    return evaluation.event_detection(p, evaluation.event_catalog(p))


@register("a18_event_detection", _DETECT, "SELECT * FROM det")
def _(spark, d):
    return _detections(spark, d).drop("user_id")


@register("a19_event_summary", _DETECT, """SELECT coalesce(user_id, 'ALL') AS user_id, count(*) AS events, count_if(hit) AS detected, round(avg(CAST(hit AS INTEGER)), 6) AS detection_rate, round(avg(CAST(early_25 AS INTEGER)), 6) AS early_25_rate,
  round(sum(detected_points) / sum(event_points), 6) AS point_recall, round(quantile_cont(delay_points, 0.5), 6) AS median_delay FROM (SELECT *, split_part(trajectory_id, '__', 1) AS user_id FROM det) GROUP BY ROLLUP (user_id)""")
def _(spark, d):
    return evaluation.event_summary(_detections(spark, d))


@register("a20_false_alerts", sql.LINKED + ", fl AS (SELECT *, CASE WHEN predicted = 1 AND anomaly_label = 0 THEN 1 ELSE 0 END AS fpos FROM linked)" + sql.runs("fr", "fpos", "fl"), """,
c AS (SELECT user_id, CAST(sum(fpos) AS BIGINT) AS false_points, count_if(anomaly_label = 0) AS normal_points, CAST(sum(CASE WHEN linked THEN gap_us ELSE 0 END) AS BIGINT) AS exposure_us FROM fl GROUP BY 1),
r AS (SELECT split_part(trajectory_id, '__', 1) AS user_id, count(*) AS false_runs, count(DISTINCT trajectory_id) AS alerted_trajectories FROM fr GROUP BY 1)
SELECT user_id, false_points, normal_points, coalesce(false_runs, 0) AS false_runs, coalesce(alerted_trajectories, 0) AS alerted_trajectories, exposure_us, round(false_points / nullif(normal_points, 0), 6) AS fpr,
  round(coalesce(false_runs, 0) * 3.6e9 / nullif(exposure_us, 0), 6) AS runs_per_hour FROM c LEFT JOIN r USING (user_id)""")
def _(spark, d):
    return evaluation.false_alerts(gps_points(spark, d))


_RADII = "(SELECT CAST(unnest([10, 25, 50, 100, 200, 500, 1000]) AS INTEGER) AS radius_m)"


@register("a25_coverage_by_radius", _NEAR, f"""SELECT radius_m, coalesce(user_id, 'ALL') AS user_id, count(*) AS points, count_if(coalesce(nearest_m <= radius_m, false)) AS covered, round(count_if(coalesce(nearest_m <= radius_m, false)) / count(*), 6) AS share
  FROM near, {_RADII} GROUP BY GROUPING SETS ((radius_m), (radius_m, user_id))""")
def _(spark, d):
    return spatial.coverage_by_radius(_nearest(spark, d))


@register("a26_nearest_users", _NEAR, """, c AS (SELECT user_id, split_part(nearest_trajectory, '__', 1) AS reference_user, count(*) AS points FROM near WHERE nearest_m IS NOT NULL GROUP BY ALL)
SELECT *, round(points / sum(points) OVER (PARTITION BY user_id), 6) AS fraction FROM c""")
def _(spark, d):
    return spatial.nearest_users(_nearest(spark, d), gps_points(spark, d))


@register("d8_standard_scaler", sql.FEATURES, " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS scale FROM feat" for c in ("distance", "speed", "turn")))
def _(spark, d):
    return movement.standard_scaler(features(spark, d), ["distance", "speed", "turn"]).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


_RULE = ("distance", "speed", "turn")
_RULE_SQL = sql.FEATURES + ", tr AS (SELECT * FROM flagged WHERE anomaly_label = 0 AND is_training_eligible), " + ", ".join(f"m_{c} AS (SELECT quantile_cont({c}, 0.5) AS med, (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349 AS sc FROM tr)" for c in _RULE)


@register("d9_rule_score", _RULE_SQL, f"SELECT trajectory_id, source_point_index, round(greatest({', '.join(f'abs({c} - m_{c}.med) / m_{c}.sc' for c in _RULE)}), 4) AS rule_score FROM flagged, {', '.join(f'm_{c}' for c in _RULE)}")
def _(spark, d):
    f = flagged(spark, d)
    rule = movement.statistical_rule(f.where("anomaly_label = 0 and is_training_eligible"), list(_RULE))
    return movement.rule_score(f, rule, list(_RULE)).select("trajectory_id", "source_point_index", F.round("rule_score", 4).alias("rule_score"))


@register("d13_threshold", sql.GPS, "SELECT round(quantile_cont(score, 0.95), 6) AS threshold FROM gps WHERE anomaly_label = 0")
def _(spark, d):
    return evaluation.threshold(gps_points(spark, d).where("anomaly_label = 0")).select(F.round("threshold", 6).alias("threshold"))


@register("d1_user_splits", sql.GPS + sql.SPLITS, "SELECT user_id, dataset_split FROM split")
def _(spark, d):
    return datasets.user_splits(gps_points(spark, d))


@register("k3_top_turns", sql.FEATURES, "SELECT trajectory_id, source_point_index, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY round(turn, 6) DESC, source_point_index) AS INTEGER) AS nth FROM feat) WHERE nth <= 5")
def _(spark, d):
    w = Window.partitionBy("trajectory_id").orderBy(F.desc(F.round("turn", 6)), "source_point_index")
    return features(spark, d).withColumn("nth", F.row_number().over(w)).where("nth <= 5").select("trajectory_id", "source_point_index", "nth")


@register("k4_arg_max", sql.FEATURES, "SELECT trajectory_id, arg_max(source_point_index, row(score, -source_point_index)) AS highest, arg_min(source_point_index, row(score, source_point_index)) AS lowest FROM feat GROUP BY 1")
def _(spark, d):
    first = F.col("source_point_index")  # of equal scores the earliest point
    return features(spark, d).groupBy("trajectory_id").agg(F.max_by(first, F.struct("score", -first)).alias("highest"), F.min_by(first, F.struct("score", first)).alias("lowest"))


@register("t4_sessions", sql.GPS, """, g AS (SELECT *, CASE WHEN elapsed_us - lag(elapsed_us) OVER (PARTITION BY trajectory_id ORDER BY elapsed_us) <= 300000000 THEN 0 ELSE 1 END AS b FROM gps),
s AS (SELECT *, sum(b) OVER (PARTITION BY trajectory_id ORDER BY elapsed_us) AS sid FROM g) SELECT trajectory_id, min(elapsed_us) AS start_us, count(*) AS points FROM s GROUP BY trajectory_id, sid""")
def _(spark, d):
    p = gps_points(spark, d).withColumn("timestamp", F.timestamp_micros("elapsed_us"))
    s = p.groupBy("trajectory_id", F.session_window("timestamp", "300 seconds")).agg(F.min("elapsed_us").alias("start_us"), F.count("*").alias("points"))
    return s.select("trajectory_id", "start_us", "points")


@register("t5_hourly_burden", sql.GPS, "SELECT trajectory_id, elapsed_us // 3600000000 AS hour, CAST(sum(predicted) AS BIGINT) AS positives, count(*) AS points FROM gps GROUP BY ALL")
def _(spark, d):
    p = gps_points(spark, d).withColumn("timestamp", F.timestamp_micros("elapsed_us"))
    g = p.groupBy("trajectory_id", F.window("timestamp", "1 hour")).agg(F.sum("predicted").alias("positives"), F.count("*").alias("points"))
    return g.select("trajectory_id", F.expr("unix_micros(window.start) div 3600000000").alias("hour"), "positives", "points")


@once
def _window_scores(spark, d) -> DataFrame:
    p = saved(gps_points(spark, d), "points")
    return reduce(DataFrame.unionByName, [similarity.nearest_windows(p, width) for width in similarity.WIDTHS])


@register("j12_prior_window_similarity")
def _(spark, d):
    s = _window_scores(spark, d)
    return s.select("width", "kind", "gap", "trajectory_id", "source_point_index", *[F.round(c, 4).alias(c) for c in ("frechet_m", "aligned_mean_m", "aligned_max_m")], "ref_trajectory", "ref_index")


@register("a30_window_configurations")
def _(spark, d):
    g = similarity.compare_configurations(similarity.with_combined(_window_scores(spark, d)), gps_points(spark, d))
    return g.select("width", "gap", "kind", "user_id", "windows", "available", *similarity.WORK, *[F.round(c, 4).alias(c) for c in ("normal_m", "labelled_m", "separation_m")])


#: The reference's model features.
_MODEL = ("dt", "distance", "speed", "acceleration", "turn", "stop_s", "bearing_sin", "bearing_cos")


def _model_features(spark: SparkSession, d: str) -> DataFrame:
    sine, cosine = geo.bearing_sin_cos(F.col("bearing"))
    return flagged(spark, d).withColumns({"bearing_sin": sine, "bearing_cos": cosine})


@register("d10_isolation_forest")
def _(spark, d):
    f = _model_features(spark, d)
    train = f.where("anomaly_label = 0 and is_training_eligible")
    model = detectors.isolation_forest(train, list(_MODEL), trees=200)
    return detectors.isolation_scores(f, model, list(_MODEL)).select("trajectory_id", "source_point_index", F.round("isolation_score", 6).alias("isolation_score"))


@register("d11_linear_reconstruction")
def _(spark, d):
    f = _model_features(spark, d)
    train = f.where("anomaly_label = 0 and is_training_eligible")
    return detectors.reconstruction_scores(f, detectors.linear_reconstruction(train, list(_MODEL), rank=4), list(_MODEL)).select("trajectory_id", "source_point_index", F.round("reconstruction_error", 4).alias("reconstruction_error"))


_BY_INDEX = "WINDOW w AS (PARTITION BY trajectory_id ORDER BY source_point_index)"


@register("w15_neighbour_distances", sql.GPS, f"""SELECT trajectory_id, source_point_index, round({sql.haversine("latitude", "longitude", "lag(latitude) OVER w", "lag(longitude) OVER w")}, 4) AS previous_m,
  round({sql.haversine("latitude", "longitude", "lead(latitude) OVER w", "lead(longitude) OVER w")}, 4) AS next_m FROM gps {_BY_INDEX}""")
def _(spark, d):
    return audits.neighbour_distances(gps_points(spark, d)).select("trajectory_id", "source_point_index", F.round("previous_m", 4).alias("previous_m"), F.round("next_m", 4).alias("next_m"))


@register("w16_interpolation_residual", sql.FEATURES, f""", n AS (SELECT *, lag(latitude) OVER w AS a_lat, lag(longitude) OVER w AS a_lon, lead(latitude) OVER w AS b_lat, lead(longitude) OVER w AS b_lon, lag(is_low_quality) OVER w AS a_low, lead(is_low_quality) OVER w AS b_low,
  (elapsed_us - lag(elapsed_us) OVER w) / (lead(elapsed_us) OVER w - lag(elapsed_us) OVER w) AS share, lead(distance) OVER w AS b_distance, lead(speed) OVER w AS b_speed FROM flagged {_BY_INDEX}),
m AS (SELECT *, a_lat + share * (b_lat - a_lat) AS m_lat, a_lon + share * ({sql.pmod("b_lon - a_lon + 180.0", "360.0")} - 180.0) AS m_lon FROM n WHERE NOT is_low_quality AND NOT a_low AND NOT b_low)
SELECT trajectory_id, source_point_index, round({sql.haversine("latitude", "longitude", "m_lat", "m_lon")}, 3) AS residual_m, distance <= 3 AND b_distance <= 3 AND speed <= 0.5 AND b_speed <= 0.5 AS stationary FROM m""")
def _(spark, d):
    return audits.interpolation_residual(flagged(spark, d)).select("trajectory_id", "source_point_index", F.round("residual_m", 3).alias("residual_m"), "stationary")


@register("w18_segments_with_context", sql.GPS, f""", a AS (SELECT *, predicted = 1 AS is_on, coalesce(lag(predicted) OVER w = 1, false) AS was, coalesce(lead(predicted) OVER w = 1, false) AS will FROM gps {_BY_INDEX}),
b AS (SELECT *, CAST(sum(CASE WHEN is_on AND NOT was THEN 1 ELSE 0 END) OVER w AS BIGINT) AS run FROM a {_BY_INDEX})
SELECT trajectory_id, source_point_index, run AS segment, 'inside' AS part FROM b WHERE is_on UNION ALL SELECT trajectory_id, source_point_index, run, 'after' FROM b WHERE NOT is_on AND was
UNION ALL SELECT trajectory_id, source_point_index, run + 1, 'before' FROM b WHERE NOT is_on AND will""")
def _(spark, d):
    return audits.segments_with_context(gps_points(spark, d), "predicted").select("trajectory_id", "source_point_index", "segment", "part")


@register("w19_empirical_percentile", sql.GPS, """, ref AS (SELECT score AS s FROM gps WHERE anomaly_label = 0)
SELECT trajectory_id, source_point_index, round(100.0 * (count_if(s < score) + count_if(s <= score)) / (2 * count(*)), 6) AS percentile FROM gps, ref WHERE anomaly_label = 1 GROUP BY trajectory_id, source_point_index""")
def _(spark, d):
    p = gps_points(spark, d)
    out = audits.empirical_percentile(p.where("anomaly_label = 1"), p.where("anomaly_label = 0"), "score")
    return out.select("trajectory_id", "source_point_index", F.round("percentile", 6).alias("percentile"))


@register("a29_correlation", sql.FEATURES, """, k AS (SELECT score AS x, speed AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rx, rank() OVER (ORDER BY speed) + (count(*) OVER (PARTITION BY speed) - 1) / 2 AS ry FROM feat)
SELECT count(*) AS n, round(avg(CASE WHEN abs(x - y) <= 1e-5 + 1e-8 * abs(y) THEN 1.0 ELSE 0.0 END), 6) AS equal_fraction, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, '' AS reason FROM k""")
def _(spark, d):
    return audits.correlation(features(spark, d), "score", "speed")
