"""Queries of validation, scalar functions, set operations, manifests and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.operators import alerts, checks, evaluation, movement, routes
from trajspark.sources import gps
from trajspark.sources.gps import gps_points

from . import sql
from .catalog import features, flagged, register, split_flagged
from .labels import _COHORTS, MODEL, _robust

_BROKEN = sql.GPS + """, bad AS (SELECT user_id, trajectory_id, CASE WHEN source_point_index % 50 = 3 THEN NULL WHEN source_point_index % 50 = 7 THEN latitude + 90 ELSE latitude END AS latitude, CASE WHEN source_point_index % 50 = 11 THEN longitude + 90 ELSE longitude END AS longitude,
  CASE WHEN source_point_index % 50 = 13 THEN NULL WHEN source_point_index % 50 = 17 THEN elapsed_us - 60000000 ELSE elapsed_us END AS elapsed_us, source_point_index FROM gps)"""


def _broken(spark, d):
    """The points with some made invalid: null and out-of-range coordinates, missing and reversed times."""
    i = F.col("source_point_index") % 50
    return gps_points(spark, d).select("user_id", "trajectory_id", F.when(i == 3, None).when(i == 7, F.col("latitude") + 90).otherwise(F.col("latitude")).alias("latitude"), F.when(i == 11, F.col("longitude") + 90).otherwise(F.col("longitude")).alias("longitude"), F.when(i == 13, None).when(i == 17, F.col("elapsed_us") - 60_000_000).otherwise(F.col("elapsed_us")).alias("elapsed_us"), "source_point_index")


@register("v1_input_checks", _BROKEN, "SELECT count(*) AS points, count_if(latitude IS NULL OR longitude IS NULL) AS missing_coordinates, count_if(elapsed_us IS NULL) AS missing_times, count_if(abs(latitude) > 90) AS bad_latitude, count_if(abs(longitude) > 180) AS bad_longitude FROM bad")
def _(spark, d):
    return checks.input_violations(_broken(spark, d))


@register("s4_file_audit", _BROKEN, """, o AS (SELECT *, latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND elapsed_us IS NOT NULL AS ok, lag(elapsed_us) OVER (PARTITION BY trajectory_id ORDER BY source_point_index) AS before FROM bad)
SELECT trajectory_id, count(*) AS raw_rows, count_if(NOT coalesce(ok, false)) AS invalid_rows, count_if(elapsed_us < before) AS reversed_times, count(DISTINCT CASE WHEN ok THEN elapsed_us END) AS cleaned_rows, CASE WHEN count_if(coalesce(ok, false)) = 0 THEN 'all_rows_invalid' ELSE 'loaded' END AS load_status FROM o GROUP BY 1""")
def _(spark, d):
    return checks.file_audit(_broken(spark, d))


@register("v2_feature_ranges", sql.FEATURES, "SELECT trajectory_id, count(*) AS points, count_if(isinf(speed) OR isinf(distance) OR isinf(acceleration)) AS infinite, round(min(speed), 4) AS min_speed, round(max(speed), 4) AS max_speed, round(min(turn), 4) AS min_turn, round(max(turn), 4) AS max_turn, max(source_point_index) - min(source_point_index) + 1 = count(*) AS whole_index FROM feat GROUP BY 1")
def _(spark, d):
    return checks.feature_ranges(features(spark, d))


@register("v3_key_checks", _BROKEN, "SELECT count_if(source_point_index IS NULL OR trajectory_id IS NULL) AS missing, count_if(source_point_index < 0) AS negative, count(*) - count(DISTINCT trajectory_id || '#' || CAST(source_point_index AS VARCHAR)) AS repeated FROM bad")
def _(spark, d):
    return checks.key_violations(_broken(spark, d), "trajectory_id", "source_point_index")


@register("v4_user_ids", sql.GPS, """, u0 AS (SELECT DISTINCT user_id FROM gps UNION ALL SELECT DISTINCT 'u' || user_id FROM gps WHERE user_id LIKE '%2')
SELECT count(*) AS users, count_if(NOT regexp_full_match(user_id, '[0-9]{3}')) AS malformed, count(*) - count(DISTINCT user_id) AS repeated FROM u0""")
def _(spark, d):
    u = gps_points(spark, d).select("user_id").distinct()
    return checks.user_id_violations(u.union(u.where("user_id like '%2'").select(F.concat(F.lit("u"), "user_id"))))


_SPLIT = sql.FEATURES + sql.SPLITS + ", sp AS (SELECT f.*, dataset_split FROM flagged f JOIN split USING (user_id))"


@register("v5_split_disjoint", _SPLIT, """SELECT 'user_id' AS key, count(*) AS distinct_keys, count_if(n > 1) AS in_several FROM (SELECT user_id, count(DISTINCT dataset_split) AS n FROM sp GROUP BY 1) UNION ALL SELECT 'trajectory_id', count(*), count_if(n > 1) FROM (SELECT trajectory_id, count(DISTINCT dataset_split) AS n FROM sp GROUP BY 1)""")
def _(spark, d):
    return checks.split_overlap(split_flagged(spark, d), "user_id", "trajectory_id")


@register("v8_reference_admissible", _SPLIT, "SELECT count(*) AS points, count_if(dataset_split <> 'train') AS foreign_split, count_if(is_low_quality) AS low_quality, count_if(NOT is_training_eligible) AS not_eligible, count(DISTINCT CASE WHEN dataset_split = 'train' THEN trajectory_id END) AS train_sources FROM sp")
def _(spark, d):
    return checks.reference_violations(split_flagged(spark, d))


@register("a4_split_summary", _SPLIT, "SELECT dataset_split, count(DISTINCT user_id) AS users, count(DISTINCT trajectory_id) AS trajectories, count(*) AS points, CAST(sum(anomaly_label) AS BIGINT) AS labelled, count_if(is_low_quality) AS low_quality FROM sp GROUP BY 1")
def _(spark, d):
    return split_flagged(spark, d).groupBy("dataset_split").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("trajectory_id").alias("trajectories"), F.count("*").alias("points"), F.sum("anomaly_label").alias("labelled"), F.count_if("is_low_quality").alias("low_quality"))


@register("a3_reason_histogram", sql.FEATURES, "SELECT user_id, quality_reason, count(*) AS points, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM flagged WHERE is_low_quality GROUP BY user_id, quality_reason")
def _(spark, d):
    g = flagged(spark, d).where("is_low_quality").groupBy("user_id", "quality_reason").agg(F.count("*").alias("points"))
    return g.withColumn("share", F.round(F.col("points") / F.sum("points").over(Window.partitionBy("user_id")), 6))


@register("x17_reason_json", sql.FEATURES, """, g AS (SELECT user_id, quality_reason, count(*) AS n FROM flagged WHERE is_low_quality GROUP BY ALL)
SELECT user_id, '{' || string_agg('"' || quality_reason || '":' || CAST(n AS VARCHAR), ',' ORDER BY quality_reason) || '}' AS reasons FROM g GROUP BY 1""")
def _(spark, d):
    g = flagged(spark, d).where("is_low_quality").groupBy("user_id", "quality_reason").agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(geo.sorted_json(F.map_from_entries(F.collect_list(F.struct("quality_reason", "n")))).alias("reasons"))


@register("x4_x5_x11_encodings", sql.FEATURES, """SELECT trajectory_id, source_point_index, round(sin(radians(bearing)), 6) + 0.0 AS bearing_sin, round(cos(radians(bearing)), 6) + 0.0 AS bearing_cos, round(log10(1 + speed), 6) AS log_speed,
  round(6371000.0 * (-sin(radians(116.3)) * (cos(radians(latitude)) * cos(radians(longitude)) - cos(radians(39.9)) * cos(radians(116.3))) + cos(radians(116.3)) * (cos(radians(latitude)) * sin(radians(longitude)) - cos(radians(39.9)) * sin(radians(116.3)))), 3) + 0.0 AS east_m FROM feat""")
def _(spark, d):
    sine, cosine = geo.bearing_sin_cos(F.col("bearing"))
    z = lambda c, k: F.round(c, k) + 0.0
    return features(spark, d).select("trajectory_id", "source_point_index", z(sine, 6).alias("bearing_sin"), z(cosine, 6).alias("bearing_cos"), F.round(geo.log_score(F.col("speed")), 6).alias("log_speed"), z(geo.enu(F.col("latitude"), F.col("longitude"), 39.9, 116.3)["x"], 3).alias("east_m"))


@register("x12_seeds", sql.GPS, """SELECT trajectory_id, CAST('0x' || substr(sha256('[42, "' || trajectory_id || '", "route_deviation", 1]'), 1, 16) AS UBIGINT)::VARCHAR AS seed FROM gps GROUP BY 1""")
def _(spark, d):
    return gps_points(spark, d).select("trajectory_id").distinct().select("trajectory_id", geo.seed_for(42, F.col("trajectory_id"), "route_deviation").cast("string").alias("seed"))


@register("x13_reason_lists", sql.FEATURES, "SELECT trajectory_id, source_point_index, array_to_string(list_filter(string_split(quality_reason, ';'), lambda x: x <> 'gps_jump'), ';') AS reasons FROM flagged WHERE is_low_quality")
def _(spark, d):
    return flagged(spark, d).where("is_low_quality").select("trajectory_id", "source_point_index", geo.without_reason(F.col("quality_reason"), "gps_jump").alias("reasons"))


@register("x14_ratio_reasons", sql.GPS, "SELECT trajectory_id, round(count_if(predicted = 1 AND anomaly_label = 1) / nullif(count_if(predicted = 1 AND source_point_index < 20), 0), 6) AS ratio, CASE WHEN count_if(predicted = 1 AND source_point_index < 20) = 0 THEN 'zero_denominator' ELSE '' END AS reason FROM gps GROUP BY 1")
def _(spark, d):
    hit, early = F.count_if((F.col("predicted") == 1) & (F.col("anomaly_label") == 1)), F.count_if((F.col("predicted") == 1) & (F.col("source_point_index") < 20))
    g = gps_points(spark, d).groupBy("trajectory_id").agg(hit.alias("a"), early.alias("b"))
    return g.select("trajectory_id", F.round(geo.safe_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), geo.ratio_reason(F.col("b")).alias("reason"))


@register("x15_markers", sql.FEATURES, "SELECT trajectory_id, source_point_index, concat_ws(';', CASE WHEN is_gps_jump THEN 'jump' END, CASE WHEN is_unrealistic_speed THEN 'speed' END, CASE WHEN is_long_gap THEN 'gap' END, CASE WHEN turn > 120 THEN 'turn' END, CASE WHEN stop_s > 60 THEN 'stop' END) AS markers FROM flagged WHERE is_gps_jump OR is_unrealistic_speed OR is_long_gap OR turn > 120 OR stop_s > 60")
def _(spark, d):
    return movement.marked_points(flagged(spark, d))


@register("f11_abstention", _SPLIT, "SELECT radius_m, count_if(m <= radius_m) AS kept, count_if(m <= radius_m AND anomaly_label = 1) AS kept_labelled FROM (SELECT *, distance AS m FROM flagged), (SELECT CAST(unnest([10, 25, 50, 100, 200, 500, 1000]) AS INTEGER) AS radius_m) GROUP BY 1")
def _(spark, d):
    return evaluation.abstention(flagged(spark, d), "distance", (10, 25, 50, 100, 200, 500, 1000))


@register("f13_minimum_context", sql.GPS, "SELECT minimum_points, count_if(source_point_index >= minimum_points) AS supported, count_if(source_point_index > 0 AND source_point_index < minimum_points) AS insufficient FROM gps, (SELECT CAST(unnest([10, 25, 50, 100]) AS INTEGER) AS minimum_points) GROUP BY 1")
def _(spark, d):
    return evaluation.minimum_context(gps_points(spark, d), "source_point_index", (10, 25, 50, 100))


@register("f14_k1_one_trajectory", sql.GPS, "SELECT trajectory_id, source_point_index, elapsed_us FROM gps WHERE trajectory_id = (SELECT min(trajectory_id) FROM gps)")
def _(spark, d):
    p = gps_points(spark, d)
    return movement.one_trajectory(p, p.agg(F.min("trajectory_id")).first()[0]).select("trajectory_id", "source_point_index", "elapsed_us")


@register("f15_observable", sql.FEATURES, "SELECT user_id, trajectory_id, source_point_index, elapsed_us, latitude, longitude FROM flagged")
def _(spark, d):
    return movement.observable(flagged(spark, d))


@register("k6_thinned", sql.GPS, "SELECT trajectory_id, source_point_index FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY source_point_index) AS n FROM gps) WHERE (n - 1) % 10 = 0")
def _(spark, d):
    return movement.thinned(gps_points(spark, d), 10).select("trajectory_id", "source_point_index")


@register("s2_k2_first_files", sql.GPS, """, f AS (SELECT DISTINCT user_id, trajectory_id AS file_name FROM gps), r2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY file_name) AS n FROM f WHERE user_id NOT LIKE '%3')
SELECT x.user_id, r2.file_name FROM (SELECT DISTINCT user_id FROM gps) x LEFT JOIN r2 ON r2.user_id = x.user_id AND n <= 2""")
def _(spark, d):
    p = gps_points(spark, d).select("user_id", F.col("trajectory_id").alias("file_name")).distinct()
    return gps.first_files(p.where("user_id not like '%3'"), p.select("user_id").distinct(), 2).select("user_id", "file_name")


@register("s11_ui_user_usage", _SPLIT, "SELECT DISTINCT user_id FROM sp WHERE dataset_split = 'train' INTERSECT SELECT DISTINCT user_id FROM sp WHERE is_low_quality")
def _(spark, d):
    p = split_flagged(spark, d)
    return p.where("dataset_split = 'train'").select("user_id").intersect(p.where("is_low_quality").select("user_id"))


@register("u_union_aligned", sql.GPS, "SELECT trajectory_id, source_point_index, NULL::INTEGER AS predicted, anomaly_label FROM gps WHERE anomaly_label = 1 UNION ALL SELECT trajectory_id, source_point_index, predicted, NULL FROM gps WHERE predicted = 1")
def _(spark, d):
    p = gps_points(spark, d)
    return p.where("anomaly_label = 1").select("trajectory_id", "source_point_index", "anomaly_label").unionByName(p.where("predicted = 1").select("trajectory_id", "source_point_index", "predicted"), allowMissingColumns=True)


@register("u_except_both", sql.GPS, """, a AS (SELECT trajectory_id, source_point_index FROM gps WHERE anomaly_label = 1), b AS (SELECT trajectory_id, source_point_index FROM gps WHERE predicted = 1)
SELECT 'left_only' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right_only', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(spark, d):
    p = gps_points(spark, d)
    return checks.set_differences(*[p.where(f"{c} = 1").select("trajectory_id", "source_point_index") for c in ("anomaly_label", "predicted")])


@register("ud_distinct", sql.GPS, "SELECT DISTINCT user_id, anomaly_label, predicted FROM gps")
def _(spark, d):
    return gps_points(spark, d).select("user_id", "anomaly_label", "predicted").distinct()


_QUALITY = sql.FEATURES + """, q0 AS (SELECT user_id, trajectory_id, count(*) AS points, count_if(is_low_quality) AS low FROM flagged GROUP BY ALL), q AS (SELECT *, points >= 100 AND low <= 0.05 * points AS eligible FROM q0)"""


@register("j5_manifest", _QUALITY + sql.SPLITS, "SELECT q.trajectory_id, q.user_id, dataset_split, points, low, eligible FROM q LEFT JOIN split USING (user_id)")
def _(spark, d):
    from trajspark.operators import datasets

    p = flagged(spark, d)
    return checks.manifest(movement.trajectory_quality(p), datasets.user_splits(p))


@register("j13_semi_anti", _QUALITY, "SELECT trajectory_id, count(*) AS points FROM gps WHERE trajectory_id IN (SELECT trajectory_id FROM q WHERE eligible) AND user_id NOT IN (SELECT user_id FROM gps GROUP BY 1 HAVING count(*) % 3 = 0) GROUP BY 1")
def _(spark, d):
    p = gps_points(spark, d)
    good = movement.trajectory_quality(flagged(spark, d)).where("eligible").select("trajectory_id")
    out = p.groupBy("user_id").count().where("count % 3 = 0").select("user_id")
    return p.join(good, "trajectory_id", "left_semi").join(out, "user_id", "left_anti").groupBy("trajectory_id").agg(F.count("*").alias("points"))


@register("j16_config_cross", sql.GPS, "SELECT user_id, cutoff, count_if(score > cutoff) AS above FROM (SELECT DISTINCT user_id AS u2 FROM gps) CROSS JOIN (SELECT CAST(unnest([100, 200, 400]) AS INTEGER) AS cutoff) LEFT JOIN gps ON user_id = u2 GROUP BY ALL")
def _(spark, d):
    g = gps_points(spark, d).select("user_id", "score", F.explode(F.lit([100, 200, 400])).alias("cutoff"))
    return g.groupBy("user_id", "cutoff").agg(F.count_if(F.col("score") > F.col("cutoff")).alias("above"))


@register("a40_row_digest", sql.GPS, "SELECT user_id, count(*) AS rows, CAST(bit_xor(CAST('0x' || substr(sha256(trajectory_id || '|' || CAST(source_point_index AS VARCHAR) || '|' || CAST(elapsed_us AS VARCHAR)), 1, 15) AS BIGINT)) AS BIGINT) AS digest FROM gps GROUP BY 1")
def _(spark, d):
    return checks.row_digest(gps_points(spark, d), ["trajectory_id", "source_point_index", "elapsed_us"], "user_id")


@register("a41_histogram", sql.FEATURES, ", e AS (SELECT quantile_cont(speed, [0.01, 0.99]) AS q FROM feat), h AS (SELECT least(greatest(CAST(floor((speed - q[1]) / nullif(q[2] - q[1], 0) * 20) AS INTEGER), -1), 20) AS bin FROM feat, e)\nSELECT bin, count(*) AS points, CAST(sum(count(*)) OVER (ORDER BY bin) AS BIGINT) AS cumulative FROM h GROUP BY bin")
def _(spark, d):
    return evaluation.histogram(features(spark, d), "speed", 20)


@register("a11_precision_recall", sql.GPS, """, h AS (SELECT score AS threshold, count_if(anomaly_label = 1) AS p, count(*) AS n FROM gps GROUP BY 1), s AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS taken, (SELECT sum(p) FROM h) AS pos FROM h WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, tp / taken AS precision, tp / nullif(pos, 0) AS recall FROM s""")
def _(spark, d):
    return evaluation.precision_recall(gps_points(spark, d))


@register("t5_sliding_burden", sql.GPS, """, w AS (SELECT *, unnest([0, 1, 2, 3]) AS back FROM gps), v AS (SELECT trajectory_id, (elapsed_us // 900000000 - back) * 900000000 AS start_us, predicted FROM w)
SELECT trajectory_id, start_us, CAST(sum(predicted) AS BIGINT) AS positives, count(*) AS points FROM v GROUP BY ALL""")
def _(spark, d):
    p = gps_points(spark, d).withColumn("timestamp", F.timestamp_micros("elapsed_us"))
    g = p.groupBy("trajectory_id", F.window("timestamp", "1 hour", "15 minutes")).agg(F.sum("predicted").alias("positives"), F.count("*").alias("points"))
    return g.select("trajectory_id", F.expr("unix_micros(window.start)").alias("start_us"), "positives", "points")


@register("u1_grouped_summary", sql.GPS, "SELECT CASE WHEN user_id LIKE '%3' THEN NULL ELSE user_id END AS user_id, count(*) AS points, CAST(sum(predicted) AS BIGINT) AS positives FROM gps GROUP BY 1")
def _(spark, d):
    p = gps_points(spark, d).withColumn("user_id", F.when(~F.col("user_id").like("%3"), F.col("user_id")))
    return evaluation.grouped_summary(p, ["user_id"], F.count("*").alias("points"), F.sum("predicted").alias("positives"))


_WINDOWS = " UNION ALL ".join(f"SELECT {n} AS width, trajectory_id, source_point_index - {n - 1} AS start_index, source_point_index AS end_index, min(lat_udeg) OVER w{n} AS low, max(lat_udeg) OVER w{n} AS high, sum(lon_udeg) OVER w{n} AS lon_sum, count(*) OVER w{n} AS n FROM gps WINDOW w{n} AS (PARTITION BY trajectory_id ORDER BY source_point_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (10, 25, 50))


@register("w17_windows_all_widths", sql.GPS + f", a AS ({_WINDOWS})", "SELECT width, trajectory_id, start_index, end_index, low, high, CAST(lon_sum AS BIGINT) AS lon_sum FROM a WHERE n = width AND start_index % 10 = 0")
def _(spark, d):
    return movement.sliding_windows(gps_points(spark, d), (10, 25, 50), 10).select("width", "trajectory_id", "start_index", "end_index", F.array_min("w.lat_udeg").alias("low"), F.array_max("w.lat_udeg").alias("high"), F.aggregate("w", F.lit(0).cast("bigint"), lambda t, x: t + x["lon_udeg"]).alias("lon_sum"))


@register("d9_rule_all_features", _COHORTS, "SELECT f.trajectory_id, f.source_point_index, round(greatest(" + ", ".join(f"abs({c} - (SELECT median FROM rf WHERE feature = '{c}')) / (SELECT scale FROM rf WHERE feature = '{c}')" for c in MODEL) + "), 3) AS rule_score FROM (SELECT *, sin(radians(bearing)) AS bearing_sin, cos(radians(bearing)) AS bearing_cos FROM flagged) f")
def _(spark, d):
    f = routes.with_bearing_parts(flagged(spark, d))
    return movement.rule_score(f, _robust(spark, d).select("feature", "median", "scale"), list(MODEL)).select("trajectory_id", "source_point_index", F.round("rule_score", 3).alias("rule_score"))


@register("d16_end_to_end", sql.FEATURES + sql.gate(3, 2).removeprefix(sql.GPS) + sql.cooled(60), "SELECT f.trajectory_id, f.source_point_index, CASE WHEN f.is_low_quality THEN NULL ELSE f.predicted END AS prediction, CASE WHEN f.is_low_quality THEN 'quality_unknown' ELSE 'scored' END AS status, coalesce(c.emitted, false) AND NOT f.is_low_quality AS notified FROM flagged f LEFT JOIN cooled c USING (trajectory_id, source_point_index)", recursive=True)
def _(spark, d):
    f = flagged(spark, d)
    emitted = alerts.cooldown(alerts.vote_gate(f, 3, 2), 60).select("trajectory_id", "source_point_index", "emitted")
    low = F.col("is_low_quality")
    j = f.join(emitted, ["trajectory_id", "source_point_index"], "left")
    return j.select("trajectory_id", "source_point_index", F.when(~low, F.col("predicted")).alias("prediction"), F.when(low, "quality_unknown").otherwise("scored").alias("status"), (F.coalesce("emitted", F.lit(False)) & ~low).alias("notified"))
