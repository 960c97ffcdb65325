"""Queries over injected copies: the injection itself, lineage joins, label and route audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.operators import datasets, routes
from trajspark.sources.gps import gps_points

from . import sql
from .catalog import copies, features, flagged, once, register, split_flagged

MODEL = routes.MODEL

_SEG = sql.FEATURES + sql.COPIES


@register("d2_segments", _SEG, "SELECT trajectory_id, anomaly_type, len AS segment_length, start AS segment_start FROM seg")
def _(spark, d):
    return datasets.segments(split_flagged(spark, d).where("dataset_split <> 'train'")).select("trajectory_id", "anomaly_type", "segment_length", "segment_start")


for _name, _kind in (("d3_route_deviation", "route_deviation"), ("d4_abnormal_speed", "abnormal_speed"), ("d5_long_stop", "long_stop"), ("d6_direction_change", "direction_change")):

    @register(_name, _SEG, f"SELECT trajectory_id, source_point_index, anomaly_label, elapsed_us, round(latitude, 7) AS latitude, round(longitude, 7) AS longitude FROM copies WHERE anomaly_type = '{_kind}'")
    def _(spark, d, kind=_kind):
        c = datasets.inject(split_flagged(spark, d).where("dataset_split <> 'train'")).where(F.col("anomaly_type") == kind)
        return c.select("trajectory_id", "source_point_index", "anomaly_label", "elapsed_us", F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"))


@register("d7_injected_copies", _SEG, """SELECT trajectory_id AS sample_id, source_trajectory_id, anomaly_type, count(*) AS generated_points, CAST(sum(anomaly_label) AS BIGINT) AS anomaly_points, min(CASE WHEN anomaly_label = 1 THEN elapsed_us END) AS anomaly_start_us,
  max(CASE WHEN anomaly_label = 1 THEN elapsed_us END) AS anomaly_end_us, round(sum(distance), 3) AS distance_m, round(max(speed), 4) AS max_speed, count_if(is_low_quality) AS low_quality FROM c_flagged GROUP BY ALL""")
def _(spark, d):
    on = F.when(F.col("anomaly_label") == 1, F.col("elapsed_us"))
    return copies(spark, d).groupBy(F.col("trajectory_id").alias("sample_id"), "source_trajectory_id", "anomaly_type").agg(
        F.count("*").alias("generated_points"), F.sum("anomaly_label").alias("anomaly_points"), F.min(on).alias("anomaly_start_us"), F.max(on).alias("anomaly_end_us"),
        F.round(F.sum("distance"), 3).alias("distance_m"), F.round(F.max("speed"), 4).alias("max_speed"), F.count_if("is_low_quality").alias("low_quality"),
    )


_Q = _SEG + """, joined AS (SELECT c.*, f.is_training_eligible AS source_quality_valid FROM c_flagged c LEFT JOIN flagged f ON f.trajectory_id = c.source_trajectory_id AND f.source_point_index = c.source_point_index)"""


def _attached(spark, d):
    return routes.attach_source_quality(copies(spark, d), flagged(spark, d))


@register("j1_source_quality", _Q, "SELECT trajectory_id, source_point_index, source_quality_valid, source_quality_valid = is_training_eligible AS agrees FROM joined")
def _(spark, d):
    return _attached(spark, d).select("trajectory_id", "source_point_index", "source_quality_valid", (F.col("source_quality_valid") == F.col("is_training_eligible")).alias("agrees"))


@register("j2_quality_by_position", _SEG, """, a AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY elapsed_us, source_point_index) AS nth FROM c_flagged), b AS (SELECT trajectory_id AS source_trajectory_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY elapsed_us, source_point_index) AS nth, is_training_eligible AS source_quality_valid FROM flagged)
SELECT a.trajectory_id, a.source_point_index, b.source_quality_valid FROM a LEFT JOIN b USING (source_trajectory_id, nth)""")
def _(spark, d):
    return routes.attach_by_position(copies(spark, d), flagged(spark, d)).select("trajectory_id", "source_point_index", "source_quality_valid")


@register("f7_evaluation_rows", _Q, """, e AS (SELECT 'original' AS part, trajectory_id, source_point_index, 0 AS label FROM flagged JOIN split USING (user_id) WHERE dataset_split <> 'train' AND is_training_eligible
  UNION ALL SELECT 'copy', trajectory_id, source_point_index, 1 FROM joined WHERE anomaly_label = 1 AND source_quality_valid AND NOT is_low_quality)
SELECT part, label, count(*) AS points, count(DISTINCT trajectory_id) AS trajectories FROM e GROUP BY ALL""")
def _(spark, d):
    normal = split_flagged(spark, d).where("dataset_split <> 'train' and is_training_eligible").select(F.lit("original").alias("part"), "trajectory_id", "source_point_index", F.lit(0).alias("label"))
    copied = _attached(spark, d).where("anomaly_label = 1 and source_quality_valid and not is_low_quality").select(F.lit("copy").alias("part"), "trajectory_id", "source_point_index", F.lit(1).alias("label"))
    return normal.union(copied).groupBy("part", "label").agg(F.count("*").alias("points"), F.countDistinct("trajectory_id").alias("trajectories"))


@register("f8_validation_normals", _SEG, "SELECT trajectory_id, source_point_index FROM own WHERE dataset_split = 'val' AND anomaly_label = 0 AND is_training_eligible")
def _(spark, d):
    return split_flagged(spark, d).where("dataset_split = 'val' and anomaly_label = 0 and is_training_eligible").select("trajectory_id", "source_point_index")


@register("f4_normal_metadata", sql.GPS, "SELECT trajectory_id || '__normal' AS sample_id, trajectory_id AS source_trajectory_id, source_point_index, false AS is_synthetic, 0 AS anomaly_label, 'normal' AS anomaly_type, '' AS anomaly_segment_id FROM gps")
def _(spark, d):
    p = gps_points(spark, d)
    return p.select(F.concat_ws("__", "trajectory_id", F.lit("normal")).alias("sample_id"), F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index", F.lit(False).alias("is_synthetic"), F.lit(0).alias("anomaly_label"), F.lit("normal").alias("anomaly_type"), F.lit("").alias("anomaly_segment_id"))


_PARTS = "sin(radians(bearing)) AS bearing_sin, cos(radians(bearing)) AS bearing_cos"
_DIFF = ", ".join(f"c.{c} - o.{c} AS {c}_delta, NOT (abs(c.{c} - o.{c}) <= 1e-5 + 1e-8 * abs(o.{c})) AS {c}_changed" for c in MODEL)
_DELTAS = _SEG + f""", cb AS (SELECT *, {_PARTS} FROM c_flagged), ob AS (SELECT *, {_PARTS} FROM flagged),
dl0 AS (SELECT c.*, {_DIFF}, {sql.haversine("o.latitude", "o.longitude", "c.latitude", "c.longitude")} AS displacement_m, (c.elapsed_us - o.elapsed_us) / 1e6 AS time_delta_s, c.latitude <> o.latitude OR c.longitude <> o.longitude AS coordinate_changed, o.is_training_eligible AS original_is_training_eligible
  FROM cb c JOIN ob o ON o.trajectory_id = c.source_trajectory_id AND o.source_point_index = c.source_point_index),
dl1 AS (SELECT *, displacement_m > 1e-6 AS displaced, {" + ".join(f"CAST({c}_changed AS INTEGER)" for c in MODEL)} AS changed_features FROM dl0),
dl AS (SELECT *, CASE WHEN changed_features = 0 THEN '0' WHEN changed_features = 1 THEN '1' WHEN changed_features <= 3 THEN '2-3' ELSE '4+' END AS feature_category, CASE WHEN displacement_m <= 1e-6 THEN 'zero' WHEN displacement_m < 10 THEN '0-10'
  WHEN displacement_m < 25 THEN '10-25' WHEN displacement_m < 50 THEN '25-50' WHEN displacement_m < 100 THEN '50-100' WHEN displacement_m < 200 THEN '100-200' ELSE '200+' END AS displacement_bin FROM dl1)"""
_STRUCT = _DELTAS + """, st0 AS (SELECT *, coalesce(lag(displaced) OVER w, false) AS previous_displaced, coalesce(lead(displaced) OVER w, false) AS next_displaced, CAST(sum(CAST(displaced AS INTEGER)) OVER w - CAST(displaced AS INTEGER) AS BIGINT) AS past_displaced,
  NOT displaced AND changed_features > 0 AS propagated_only, CASE WHEN anomaly_label = 1 AND coalesce(lag(anomaly_label) OVER w, 0) <> 1 THEN 1 ELSE 0 END AS s FROM dl WINDOW w AS (PARTITION BY trajectory_id ORDER BY source_point_index)),
st1 AS (SELECT *, CAST(sum(s) OVER (PARTITION BY trajectory_id ORDER BY source_point_index) AS BIGINT) AS lrun FROM st0),
st2 AS (SELECT *, CASE WHEN anomaly_label = 1 THEN row_number() OVER (PARTITION BY trajectory_id, anomaly_label, lrun ORDER BY source_point_index) - 1 ELSE -1 END AS segment_position, CASE WHEN anomaly_label = 1 THEN count(*) OVER (PARTITION BY trajectory_id, anomaly_label, lrun) ELSE 0 END AS segment_length,
  CASE WHEN anomaly_label = 1 THEN lrun END AS label_run FROM st1),
st3 AS (SELECT *, CASE WHEN anomaly_label = 1 THEN segment_position / greatest(segment_length - 1, 1) END AS relative_position, CASE WHEN anomaly_label <> 1 THEN 'outside' WHEN segment_length = 1 THEN 'singleton' WHEN segment_position = 0 THEN 'start' WHEN segment_position = segment_length - 1 THEN 'end' ELSE 'interior' END AS boundary FROM st2),
st AS (SELECT *, CASE WHEN anomaly_label <> 1 THEN 'outside' WHEN relative_position < 1 / 3 THEN 'early' WHEN relative_position < 2 / 3 THEN 'middle' ELSE 'late' END AS bucket FROM st3)"""


def _deltas(spark, d):
    return routes.point_deltas(routes.aligned(routes.with_bearing_parts(copies(spark, d)), routes.with_bearing_parts(flagged(spark, d))))


def _structured(spark, d):
    return routes.segment_structure(_deltas(spark, d))


@register("j4_source_alignment", _DELTAS, "SELECT trajectory_id, source_point_index, displaced, coordinate_changed, round(displacement_m, 4) AS displacement_m, round(time_delta_s, 6) AS time_delta_s, CAST(changed_features AS INTEGER) AS changed_features FROM dl")
def _(spark, d):
    return _deltas(spark, d).select("trajectory_id", "source_point_index", "displaced", "coordinate_changed", F.round("displacement_m", 4).alias("displacement_m"), F.round("time_delta_s", 6).alias("time_delta_s"), "changed_features")


@register("x8_feature_categories", _DELTAS, "SELECT anomaly_type, displacement_bin, feature_category, count(*) AS points FROM dl GROUP BY ALL")
def _(spark, d):
    return _deltas(spark, d).groupBy("anomaly_type", "displacement_bin", "feature_category").agg(F.count("*").alias("points"))


_STCOLS = ("trajectory_id", "source_point_index", "label_run", "segment_position", "segment_length", "boundary", "bucket", "previous_displaced", "next_displaced", "past_displaced", "propagated_only")


@register("w12_segment_structure", _STRUCT, f"SELECT {', '.join(_STCOLS)}, round(relative_position, 6) AS relative_position FROM st")
def _(spark, d):
    return _structured(spark, d).select(*_STCOLS, F.round("relative_position", 6).alias("relative_position"))


@register("a28_progression", _STRUCT, """SELECT bucket, count(*) AS points, round(quantile_cont(displacement_m, 0.5), 4) AS displacement_median, round(quantile_cont(displacement_m, 0.9), 4) AS displacement_p90, round(quantile_cont(changed_features, 0.5), 4) AS changed_median FROM st WHERE anomaly_label = 1 GROUP BY 1
UNION ALL SELECT boundary, count(*), round(quantile_cont(displacement_m, 0.5), 4), round(quantile_cont(displacement_m, 0.9), 4), round(quantile_cont(changed_features, 0.5), 4) FROM st WHERE anomaly_label = 1 GROUP BY 1""")
def _(spark, d):
    p = _structured(spark, d).where("anomaly_label = 1").select(F.explode(F.array("bucket", "boundary")).alias("bucket"), "displacement_m", "changed_features")
    q = lambda c, x: F.round(F.percentile(c, x), 4)
    return p.groupBy("bucket").agg(F.count("*").alias("points"), q("displacement_m", 0.5).alias("displacement_median"), q("displacement_m", 0.9).alias("displacement_p90"), q("changed_features", 0.5).alias("changed_median"))


@register("a31_feature_deltas", _DELTAS, " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS points, count_if({c}_changed) AS changed, round(100.0 * count_if({c}_changed) / count(*), 6) AS changed_percentage, round(quantile_cont(abs({c}_delta), 0.5), 4) AS median,
  round(quantile_cont(abs({c}_delta), 0.9), 4) AS p90, round(quantile_cont(abs({c}_delta), 0.95), 4) AS p95 FROM dl WHERE anomaly_label = 1""" for c in MODEL))
def _(spark, d):
    p = routes.unpivoted_deltas(_deltas(spark, d).where("anomaly_label = 1"))
    q = lambda x: F.round(F.percentile(F.abs("delta"), x), 4)
    return p.groupBy("feature").agg(F.count("*").alias("points"), F.count_if("changed").alias("changed"), F.round(100.0 * F.count_if("changed") / F.count("*"), 6).alias("changed_percentage"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.95).alias("p95"))


@register("a36_contingency", _STRUCT, """SELECT label AS anomaly_label, changed AS coordinate_changed, count(st.trajectory_id) AS points FROM (SELECT unnest([0, 0, 1, 1]) AS label, unnest([false, true, false, true]) AS changed) g
  LEFT JOIN st ON st.anomaly_label = label AND st.coordinate_changed = changed GROUP BY ALL""")
def _(spark, d):
    return routes.contingency(_structured(spark, d), "anomaly_label", "coordinate_changed")


@register("a36_displacement_thresholds", _DELTAS, "SELECT threshold_m, count_if(displacement_m > threshold_m OR threshold_m > 0 AND displacement_m = threshold_m) AS points, round(100.0 * count_if(displacement_m > threshold_m OR threshold_m > 0 AND displacement_m = threshold_m) / count(*), 6) AS percentage FROM dl, (SELECT CAST(unnest([0, 10, 25, 50, 100, 200]) AS INTEGER) AS threshold_m) WHERE anomaly_label = 1 GROUP BY 1")
def _(spark, d):
    p = _deltas(spark, d).where("anomaly_label = 1").select("displacement_m", F.explode(F.lit([0, 10, 25, 50, 100, 200])).alias("threshold_m"))
    hit = F.count_if((F.col("displacement_m") > F.col("threshold_m")) | ((F.col("threshold_m") > 0) & (F.col("displacement_m") == F.col("threshold_m"))))
    return p.groupBy("threshold_m").agg(hit.alias("points"), F.round(100.0 * hit / F.count("*"), 6).alias("percentage"))


@register("a36_propagation", _STRUCT, """SELECT CASE anomaly_label WHEN 1 THEN 'labelled' WHEN 0 THEN 'not_labelled' ELSE 'all' END AS scope, count(*) AS points, count_if(coordinate_changed) AS modified, count_if(propagated_only) AS propagated, count_if(propagated_only AND previous_displaced) AS after_displaced,
  count_if(propagated_only AND next_displaced) AS before_displaced, count_if(propagated_only AND NOT previous_displaced) AS carried FROM st GROUP BY GROUPING SETS ((anomaly_label), ())""")
def _(spark, d):
    only = F.col("propagated_only")
    g = _structured(spark, d).rollup("anomaly_label").agg(F.count("*").alias("points"), F.count_if("coordinate_changed").alias("modified"), F.count_if(only).alias("propagated"), F.count_if(only & F.col("previous_displaced")).alias("after_displaced"), F.count_if(only & F.col("next_displaced")).alias("before_displaced"), F.count_if(only & ~F.col("previous_displaced")).alias("carried"))
    scope = F.when(F.col("anomaly_label") == 1, "labelled").when(F.col("anomaly_label") == 0, "not_labelled").otherwise("all")
    return g.select(scope.alias("scope"), "points", "modified", "propagated", "after_displaced", "before_displaced", "carried")


@register("a37_segment_audit", _STRUCT, f""", sm AS (SELECT *, coalesce({sql.haversine("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")}, 0.0) AS step_m FROM st WINDOW w AS (PARTITION BY trajectory_id ORDER BY source_point_index))
SELECT trajectory_id, anomaly_type, count(*) AS points, count_if(anomaly_label = 1) AS labelled, min(CASE WHEN anomaly_label = 1 THEN source_point_index END) AS first_index, max(CASE WHEN anomaly_label = 1 THEN source_point_index END) AS last_index,
  count_if(anomaly_label = 1 AND is_training_eligible) AS evaluated, count_if(anomaly_label = 1 AND NOT displaced) AS zero_displacement, count_if(anomaly_label = 1 AND changed_features = 0) AS near_identical, count_if(anomaly_label <> 1 AND displaced) AS unlabelled_displaced,
  count_if(anomaly_label <> 1 AND changed_features > 0) AS unlabelled_changed, round(max(CASE WHEN anomaly_label = 1 THEN displacement_m END), 4) AS max_displacement_m, count_if(anomaly_label = 1 AND speed > 50) AS fast, count_if(anomaly_label = 1 AND step_m > 1000 AND dt <= 60) AS jumps FROM sm GROUP BY ALL""")
def _(spark, d):
    return routes.segment_audit(_structured(spark, d))


# context: nearest earlier point of the own copy and of the own original
_TIERS = _STRUCT + f""", cp AS (SELECT a.trajectory_id, a.source_point_index, min({sql.haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")}) AS prefix_synthetic_m FROM c_flagged a JOIN c_flagged b ON a.trajectory_id = b.trajectory_id AND b.elapsed_us < a.elapsed_us WHERE a.anomaly_label = 1 GROUP BY ALL),
op AS (SELECT a.trajectory_id AS source_trajectory_id, a.source_point_index, min({sql.haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")}) AS prefix_original_m FROM own a JOIN own b ON a.trajectory_id = b.trajectory_id AND b.elapsed_us < a.elapsed_us GROUP BY ALL),
ti0 AS (SELECT st.*, prefix_synthetic_m, prefix_original_m, prefix_synthetic_m IS NOT NULL AND prefix_original_m IS NOT NULL AS complete, coalesce(abs(prefix_synthetic_m - prefix_original_m) > 1e-5 + 1e-8 * abs(prefix_original_m), false) AS context_changed
  FROM st LEFT JOIN cp USING (trajectory_id, source_point_index) LEFT JOIN op USING (source_trajectory_id, source_point_index) WHERE anomaly_label = 1),
ti AS (SELECT *, CASE WHEN displaced THEN 'tier1' WHEN changed_features > 0 THEN 'tier2' WHEN context_changed THEN 'tier3' WHEN complete THEN 'tier4' END AS tier FROM ti0)"""


@once
def _tiered(spark, d):
    from trajspark.operators import spatial

    own = split_flagged(spark, d).where("dataset_split <> 'train'")
    c = copies(spark, d)
    at = ["trajectory_id", "source_point_index", "latitude", "longitude", "elapsed_us"]
    near = lambda q, r: spatial.causal_nearest(q.select(*at), r.select(*at), ("trajectory_id",)).select("trajectory_id", "source_point_index", "nearest_m")
    synthetic = near(c.where("anomaly_label = 1"), c).withColumnRenamed("nearest_m", "prefix_synthetic_m")
    original = near(own, own).select(F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index", F.col("nearest_m").alias("prefix_original_m"))
    p = _structured(spark, d).where("anomaly_label = 1").join(synthetic, ["trajectory_id", "source_point_index"], "left").join(original, ["source_trajectory_id", "source_point_index"], "left")
    return routes.tiers(p, ("prefix",))


@register("a32_tiers", _TIERS, "SELECT trajectory_id, source_point_index, tier AS identifiability_tier, context_changed FROM ti")
def _(spark, d):
    return _tiered(spark, d).select("trajectory_id", "source_point_index", "identifiability_tier", "context_changed")


_T4 = ", ".join(f"count_if(tier = '{t}') AS {t}" for t in routes.TIERS)


@register("a35_tier_summary", _TIERS, f"""SELECT coalesce(user_id, 'ALL') AS user_id, count(*) AS points, {_T4}, round(count_if(coalesce(tier <> 'tier4', false)) / count(*), 6) AS observable_ratio, count(DISTINCT trajectory_id) AS samples, round(quantile_cont(displacement_m, 0.5), 4) AS displacement_median FROM ti GROUP BY ROLLUP (user_id)""")
def _(spark, d):
    p = _tiered(spark, d)
    g = p.rollup("user_id").agg(F.count("*").alias("points"), *routes.counts_by(p, "identifiability_tier", routes.TIERS), F.round(F.count_if("observable") / F.count("*"), 6).alias("observable_ratio"), F.countDistinct("trajectory_id").alias("samples"), F.round(F.percentile("displacement_m", 0.5), 4).alias("displacement_median"))
    return g.withColumn("user_id", F.coalesce("user_id", F.lit("ALL")))


@register("a35_sample_summary", _TIERS, f"SELECT trajectory_id, anomaly_type, count(*) AS points, count_if(displaced) AS displaced, round(max(displacement_m), 4) AS displacement_max, {_T4} FROM ti GROUP BY ALL")
def _(spark, d):
    p = _tiered(spark, d)
    return p.groupBy("trajectory_id", "anomaly_type").agg(F.count("*").alias("points"), F.count_if("displaced").alias("displaced"), F.round(F.max("displacement_m"), 4).alias("displacement_max"), *routes.counts_by(p, "identifiability_tier", routes.TIERS))


@register("a35_label_policies", _TIERS, """, b AS (SELECT *, tier = 'tier1' AS direct, coalesce(tier <> 'tier4', false) AS seen, boundary IN ('start', 'end', 'singleton') AS edge FROM ti)
SELECT 'A direct displacement' AS policy, count_if(direct) AS positive, 0 AS ignored, count_if(NOT direct) AS negative FROM b
UNION ALL SELECT 'B direct or observable boundary', count_if(direct OR seen AND edge), count_if(NOT seen AND edge), count_if(NOT (direct OR seen AND edge) AND NOT (NOT seen AND edge)) FROM b
UNION ALL SELECT 'C segment', count(DISTINCT trajectory_id || '#' || CAST(label_run AS VARCHAR)), 0, 0 FROM b UNION ALL SELECT 'E observable', count_if(seen), count_if(NOT seen), 0 FROM b""")
def _(spark, d):
    direct, seen, edge = F.coalesce(F.col("identifiability_tier") == "tier1", F.lit(False)), F.col("observable"), F.col("boundary").isin("start", "end", "singleton")
    near = direct | (seen & edge)
    n = F.count_if
    zero = F.lit(0).cast("long")
    row = lambda name, a, b, c: F.struct(F.lit(name).alias("policy"), a.alias("positive"), b.alias("ignored"), c.alias("negative"))
    p = _tiered(spark, d).agg(n(direct).alias("a"), n(~direct).alias("b"), n(near).alias("c"), n(~seen & edge).alias("e"), n(~near & ~(~seen & edge)).alias("f"), F.countDistinct("trajectory_id", "label_run").alias("g"), n(seen).alias("h"), n(~seen).alias("i"))
    rows = [row("A direct displacement", F.col("a"), zero, F.col("b")), row("B direct or observable boundary", F.col("c"), F.col("e"), F.col("f")), row("C segment", F.col("g"), zero, zero), row("E observable", F.col("h"), F.col("i"), zero)]
    return p.select(F.inline(F.array(*rows)))


@register("a43_segment_statistics", _STRUCT, """SELECT trajectory_id, label_run, count(*) AS points, round(avg(speed), 4) AS mean_speed, round(max(speed), 4) AS max_speed, round(avg(displacement_m), 4) AS mean_deviation_m, round(max(displacement_m), 4) AS max_deviation_m, round(max(stop_s), 4) AS stop_s,
  round(avg(latitude), 6) AS centre_lat, round(avg(longitude), 6) AS centre_lon FROM st WHERE anomaly_label = 1 GROUP BY ALL""")
def _(spark, d):
    r = lambda c, k=4: F.round(c, k)
    return _structured(spark, d).where("anomaly_label = 1").groupBy("trajectory_id", "label_run").agg(F.count("*").alias("points"), r(F.avg("speed")).alias("mean_speed"), r(F.max("speed")).alias("max_speed"), r(F.avg("displacement_m")).alias("mean_deviation_m"), r(F.max("displacement_m")).alias("max_deviation_m"), r(F.max("stop_s")).alias("stop_s"), r(F.avg("latitude"), 6).alias("centre_lat"), r(F.avg("longitude"), 6).alias("centre_lon"))


_COHORTS = _STRUCT + f""", tr AS (SELECT f.*, {_PARTS} FROM flagged f JOIN split USING (user_id) WHERE dataset_split = 'train' AND is_training_eligible),
ref AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q, stddev_pop({c}) AS sd FROM tr" for c in MODEL)}),
rf AS (SELECT feature, q[1] AS p01, q[3] AS median, q[5] AS p99, CASE WHEN q[4] > q[2] THEN (q[4] - q[2]) / 1.349 WHEN sd > 0 THEN sd WHEN q IS NOT NULL THEN 1e-9 * greatest(1.0, abs(q[3])) END AS scale FROM ref),
lab AS (SELECT * FROM st WHERE anomaly_label = 1),
long AS ({" UNION ALL ".join(f"SELECT trajectory_id, source_point_index, anomaly_type, '{c}' AS feature, {c} AS x, {c}_delta AS dx FROM lab" for c in MODEL)})"""


def _robust(spark, d):
    """(feature, p01, median, p99, scale) of the training points; a row a feature, of nulls where there is no training point."""
    train = routes.with_bearing_parts(split_flagged(spark, d).where("dataset_split = 'train' and is_training_eligible"))
    long = train.select(*MODEL).unpivot([], list(MODEL), "feature", "x")
    q = F.percentile("x", F.array(*[F.lit(v) for v in (0.01, 0.25, 0.5, 0.75, 0.99)]))
    names = spark.createDataFrame([(c,) for c in MODEL], "feature string")
    g = names.join(long.groupBy("feature").agg(q.alias("q"), F.stddev_pop("x").alias("sd")), "feature", "left")
    width = F.col("q")[3] - F.col("q")[1]
    scale = F.when(width > 0, width / 1.349).when(F.col("sd") > 0, F.col("sd")).when(F.col("q").isNotNull(), 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("q")[2])))
    return g.select("feature", F.col("q")[0].alias("p01"), F.col("q")[2].alias("median"), F.col("q")[4].alias("p99"), scale.alias("scale"))


def _long(spark, d):
    p = _structured(spark, d).where("anomaly_label = 1")
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.col(f"{c}_delta").alias("dx")) for c in MODEL])
    return p.select("trajectory_id", "source_point_index", "anomaly_type", F.inline(rows))


@register("a38_cohort_effects", _COHORTS, "SELECT anomaly_type, feature, count(*) AS n, round(quantile_cont(x, 0.5), 4) + 0.0 AS median, round(abs(quantile_cont(x, 0.5) - any_value(rf.median)) / any_value(scale), 3) AS effect FROM long JOIN rf USING (feature) GROUP BY ALL")
def _(spark, d):
    g = _long(spark, d).groupBy("anomaly_type", "feature").agg(F.count("*").alias("n"), F.percentile("x", 0.5).alias("own")).join(F.broadcast(_robust(spark, d)), "feature")  # eight rows
    return g.select("anomaly_type", "feature", "n", (F.round("own", 4) + 0.0).alias("median"), F.round(F.abs(F.col("own") - F.col("median")) / F.col("scale"), 3).alias("effect"))


@register("f12_hard_subset", _COHORTS, "SELECT trajectory_id, source_point_index, bool_and(x BETWEEN p01 AND p99) AS all_inside, round(max(abs(dx) / scale), 3) AS max_scaled_delta FROM long JOIN rf USING (feature) GROUP BY ALL")
def _(spark, d):
    p = _long(spark, d).join(F.broadcast(_robust(spark, d)), "feature")  # eight rows
    return p.groupBy("trajectory_id", "source_point_index").agg(F.bool_and(F.col("x").between(F.col("p01"), F.col("p99"))).alias("all_inside"), F.round(F.max(F.abs("dx") / F.col("scale")), 3).alias("max_scaled_delta"))


@register("d15_isometry_probe", sql.FEATURES + f""", first AS (SELECT trajectory_id, arg_min(latitude, row(elapsed_us, source_point_index)) AS lat0 FROM gps GROUP BY 1), ang AS (SELECT trajectory_id, degrees(2 * asin(sin(200.0 / (2 * 6371000.0)) / cos(radians(lat0)))) AS angle FROM first),
moved AS (SELECT gps.* EXCLUDE (longitude), {sql.pmod("longitude + angle + 180.0", "360.0")} - 180.0 AS longitude FROM gps JOIN ang USING (trajectory_id))""" + sql.features("moved", "m_"), """SELECT a.trajectory_id, count(*) AS points, round(max(abs(a.distance - b.distance)), 3) AS distance_delta, round(max(abs(a.speed - b.speed)), 3) AS speed_delta, max(abs(a.dt - b.dt)) AS dt_delta
  FROM flagged a JOIN m_flagged b USING (trajectory_id, source_point_index) GROUP BY 1""")
def _(spark, d):
    from trajspark.operators import movement

    p = gps_points(spark, d)
    moved = movement.movement_features(datasets.rotated(p, 200.0)).select("trajectory_id", "source_point_index", *[F.col(c).alias(f"_{c}") for c in ("distance", "speed", "dt")])
    j = features(spark, d).join(moved, ["trajectory_id", "source_point_index"])
    gap = lambda c: F.max(F.abs(F.col(c) - F.col(f"_{c}")))
    return j.groupBy("trajectory_id").agg(F.count("*").alias("points"), F.round(gap("distance"), 3).alias("distance_delta"), F.round(gap("speed"), 3).alias("speed_delta"), gap("dt").alias("dt_delta"))


@register("v6_copy_completeness", _SEG, """, s AS (SELECT source_trajectory_id, count(DISTINCT anomaly_type) AS types, count(DISTINCT trajectory_id) AS samples, count(*) AS points FROM copies GROUP BY 1), o AS (SELECT trajectory_id AS source_trajectory_id, count(*) AS n FROM own GROUP BY 1)
SELECT o.source_trajectory_id, coalesce(types, 0) = 4 AS all_types, coalesce(samples, 0) = coalesce(types, 0) AS one_each, coalesce(points, 0) = 4 * n AS same_points FROM o LEFT JOIN s USING (source_trajectory_id)""")
def _(spark, d):
    own = split_flagged(spark, d).where("dataset_split <> 'train'")
    return datasets.copy_completeness(own, datasets.inject(own))


@register("j7_reconciliation", _SEG, """, a AS (SELECT source_trajectory_id, source_point_index FROM copies WHERE anomaly_type = 'long_stop' AND source_point_index % 11 <> 3), b AS (SELECT trajectory_id AS source_trajectory_id, source_point_index FROM own WHERE source_point_index % 13 <> 5)
SELECT CASE WHEN b.source_point_index IS NULL THEN 'left_only' WHEN a.source_point_index IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS points FROM a FULL JOIN b ON a.source_trajectory_id = b.source_trajectory_id AND a.source_point_index = b.source_point_index GROUP BY 1""")
def _(spark, d):
    own = split_flagged(spark, d).where("dataset_split <> 'train'")
    a = datasets.inject(own).where("anomaly_type = 'long_stop' and source_point_index % 11 <> 3").select("source_trajectory_id", "source_point_index")
    b = own.where("source_point_index % 13 <> 5").select(F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index")
    return datasets.reconciled(a, b, ["source_trajectory_id", "source_point_index"]).groupBy("side").agg(F.count("*").alias("points"))


@register("w14_past_labelled_copies", _SEG, "SELECT trajectory_id, source_point_index, CAST(coalesce(sum(anomaly_label) OVER (PARTITION BY trajectory_id ORDER BY source_point_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past FROM copies")
def _(spark, d):
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index").rowsBetween(Window.unboundedPreceding, -1)
    return datasets.inject(split_flagged(spark, d).where("dataset_split <> 'train'")).select("trajectory_id", "source_point_index", F.coalesce(F.sum("anomaly_label").over(w), F.lit(0)).alias("past"))


@register("x9_tolerant_equality", sql.FEATURES, "SELECT trajectory_id, count_if(abs(speed - bearing) <= 1.0 + 0.1 * abs(bearing)) AS near FROM feat GROUP BY 1")
def _(spark, d):
    return features(spark, d).groupBy("trajectory_id").agg(F.count_if(geo.nearly_equal(F.col("speed"), F.col("bearing"), 1.0, 0.1)).alias("near"))
