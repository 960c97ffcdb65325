"""Queries over complete event rows: the stand-in runs have SQL, the stored runs of real detectors the same rows without."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import events, routes, runs

from . import labels, models
from .catalog import copies, flagged, register, split_flagged
from .runs import _COPIED

_IN = "source_quality_valid AND NOT is_low_quality"
#: Labelled points with their events, after the copies under all runs.
_LABELLED = """, lr0 AS (SELECT *, CASE WHEN anomaly_label = 1 AND coalesce(lag(anomaly_label) OVER w, 0) <> 1 THEN 1 ELSE 0 END AS s FROM qc WINDOW w AS (PARTITION BY trajectory_id ORDER BY source_point_index)),
lr1 AS (SELECT *, sum(s) OVER (PARTITION BY trajectory_id ORDER BY source_point_index) AS label_run FROM lr0),
lab AS (SELECT *, trajectory_id || '__run_' || CASE WHEN label_run > 99 THEN CAST(CAST(label_run AS BIGINT) AS VARCHAR) ELSE lpad(CAST(CAST(label_run AS BIGINT) AS VARCHAR), 2, '0') END AS event_id, elapsed_us - lag(elapsed_us) OVER (PARTITION BY trajectory_id, label_run ORDER BY source_point_index) AS gap FROM lr1 WHERE anomaly_label = 1)"""
_CATALOG = _LABELLED + f""", ev0 AS (SELECT event_id, trajectory_id AS sample_id, user_id, source_trajectory_id, anomaly_type, min(source_point_index) AS start_index, max(source_point_index) AS end_index, arg_min(elapsed_us, source_point_index) AS start_us, arg_max(elapsed_us, source_point_index) AS end_us,
  count(*) AS event_points, count_if({_IN}) AS evaluated_points, bool_and(coalesce(gap > 0 AND gap <= 300000000, gap IS NULL)) AS whole FROM lab GROUP BY ALL),
ev1 AS (SELECT *, event_points - evaluated_points AS excluded_points, (end_us - start_us) / 1e6 AS span_s, CASE WHEN whole THEN (end_us - start_us) / 1e6 END AS duration_s, CASE WHEN whole THEN '' ELSE 'long_gap_inside_labelled_event' END AS duration_reason FROM ev0),
qq AS (SELECT quantile_cont(event_points, [0.33, 0.66]) AS a, quantile_cont(duration_s, [0.33, 0.66]) AS b FROM ev1),
evc AS (SELECT ev1.* EXCLUDE (whole), CASE WHEN event_points <= a[1] THEN 'short' WHEN event_points <= a[2] THEN 'medium' ELSE 'long' END AS length_group, CASE WHEN duration_s IS NULL THEN 'not_available' WHEN duration_s <= b[1] THEN 'short' WHEN duration_s <= b[2] THEN 'medium' ELSE 'long' END AS duration_group FROM ev1, qq)"""
_DETECTED = _COPIED + _CATALOG + f""", pt AS (SELECT model, seed, run_no AS run, event_id, rc.source_point_index, rc.elapsed_us, rc.predicted FROM rc JOIN (SELECT trajectory_id, source_point_index, event_id FROM lab) l USING (trajectory_id, source_point_index) WHERE {_IN}),
p0 AS (SELECT *, elapsed_us - lag(elapsed_us) OVER w AS gap, coalesce(source_point_index - lag(source_point_index) OVER w = 1 AND elapsed_us - lag(elapsed_us) OVER w BETWEEN 1 AND 300000000, false) AS near, lag(predicted) OVER w AS was, row_number() OVER w AS nth, min(CASE WHEN predicted = 1 THEN source_point_index END) OVER (PARTITION BY run, event_id) AS f
  FROM pt WINDOW w AS (PARTITION BY run, event_id ORDER BY source_point_index)),
p1 AS (SELECT *, predicted = 1 AND NOT (near AND coalesce(was = 1, false)) AS starts FROM p0),
p2 AS (SELECT *, CASE WHEN predicted = 1 THEN nth - last_value(CASE WHEN starts THEN nth END IGNORE NULLS) OVER (PARTITION BY run, event_id ORDER BY source_point_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 END AS len FROM p1),
gr AS (SELECT run, event_id, count_if(predicted = 1) AS detected_points, min(f) AS first_index, arg_min(CASE WHEN predicted = 1 THEN elapsed_us END, CASE WHEN predicted = 1 THEN source_point_index END) AS first_us, coalesce(bool_or(gap > 300000000 AND source_point_index <= f), false) AS crossed, CAST(coalesce(max(len), 0) AS BIGINT) AS longest_run_points, count_if(starts) AS run_count FROM p2 GROUP BY ALL),
d0 AS (SELECT r.model, CAST(r.seed AS INTEGER) AS seed, r.run_no AS run, e.event_id, sample_id, user_id, anomaly_type, start_index, start_us, event_points, evaluated_points, coalesce(detected_points, 0) AS detected_points, first_index, first_us, coalesce(crossed, false) AS crossed, coalesce(longest_run_points, 0) AS longest_run_points, coalesce(run_count, 0) AS run_count
  FROM evc e CROSS JOIN runs r LEFT JOIN gr ON gr.run = r.run_no AND gr.event_id = e.event_id),
det AS (SELECT * EXCLUDE (crossed), first_index IS NOT NULL AS detected, first_index - start_index AS delay_points, (first_us - start_us) / 1e6 AS delay_s, CASE WHEN first_index IS NULL THEN 'missed_event' ELSE 'detected' END AS status, round((first_index - start_index) / greatest(event_points - 1, 1), 6) AS relative_position,
  first_index IS NOT NULL AND coalesce(first_us > start_us, false) AND crossed AS delay_crosses_gap, round(detected_points / event_points, 6) AS event_coverage, round(detected_points / nullif(evaluated_points, 0), 6) AS evaluated_coverage, round(evaluated_points / event_points, 6) AS available_ratio, round(longest_run_points / event_points, 6) AS longest_run_ratio,
  round(detected_points / nullif(run_count, 0), 6) AS mean_run_points, {", ".join(f"coalesce((first_index - start_index) / greatest(event_points - 1, 1) <= {k / 100}, false) AS early_{k}" for k in events.EARLY)} FROM d0)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return events.with_events(routes.attach_source_quality(copies(spark, d), flagged(spark, d)))


def _evaluated():
    return F.col("source_quality_valid") & ~F.col("is_low_quality")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    p = _labelled(spark, d)
    return events.detections(runs.detector_runs(p.where(_evaluated()), "anomaly_label"), events.catalog(p, _evaluated()))


@register("a17_events", _COPIED + _CATALOG, "SELECT * FROM evc")
def _(spark, d):
    return events.catalog(_labelled(spark, d), _evaluated())


_T = ", ".join(f"count_if({_IN} AND tier = '{t}') AS {t}_count" for t in routes.TIERS)


@register("a17_event_tiers", labels._TIERS + ", qv AS (SELECT t.*, f.is_training_eligible AS source_quality_valid FROM ti t JOIN flagged f ON f.trajectory_id = t.source_trajectory_id AND f.source_point_index = t.source_point_index)", f"""SELECT trajectory_id AS sample_id, CAST(label_run AS BIGINT) AS label_run, count(*) AS event_points, count_if({_IN}) AS evaluated_points, {_T}, round((count_if({_IN}) - count_if({_IN} AND tier = 'tier4')) / nullif(count_if({_IN}), 0), 6) AS observable_ratio, count_if({_IN} AND tier = 'tier4') > 0 AS contains_tier4 FROM qv GROUP BY ALL""")
def _(spark, d):
    p = routes.attach_source_quality(labels._tiered(spark, d), flagged(spark, d))
    e = events.catalog(p.withColumn("event_id", F.concat_ws("#", "trajectory_id", F.col("label_run").cast("string"))), _evaluated(), "identifiability_tier")
    return e.select("sample_id", F.substring_index("event_id", "#", -1).cast("bigint").alias("label_run"), "event_points", "evaluated_points", *[f"{t}_count" for t in routes.TIERS], "observable_ratio", "contains_tier4")


@register("a18_event_rows", _DETECTED, "SELECT * FROM det")
def _(spark, d):
    return _detections(spark, d)


_SHARES = ", ".join(f"round(avg({c}), {3 if c == 'delay_s' else 6}) AS {c}_mean, " + ", ".join(f"round(quantile_cont({c}, {q}), {3 if c == 'delay_s' else 6}) AS {c}_{n}" for n, q in qs) for cs, qs in ((("delay_points", "delay_s", "relative_position"), (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))), (("event_coverage", "evaluated_coverage"), (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))) for c in cs)
_EVENT_SUMMARY = f"""SELECT model, seed, run, coalesce(user_id, 'ALL') AS user_id, count(*) AS events, count_if(detected) AS detected_events, count_if(NOT detected) AS missed_events, round(avg(CAST(detected AS INTEGER)), 6) AS detection_rate, round(sum(detected_points) / nullif(sum(evaluated_points), 0), 6) AS point_recall, round(sum(detected_points) / sum(event_points), 6) AS full_label_fraction,
  round(quantile_cont(longest_run_points, 0.5), 6) AS median_longest_run, round(quantile_cont(longest_run_ratio, 0.5), 6) AS median_longest_ratio, round(avg(run_count), 6) AS mean_run_count, CAST(sum(run_count) AS BIGINT) AS total_runs, {", ".join(f"round(avg(CAST(early_{k} AS INTEGER)), 6) AS early_{k}_rate, round(avg(CASE WHEN detected THEN CAST(early_{k} AS INTEGER) END), 6) AS early_{k}_conditional_rate" for k in events.EARLY)},
  {_SHARES}, CASE WHEN count_if(detected) = 0 THEN 'all_events_missed' ELSE '' END AS delay_reason
  FROM (SELECT * REPLACE ((first_index - start_index) / greatest(event_points - 1, 1) AS relative_position, detected_points / event_points AS event_coverage, detected_points / nullif(evaluated_points, 0) AS evaluated_coverage, longest_run_points / event_points AS longest_run_ratio) FROM det) GROUP BY GROUPING SETS ((model, seed, run), (model, seed, run, user_id))"""


@register("a19_event_report", _DETECTED, _EVENT_SUMMARY)
def _(spark, d):
    return events.summary(_detections(spark, d), "user_id")


_FALSE = _COPIED + """, nm AS (SELECT model, seed, run_no AS run, user_id, trajectory_id, source_point_index, elapsed_us, predicted FROM ro WHERE is_training_eligible AND anomaly_label = 0),
n0 AS (SELECT *, elapsed_us - lag(elapsed_us) OVER w AS gap, coalesce(source_point_index - lag(source_point_index) OVER w = 1 AND elapsed_us - lag(elapsed_us) OVER w BETWEEN 1 AND 300000000, false) AS near, lag(predicted) OVER w AS was, row_number() OVER w AS nth FROM nm WINDOW w AS (PARTITION BY run, trajectory_id ORDER BY source_point_index)),
n1 AS (SELECT *, predicted = 1 AND NOT (near AND coalesce(was = 1, false)) AS starts FROM n0),
n2 AS (SELECT *, CASE WHEN predicted = 1 THEN nth - last_value(CASE WHEN starts THEN nth END IGNORE NULLS) OVER (PARTITION BY run, trajectory_id ORDER BY source_point_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 END AS len FROM n1),
fr AS (SELECT model, seed, run, user_id, trajectory_id, count(*) AS points, count_if(predicted = 1) AS false_points, count_if(starts) AS false_runs, CAST(coalesce(max(len), 0) AS BIGINT) AS longest_run_points, CAST(coalesce(sum(CASE WHEN near THEN gap END), 0) AS BIGINT) AS exposure_us, count_if(near) AS intervals FROM n2 GROUP BY ALL)"""
_FALSE_SUMMARY = """SELECT model, seed, run, coalesce(user_id, 'ALL') AS user_id, count(*) AS trajectories, CAST(sum(points) AS BIGINT) AS points, CAST(sum(false_points) AS BIGINT) AS false_points, CAST(sum(false_runs) AS BIGINT) AS false_runs, CAST(sum(exposure_us) AS BIGINT) AS exposure_us, CAST(sum(intervals) AS BIGINT) AS intervals,
  round(sum(false_points) / nullif(sum(points), 0), 6) AS fpr, round(sum(false_runs) / count(*), 6) AS runs_per_trajectory, round(100 * count_if(false_runs > 0) / count(*), 6) AS alerted_percent, round(1000 * sum(false_points) / nullif(sum(points), 0), 6) AS false_per_1000, round(sum(false_runs) * 3.6e9 / nullif(sum(exposure_us), 0), 6) AS runs_per_hour,
  CASE WHEN sum(exposure_us) > 0 THEN '' ELSE 'no_valid_adjacent_observation_intervals' END AS exposure_reason, max(longest_run_points) AS longest_run_points FROM fr GROUP BY GROUPING SETS ((model, seed, run), (model, seed, run, user_id))"""


def _false_rows(spark: SparkSession, d: str) -> DataFrame:
    own = runs.detector_runs(split_flagged(spark, d).where("dataset_split <> 'train' and is_training_eligible and anomaly_label = 0"))
    return events.false_rows(own)


@register("a20_false_rows", _FALSE, "SELECT * FROM fr")
def _(spark, d):
    return _false_rows(spark, d)


@register("a20_false_report", _FALSE, _FALSE_SUMMARY)
def _(spark, d):
    return events.false_summary(_false_rows(spark, d), "user_id")


_USER = f"{_FALSE}{_DETECTED.removeprefix(_COPIED)}, es AS ({_EVENT_SUMMARY}), fs AS ({_FALSE_SUMMARY})"
_BOTH = "SELECT coalesce(es.model, fs.model) AS model, coalesce(es.seed, fs.seed) AS seed, coalesce(es.run, fs.run) AS run, coalesce(es.user_id, fs.user_id) AS user_id, events, detection_rate, point_recall, early_25_rate, false_per_1000, runs_per_hour, alerted_percent FROM es FULL JOIN fs ON es.run = fs.run AND es.user_id = fs.user_id"
_FAMILY = ("detection_rate", "point_recall", "early_25_rate", "false_per_1000", "runs_per_hour", "alerted_percent")


def _user_alerts(spark: SparkSession, d: str) -> DataFrame:
    both = events.user_alerts(events.summary(_detections(spark, d), "user_id"), events.false_summary(_false_rows(spark, d), "user_id"))
    return both.select("model", "seed", "run", "user_id", "events", *_FAMILY)


@register("a44_user_event_alerts", _USER, _BOTH)
def _(spark, d):
    return _user_alerts(spark, d)


@register("a44_family_means", _USER, f"SELECT model, user_id, count(*) AS runs, {', '.join(f'round(avg({m}), 6) AS {m}, count({m}) AS {m}_defined' for m in _FAMILY)} FROM ({_BOTH}) GROUP BY ALL")
def _(spark, d):
    return events.family_means(_user_alerts(spark, d), _FAMILY, "user_id")


# the same rows over the stored runs


def _stored_detections(spark: SparkSession, d: str) -> DataFrame:
    p = models._copied(models._predictions(spark, d))
    one = p.where("run = 0").select("trajectory_id", "user_id", "source_trajectory_id", "anomaly_type", "source_point_index", "elapsed_us", "anomaly_label", "source_quality_valid", "is_low_quality")
    labelled = events.with_events(one)
    points = p.where("anomaly_label = 1").where(_evaluated()).join(labelled.select("trajectory_id", "source_point_index", "event_id"), ["trajectory_id", "source_point_index"])
    return events.detections(points, events.catalog(labelled, _evaluated()))


@register("a18_run_event_rows")
def _(spark, d):
    return _stored_detections(spark, d)


@register("a19_run_event_report")
def _(spark, d):
    return events.summary(_stored_detections(spark, d), "user_id", "anomaly_type")


@register("a20_run_false_report")
def _(spark, d):
    return events.false_summary(events.false_rows(models._normal(models._predictions(spark, d)).where("is_training_eligible and anomaly_label = 0")), "user_id")
