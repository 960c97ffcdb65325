"""Queries over detector runs: metrics, seeds, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import datasets, evaluation, routes, runs
from trajspark.sources.gps import gps_points

from . import sql
from .catalog import once, register, split_flagged

_RUNS = "runs AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {'NULL' if s is None else s}, {k})" for m, s, k in runs.RUNS) + ") v(model, seed, run_no))"


def _scored(source: str, to: str, raised: str = "0.0") -> str:
    return f"""{to}0 AS (SELECT s.*, model, CAST(seed AS INTEGER) AS seed, run_no, s.score + ((CAST(round(s.score * 100) AS BIGINT) * (run_no + 1)) % 997) / 10.0 + {raised} AS run_score, 180.0 + 2 * run_no AS threshold FROM {source} s, runs),
{to} AS (SELECT * REPLACE (CAST(run_score > threshold AS INTEGER) AS predicted) FROM {to}0)"""


_NORMAL = sql.GPS + f", {_RUNS}, {_scored('gps', 'rn')}"
_COUNTS = "count_if(anomaly_label = 1 AND predicted = 1) AS tp, count_if(anomaly_label <> 1 AND predicted = 1) AS fp, count_if(anomaly_label <> 1 AND predicted <> 1) AS tn, count_if(anomaly_label = 1 AND predicted <> 1) AS fn"
_RATIO = """round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr"""
_METRICS = _NORMAL + f", mc AS (SELECT model, seed, {_COUNTS} FROM rn GROUP BY ALL), mt AS (SELECT *, {_RATIO} FROM mc)"
_LONG = _METRICS + ", lg AS (" + " UNION ALL ".join(f"SELECT model, seed, '{m}' AS metric, {m} AS value FROM mt" for m in runs.METRICS) + ")"


def _points(spark, d):
    return runs.detector_runs(gps_points(spark, d))


def _metrics(spark, d):
    return evaluation.confusion(_points(spark, d), "model", "seed")


def _long(spark, d):
    return runs.unpivoted(_metrics(spark, d), ["model", "seed"])


@register("s16_detector_runs", _NORMAL, "SELECT model, seed, any_value(threshold) AS threshold, count(*) AS points, count_if(predicted = 1) AS positives, count_if((predicted = 1) <> (run_score > threshold)) AS mismatches, count(*) - count(DISTINCT trajectory_id || '#' || CAST(source_point_index AS VARCHAR)) AS repeated FROM rn GROUP BY ALL")
def _(spark, d):
    p = _points(spark, d)
    return p.groupBy("model", "seed").agg(F.first("threshold").alias("threshold"), F.count("*").alias("points"), F.count_if(F.col("predicted") == 1).alias("positives"), F.count_if((F.col("predicted") == 1) != (F.col("run_score") > F.col("threshold"))).alias("mismatches"), (F.count("*") - F.countDistinct("trajectory_id", "source_point_index")).alias("repeated"))


@register("d14_seed_metrics", _METRICS, "SELECT * FROM mt")
def _(spark, d):
    return _metrics(spark, d)


@register("pv_metric_unpivot", _LONG, "SELECT model, seed, metric, value FROM lg")
def _(spark, d):
    return _long(spark, d)


@register("pv_metric_pivot", _LONG, "SELECT metric, " + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN value END), 6) AS {m}" for m in ("statistical_rule", "isolation_forest", "autoencoder")) + " FROM lg GROUP BY 1")
def _(spark, d):
    return _long(spark, d).groupBy("metric").pivot("model", ["statistical_rule", "isolation_forest", "autoencoder"]).agg(F.round(F.avg("value"), 6))


@register("a14_seed_summary", _LONG, "SELECT model, metric, count(*) AS runs, count(value) AS defined, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, CASE WHEN count(value) = 0 THEN 'undefined' WHEN count(*) = 1 THEN 'single_run' WHEN count(value) < 2 THEN 'one_defined_value' ELSE '' END AS reason FROM lg GROUP BY ALL")
def _(spark, d):
    return runs.group_summary(_long(spark, d), "model", "metric")


@register("w20_seed_ranks", _LONG, "SELECT model, seed, metric, CAST(rank() OVER (PARTITION BY model, metric ORDER BY value DESC) AS INTEGER) AS rank, round((value - avg(value) OVER (PARTITION BY model, metric)) / nullif(stddev_samp(value) OVER (PARTITION BY model, metric), 0), 4) AS z FROM lg WHERE value IS NOT NULL AND model = 'isolation_forest'")
def _(spark, d):
    return runs.seed_ranks(_long(spark, d).where("model = 'isolation_forest'"))


@register("a15_stage_delta", _LONG, "SELECT a.seed, a.metric, a.value AS first_stage, b.value AS second_stage, round(b.value - a.value, 6) AS delta FROM lg a JOIN lg b ON a.seed = b.seed AND a.metric = b.metric WHERE a.model = 'isolation_forest' AND b.model = 'autoencoder'")
def _(spark, d):
    x = _long(spark, d)
    a = x.where("model = 'isolation_forest'").select("seed", "metric", F.col("value").alias("first_stage"))
    b = x.where("model = 'autoencoder'").select("seed", "metric", F.col("value").alias("second_stage"))
    return a.join(b, ["seed", "metric"]).withColumn("delta", F.round(F.col("second_stage") - F.col("first_stage"), 6))


@register("j14_null_safe_runs", _METRICS + f", tot AS (SELECT model, seed, count(*) AS points FROM rn GROUP BY ALL)", "SELECT mt.model, mt.seed, mt.recall, tot.points FROM mt JOIN tot ON mt.model = tot.model AND mt.seed IS NOT DISTINCT FROM tot.seed")
def _(spark, d):
    total = _points(spark, d).groupBy("model", "seed").agg(F.count("*").alias("points"))
    return runs.null_safe(_metrics(spark, d).select("model", "seed", "recall"), total, ("model", "seed"))


@register("v10_totals", _NORMAL + f", us AS (SELECT model, seed, user_id, {_COUNTS} FROM rn GROUP BY ALL), a AS (SELECT model, seed, {_COUNTS} FROM rn GROUP BY ALL), b AS (SELECT model, seed, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM us GROUP BY ALL)", "SELECT count(*) AS runs, count_if(a.tp <> b.tp OR a.fp <> b.fp OR a.tn <> b.tn OR a.fn <> b.fn) AS violations FROM a JOIN b ON a.model = b.model AND a.seed IS NOT DISTINCT FROM b.seed")
def _(spark, d):
    p, names = _points(spark, d), ("tp", "fp", "tn", "fn")
    users = evaluation.confusion(p, "model", "seed", "user_id").groupBy("model", "seed").agg(*[F.sum(c).alias(f"sum_{c}") for c in names])
    j = runs.null_safe(evaluation.confusion(p, "model", "seed"), users, ("model", "seed"))
    wrong = F.lit(False)
    for c in names:
        wrong = wrong | (F.col(c) != F.col(f"sum_{c}"))
    return j.agg(F.count("*").alias("runs"), F.count_if(wrong).alias("violations"))


@register("v12_metric_regression", _LONG, """, old AS (SELECT model, seed, metric, CASE WHEN metric = 'f1' THEN value + 0.001 ELSE value END AS before FROM lg WHERE NOT (metric = 'fpr' AND coalesce(seed, 0) = 3))
SELECT lg.metric, count(*) AS rows, count_if(old.metric IS NULL) AS missing, count_if(old.metric IS NOT NULL AND NOT coalesce(abs(value - before) <= 1e-9, value IS NULL AND before IS NULL)) AS changed FROM lg LEFT JOIN old ON lg.model = old.model AND lg.seed IS NOT DISTINCT FROM old.seed AND lg.metric = old.metric GROUP BY 1""")
def _(spark, d):
    from trajspark.operators import checks

    new = _long(spark, d)
    old = new.where("not (metric = 'fpr' and coalesce(seed, 0) = 3)").withColumn("before", F.when(F.col("metric") == "f1", F.col("value") + 0.001).otherwise(F.col("value"))).drop("value")
    return checks.regression(new, old, ("model", "seed", "metric"), "value", "before", 1e-9).groupBy("metric").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "changed").alias("changed"))


@register("a12_macro_users", _NORMAL + f", us AS (SELECT model, seed, user_id, {_COUNTS} FROM rn GROUP BY ALL), ur AS (SELECT *, {_RATIO} FROM us)", "SELECT model, seed, count(*) AS users, count(recall) AS defined, round(avg(recall), 6) AS macro_recall, round(stddev_samp(recall), 6) AS user_std FROM ur GROUP BY ALL")
def _(spark, d):
    u = evaluation.confusion(_points(spark, d), "model", "seed", "user_id")
    return u.groupBy("model", "seed").agg(F.count("*").alias("users"), F.count("recall").alias("defined"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.stddev_samp("recall"), 6).alias("user_std"))


# copies under the runs
_COPIED = sql.COPIED + f""", {_RUNS}, qc AS (SELECT c.*, 0 AS predicted, f.is_training_eligible AS source_quality_valid FROM c_flagged c JOIN flagged f ON f.trajectory_id = c.source_trajectory_id AND f.source_point_index = c.source_point_index),
{_scored("qc", "rc", "60.0 * anomaly_label")}, {_scored("own", "ro")}"""


@once
def _own(spark, d):
    return split_flagged(spark, d).where("dataset_split <> 'train'")


@once
def _copies(spark, d):
    return routes.attach_source_quality(datasets.injected(_own(spark, d)), _own(spark, d))


def _own_runs(spark, d):
    return runs.detector_runs(_own(spark, d))


def _copy_runs(spark, d):
    return runs.detector_runs(_copies(spark, d), "anomaly_label")


@register("a13_type_metrics", _COPIED, """, neg AS (SELECT model, seed, count_if(predicted = 1) AS fp, count_if(predicted <> 1) AS tn FROM ro WHERE is_training_eligible GROUP BY ALL),
pos AS (SELECT model, seed, anomaly_type, count_if(predicted = 1) AS tp, count_if(predicted <> 1) AS fn, round(avg(run_score), 6) AS score_mean, round(quantile_cont(run_score, 0.5), 4) AS score_median, round(quantile_cont(run_score, 0.95), 4) AS score_p95 FROM rc WHERE anomaly_label = 1 AND source_quality_valid AND NOT is_low_quality GROUP BY ALL)
SELECT pos.*, fp, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM pos JOIN neg ON pos.model = neg.model AND pos.seed IS NOT DISTINCT FROM neg.seed""")
def _(spark, d):
    positives = _copy_runs(spark, d).where("anomaly_label = 1 and source_quality_valid and not is_low_quality")
    return evaluation.type_metrics(positives, _own_runs(spark, d).where("is_training_eligible"))


@register("j6_prediction_pairs", _COPIED, """SELECT c.model, c.seed, c.anomaly_type, count(*) AS points, count_if(c.predicted = 1 AND o.predicted = 0) AS gained, count_if(c.predicted = 0 AND o.predicted = 1) AS lost, round(avg(c.run_score - o.run_score), 4) AS score_delta
  FROM rc c JOIN ro o ON o.trajectory_id = c.source_trajectory_id AND o.source_point_index = c.source_point_index AND o.run_no = c.run_no WHERE c.anomaly_label = 1 GROUP BY ALL""")
def _(spark, d):
    return evaluation.prediction_pairs(_copy_runs(spark, d).where("anomaly_label = 1"), _own_runs(spark, d))


_BINS = "CASE WHEN displacement_m <= 1e-6 THEN 'zero' WHEN displacement_m < 10 THEN '0-10' WHEN displacement_m < 25 THEN '10-25' WHEN displacement_m < 50 THEN '25-50' WHEN displacement_m < 100 THEN '50-100' WHEN displacement_m < 200 THEN '100-200' ELSE '200+' END"
_DISP = _COPIED + f""", dp AS (SELECT rc.*, {sql.haversine("o.latitude", "o.longitude", "rc.latitude", "rc.longitude")} AS displacement_m FROM rc JOIN own o ON o.trajectory_id = rc.source_trajectory_id AND o.source_point_index = rc.source_point_index WHERE rc.anomaly_label = 1), db AS (SELECT *, {_BINS} AS bin FROM dp)"""


def _displaced_runs(spark, d):
    from trajspark.functions import geo

    o = split_flagged(spark, d).select(F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    p = _copy_runs(spark, d).where("anomaly_label = 1").join(o, ["source_trajectory_id", "source_point_index"])
    p = p.withColumn("displacement_m", geo.haversine(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")))
    return p.withColumn("bin", geo.displacement_bin(F.col("displacement_m")))


_CATEGORIES = ("zero", "0-10", "10-25", "25-50", "50-100", "100-200", "200+")


@register("a33_recall_by_bin", _DISP, f"""SELECT r.model, CAST(r.seed AS INTEGER) AS seed, b.bin, count(db.bin) AS points, CAST(coalesce(sum(predicted), 0) AS BIGINT) AS detected, round(sum(predicted) / nullif(count(db.bin), 0), 6) AS recall, count(db.bin) BETWEEN 1 AND 29 AS low_support, CASE WHEN count(db.bin) = 0 THEN 'no_rows' ELSE '' END AS reason
  FROM runs r CROSS JOIN (SELECT unnest({list(_CATEGORIES)}) AS bin) b LEFT JOIN db ON db.run_no = r.run_no AND db.bin = b.bin GROUP BY ALL""")
def _(spark, d):
    return evaluation.recall_by_category(_displaced_runs(spark, d), "bin", _CATEGORIES)


@register("a34_counterfactual_recall", _DISP, """SELECT model, seed, count(*) AS points, round(avg(predicted), 6) AS recall, count_if(displacement_m > 1e-6) AS observable, round(avg(CASE WHEN displacement_m > 1e-6 THEN predicted END), 6) AS observable_recall, round(avg(CASE WHEN NOT displacement_m > 1e-6 THEN predicted END), 6) AS hidden_recall FROM db GROUP BY ALL""")
def _(spark, d):
    seen = F.col("displacement_m") > 1e-6
    r = lambda c: F.round(F.avg(c), 6)
    return _displaced_runs(spark, d).groupBy("model", "seed").agg(F.count("*").alias("points"), r("predicted").alias("recall"), F.count_if(seen).alias("observable"), r(F.when(seen, F.col("predicted"))).alias("observable_recall"), r(F.when(~seen, F.col("predicted"))).alias("hidden_recall"))


@register("a39_route_scores", _DISP, """, x AS (SELECT model, seed, user_id, predicted, run_score FROM db WHERE anomaly_type = 'route_deviation')
SELECT model, seed, coalesce(user_id, 'ALL') AS user_id, count(*) AS points, round(avg(predicted), 6) AS recall, round(avg(run_score), 6) AS mean, round(quantile_cont(run_score, 0.5), 4) AS median, round(stddev_pop(run_score), 4) AS std, round(quantile_cont(run_score, 0.99), 4) AS p99 FROM x GROUP BY GROUPING SETS ((model, seed), (model, seed, user_id))""")
def _(spark, d):
    p = _displaced_runs(spark, d).where("anomaly_type = 'route_deviation'")
    q = lambda x: F.round(F.percentile("run_score", x), 4)
    g = p.groupingSets([["model", "seed"], ["model", "seed", "user_id"]], "model", "seed", "user_id").agg(F.count("*").alias("points"), F.round(F.avg("predicted"), 6).alias("recall"), F.round(F.avg("run_score"), 6).alias("mean"), q(0.5).alias("median"), F.round(F.stddev_pop("run_score"), 4).alias("std"), q(0.99).alias("p99"))
    return g.withColumn("user_id", F.coalesce("user_id", F.lit("ALL")))


# policies over context streams
_CTX = _COPIED + """, pre AS (SELECT c.model, c.seed, c.run_no, c.user_id, c.trajectory_id AS sample_id, c.segment_start, c.segment_end, c.source_point_index, c.elapsed_us, o.predicted FROM rc c JOIN ro o ON o.trajectory_id = c.source_trajectory_id AND o.source_point_index = c.source_point_index AND o.run_no = c.run_no
    AND o.elapsed_us = c.elapsed_us AND o.latitude = c.latitude AND o.longitude = c.longitude WHERE c.source_point_index < c.segment_start AND o.is_training_eligible AND c.anomaly_type = 'route_deviation'),
ctx AS (SELECT *, CAST(run_no AS VARCHAR) || '|' || sample_id AS trajectory_id FROM (SELECT * FROM pre UNION ALL SELECT model, seed, run_no, user_id, trajectory_id, segment_start, segment_end, source_point_index, elapsed_us, predicted FROM rc WHERE anomaly_label = 1 AND source_quality_valid AND NOT is_low_quality AND anomaly_type = 'route_deviation'))"""


def _gated(source: str, to: str) -> str:
    """CTEs ending in `{to}_cool`: gates and cooldowns of the streams of `source`, and their states in `{to}_st`."""
    w = "PARTITION BY trajectory_id ORDER BY source_point_index"
    inner = "PARTITION BY trajectory_id, blk ORDER BY source_point_index"
    gates = " UNION ALL ".join(f"SELECT *, {n} AS window_points, {m} AS minimum_positive, row_number() OVER ({inner}) >= {n} AND sum(predicted) OVER ({inner} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {m} AS gate FROM {to}_b" for n, m in runs.GATES)
    key = "trajectory_id, window_points, minimum_positive"
    emit = "(c.elapsed_us - p.at >= p.cooldown_s * 1000000)"
    return f""", {to}_l AS (SELECT *, coalesce(source_point_index - lag(source_point_index) OVER w = 1 AND elapsed_us - lag(elapsed_us) OVER w BETWEEN 1 AND 300000000, false) AS linked FROM {source} WINDOW w AS ({w})),
{to}_b AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER ({w}) AS blk FROM {to}_l), {to}_g AS ({gates}),
{to}_st AS (SELECT *, gate AND NOT (coalesce(lag(gate) OVER (PARTITION BY {key} ORDER BY source_point_index), false) AND linked) AS candidate FROM {to}_g),
{to}_cand AS (SELECT {key}, source_point_index, elapsed_us, row_number() OVER (PARTITION BY {key} ORDER BY source_point_index) AS n FROM {to}_st WHERE candidate),
{to}_cool AS (SELECT c.*, cooldown_s, true AS emitted, elapsed_us AS at, source_point_index AS idx, CAST(NULL AS BIGINT) AS suppressor_index FROM {to}_cand c, (SELECT unnest([0, 60, 300]) AS cooldown_s) WHERE n = 1
  UNION ALL SELECT c.*, p.cooldown_s, {emit}, CASE WHEN {emit} THEN c.elapsed_us ELSE p.at END, CASE WHEN {emit} THEN c.source_point_index ELSE p.idx END, CASE WHEN {emit} THEN NULL ELSE p.idx END
  FROM {to}_cool p JOIN {to}_cand c ON c.trajectory_id = p.trajectory_id AND c.window_points = p.window_points AND c.minimum_positive = p.minimum_positive AND c.n = p.n + 1)"""


_POLICY = "CAST(minimum_positive AS VARCHAR) || 'of' || CAST(window_points AS VARCHAR) || '_cd' || CAST(cooldown_s AS VARCHAR) AS policy_id"
_IN = "source_point_index >= segment_start AND source_point_index < segment_end"
_EVENTS = _CTX + _gated("ctx", "e") + f""", eg AS (SELECT model, seed, run_no, user_id, sample_id, segment_start, segment_end, trajectory_id, window_points, minimum_positive, count_if({_IN}) AS evaluated, count_if({_IN} AND predicted = 1) AS raw_points, count_if({_IN} AND gate) AS gate_points,
  min(CASE WHEN {_IN} AND predicted = 1 THEN source_point_index END) AS raw_first, min(CASE WHEN {_IN} AND gate THEN source_point_index END) AS gate_first, count_if({_IN} AND candidate) AS candidates FROM e_st GROUP BY ALL),
en0 AS (SELECT c.*, segment_start FROM e_cool c JOIN (SELECT trajectory_id, source_point_index, segment_start, segment_end FROM ctx) x USING (trajectory_id, source_point_index) WHERE {_IN}),
en1 AS (SELECT *, min(CASE WHEN emitted THEN source_point_index END) OVER (PARTITION BY trajectory_id, window_points, minimum_positive, cooldown_s) AS f FROM en0), en2 AS (SELECT *, NOT emitted AND (f IS NULL OR source_point_index < f) AS early FROM en1),
en AS (SELECT trajectory_id, window_points, minimum_positive, cooldown_s, min(CASE WHEN emitted THEN source_point_index END) AS notification_first, count_if(emitted) AS notification_points, count_if(NOT emitted) AS suppressed, count_if(early) AS suppressed_before, coalesce(bool_or(early AND suppressor_index < segment_start), false) AS suppressed_by_earlier_alert FROM en2 GROUP BY ALL),
ev0 AS (SELECT eg.*, cooldown_s, notification_first, coalesce(notification_points, 0) AS notification_points, coalesce(suppressed, 0) AS suppressed, coalesce(suppressed_before, 0) AS suppressed_before, coalesce(suppressed_by_earlier_alert, false) AS suppressed_by_earlier_alert FROM eg CROSS JOIN (SELECT unnest([0, 60, 300]) AS cooldown_s) LEFT JOIN en USING (trajectory_id, window_points, minimum_positive, cooldown_s)),
ev AS (SELECT *, {_POLICY}, raw_first IS NOT NULL AS raw_detected, gate_first IS NOT NULL AS gate_detected, notification_first IS NOT NULL AS notification_detected, raw_first - segment_start AS raw_delay, gate_first - segment_start AS gate_delay, notification_first - segment_start AS notification_delay, segment_end - segment_start AS event_points,
  gate_first IS NOT NULL AND notification_first IS NULL AND suppressed > 0 AS cooldown_miss, notification_first IS NOT NULL AND suppressed_before > 0 AS cooldown_delay, raw_first IS NOT NULL AND gate_first IS NULL AS gate_miss, gate_first IS NOT NULL AND notification_first IS NULL AND candidates = 0 AS carried_run,
  coalesce((notification_first - segment_start) / greatest(segment_end - segment_start - 1, 1) <= 0.25, false) AS early25 FROM ev0)"""


def _contexts(spark, d):
    return runs.context_streams(_copy_runs(spark, d).where("anomaly_type = 'route_deviation'"), _own_runs(spark, d))


def _event_rows(spark, d):
    return runs.event_rows(_contexts(spark, d))


@register("j17_context_streams", _CTX, "SELECT model, seed, sample_id, count(*) AS points, count_if(source_point_index < segment_start) AS before_event, CAST(sum(predicted) AS BIGINT) AS positives FROM ctx GROUP BY ALL")
def _(spark, d):
    return _contexts(spark, d).groupBy("model", "seed", "sample_id").agg(F.count("*").alias("points"), F.count_if(F.col("source_point_index") < F.col("segment_start")).alias("before_event"), F.sum("predicted").alias("positives"))


_EVCOLS = ("model", "seed", "sample_id", "policy_id", "evaluated", "raw_points", "gate_points", "notification_points", "raw_detected", "gate_detected", "notification_detected", "raw_delay", "gate_delay", "notification_delay", "suppressed", "suppressed_before", "suppressed_by_earlier_alert", "cooldown_miss", "cooldown_delay", "gate_miss", "carried_run", "early25", "event_points")


@register("a21_policy_events", _EVENTS, f"SELECT {', '.join(_EVCOLS)} FROM ev", recursive=True)
def _(spark, d):
    return _event_rows(spark, d).select(*_EVCOLS)


_GRID = _EVENTS + ", nrm AS (SELECT model, seed, run_no, user_id, CAST(run_no AS VARCHAR) || '|' || trajectory_id AS trajectory_id, source_point_index, elapsed_us, predicted FROM ro WHERE is_training_eligible AND anomaly_label = 0)" + _gated("nrm", "n") + f""",
nb AS (SELECT model, seed, run_no, user_id, trajectory_id, count(*) AS points FROM nrm GROUP BY ALL), nn AS (SELECT trajectory_id, window_points, minimum_positive, cooldown_s, count(*) AS notifications FROM n_cool WHERE emitted GROUP BY ALL),
nf AS (SELECT nb.*, {_POLICY}, coalesce(notifications, 0) AS notifications FROM nb CROSS JOIN (SELECT * FROM (VALUES {", ".join(f"({n}, {m})" for n, m in runs.GATES)}) g(window_points, minimum_positive)) CROSS JOIN (SELECT unnest([0, 60, 300]) AS cooldown_s) LEFT JOIN nn USING (trajectory_id, window_points, minimum_positive, cooldown_s))"""


def _grid_sql(more: str = "") -> str:
    on = "".join(f" AND a.{c.strip()} = b.{c.strip()}" for c in more.split(",") if c.strip())
    return f"""SELECT a.*, b.false_notifications, b.false_per_1000, b.false_per_trajectory FROM (SELECT model, seed, run_no AS run, policy_id{more}, count(*) AS events, round(avg(CAST(raw_detected AS INTEGER)), 6) AS raw_edr, round(avg(CAST(notification_detected AS INTEGER)), 6) AS edr, round(avg(CAST(early25 AS INTEGER)), 6) AS early25_rate,
  round(quantile_cont(notification_delay, 0.5), 6) AS delay_median, count_if(cooldown_miss) AS cooldown_misses, count_if(gate_miss) AS gate_misses, any_value(minimum_positive) AS gate_rank, any_value(cooldown_s) AS cooldown_rank FROM ev GROUP BY ALL) a
JOIN (SELECT run_no AS run, policy_id{more}, CAST(sum(notifications) AS BIGINT) AS false_notifications, round(1000 * sum(notifications) / sum(points), 6) AS false_per_1000, round(sum(notifications) / count(*), 6) AS false_per_trajectory FROM nf GROUP BY ALL) b ON a.run = b.run AND a.policy_id = b.policy_id{on}"""


def _grid(spark, d, *more):
    normal = _own_runs(spark, d).where("is_training_eligible and anomaly_label = 0").withColumn("trajectory_id", F.concat_ws("|", F.col("run").cast("string"), "trajectory_id"))
    return runs.policy_grid(_event_rows(spark, d), runs.false_rows(normal), *more)


@once
def _whole_grid(spark, d):
    return _grid(spark, d)


@register("a22_policy_grid", _GRID, _grid_sql(), recursive=True)
def _(spark, d):
    return _grid(spark, d)


@register("a44_user_alerts", _GRID, f"SELECT * FROM ({_grid_sql(', user_id')}) WHERE policy_id IN ('1of1_cd0', '2of3_cd60')", recursive=True)
def _(spark, d):
    return _grid(spark, d, "user_id").where("policy_id in ('1of1_cd0', '2of3_cd60')")


_SELECT = _GRID + f""", gr AS ({_grid_sql()}), rw AS (SELECT run, edr AS raw_e, early25_rate AS raw_y FROM gr WHERE policy_id = '1of1_cd0'),
pm AS (SELECT model, policy_id, count(*) AS runs, round(avg(edr), 6) AS edr, round(avg(early25_rate), 6) AS early25_rate, round(avg(raw_e), 6) AS raw_edr, round(avg(raw_y), 6) AS raw_early, count_if(edr + 1e-12 >= 0.85 * raw_e) AS seeds_passed, round(avg(false_per_1000), 6) AS false_per_1000, round(avg(false_per_trajectory), 6) AS false_per_trajectory,
  round(avg(delay_median), 6) AS delay_median, any_value(gate_rank) AS gate_rank, any_value(cooldown_rank) AS cooldown_rank FROM gr JOIN rw USING (run) GROUP BY ALL),
pe AS (SELECT *, concat_ws(';', CASE WHEN NOT edr + 1e-12 >= 0.9 * raw_edr THEN 'mean_edr' END, CASE WHEN NOT early25_rate + 1e-12 >= 0.8 * raw_early THEN 'mean_early25' END, CASE WHEN NOT (runs = 1 OR seeds_passed >= 4) THEN 'seed_edr' END) AS rejection FROM pm), pq AS (SELECT *, rejection = '' AS eligible FROM pe),
sel AS (SELECT *, eligible AND row_number() OVER (PARTITION BY model ORDER BY eligible DESC, false_per_1000, false_per_trajectory, delay_median NULLS LAST, edr DESC, gate_rank, cooldown_rank, policy_id) = 1 AS selected FROM pq)"""


@register("a23_policy_selection", _SELECT, "SELECT * FROM sel", recursive=True)
def _(spark, d):
    return runs.select_policies(_grid(spark, d))


@register("a24_reductions", _SELECT, """SELECT g.model, g.seed, g.policy_id, round(100 * (1 - g.false_notifications / nullif(r.false_notifications, 0)), 4) AS false_reduction_pct, round(100 * g.edr / nullif(r.edr, 0), 4) AS edr_retention_pct, round(g.delay_median - r.delay_median, 4) AS delay_change
  FROM gr g JOIN sel ON sel.model = g.model AND sel.policy_id = g.policy_id AND selected JOIN gr r ON r.run = g.run AND r.policy_id = '1of1_cd0'""", recursive=True)
def _(spark, d):
    grid = _whole_grid(spark, d)  # read three times
    return runs.reductions(grid, runs.select_policies(grid))


@register("j15_raw_against_gated", _GRID, f"""SELECT a.model, a.policy_id, count(*) AS runs, round(avg(a.false_notifications / nullif(b.false_notifications, 0)), 6) AS kept_false, round(avg(a.edr / nullif(b.edr, 0)), 6) AS kept_edr FROM ({_grid_sql()}) a JOIN ({_grid_sql()}) b ON a.run = b.run AND b.policy_id = '1of1_cd0' GROUP BY ALL""", recursive=True)
def _(spark, d):
    from trajspark.functions.geo import safe_ratio

    grid = _whole_grid(spark, d)
    raw = grid.where("policy_id = '1of1_cd0'").select("run", F.col("false_notifications").alias("_f"), F.col("edr").alias("_e"))
    j = grid.join(F.broadcast(raw), "run")  # a row a run
    return j.groupBy("model", "policy_id").agg(F.count("*").alias("runs"), F.round(F.avg(safe_ratio(F.col("false_notifications"), F.col("_f"))), 6).alias("kept_false"), F.round(F.avg(safe_ratio(F.col("edr"), F.col("_e"))), 6).alias("kept_edr"))


@register("k5_best_of", _METRICS, "SELECT model, seed, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC NULLS LAST, fpr, seed) AS n FROM mt) WHERE n = 1")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("model").orderBy(F.desc_nulls_last("f1"), "fpr", "seed")
    return _metrics(spark, d).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("model", "seed", "f1")
