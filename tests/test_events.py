"""Event rows against the hand values of small streams, and over the stored runs."""

import pytest
from pyspark.sql import functions as F

from trajspark.operators import events
from trajspark.plans import registry

SF = "/root/testdata/sf0.01"
SCHEMA = "user_id string, trajectory_id string, source_trajectory_id string, anomaly_type string, source_point_index long, elapsed_us long, anomaly_label int, ok boolean"


def copies(spark):
    rows = []
    for i, label in enumerate([0, 1, 1, 1, 1, 1, 0, 1, 0]):
        rows.append(("u", "s", "o", "stop", i, i * 3_000_000 + (400_000_000 if i >= 7 else 0), label, i != 3))
    return spark.createDataFrame(rows, SCHEMA)


def points(spark, labelled, decided):
    p = labelled.where("ok").withColumn("predicted", F.element_at(F.create_map(*[x for k, v in decided.items() for x in (F.lit(k), F.lit(v))]), F.col("source_point_index").cast("int")))
    return p.select(F.lit("m").alias("model"), F.lit(1).alias("seed"), F.lit(7).alias("run"), "event_id", "source_point_index", "elapsed_us", "predicted")


def test_catalog_and_detection_by_hand(spark):
    labelled = events.with_events(copies(spark))
    e = {r["event_id"]: r for r in events.catalog(labelled, F.col("ok")).collect()}
    a, b = e["s__run_01"], e["s__run_02"]
    assert (a["start_index"], a["end_index"], a["event_points"], a["evaluated_points"], a["excluded_points"], a["span_s"], a["duration_s"], a["duration_reason"]) == (1, 5, 5, 4, 1, 12.0, 12.0, "")
    assert (b["event_points"], b["span_s"], b["length_group"]) == (1, 0.0, "short") and a["length_group"] == "long"
    d = {r["event_id"]: r for r in events.detections(points(spark, labelled, {1: 0, 2: 1, 4: 1, 5: 1, 7: 0}), events.catalog(labelled, F.col("ok"))).collect()}
    a, b = d["s__run_01"], d["s__run_02"]
    # the excluded point 3 parts 2 from 4 and 5
    assert (a["detected"], a["first_index"], a["delay_points"], a["delay_s"], a["relative_position"], a["detected_points"], a["run_count"], a["longest_run_points"], a["mean_run_points"]) == (True, 2, 1, 3.0, 0.25, 3, 2, 2, 1.5)
    assert (a["event_coverage"], a["evaluated_coverage"], a["available_ratio"], a["longest_run_ratio"], a["early_10"], a["early_25"], a["delay_crosses_gap"]) == (0.6, 0.75, 0.8, 0.4, False, True, False)
    assert (b["detected"], b["status"], b["delay_points"], b["mean_run_points"], b["run_count"]) == (False, "missed_event", None, None, 0)
    s = {r["user_id"]: r for r in events.summary(events.detections(points(spark, labelled, {1: 0, 2: 1, 4: 1, 5: 1, 7: 0}), events.catalog(labelled, F.col("ok"))), "user_id").collect()}
    assert set(s) == {"ALL", "u"} and (s["ALL"]["events"], s["ALL"]["missed_events"], s["ALL"]["early_25_rate"], s["ALL"]["early_25_conditional_rate"], s["ALL"]["point_recall"], s["ALL"]["total_runs"]) == (2, 1, 0.5, 1.0, 0.6, 2)


def test_gaps_inside_events(spark):
    rows = [("u", "s", "o", "stop", i, t * 1_000_000, 1, True) for i, t in enumerate([0, 3, 400, 403])]
    labelled = events.with_events(spark.createDataFrame(rows, SCHEMA))
    e = events.catalog(labelled, F.col("ok"))
    r = e.first()
    assert (r["duration_s"], r["duration_reason"], r["span_s"], r["duration_group"]) == (None, "long_gap_inside_labelled_event", 403.0, "not_available")
    late = events.detections(points(spark, labelled, {0: 0, 1: 0, 2: 1, 3: 1}), e).first()
    early = events.detections(points(spark, labelled, {0: 0, 1: 1, 2: 1, 3: 1}), e).first()
    assert late["delay_crosses_gap"] and not early["delay_crosses_gap"] and (early["run_count"], early["longest_run_points"]) == (2, 2)


def test_missing_points_fail(spark):
    labelled = events.with_events(copies(spark))
    p = points(spark, labelled, {1: 0, 2: 1, 4: 1, 5: 1, 7: 0})
    for broken in (p.where("source_point_index <> 4"), p.unionByName(p.where("source_point_index = 7"))):
        with pytest.raises(Exception, match="evaluated points differ"):
            events.detections(broken, events.catalog(labelled, F.col("ok"))).collect()


def test_false_alerts_by_hand(spark):
    rows = [("m", None, 0, "u", t, i, i * 3_000_000 + (400_000_000 if i > 3 else 0), p) for t, bits in (("a", [0, 1, 1, 0, 1, 1]), ("b", [0, 0])) for i, p in enumerate(bits)]
    p = spark.createDataFrame(rows, "model string, seed int, run int, user_id string, trajectory_id string, source_point_index long, elapsed_us long, predicted int")
    f = {r["trajectory_id"]: r for r in events.false_rows(p).collect()}
    assert (f["a"]["false_points"], f["a"]["false_runs"], f["a"]["longest_run_points"], f["a"]["exposure_us"], f["a"]["intervals"]) == (4, 2, 2, 12_000_000, 4)
    s = events.false_summary(events.false_rows(p)).first()
    assert (s["trajectories"], s["fpr"], s["runs_per_trajectory"], s["alerted_percent"], s["false_per_1000"], s["runs_per_hour"]) == (2, 0.5, 1.0, 50.0, 500.0, 480.0)
    lonely = events.false_summary(events.false_rows(p.where("trajectory_id = 'b' and source_point_index = 0"))).first()
    assert lonely["runs_per_hour"] is None and lonely["exposure_reason"] == "no_valid_adjacent_observation_intervals"


def test_stored_runs_have_the_same_rows(spark):
    q = registry.queries()
    rows = q["a18_run_event_rows"](spark, SF).toPandas()
    assert len(rows) == 11 * rows["event_id"].nunique() and (rows["detected"] == (rows["detected_points"] > 0)).all() and (rows["longest_run_points"] <= rows["detected_points"]).all()
    report = q["a19_run_event_report"](spark, SF).toPandas()
    every = report[(report["user_id"] == "ALL") & (report["anomaly_type"] == "ALL")].set_index("run")
    for run, own in rows.groupby("run"):
        assert abs(every.loc[run, "detection_rate"] - own["detected"].mean()) < 1e-5 and every.loc[run, "missed_events"] == (~own["detected"]).sum()
    assert q["a20_run_false_report"](spark, SF).where("user_id = 'ALL'").count() == 11
    demo = q["d16_scored_csv"](spark, SF).toPandas()
    assert demo.groupby(["model", "seed"], dropna=False).size().nunique() == 1 and set(demo["status"]) == {"scored", "quality_unknown"}
    assert demo[demo["status"] == "quality_unknown"]["prediction"].isna().all() and not demo[demo["status"] == "quality_unknown"]["notified"].any() and demo["notified"].any()
