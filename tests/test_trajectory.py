import math
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.operators import alerts, audits, checks, datasets, detectors, movement
from trajspark.plans import registry
from trajspark.sources import gps
from trajspark.streaming import alerts as live

SF = "/root/testdata/sf0.001"
#: Queries that fit detectors on the training users; test_detector_runs and test_events run them on more users.
FITTED = {n for n in registry.queries() if "_run_" in n} | {"d12_fit_history", "d12_parameters", "d11_reconstruction_error", "s16_stored_runs", "d16_scored_csv"}


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_scalar_functions(spark):
    lit = F.lit
    d, n, e, t = one(spark, geo.haversine(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), geo.bearing(lit(0.0), lit(0.0), lit(1.0), lit(0.0)), geo.bearing(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), geo.angle_difference(lit(350.0), lit(10.0)))
    assert abs(d - 111_194.93) < 1 and abs(n) < 1e-9 and abs(e - 90) < 1e-9 and abs(t - 20) < 1e-9
    assert one(spark, geo.parse_boolean(lit(" Yes")), geo.parse_boolean(lit("0")), geo.parse_boolean(lit("?"))) == [True, False, None]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    key = lambda row: tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row)
    want = sorted(key([row[names.index(c)] for c in columns]) for row in cursor.fetchall())
    assert sorted(key(r) for r in got.select(*columns).collect()) == want


def test_greedy_cooldown_by_hand(spark):
    rows = [("t", i, i * 3_000_000, p) for i, p in enumerate([0, 1, 1, 0, 1, 0, 1])]
    p = spark.createDataFrame(rows, "trajectory_id string, source_point_index long, elapsed_us long, predicted int")
    got = {r["source_point_index"]: r["emitted"] for r in alerts.cooldown(alerts.vote_gate(p, 1, 1), 10).collect()}
    assert got == {1: True, 4: False, 6: True}


def test_streams_agree_with_batch(spark):
    p = gps.gps_points(spark, SF).select("trajectory_id", "source_point_index", "elapsed_us", "latitude", "longitude", "predicted")
    folder = tempfile.mkdtemp()
    for k in range(3):  # three micro-batches in order of the index
        p.where((F.col("source_point_index") >= k * 130) & (F.col("source_point_index") < (k + 1) * 130)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for name, df in (("n", live.notifications(stream, 3, 2, 60)), ("m", live.movement(stream))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()
    emitted = {(r[0], r[1]) for r in spark.table("n").where("emitted").collect()}
    batch = alerts.cooldown(alerts.vote_gate(p, 3, 2), 60).where("emitted")
    assert emitted == {(r["trajectory_id"], r["source_point_index"]) for r in batch.collect()}
    a = movement.movement_features(p).select("trajectory_id", "source_point_index", "distance", "stop_s", "bearing")
    j = a.join(spark.table("m").toDF("trajectory_id", "source_point_index", "dt", "d2", "v", "b2", "s2"), ["trajectory_id", "source_point_index"])
    assert j.count() == p.count() and j.where("abs(distance - d2) > 1e-6 or abs(stop_s - s2) > 1e-6 or abs(bearing - b2) > 1e-6").count() == 0


def test_frechet():
    a = np.array([[[0.0, 0, 0], [1, 0, 0], [2, 0, 0]]])
    assert detectors.frechet(a, a + [0, 3, 0])[0] == 3 and math.isclose(detectors.frechet(a, a[:, ::-1])[0], 2)


def test_plt_reader(spark, tmp_path):
    folder = tmp_path / "007" / "Trajectory"
    folder.mkdir(parents=True)
    (folder / "a.plt").write_text("h\n" * 6 + "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\nbad,116.3,0,492,39744.1,2008-10-23,xx\n")
    rows = gps.read_plt(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["user_id"], r["trajectory_id"], r["latitude"]) for r in rows] == [("007", "a", 39.9), ("007", "a", None)]
    assert rows[0]["timestamp"].hour == 2 and rows[1]["timestamp"] is None


def test_other_queries_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()) - FITTED:
        assert registry.queries()[name](spark, SF).count() > 0, name


def test_fitted_queries_need_training_users(spark):
    with pytest.raises(ValueError, match="no training rows"):  # one user, of the test split
        registry.queries()["s16_stored_runs"](spark, SF)


def test_isolation_prefers_outliers(spark):
    df = spark.range(500).select(F.lit("t").alias("trajectory_id"), F.col("id").alias("source_point_index"), F.when(F.col("id") == 7, 100.0).otherwise(F.col("id") % 10).cast("double").alias("x"))
    s = detectors.isolation_scores(df, detectors.isolation_forest(df, ["x"], trees=20), ["x"])
    assert s.orderBy(F.desc("isolation_score")).first()["source_point_index"] == 7


def test_audit_edges(spark):
    df = spark.createDataFrame([(float(i // 3), float(i // 3), i) for i in range(9)] + [(None, 1.0, 9)], "x double, y double, id long")
    r = audits.correlation(df, "x", "y").first()
    assert (r["n"], r["equal_fraction"], r["pearson"], r["spearman"], r["reason"]) == (9, 1.0, 1.0, 1.0, "")
    assert audits.correlation(df.limit(0), "x", "y").first()["reason"] == "no_paired_finite_rows"
    assert audits.correlation(df.where("x = 1"), "x", "y").first()["reason"] == "constant_or_insufficient_rows"
    got = {r["id"]: r["percentile"] for r in audits.empirical_percentile(df, df.where("x <> 1"), "x").collect()}
    assert got == {**{i: 25.0 for i in range(3)}, **{i: 50.0 for i in range(3, 6)}, **{i: 75.0 for i in range(6, 9)}, 9: None}
    assert audits.empirical_percentile(df, df.limit(0), "x").where("percentile is not null").count() == 0
    rows = [("t", i, p) for i, p in enumerate([1, 0, 1, 1, None, 0])]
    parts = audits.segments_with_context(spark.createDataFrame(rows, "trajectory_id string, source_point_index long, anomaly_label int"))
    assert sorted((r["source_point_index"], r["segment"], r["part"]) for r in parts.collect()) == [(0, 1, "inside"), (1, 1, "after"), (1, 2, "before"), (2, 2, "inside"), (3, 2, "inside"), (4, 2, "after")]


def test_ids_keep_all_digits(spark):
    """Two points of each of 31,500 source users: 10,500 trajectories of 2,100 users; none may merge."""
    events = spark.range(63_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id div 31500) AS ts", "(id % 31500) * 5 div 3 AS user_id", "cast(id % 90 AS double) AS value")
    p = gps.points_from_events(events)
    keys = p.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("trajectory_id").alias("t"), F.countDistinct("trajectory_id", "source_point_index").alias("k"), F.count("*").alias("n")).first()
    want = events.selectExpr("count(DISTINCT user_id div 15) AS users", "count(DISTINCT user_id div 5) AS t").first()
    assert (keys["users"], keys["t"]) == (want["users"], want["t"]) and keys["users"] > 1000 and keys["t"] > 10_000 and keys["k"] == keys["n"] == 63_000
    assert p.where("user_id <> substring_index(trajectory_id, '__', 1)").isEmpty()
    assert checks.key_violations(p, "trajectory_id", "source_point_index").first()["repeated"] == 0
    cut = p.withColumn("trajectory_id", F.substring("trajectory_id", 1, 8))
    assert checks.key_violations(cut, "trajectory_id", "source_point_index").first()["repeated"] > 0


def test_splits_round_half_to_even_and_may_demand_all(spark):
    users = lambda n: spark.range(n).select(F.format_string("%03d", "id").alias("user_id"))
    sizes = lambda n: {r[0]: r[1] for r in datasets.user_splits(users(n)).groupBy("dataset_split").count().collect()}
    assert sizes(13) == {"train": 7, "val": 3, "test": 3} and sizes(3) == {"train": 1, "val": 1, "test": 1} and sizes(1) == {"test": 1}
    with pytest.raises(Exception, match="fewer than three users"):
        datasets.user_splits(users(2), all_splits=True).collect()
