"""Out-of-order streams: shuffled micro-batches equal the batch operators, what is late or repeated leaves by the side, idle state goes."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from trajspark.operators import alerts, movement
from trajspark.sources import gps
from trajspark.streaming import ordered

SF = "/root/testdata/sf0.001"
KEYS = "trajectory_id string, source_point_index long, elapsed_us long, latitude double, longitude double, predicted int"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ordered.ROCKSDB)
    yield
    spark.conf.set(name, before)


def play(spark, batches, make):
    """Rows and progress of a query that reads one file a micro-batch, and one far-off point at the end to fire the timers."""
    folder = tempfile.mkdtemp()
    for k, rows in enumerate([*batches, [("zz", 0, 10**13, 0.0, 0.0, 0)], [("zz", 1, 10**13 + 1, 0.0, 0.0, 0)]]):
        spark.createDataFrame(rows, KEYS).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = make(stream).writeStream.format("memory").queryName("ordered").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return [r for r in spark.table("ordered").collect() if r["trajectory_id"] != "zz"], query.recentProgress


def shuffled(rows, delay_us, size, seed):
    """Rows in an order in which none comes more than `delay_us` of its trajectory's time too late, in batches of several files."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[2] + rng.random() * delay_us * 0.9)
    return [late[a : a + size] for a in range(0, len(late), size)]


def test_shuffled_batches_equal_batch(spark):
    p = gps.gps_points(spark, SF).select("trajectory_id", "source_point_index", "elapsed_us", "latitude", "longitude", "predicted")
    rows = [tuple(r) for r in p.collect()]
    batches = shuffled(rows, 600_000_000, 260, 1)
    assert any(a[-1][2] > b[0][2] for a, b in zip(batches, batches[1:], strict=False)) and sorted(sum(batches, [])) == sorted(rows)
    got, progress = play(spark, batches, lambda s: ordered.notifications(s, 3, 2, 60))
    assert {r["kind"] for r in got} == {"point"} and ordered.dropped_behind_watermark(progress) == 0
    gated = alerts.vote_gate(p, 3, 2)
    want = {(r["trajectory_id"], r["source_point_index"], r["gate"], r["candidate"]) for r in gated.collect()}
    assert {(r["trajectory_id"], r["source_point_index"], r["gate"], r["candidate"]) for r in got} == want and len(got) == len(rows)
    assert {(r["trajectory_id"], r["source_point_index"]) for r in got if r["emitted"]} == {(r["trajectory_id"], r["source_point_index"]) for r in alerts.cooldown(gated, 60).where("emitted").collect()}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # what is left belongs to the far-off trajectory
    moved, _ = play(spark, batches, ordered.movement)
    made = {(r["trajectory_id"], r["source_point_index"]): r for r in moved}
    features = movement.movement_features(p).select("trajectory_id", "source_point_index", "dt", "distance", "speed", "bearing", "stop_s").collect()
    assert len(made) == len(features)
    for r in features:
        assert all(abs(r[c] - made[r[0], r[1]][c]) < 1e-6 for c in ("dt", "distance", "speed", "bearing", "stop_s"))


def test_late_repeated_and_dropped_points(spark):
    row = lambda t, i, s, p=0: (t, i, int((s + 1000) * 1e6), 0.0, 0.0, p)  # noqa: E731  the first watermark is 0
    batches = [
        [row("a", 0, 0), row("a", 2, 200, 1), row("a", 1, 100)],
        [row("a", 9, 100), row("a", 3, 300), row("a", 8, 300), row("b", 0, 50)],  # 100 and 300 stand twice
        [row("a", 4, 2000)],  # the frontier is 1,400 s
        [row("a", 5, 1390), row("a", 6, 1401)],  # late; in time
        [row("c", 0, 9000)],
        [row("c", 1, 9001)],  # Spark drops by the watermark of the batch before
        [row("c", 2, 9002), row("a", 7, 2100)],  # it stands at 5,400 s: the second one is dropped
    ]
    got, progress = play(spark, batches, lambda s: ordered.notifications(s, 1, 1, 0))
    kinds = {(r["trajectory_id"], r["source_point_index"]): r["kind"] for r in got}
    assert {k for k, v in kinds.items() if v == "late"} == {("a", 5)} and {k for k, v in kinds.items() if v == "duplicate"} == {("a", 9), ("a", 8)}
    order = [r["source_point_index"] for r in got if r["trajectory_id"] == "a" and r["kind"] == "point"]
    assert order == [0, 1, 2, 3, 6, 4] and ("b", 0) in kinds and ("c", 1) in kinds and ("a", 7) not in kinds
    assert ordered.dropped_behind_watermark(progress) == 1
    assert all(r["votes"] is None and r["emitted"] is None for r in got if r["kind"] != "point")
    counts = {(r["trajectory_id"], r["kind"]): r["rows"] for r in ordered.side_counts(spark.table("ordered")).collect()}
    assert counts["a", "late"] == 1 and counts["a", "duplicate"] == 2 and counts["a", "point"] == 6


def test_state_goes_when_idle_and_starts_anew(spark):
    row = lambda t, i, s, p=1: (t, i, int(s * 1e6), 0.0, 0.0, p)
    batches = [[row("a", 0, 1), row("a", 1, 10)], [row("b", 0, 20_000)], [row("b", 1, 20_001)], [row("a", 2, 20_005)]]
    got, progress = play(spark, batches, lambda s: ordered.notifications(s, 2, 2, 0, delay_s=60, idle_s=600, watermark="1 hour"))
    rows = {(r["trajectory_id"], r["source_point_index"]): r for r in got}
    assert rows["a", 1]["gate"] and rows["a", 2]["votes"] == 1 and not rows["a", 2]["gate"]  # the old votes are forgotten
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert min(totals[2:]) < max(totals)
