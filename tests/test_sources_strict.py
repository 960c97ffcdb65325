"""Strict readers, complete-or-fail joins, sinks that can be run again, the plt format and folds over long trajectories."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import alerts, folds, guards, movement
from trajspark.operators.alerts import COOLDOWNS, GATES
from trajspark.sources import files, gps, plt, sinks, strict

SCHEMA = {"user_id": "string", "trajectory_id": "string", "timestamp": "timestamp", "latitude": "double", "is_low_quality": "boolean", "anomaly_label": "int", "quality_reason": "string"}
HEADER = ",".join(SCHEMA)


def write(path, *lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")


def test_dataset_reader_names_every_bad_line(spark, tmp_path):
    write(tmp_path / "a.csv", "001,t,2024-01-01 00:00:00,39.5,True,0,", "001,t,2024-01-01T00:00:01,1e1,false,1,long_gap", "002,null,2024-01-01 00:00:02.123456,-0.5,,,")
    write(tmp_path / "b.csv", "001,t,yesterday,39.5,True,0,", "001,t,2024-01-01 00:00:00,nan,yes,0,", "001,t", "001,t,2024-01-01 00:00:00,39.5,True,0,,extra", "009,,2024-01-01 00:00:00,39.5,True,x,")
    (tmp_path / "empty.csv").write_text(HEADER + "\n")
    read = strict.read_dataset_csv(spark, str(tmp_path), SCHEMA, required=("trajectory_id",))
    good = read.where(F.col("_file").endswith("a.csv")).orderBy("timestamp").collect()
    assert [r["user_id"] for r in good] == ["001", "001", "002"] and [r["timestamp"].microsecond for r in good] == [0, 0, 123456]
    assert [r["is_low_quality"] for r in good] == [True, False, None] and good[0]["quality_reason"] == "" and good[2]["trajectory_id"] == "null" and good[2]["anomaly_label"] is None
    report = {r["file"].rsplit("/", 1)[1]: r for r in strict.file_report(read).collect()}
    assert (report["a.csv"]["lines"], report["a.csv"]["bad_lines"], report["a.csv"]["problems"]) == (3, 0, "{}")
    assert (report["b.csv"]["lines"], report["b.csv"]["bad_lines"]) == (5, 5)
    assert json.loads(report["b.csv"]["problems"]) == {"bad anomaly_label": 1, "bad is_low_quality": 1, "bad latitude": 1, "bad timestamp": 1, "corrupt": 2, "empty trajectory_id": 1}
    with pytest.raises(Exception, match="b.csv: "):
        strict.strict(read).count()
    assert strict.strict(strict.read_dataset_csv(spark, str(tmp_path / "a.csv"), SCHEMA)).columns == list(SCHEMA)
    write(tmp_path / "c.csv", "x", header="user_id,other")
    with pytest.raises(Exception, match="(?i)header|column"):
        strict.read_dataset_csv(spark, str(tmp_path / "c.csv"), SCHEMA).collect()


def dataset(spark, more=""):
    rows = [(f"{u:03d}", f"t{u}", i, u % 2 if i > 2 else 0, True, 45.0 * i, "train" if u < 3 else "val") for u in range(5) for i in range(4 + u)]
    return spark.createDataFrame(rows, "user_id string, trajectory_id string, source_point_index long, anomaly_label int, is_training_eligible boolean, bearing double, dataset_split string")


def test_split_loader(spark, tmp_path):
    df = dataset(spark)
    manifest = df.groupBy("trajectory_id", "dataset_split").agg(F.count("*").alias("points"))
    root = str(tmp_path / "d")
    df.write.partitionBy("dataset_split").parquet(root)
    got = strict.load_split(spark, root, "train", manifest, df)
    assert got.count() == df.where("dataset_split = 'train'").count() and abs(got.where("bearing = 90").first()["bearing_sin"] - 1) < 1e-12
    assert "PartitionFilters: [isnotnull(dataset_split" in got._jdf.queryExecution().executedPlan().toString()
    wrong = {
        "missing_trajectories": (df, manifest.unionByName(spark.createDataFrame([("new", "train", 3)], manifest.schema)), None),
        "other_counts": (df, manifest.withColumn("points", F.col("points") + 1), None),
        "added_trajectories": (df, manifest.where("trajectory_id <> 't1'"), None),
        "foreign_users": (df, manifest, df.where("user_id <> '001'")),
        "bad_labels": (df.withColumn("anomaly_label", F.when(F.col("source_point_index") == 1, 2).otherwise(F.col("anomaly_label"))), manifest, None),
        "repeated_keys": (df.withColumn("source_point_index", F.lit(0).cast("long")), manifest, None),
        "no_quality": (df.withColumn("is_training_eligible", F.lit(None).cast("boolean")), manifest, None),
    }
    for k, (name, (rows, m, users)) in enumerate(wrong.items()):
        rows.write.partitionBy("dataset_split").parquet(f"{root}{k}")
        with pytest.raises(Exception, match=f'"{name}":[1-9]'):
            strict.load_split(spark, f"{root}{k}", "train", m, users).count()


def test_demo_points_and_policies(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS timestamp, 39.0 + id AS latitude, 116.0 AS longitude FROM range(5)")
    rows = strict.demo_points(df).collect()
    assert len(rows) == 5 and {(r["user_id"], r["trajectory_id"], r["altitude"]) for r in rows} == {("demo_user", "demo_trajectory", 0.0)}
    mixed = df.withColumn("user_id", F.when(F.col("latitude") > 40, "7").otherwise(""))
    assert {r["user_id"] for r in strict.demo_points(mixed).collect()} == {"7", "demo_user"}
    for bad, name in ((df.union(df.limit(1)), "times_not_increasing"), (df.withColumn("latitude", F.lit(91.0)), "invalid_rows"), (df.withColumn("longitude", F.lit("x")), "invalid_rows"), (df.limit(0), "no_rows")):
        with pytest.raises(Exception, match=f'"{name}":[1-9]'):
            strict.demo_points(bad).count()
    policies = [{"policy_id": f"{m}of{n}_cd{c}", "window_points": n, "minimum_positive": m, "cooldown_s": c} for n, m in GATES for c in COOLDOWNS]
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"policies": policies}, indent=1))
    assert strict.read_policies(spark, str(path), GATES, COOLDOWNS).count() == 21
    for k, (broken, name) in enumerate(((policies[1:], "missing"), (policies + policies[:1], "repeated"), (policies[1:] + [{**policies[0], "policy_id": "1of2_cd0"}], "ids_unlike_parameters"), (policies + [{**policies[0], "cooldown_s": 7, "policy_id": "1of1_cd7"}], "unknown"))):
        other = tmp_path / f"p{k}.json"
        other.write_text(json.dumps({"policies": broken}))
        with pytest.raises(Exception, match=f'"{name}":[1-9]'):
            strict.read_policies(spark, str(other), GATES, COOLDOWNS).count()
    with pytest.raises(ValueError, match="speed"):
        strict.require(df, ("latitude", "speed"))
    with pytest.raises(Exception, match="not finite"):
        strict.require(df.withColumn("latitude", F.lit(float("nan"))), ("latitude",), finite=True).count()


def test_exact_joins(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (2, "z", 3.0)], "k int, v string, m double")
    b = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert sorted(map(tuple, guards.exact_join(a, b, ["k"]).collect())) == [(1, "x", 1.0, 10), (2, "y", 2.0, 20), (2, "z", 3.0, 20)]
    assert guards.exact_join(a.limit(0), b, ["k"]).count() == 0
    null = spark.createDataFrame([(None, 5)], "k int, w int")
    for f, text in (
        (lambda: guards.exact_join(a, b.where("k <> 2"), ["k"]), 'no right row for {"k":2}'), (lambda: guards.exact_join(a.where("k = 1"), b, ["k"], whole_right=True), 'no left row uses {"k":2}'), (lambda: guards.exact_join(a, b, ["k"], one_to_one=True), 'several left rows for {"k":2}'),
        (lambda: guards.exact_join(a, b.unionByName(b.where("k = 1")), ["k"]), 'several right rows for {"k":1}'), (lambda: guards.exact_join(null, b.withColumnRenamed("w", "u"), ["k"]), 'no right row for {"k":null}'), (lambda: guards.exact_join(a, b.unionByName(null), ["k"], whole_right=True), 'no left row uses {"k":null}'),
    ):
        with pytest.raises(Exception) as error:
            f().count()
        assert text in str(error.value)
    with pytest.raises(ValueError):
        guards.exact_join(a, a, ["k"])
    scores = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 0.6), (3, 9.0, 0.7)], "k int, m double, score double")
    one = a.where("v <> 'z'")
    assert {(r["k"], r["score"]) for r in guards.attach_scores(one, scores, ["k"], ["m"]).collect()} == {(1, 0.5), (2, 0.6)}
    with pytest.raises(Exception) as error:
        guards.attach_scores(a, scores, ["k"], ["m"]).count()
    assert 'scored as another row: {"k":2}' in str(error.value)


def test_sorted_csv(spark, tmp_path):
    df = spark.range(1000).select(F.format_string("%04d", (F.col("id") * 7919) % 1000).alias("key"), F.expr("timestamp_ntz'2024-01-01 00:00:00.25' + make_dt_interval(0, 0, 0, id)").alias("at"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "a,\"b\"").alias("text"), (F.col("id") / 3).alias("x"))
    path = str(tmp_path / "out")
    sinks.write_sorted_csv(df, path, ["key", "at", "x", "text"], ["key"], files=4)
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    lines = [p.read_text().splitlines() for p in parts]
    assert len(parts) > 1 and all(part[0] == "key,at,x,text" for part in lines)
    keys = [x[:4] for part in lines for x in part[1:]]
    assert keys == sorted(keys) and len(keys) == 1000 and "2024-01-01 00:" in lines[0][1]
    back = strict.strict(strict.read_dataset_csv(spark, path, {"key": "string", "at": "timestamp", "x": "double", "text": "string"}))
    assert sinks.differences(df.select("key", "at", "x").orderBy("key"), back.select("key", "at", "x")).first() == (0, 0)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_sorted_csv(df, path, ["key"], ["key"])


def test_blocks_survive_kills_and_reruns(spark, tmp_path):
    path = str(tmp_path / "blocks")
    wanted = spark.createDataFrame([(w, g) for w in (10, 25) for g in (0, 10)], "width int, gap int")
    assert sinks.missing_blocks(spark, path, wanted, ["width", "gap"]).count() == 4
    block = lambda w, g, n=50: spark.range(n).select(F.lit(w).alias("width"), F.lit(g).alias("gap"), F.col("id"), (F.col("id") * w + g).alias("score"))
    sinks.append_blocks(block(10, 0), path, ["width", "gap"])
    sinks.append_blocks(block(10, 10), path, ["width", "gap"])
    with pytest.raises(Exception, match="killed"):  # a run that dies in the middle of a block, after some tasks have written
        sinks.append_blocks(block(25, 0).repartition(8).withColumn("score", F.when(F.col("id") == 49, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("score"))), path, ["width", "gap"])
    left = {tuple(r) for r in sinks.missing_blocks(spark, path, wanted, ["width", "gap"]).collect()}
    assert left == {(25, 0), (25, 10)} and spark.read.parquet(path).count() == 100
    for w, g in sorted(left) + [(10, 10)]:  # goes on, and repeats one that was there
        sinks.append_blocks(block(w, g), path, ["width", "gap"])
    rows = spark.read.parquet(path).groupBy("width", "gap").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()
    assert {(r["width"], r["gap"], r["n"], r["s"]) for r in rows} == {(w, g, 50, sum(i * w + g for i in range(50))) for w in (10, 25) for g in (0, 10)}
    assert sinks.missing_blocks(spark, path, wanted, ["width", "gap"]).isEmpty()


def test_verified_tables(spark, tmp_path):
    df = dataset(spark)
    root = str(tmp_path / "v")
    out = sinks.write_verified({"points": df, "users": df.select("user_id").distinct()}, root, {"points": ["dataset_split"]})
    assert out["points"].count() == df.count() and out["users"].count() == 5
    with pytest.raises(FileExistsError):
        sinks.write_verified({"more": df, "users": df}, root)
    assert not (tmp_path / "v" / "more").exists()
    assert sinks.differences(df, df.limit(10)).first()[0] > 0 and sinks.differences(df, df.withColumn("bearing", F.col("bearing") + 1)).first()["digest"] == 1


def logs(tmp_path, users=3, points=60):
    rng = random.Random(1)
    for u in range(users):
        folder = tmp_path / f"{u:03d}" / "Trajectory"
        folder.mkdir(parents=True)
        for k in range(4 - u):
            lines = ["h"] * 6 + [f"{39 + rng.random():.6f},{116 + rng.random():.6f},0,{rng.randrange(99)},39744.1,2008-10-23,{i // 60:02d}:{i % 60:02d}:05" for i in range(points)]
            lines[10], lines[11], lines[12] = "bad,116.3,0,x,1,2008-10-23,02:53:04", "39.5,116.5", "39.9,116.3,0,492,39744.1,2008-13-45,02:53:04"
            (folder / f"2008{9 - k}.plt").write_text("\r\n".join(lines) + "\r\n\r\n")
    (tmp_path / "004").mkdir()
    (tmp_path / "000" / "Trajectory" / "notes.txt").write_text("no log")


def test_plt_format(spark, tmp_path, monkeypatch):
    logs(tmp_path)
    spark.dataSource.register(plt.PltSource)
    load = lambda **options: spark.read.format("plt").options(**options).load(str(tmp_path))
    got = load(missing="skip")
    columns = ["user_id", "trajectory_id", "line", "timestamp", "latitude", "longitude", "altitude"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, gps.read_plt(spark, str(tmp_path)).select(*columns).collect()))
    assert got.count() == 9 * 60
    first = load(users="000,002", filesPerUser="2").groupBy("user_id").agg(F.array_sort(F.collect_set("trajectory_id")).alias("t"))
    assert {r["user_id"]: r["t"] for r in first.collect()} == {"000": ["20086", "20087"], "002": ["20088", "20089"]}
    for options, text in (({"users": "000,009"}, "users without files: 009"), ({}, "users without files: 004")):
        with pytest.raises(Exception, match=text):
            load(**options).count()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("plt").load(str(tmp_path / "nowhere")).count()
    monkeypatch.setattr(plt, "GROUP_BYTES", 5000)
    groups = plt.PltReader({"path": str(tmp_path), "missing": "skip"}).partitions()
    assert len(groups) > 3 and sum(len(g.files) for g in groups) == 9


def test_snapshots(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a", b"1" * 100), ("b", b""), ("sub/c", bytes(range(256)) * 20), ("d", b"x")):
        (tmp_path / name).write_bytes(data)
    before = files.snapshot(spark, str(tmp_path), block_bytes=37)
    held = spark.createDataFrame(before.collect(), before.schema)
    assert {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in held.collect()} == {n.rsplit("/", 1)[-1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in (("a", b"1" * 100), ("b", b""), ("sub/c", bytes(range(256)) * 20), ("d", b"x"))}
    (tmp_path / "a").write_bytes(b"2" * 100)
    (tmp_path / "d").unlink()
    (tmp_path / "e").write_bytes(b"new")
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.changes(held, files.snapshot(spark, str(tmp_path))).collect()}
    assert status == {"a": "changed", "b": "same", "c": "same", "d": "lost", "e": "added"}


def test_folds_over_chunks(spark):
    """One trajectory of many batches beside short ones: the folds carry over batches and start anew at a trajectory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        p = spark.range(5000).select(F.lit("u").alias("user_id"), F.when(F.col("id") < 4000, "long").otherwise(F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))).alias("trajectory_id"), F.col("id").alias("source_point_index"), (F.col("id") * 1_700_000 + F.col("id") % 13).alias("elapsed_us"), (F.col("id") * 31 % 1000).alias("lat_udeg"), (F.col("id") * 17 % 999).alias("lon_udeg")).repartition(5)
        rows = sorted(p.collect(), key=lambda r: (r["trajectory_id"], r["source_point_index"]))
        got = {(r["trajectory_id"], r["source_point_index"]): (r["emitted"], r["suppressor_index"]) for r in folds.cooldown(p, 9).collect()}
        want, key, at, index = {}, None, 0, 0
        for r in rows:
            if r["trajectory_id"] != key or r["elapsed_us"] - at >= 9_000_000:
                key, at, index = r["trajectory_id"], r["elapsed_us"], r["source_point_index"]
                want[key, index] = (True, None)
            else:
                want[key, r["source_point_index"]] = (False, index)
        assert got == want
        prints = {r["trajectory_id"]: r["fingerprint"] for r in movement.fingerprints(p).collect()}
        for t in {r["trajectory_id"] for r in rows}:
            own = [r for r in rows if r["trajectory_id"] == t]
            text = "\n".join(f"{r['lat_udeg']},{r['lon_udeg']},{r['elapsed_us'] - own[0]['elapsed_us']}" for r in own)
            assert prints[t] == hashlib.sha256(text.encode()).hexdigest()
        assert alerts.cooldown(p.withColumn("candidate", F.lit(False)), 9).count() == 0 and movement.fingerprints(p.limit(0)).count() == 0
    finally:
        spark.conf.set(name, before)
