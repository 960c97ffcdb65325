"""The reconstruction detector and the stored runs against plain NumPy and plain recomputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import detectors, reconstruction, stored_runs
from trajspark.plans import models, registry

SF = "/root/testdata/sf0.01"
COLUMNS = [f"c{k}" for k in range(8)]


def table(spark, n, seed=0, more=0.0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 3)) @ rng.standard_normal((3, 8)) + 0.1 * rng.standard_normal((n, 8)) + more
    return base, spark.createDataFrame([(i % 7, f"t{i % 5}", i, *map(float, r)) for i, r in enumerate(base)], "part int, trajectory_id string, source_point_index long, " + ", ".join(f"{c} double" for c in COLUMNS))


def plain_forward(vector, x):
    """Row by row and unit by unit."""
    out = []
    for row in x:
        values, at = list(row), 0
        for k, (a, b) in enumerate(reconstruction.LAYERS):
            w, c = vector[at : at + a * b], vector[at + a * b : at + a * b + b]
            values = [sum(values[i] * w[i * b + j] for i in range(a)) + c[j] for j in range(b)]
            if k < len(reconstruction.LAYERS) - 1:
                values = [max(0.0, v) for v in values]
            at += a * b + b
        out.append(sum((v - r) ** 2 for v, r in zip(values, row, strict=True)) / len(row))
    return np.array(out)


def plain_fit(train, held, seed, epochs, patience, rate):
    """Full-batch Adam over all rows at once (the gradient is tested by differences above)."""
    mean, scale = train.mean(axis=0), train.std(axis=0)
    x, v = (train - mean) / scale, (held - mean) / scale
    w, m, s = reconstruction.initial(seed), 0.0, 0.0
    best, best_epoch, history = np.inf, 0, []
    for epoch in range(1, epochs + 1):
        g = reconstruction.gradient(w, x)[1] / len(x)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.999**epoch)) + 1e-8)
        loss = reconstruction.errors(w, v).mean()
        if loss < best:
            best, best_epoch, kept = loss, epoch, w
        history.append((epoch, reconstruction.errors(w, x).mean(), loss, best, best_epoch, epoch - best_epoch))
        if epoch - best_epoch >= patience:
            break
    return kept, history


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    vector, x = reconstruction.initial(3), rng.standard_normal((20, 8))
    assert len(vector) == reconstruction.PARAMETERS == 636
    loss, g = reconstruction.gradient(vector, x)
    assert np.isclose(loss, reconstruction.errors(vector, x).sum()) and np.allclose(reconstruction.errors(vector, x), plain_forward(vector, x))
    for i in rng.choice(636, 80, replace=False):
        step = np.zeros(636)
        step[i] = 1e-6
        assert np.isclose(g[i], (reconstruction.errors(vector + step, x).sum() - reconstruction.errors(vector - step, x).sum()) / 2e-6, rtol=1e-4, atol=1e-5)


def test_fit_equals_full_batch_numpy(spark):
    train, t = table(spark, 900)
    held, h = table(spark, 200, 1)
    parameters, history = reconstruction.fit(t.repartition(5), h, COLUMNS, [1, 2], epochs=30)
    found = reconstruction.read_parameters(parameters)
    for s in (1, 2):
        weights, rows = plain_fit(train, held, s, 30, 15, reconstruction.RATE)
        got = [tuple(r)[1:] for r in history.where(F.col("seed") == s).orderBy("epoch").collect()]
        assert len(got) == len(rows) and np.allclose(np.array(got, dtype=float), np.array(rows, dtype=float), atol=1e-6)
        assert np.allclose(found[s][0], weights, atol=1e-6)
    scores = reconstruction.with_errors(h, parameters, COLUMNS, "e").select("source_point_index", F.inline("e")).where("seed = 2").orderBy("source_point_index").toPandas()["score"].to_numpy()
    w, mean, scale = found[2]
    assert np.allclose(scores, plain_forward(w, (held - mean) / np.array(scale)))


def test_patience_stops_and_the_best_weights_stay(spark):
    _, t = table(spark, 300)
    held, h = table(spark, 80, 1, more=40.0)  # unlike the training rows: its loss soon grows
    parameters, history = reconstruction.fit(t, h, COLUMNS, [1], epochs=40, patience=3, rate=0.05)
    rows = history.orderBy("epoch").collect()
    assert rows[-1]["patience"] == 3 and len(rows) < 40 and rows[-1]["epoch"] == rows[-1]["best_epoch"] + 3
    w, mean, scale = reconstruction.read_parameters(parameters)[1]
    assert np.isclose(reconstruction.errors(w, (held - mean) / np.array(scale)).mean(), min(r["validation_loss"] for r in rows))


def test_odd_rows_and_parameters(spark):
    _, t = table(spark, 60)
    null = t.withColumn("c3", F.when(F.col("source_point_index") == 4, None).otherwise(F.col("c3"))).withColumn("c5", F.when(F.col("source_point_index") == 5, float("nan")).otherwise(F.lit(2.0)))
    parameters, history = reconstruction.fit(null, t, COLUMNS, [1], epochs=2)  # c5 is constant
    assert history.count() == 2
    scores = {r["source_point_index"]: r["score"] for r in reconstruction.with_errors(null, parameters, COLUMNS, "e").select("source_point_index", F.inline("e")).collect()}
    assert len(scores) == 60 and scores[4] is None and scores[5] is None and sum(v is None for v in scores.values()) == 2
    for broken in (parameters.where("not (layer = 2 and part = 'bias' and j = 1)"), parameters.unionByName(parameters)):
        with pytest.raises(ValueError, match="complete"):
            reconstruction.read_parameters(broken.where("seed = 1"))
    with pytest.raises(ValueError, match="no training rows"):
        reconstruction.fit(t.limit(0), t, COLUMNS, [1])
    with pytest.raises(ValueError, match="no validation rows"):
        reconstruction.fit(t, t.limit(0), COLUMNS, [1])


def test_forest_draws_few_rows(spark):
    n = 40_000
    df = spark.range(n).select(F.lit("t").alias("trajectory_id"), F.col("id").alias("source_point_index"), (F.col("id") % 997).cast("double").alias("x"))
    m = detectors.isolation_forest(df, ["x"], trees=20, rows=64)
    roots = m.where("node = 1").collect()
    assert len(roots) == 20 and all(r["size"] == 64 for r in roots)
    small = detectors.isolation_forest(df.limit(100), ["x"], trees=20, rows=64)
    assert all(r["size"] == 64 for r in small.where("node = 1").collect())


def test_stored_runs(spark, tmp_path):
    """Fitted, frozen, stored and scanned over whole tables; decisions, row identity, pruning and metrics recomputed from the stored scores."""
    s = models.store(spark, SF)
    assert models.store(spark, SF) is s
    p = stored_runs.scan(spark, s.path, s.thresholds)
    audit = registry.queries()["s16_stored_runs"](spark, SF).collect()
    assert len(audit) == 11 and {(r["model"], r["seed"], r["run"]) for r in audit} == set(stored_runs.RUNS)
    assert len({r["points"] for r in audit}) == 1 and all(r["mismatches"] == r["repeated"] == r["missing"] == 0 and r["has_normal"] and r["has_anomalous"] for r in audit)
    frame = p.toPandas()
    normal = frame[(frame["stream"] == "normal") & (frame["dataset_split"] == "val") & (frame["anomaly_label"] == 0) & frame["is_training_eligible"]]
    for r in s.thresholds.collect():
        own = normal[normal["run"] == r["run"]]["run_score"]
        assert np.isclose(np.percentile(own, 95), r["threshold"], rtol=1e-9)
        assert abs((own > r["threshold"]).mean() - 0.05) < 0.01
    one = stored_runs.scan(spark, s.path, s.thresholds, "autoencoder", 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and {(r["model"], r["seed"]) for r in one.select("model", "seed").distinct().collect()} == {("autoencoder", 3)}
    metrics = {(r["model"], r["seed"], r["dataset_split"]): r for r in registry.queries()["d14_run_metrics"](spark, SF).collect()}
    assert len(metrics) == 22
    sound = frame[((frame["stream"] == "normal") & frame["is_training_eligible"] & (frame["anomaly_label"] == 0)) | ((frame["stream"] == "copy") & (frame["anomaly_label"] == 1) & frame["source_quality_valid"] & ~frame["is_low_quality"])]
    for (model, seed, split), r in metrics.items():
        own = sound[(sound["model"] == model) & (sound["dataset_split"] == split) & ((sound["seed"] == seed) if seed else sound["seed"].isna())]
        tp, fp = (((own["run_score"] > own["threshold"]) & (own["anomaly_label"] == k)).sum() for k in (1, 0))
        assert (r["tp"], r["fp"], r["tp"] + r["fn"], r["fp"] + r["tn"]) == (tp, fp, (own["anomaly_label"] == 1).sum(), (own["anomaly_label"] == 0).sum())
    # the audit sees what is wrong: a changed decision, a lost row, a repeated row
    odd = p.where("run < 2").withColumn("predicted", F.when((F.col("run") == 1) & (F.col("source_point_index") == 7), 1 - F.col("predicted")).otherwise(F.col("predicted"))).where("not (run = 0 and source_point_index = 9)")
    found = {r["run"]: r for r in stored_runs.run_audit(odd.unionByName(p.where("run = 0 and source_point_index = 11"))).collect()}
    assert found[1]["mismatches"] > 0 and found[0]["missing"] > 0 and found[0]["repeated"] > 0 and found[0]["mismatches"] == 0
    with pytest.raises(Exception, match="(?i)exists"):
        stored_runs.write_predictions(p.drop("threshold", "predicted").limit(1), s.thresholds, s.path)


def test_every_fitted_query_gives_rows(spark):
    from test_trajectory import FITTED

    for name in sorted(FITTED):
        assert registry.queries()[name](spark, SF).limit(1).count() == 1, name


def test_policies_over_stored_runs(spark):
    q = registry.queries()
    grid = q["a22_run_policy_grid"](spark, SF).collect()
    assert len(grid) == 11 * 21 and len({(r["run"], r["policy_id"]) for r in grid}) == 231
    raw = {r["run"]: r for r in grid if r["policy_id"] == "1of1_cd0"}
    for r in grid:  # a gate or cooldown never detects more events or notifies more than single points without cooldown
        assert r["edr"] <= raw[r["run"]]["raw_edr"] + 1e-9 and r["false_notifications"] <= raw[r["run"]]["false_notifications"]
    streams = models._streams(spark, SF)
    assert streams.where("source_point_index < segment_start and not equals_source").isEmpty()
    events = streams.where("run = 3 and source_point_index >= segment_start").groupBy("sample_id").agg(F.max("predicted").alias("hit")).toPandas()
    assert {x.split("__")[2] for x in events["sample_id"]} == {"route_deviation", "abnormal_speed", "long_stop", "direction_change"}
    selected = q["a23_run_policy_selection"](spark, SF).where("selected").collect()
    assert len(selected) <= 3 and all(r["eligible"] for r in selected)
    assert q["a24_run_reductions"](spark, SF).count() == sum(5 if r["model"] != "statistical_rule" else 1 for r in selected)
    summary = q["a14_run_seed_summary"](spark, SF).collect()
    assert {r["runs"] for r in summary} == {1, 5}
