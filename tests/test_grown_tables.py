"""What failed on larger tables, on small ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from trajspark.operators import audits, evaluation

SF = "/root/testdata/sf0.01"


def plain_ranking(y, score):
    """ROC-AUC over all pairs and average precision over distinct scores."""
    pos, neg = score[y == 1], score[y != 1]
    auc = ((pos[:, None] > neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2) / (len(pos) * len(neg))
    steps = np.unique(score)[::-1]
    ap = sum((pos == s).sum() * (pos >= s).sum() / (score >= s).sum() for s in steps) / len(pos)
    return auc, ap


def test_ranking_when_quantiles_differ_from_run_to_run(spark, monkeypatch):
    """Approximate quantiles of many values depend on the order in which their parts arrive; here each computation gives others."""
    shift = F.udf(lambda _: random.uniform(-20.0, 20.0), "double").asNondeterministic()
    monkeypatch.setattr(audits.F, "percentile_approx", lambda c, q: F.array(*[F.max(c) * 0 + shift(F.max(c)) + 10 * k for k in range(9)]))
    rng = np.random.default_rng(3)
    rows = [(k, float(s), int(y)) for k in ("a", "b") for s, y in zip(rng.integers(0, 80, 300), rng.integers(0, 2, 300), strict=True)]
    t = spark.createDataFrame(rows, "k string, score double, y int")
    found = {r["k"]: r for r in evaluation.grouped_ranking(t, "k", label="y").collect()}
    for k in ("a", "b"):
        own = np.array([r[1:] for r in rows if r[0] == k])
        auc, ap = plain_ranking(own[:, 1], own[:, 0])
        assert abs(found[k]["roc_auc"] - auc) < 1e-6 and abs(found[k]["average_precision"] - ap) < 1e-6
    every = evaluation.ranking_metrics(t, label="y").first()
    own = np.array([r[1:] for r in rows])
    auc, ap = plain_ranking(own[:, 1], own[:, 0])
    assert abs(every["roc_auc"] - auc) < 1e-6 and abs(every["average_precision"] - ap) < 1e-6


def test_the_policy_grid_has_a_small_plan(spark):
    """Every branch used to hold the whole way from the events; the driver held the plan several times over."""
    from trajspark.plans import runs

    plan = runs._grid(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3 and len(plan) < 200_000


def test_percentiles_hold_no_group(spark):
    """As numpy's, of large and small groups, of many equal values, and without the aggregate that gathers a group's values."""
    rng = np.random.default_rng(5)
    rows = [("many", float(v)) for v in rng.exponential(size=9000)] + [("equal", float(v)) for v in rng.integers(0, 3, 5000)] + [("few", v) for v in (3.0, 1.0, 2.0, 10.0)] + [("one", 7.0), ("none", None), ("few", None)]
    t = spark.createDataFrame(rows, "k string, value double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    df = audits.percentiles(t, shares, "k")
    found = {(r["k"], r["share"]): r["percentile"] for r in df.collect()}
    assert {k for k, _ in found} == {"many", "equal", "few", "one"} and "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()
    for (k, s), got in found.items():
        assert np.isclose(got, np.percentile([v for g, v in rows if g == k and v is not None], 100 * s), rtol=1e-12)
    assert np.isclose(audits.percentiles(t, (0.5,)).first()["percentile"], np.median([v for _, v in rows if v is not None]))


def test_who_needs_one_detector_fits_no_other(spark, monkeypatch):
    from trajspark.operators import stored_runs

    def never(*_, **__):
        raise AssertionError("not asked for")

    t = spark.createDataFrame([(1, 0.5)], "seed int, value double")
    monkeypatch.setattr(stored_runs.reconstruction, "fit", lambda *_: (t, t))
    monkeypatch.setattr(stored_runs.detectors, "isolation_forest", never)
    monkeypatch.setattr(stored_runs.movement, "statistical_rule", never)
    models = stored_runs.Models(t, t, ["value"])
    assert models.history.count() == models.parameters.count() == 1


def test_copies_with_their_sources_features_are_not_scored_again(spark, monkeypatch):
    from trajspark.operators import stored_runs
    from trajspark.plans import models

    scored = []

    def marked(rows, *_):
        scored.append(rows.count())
        return rows.withColumn("scores", F.array(F.col("speed"), F.hash("speed", "dt", "turn").cast("double")))

    monkeypatch.setattr(stored_runs, "with_scores", marked)
    held = models._flagged(spark, SF).where("dataset_split = 'val'")
    rows = models.evaluated_scores(held.withColumn("scores", F.array(F.col("speed"), F.hash("speed", "dt", "turn").cast("double"))), None)
    copies = rows.where("stream = 'copy'")
    assert copies.count() == 4 * held.count() and rows.where("scores is null").isEmpty()
    assert 0 < sum(scored) < 0.2 * copies.count()
    own = held.select(F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index", F.col("speed").alias("_s"))
    assert copies.where("equals_source").join(own, ["source_trajectory_id", "source_point_index"]).where("scores[0] <> _s").isEmpty()


def test_streams_of_stored_runs_need_no_join(spark):
    from trajspark.operators import runs

    rng = np.random.default_rng(8)
    kind = "model string, seed int, run int, user_id string, trajectory_id string, source_trajectory_id string, source_point_index long, elapsed_us long, anomaly_label int, is_training_eligible boolean, source_quality_valid boolean, is_low_quality boolean, equals_source boolean, segment_start long, segment_end long, predicted int"
    sound, marks = rng.random(40) < 0.8, rng.integers(0, 2, (2, 40))
    normal = [("m", k, k, "u", "t", "t", i, i, 0, bool(sound[i]), bool(sound[i]), False, True, None, None, int(marks[k, i])) for k in range(2) for i in range(40)]
    copied = []
    for k in range(2):
        for i in range(40):
            inside, same = 20 <= i < 30, bool(rng.random() < 0.7)
            copied.append(("m", k, k, "u", "t__c", "t", i, i, int(inside), True, bool(sound[i]), bool(rng.random() < 0.1), same and not inside, 20, 30, int(marks[k, i]) if same and not inside else int(rng.integers(0, 2))))
    c, n = spark.createDataFrame(copied, kind), spark.createDataFrame(normal, kind)
    names = ["run", "trajectory_id", "sample_id", "source_point_index", "elapsed_us", "predicted"]
    one = runs.own_context_streams(c)
    assert sorted(map(tuple, one.select(*names).collect())) == sorted(map(tuple, runs.context_streams(c, n).select(*names).collect()))
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_an_epoch_reads_blocks(spark):
    from trajspark.operators import reconstruction

    rng = np.random.default_rng(6)
    x = rng.standard_normal((10_000, 8))
    rows = spark.createDataFrame([(bool(i % 5 == 0), list(map(float, r))) for i, r in enumerate(x)], "held boolean, x array<double>").repartition(2)
    dealt = reconstruction.blocks(rows)
    sizes = [(r["held"], r["n"]) for r in dealt.collect()]
    assert sum(n for _, n in sizes) == 10_000 and sum(n for held, n in sizes if held) == 2000 and len(sizes) <= 6
    w = {s: reconstruction.initial(s) for s in (1, 2)}
    held = np.arange(10_000) % 5 == 0
    for s, total in reconstruction.epoch_sums(dealt, w).items():
        loss, g = reconstruction.gradient(w[s], x[~held])
        assert np.allclose(total[: reconstruction.PARAMETERS], g) and np.allclose(total[reconstruction.PARAMETERS :], (8000, loss, 2000, reconstruction.errors(w[s], x[held]).sum()))


def test_windows_by_group_and_by_radius(spark, monkeypatch):
    """Small keys are compared in groups without any table of pairs; the others radius by radius, with the same results, also in one call."""
    from trajspark.operators import similarity

    rng = np.random.default_rng(12)
    rows = []
    for user, trips, n in (("a", 3, 30), ("b", 2, 12), ("c", 1, 3)):
        for t in range(trips):
            at = np.array([39.9 + 0.3 * t * (user == "b"), 116.3]) + np.cumsum(rng.normal(0, 2e-4, (n, 2)), axis=0)
            at[n // 2 : n // 2 + n // 3] = at[: n // 3]
            rows += [(user, f"{user}{t}", i, t * 1000 + i * 10, float(y), float(x)) for i, (y, x) in enumerate(at)]
    p = spark.createDataFrame(rows, "user_id string, trajectory_id string, source_point_index long, elapsed_us long, latitude double, longitude double")
    made, kept = [], similarity.saved
    monkeypatch.setattr(similarity, "saved", lambda df, name: made.append(name) or kept(df, name))
    names = ["kind", "gap", "trajectory_id", "source_point_index", "ref_trajectory", "ref_index"]

    def got(**more):
        return {tuple(r[c] for c in names[:4]): tuple(r[c] for c in names[4:]) + tuple(r[c] and round(r[c], 6) for c in ("frechet_m", "aligned_mean_m", "aligned_max_m")) for r in similarity.nearest_windows(p, 4, (0, 3), 2, **more).collect()}

    one = got()
    assert set(made) == {"windows", "sizes"} and len(one) == 3 * (3 * 27 + 2 * 9) and any(v[0] is None for v in one.values())
    monkeypatch.setattr(similarity, "HELD", 100)  # slices of a few windows
    assert got() == one
    assert got(group=(0, 0)) == one and "pairs" in made
    assert got(group=(40, 20)) == one


def test_radii_begin_smaller_where_places_lie_close(spark, monkeypatch):
    from trajspark.operators import spatial

    rng = np.random.default_rng(9)
    rows = [(f"t{i % 3}", i, 39.9 + float(a), 116.3 + float(b), int(t)) for i, (a, b, t) in enumerate(zip(*rng.uniform(0, 1e-4, (2, 300)), rng.integers(0, 50, 300), strict=True))]
    p = spark.createDataFrame(rows, "trajectory_id string, source_point_index long, latitude double, longitude double, elapsed_us long")
    places = p.select(F.col("latitude").alias("ref_lat"), F.col("longitude").alias("ref_lon"))
    assert spatial.rungs(places, (), 300) == spatial.RUNGS  # few pairs are not worth more jobs
    few = {(r["trajectory_id"], r["source_point_index"]): r["nearest_m"] for r in spatial.causal_nearest(p, p).collect()}
    monkeypatch.setattr(spatial, "WORTH", 0)
    dense = spatial.rungs(places, (), 300)
    assert dense[-len(spatial.RUNGS) :] == spatial.RUNGS and len(dense) > len(spatial.RUNGS) and list(dense) == sorted(dense) and spatial.rungs(places.limit(0), (), 0) == spatial.RUNGS
    assert {(r["trajectory_id"], r["source_point_index"]): r["nearest_m"] for r in spatial.causal_nearest(p, p).collect()} == few
