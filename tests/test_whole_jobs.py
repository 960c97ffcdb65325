"""Small fixtures on which the cut forms of the operators gave other results than the whole job."""

import math

import numpy as np

from trajspark.operators import spatial
from trajspark.plans import registry

SF = "/root/testdata/sf0.01"  # sf0.001 has too few users for a train split


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_nearest_reference_at_any_distance(spark):
    rng = np.random.default_rng(4)
    ref = [(39.9 + y, 116.3 + x) for y, x in rng.normal(0, 0.01, (60, 2))] + [(10.0, 179.9999), (-10.0, -179.99), (89.9995, 20.0), (-60.0, 5.0)]
    at = [(39.9 + y, 116.3 + x) for scale in (0.001, 0.02, 0.5, 20) for y, x in rng.normal(0, scale, (15, 2))]
    at += [(10.0, -179.9999), (-10.001, 179.995), (89.9995, -160.0), (90.0, 0.0), (-90.0, 0.0), (-60.0, -175.0), (0.0, 0.0), ref[0]]
    schema = "user_id string, trajectory_id string, source_point_index long, latitude double, longitude double"
    rows = lambda points, name: spark.createDataFrame([("u", name, i, float(a), float(b)) for i, (a, b) in enumerate(points)], schema)
    q = rows(at, "q").union(spark.createDataFrame([("u", "n", 0, None, 1.0)], schema))
    got = {(r["trajectory_id"], r["source_point_index"]): r["nearest_m"] for r in spatial.nearest_reference(q, rows(ref, "r")).collect()}
    assert len(got) == len(at) + 1 and got["n", 0] is None
    for i, (a, b) in enumerate(at):
        assert math.isclose(got["q", i], min(metres(a, b, c, d) for c, d in ref), rel_tol=1e-6, abs_tol=1e-4)
    assert spatial.nearest_reference(q, rows([], "r")).where("nearest_m is null").count() == len(at) + 1
    covered = {r["radius_m"]: r["covered"] for r in spatial.coverage_by_radius(spatial.nearest_reference(rows([(0.0, 0.0)] * 1 + [(0.0, 0.003), (0.0, 0.006)], "q"), rows([(0.0, 0.0015)], "r")), spatial.RADII).where("user_id = 'ALL'").collect()}
    assert covered == {10: 0, 25: 0, 50: 0, 100: 0, 200: 2, 500: 2, 1000: 3}


def test_every_point_outside_train_is_asked_for(spark):
    p = registry.gps_points(spark, SF)
    split = registry.datasets.user_splits(p)
    others = p.join(split.where("dataset_split <> 'train'"), "user_id").count()
    rows = registry.queries()["j10_nearest_reference"](spark, SF)
    assert rows.count() == others and rows.where("nearest_m is null").count() == 0


def test_causal_nearest_at_any_distance_and_order(spark):
    rng = np.random.default_rng(7)
    rows = []
    for user in ("u", "v"):
        for turn in range(1, 5):
            centre = (39.9 + 3.0 * turn * (user == "v"), 116.3)  # v's trajectories lie more than 50 km apart
            for i, (y, x) in enumerate(rng.normal(0, 0.02, (8, 2))):
                rows.append((user, f"{user}{turn}", i, float(centre[0] + y), float(centre[1] + x), turn * 100 + i * 40, turn))
    rows += [("u", "u4", 8, None, 116.3, 900, 4), ("w", "w1", 0, 1.0, 1.0, 5, 1)]
    schema = "user_id string, trajectory_id string, source_point_index long, latitude double, longitude double, elapsed_us long, nth int"
    p = spark.createDataFrame(rows, schema)
    got = {(r["trajectory_id"], r["source_point_index"]): r["nearest_m"] for r in spatial.causal_nearest(p, p, ("user_id",), "nth").collect()}
    assert len(got) == len(rows)
    for user, t, i, a, b, us, turn in rows:
        earlier = [metres(a, b, r[3], r[4]) for r in rows if a is not None and r[3] is not None and r[0] == user and r[6] < turn and r[5] < us]
        want = min(earlier, default=None)
        assert got[t, i] is None if want is None else math.isclose(got[t, i], want, rel_tol=1e-6, abs_tol=1e-4)
    cx = spatial.causal_context(p.drop("nth"), p.where("user_id = 'v'")).collect()
    assert len(cx) == len(rows)
    for r in cx:
        mine = next(x for x in rows if (x[1], x[2]) == (r["trajectory_id"], r["source_point_index"]))
        near = lambda ok: min((metres(mine[3], mine[4], x[3], x[4]) for x in rows if mine[3] is not None and x[3] is not None and x[5] < mine[5] and ok(x)), default=None)
        for name, ok in (("prior_m", lambda x: x[0] == mine[0] and x[6] < mine[6]), ("prefix_m", lambda x: x[1] == mine[1]), ("global_m", lambda x: x[0] == "v")):
            want = near(ok)
            assert r[name] is None if want is None else math.isclose(r[name], want, rel_tol=1e-6, abs_tol=1e-4)
    assert spatial.causal_nearest(p, p.limit(0), ("user_id",), "nth").where("nearest_m is null").count() == len(rows)
