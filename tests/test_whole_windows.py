"""Window similarity against a plain recursion over all pairs of windows."""

import math
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.operators import detectors, similarity

SCHEMA = "user_id string, trajectory_id string, source_point_index long, elapsed_us long, latitude double, longitude double, anomaly_label int"


def distance(a, b):
    gap = lambda i, j: math.dist(a[i], b[j])

    @lru_cache(None)
    def reach(i, j):
        before = [reach(p, q) for p, q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p >= 0 and q >= 0]
        return max(gap(i, j), min(before)) if before else gap(0, 0)

    return reach(len(a) - 1, len(b) - 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for u, user in enumerate(("a", "b")):
        for t in range(3):
            at = np.array([39.9 + 0.4 * u * t, 116.3]) + np.cumsum(rng.normal(0, 2e-4, (24, 2)), axis=0)  # b's trajectories lie 44 km apart
            at[12:18] = at[0:6]  # repeats its own start
            out += [(user, f"{user}{t}", i, t * 1000 + i * 10 - 400 * (t == 2) * (user == "a"), float(y), float(x), int(i == 15)) for i, (y, x) in enumerate(at)]
    return out


@pytest.mark.parametrize(("width", "rungs"), [(4, similarity.RUNGS), (4, (5.0,)), (6, ())])
def test_nearest_windows_by_brute_force(spark, rows, width, rungs):
    p = spark.createDataFrame(rows, SCHEMA)
    got = {(r["kind"], r["gap"], r["trajectory_id"], r["source_point_index"]): r for r in similarity.nearest_windows(p, width, (0, 3), 2, rungs).collect()}
    by = {}
    lat0, lon0 = float(np.mean([r[4] for r in rows])), float(np.mean([r[5] for r in rows]))
    enu = p.select("trajectory_id", "source_point_index", geo.enu(p["latitude"], p["longitude"], lat0, lon0).alias("p")).collect()
    place = {(r["trajectory_id"], r["source_point_index"]): tuple(r["p"]) for r in enu}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    cut = lambda t, s: tuple(place[t, i] for i in range(s, s + width))
    seen = 0
    for t, mine in by.items():
        for s in range(len(mine) - width + 1):
            for kind, gap in (("prior", 0), ("prefix", 0), ("prefix", 3)):
                if kind == "prior":
                    bank = [(o, k) for o, other in by.items() if other[0][0] == mine[0][0] and other[-1][3] < mine[0][3] for k in range(0, len(other) - width + 1, 2)]
                else:
                    bank = [(t, k) for k in range(0, len(mine) - width + 1, 2) if k + width - 1 <= s - gap - 1 and mine[k + width - 1][3] < mine[s][3]]
                r = got[kind, gap, t, s + width - 1]
                seen += 1
                if not bank:
                    assert r["frechet_m"] is None and r["ref_trajectory"] is None
                    continue
                d, o, k = min((distance(cut(t, s), cut(o, k)), o, k) for o, k in bank)
                assert math.isclose(r["frechet_m"], d, rel_tol=1e-7, abs_tol=1e-5)
                steps = [math.dist(x, y) for x, y in zip(cut(t, s), cut(r["ref_trajectory"], r["ref_index"] - width + 1), strict=True)]
                assert math.isclose(r["aligned_mean_m"], sum(steps) / width, rel_tol=1e-6, abs_tol=1e-5) and math.isclose(r["aligned_max_m"], max(steps), rel_tol=1e-6, abs_tol=1e-5)
                assert d < 1e-6 or (r["ref_trajectory"], r["ref_index"]) == (o, k + width - 1)
    assert len(got) == seen


def test_combined_and_configurations(spark, rows):
    p = spark.createDataFrame([*rows, ("c", "c0", 0, None, None, 1.0, 0)], SCHEMA)
    near = similarity.nearest_windows(p, 4, (0, 3), 2)
    all_kinds = {(r["kind"], r["gap"], r["trajectory_id"], r["source_point_index"]): r["frechet_m"] for r in similarity.with_combined(near).collect()}
    for (kind, gap, t, i), d in all_kinds.items():
        if kind == "combined":
            parts = [x for x in (all_kinds["prior", gap, t, i], all_kinds["prefix", gap, t, i]) if x is not None]
            assert d == min(parts, default=None)
    report = similarity.compare_configurations(similarity.with_combined(near), p).where("user_id = 'ALL'").collect()
    assert len(report) == 6
    for r in report:
        mine = [d for (kind, gap, *_), d in all_kinds.items() if (kind, gap) == (r["kind"], r["gap"])]
        assert (r["windows"], r["available"]) == (len(mine), sum(d is not None for d in mine))
    assert similarity.nearest_windows(p.limit(0), 4).count() == 0


def test_early_abandon_saves_cells(spark, rows):
    """Distances that are not given up are those of the full recursion, given up ones are larger than the best; the counters fall below all cells."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(300, 8, 3)), rng.normal(size=(300, 8, 3))
    full = detectors.frechet(a, b)
    none, cells = detectors.frechet_within(a, b, np.full(300, np.inf))
    assert np.allclose(none, full) and (cells == 64).all()
    best = np.quantile(full, 0.3)
    some, cells = detectors.frechet_within(a, b, np.full(300, best))
    assert np.allclose(some[~np.isnan(some)], full[~np.isnan(some)]) and (full[np.isnan(some)] > best).all() and not np.isnan(some[full <= best]).any()
    assert cells.sum() < 300 * 64 and cells[np.isnan(some)].min() == 8
    near = similarity.nearest_windows(spark.createDataFrame(rows, SCHEMA), 6, (0, 3), 1, ()).agg(*[F.sum(c).alias(c) for c in similarity.WORK]).first()
    assert near["given_up"] > 0 and 0 < near["cells"] < near["compared"] * 36
