import hashlib
import uuid

import numpy as np
from pyspark.sql import functions as F

from trajspark.llm import components, near_dup
from trajspark.llm.components import connected, joined


def test_loose_members_meet_tied_ones(spark, monkeypatch):
    """One bucket: u is tied to the low centre, v to no centre (estimate 0.4), yet u and v are alike (0.8)."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    slots = near_dup.BANDS * near_dup.ROWS
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**32, slots, dtype=np.uint32)

    def like(base, kept):
        out = rng.integers(0, 2**32, slots, dtype=np.uint32)
        out[kept] = base[kept]
        return out

    u = like(centre, slice(0, 40))  # 0.5
    v = like(u, slice(8, 72))  # 0.8 to u, 0.4 to the centre
    high = rng.integers(0, 2**32, slots, dtype=np.uint32)
    w = like(high, slice(0, 40))  # tied to the high centre
    ids = sorted(hashlib.md5(str(i).encode()).digest() for i in range(5))
    nodes = dict(zip(ids, (centre, u, v, w, high), strict=True))
    sketches = spark.createDataFrame([(k, s.tobytes()) for k, s in nodes.items()], "node binary, sketch binary")
    found = near_dup._candidates(sketches.select("node", F.lit(1).alias("bucket")), sketches)
    pairs = {(bytes(r["u"]), bytes(r["v"])): r["likely"] for r in found.collect()}
    assert pairs[ids[1], ids[2]]
    roots = {bytes(r["node"]): r["root"] for r in connected(found.select("u", "v")).collect()}
    assert roots[ids[0]] == roots[ids[1]] == roots[ids[2]] != roots[ids[3]] == roots[ids[4]]


def test_clusters_of_both_centres_meet(spark, monkeypatch):
    """u is tied to the low centre, v to the high one; only u and v are alike."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    slots = near_dup.BANDS * near_dup.ROWS
    rng = np.random.default_rng(2)
    low, high, u, v = (rng.integers(0, 2**32, slots, dtype=np.uint32) for _ in range(4))
    u[:64] = v[:64]
    u[:8], u[64:] = low[:8], low[64:]
    u[8:20] = low[8:20]  # 0.45 to low, 0.55 to v
    v[20:56] = u[20:56]
    high[:8], high[56:80], high[20:24] = v[:8], v[56:80], v[20:24]  # 0.45 to v
    ids = sorted(hashlib.md5(str(i).encode()).digest() for i in range(4))
    sketches = spark.createDataFrame([(k, s.tobytes()) for k, s in zip(ids, (low, u, v, high), strict=True)], "node binary, sketch binary")
    found = near_dup._candidates(sketches.select("node", F.lit(1).alias("bucket")), sketches)
    assert len({r["root"] for r in connected(found.select("u", "v")).collect()}) == 1


def test_large_stars(spark):
    """Large stars whose centre is the smallest, the largest or a middle node, and a bridge between two of them."""
    name = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    groups = [sorted(name((g, i)) for i in range(700)) for g in range(3)]
    links = [(own[at], x) for own, at in zip(groups, (0, -1, 350), strict=True) for x in own if x != own[at]] + [(groups[0][5], groups[1][6])]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u string, v string")).collect()}
    first = min(groups[0][0], groups[1][0])
    assert got == {x: first for x in groups[0] + groups[1]} | {x: groups[2][0] for x in groups[2]}


def test_marked_rows_hold_all_wanted_ones(spark):
    rows = spark.range(3000).select(F.col("id"), F.unhex(F.md5(F.col("id").cast("string"))).alias("node"))
    got = near_dup.marked(rows, rows.where("id % 7 = 0").select("node"), "node")
    assert got.where("id % 7 = 0 and not marked").count() == 0 and got.where("marked").count() < 460 and got.count() == 3000
    assert near_dup.marked(rows, rows.where("id < 0").select("node"), "node").where("marked").count() == 0


def test_deduplicated_keeps_clashing_columns(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(3, text, "a", "b"), (1, text, "c", "d"), (2, "other words here", "e", "f"), (2, "other words here", "g", "h")], "doc_id long, text string, node string, row string")
    got = sorted((r["doc_id"], r["node"][0]) for r in near_dup.deduplicated(docs).collect())
    assert [i for i, _ in got] == [1, 2] and near_dup.deduplicated(docs).columns == docs.columns and got[0][1] == "c"


def _tasks(spark, run):
    """run()'s result and the number of tasks in the stages of its jobs."""
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "counted")
    out, status = run(), spark.sparkContext.statusTracker()
    stages = {s for job in status.getJobIdsForGroup(group) if (info := status.getJobInfo(job)) for s in info.stageIds}
    spark.sparkContext.setJobGroup("", "")
    return out, sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))


def _name(x):
    return hashlib.md5(str(x).encode()).digest()


def _smallest(links):
    up = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(up[u], up[v])
            changed |= up[u] != low or up[v] != low
            up[u] = up[v] = low
    return up


def test_components_take_few_tasks(spark, monkeypatch):
    """Many shuffle partitions that hold little: rounds don't write and read a file of each, over and over."""
    monkeypatch.setattr(components, "FILES", 1)
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    rng = np.random.default_rng(3)
    links = [(_name(int(a)), _name(int(b))) for a, b in rng.integers(0, 400, (300, 2))] + [(_name(f"c{i}"), _name(f"c{i + 1}")) for i in range(60)]
    table = spark.createDataFrame(links, "u binary, v binary").repartition(8)
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got, tasks = _tasks(spark, lambda: {bytes(r["node"]): bytes(r["root"]) for r in connected(table).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _smallest([x for x in links if x[0] != x[1]])
    assert tasks < 1200


def test_more_links_join_components(spark, monkeypatch):
    """Trees of a few links each, further links between roots and nodes that stood in none."""
    monkeypatch.setattr(components, "FOREST", 3)
    links = [(_name(f"{g} {i}"), _name(f"{g} {i + 1}")) for g in range(6) for i in range(9)]
    roots = connected(spark.createDataFrame(links, "u binary, v binary").repartition(5))
    own = _smallest(links)
    assert {bytes(r["node"]): bytes(r["root"]) for r in roots.collect()} == own
    ends = [(own[_name("0 3")], own[_name("1 0")]), (own[_name("2 0")], _name("new")), (_name("new"), own[_name("1 5")]), (_name("x"), _name("y"))]
    got = joined(roots, spark.createDataFrame(ends, "u binary, v binary"))
    assert {bytes(r["node"]): bytes(r["root"]) for r in got.collect()} == _smallest(links + ends)
    assert joined(roots, spark.createDataFrame([], "u binary, v binary")).count() == len(own)


def test_repeated_passages_are_bounded_before_they_are_compared(monkeypatch):
    """Texts of uneven weights: the same links as by brute force, the exact measure only where its bound reaches the threshold."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 40, 60)
        for cut in (60, 56, 50, 30):
            sets.append(np.unique(np.concatenate([base[:cut], base[:20], rng.integers(40, 80, 60 - cut)]).astype(np.uint64), return_counts=True))
    rows = [{"node": _name(i), "root": _name(i), "apart": False, "h": h.tobytes(), "w": w.astype(float).tobytes()} for i, (h, w) in enumerate(sets)]
    exact, asked = near_dup.probability_jaccard, []
    monkeypatch.setattr(near_dup, "probability_jaccard", lambda a, b: asked.append(1) or exact(a, b))
    found = near_dup.chunk_links(rows, rows, 0.8)
    near = [(_name(i), _name(j)) for i, (g, x) in enumerate(sets) for j, (h, y) in enumerate(sets) if i != j and exact((g, x.astype(float)), (h, y.astype(float))) >= 0.8]
    assert near and _smallest(found) == _smallest(near)
    assert len(asked) < len(rows) ** 2 / 4
