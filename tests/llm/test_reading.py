"""How much the searches read: list cells of the exact one, distances of the approximate one."""

import collections

import numpy as np

from trajspark.llm import ann, topk


def test_nra_reads_cells_once_and_stops_early():
    rng = np.random.default_rng(1)
    x = np.zeros((2000, 6))
    x[:, 0] = np.floor(rng.pareto(1.0, 2000) * 100)  # few candidates stand out
    x[:, 1:] = rng.integers(0, 5, (2000, 5))
    ids, q = np.arange(2000), np.arange(0, 2000, 40)
    w = np.tile(np.array([5.0, 1, -1, 0, 1, 1]), (len(q), 1))
    cells: list[int] = []
    rows, found, scores = topk.nra(ids, x, q, w, 10, cells)
    listed = int((w != 0).sum()) * len(x)
    assert sum(cells) < listed / 2  # stops before the last depth
    full = w @ x.T
    for i, query in enumerate(q):
        own = sorted((-int(s), int(v)) for v, s in enumerate(full[i]) if v != query)[:10]
        assert [(-int(s), int(v)) for s, v in zip(scores[rows == i], found[rows == i], strict=True)] == own
    even = np.floor(rng.normal(size=(600, 8)) * 64)  # nothing stands out: each cell is read, and once
    cells = []
    topk.nra(np.arange(600), even, np.arange(0, 600, 60), even[::60], 10, cells)
    assert sum(cells) <= int((even[::60] != 0).sum()) * 600


def _recall(spark, x):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(table).collect():
        got[r["query_id"]].append(r["vec_id"])
    scores = x @ x.T
    out = []
    for q in range(0, len(x), 20):
        own = np.delete(scores[q], q)
        out.append(np.mean(scores[q][got[q]] >= np.sort(own)[-20] - 1e-9))
    return np.mean(out)


def test_ann_recall_at_shipped_parameters(spark):
    rng = np.random.default_rng(8)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    assert _recall(spark, np.array([r["embedding"] for r in rows], dtype=float)) >= 0.9
    assert _recall(spark, rng.normal(size=(6000, 32))) >= 0.9  # hard: isotropic, norms spread


def test_ann_computes_few_distances():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32))
    x = ann._lifted(x / np.linalg.norm(x, axis=1)[:, None])
    graph, start = ann.build_graph(x)
    _, _, distances = ann.beam_search(x, graph, start, x[:200], ann.SEARCH_WIDTH)
    assert distances < 0.4 * 200 * len(x)
