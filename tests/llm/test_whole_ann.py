import collections

import numpy as np

from trajspark.llm import ann


def test_copies_are_found(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    copies = rng.permutation(3000)[:1000]
    x[copies] = np.repeat(rng.normal(size=(10, 16)), [400, 200, 100, 80, 60, 40, 40, 40, 20, 20], axis=0)
    got = collections.defaultdict(list)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.nearest(table).collect():
        got[r["query_id"]].append(r["vec_id"])
    scores = x @ x.T
    recall = {}
    for q in range(0, 3000, 20):
        own = np.delete(scores[q], q)
        least = np.sort(own)[-20] - 1e-9
        assert len(set(got[q])) == 20 and q not in got[q]
        recall[q] = np.mean(scores[q][got[q]] >= least)
    grouped = [recall[q] for q in recall if q in set(copies.tolist())]
    assert len(grouped) > 20 and np.mean(grouped) >= 0.9 and np.mean(list(recall.values())) >= 0.9
