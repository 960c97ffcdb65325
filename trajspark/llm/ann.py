"""Operator 6: approximate nearest neighbours (largest inner product) over robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of bounded size and similar norms. A shard's graph starts from random links; then its points are inserted again in
batches: a greedy search from the centre proposes neighbours, relaxed distance pruning (alpha) keeps diverse edges, reverse edges are
added and pruned likewise. Queries run a beam search in each shard and the shards' results are merged. Inner product becomes
Euclidean distance by one more component, sqrt(M^2 - |x|^2), M the shard's largest norm; queries have 0 there. All points of a
batch, and all queries of a block, advance in lock step, so the work is matrix work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, usable_vectors
from .vector_blocks import BLOCK, in_blocks, plain_block, search_blocks

#: Vectors of a shard, neighbours of a point, beam widths of building and searching, queries that advance together.
SHARD, DEGREE, BUILD_WIDTH, SEARCH_WIDTH, BATCH = 8192, 24, 48, 128, 256
#: Bands of norms to an octave: a shard's norms lie within 19 per cent, so that the added component doesn't drown the others.
BANDS = 4
GRAPH = "block int, ids binary, data binary, dim int, graph binary, start int, first binary"


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Greedy beam search of all queries in lock step: the `width` best points seen (ids, squared distances), nearest first; -1 pads.

    In each step every query opens its nearest point not opened yet; it ends when all points of its beam are opened. The third result is the
    number of distances computed, over all queries.
    """
    m, n = len(queries), len(x)
    norms = np.einsum("ij,ij->i", x, x)
    beam = np.full((m, width), -1, dtype=np.int64)
    far = np.full((m, width), np.inf, dtype=np.float32)
    opened = np.ones((m, width), dtype=bool)
    seen = np.zeros((m, n), dtype=bool)
    beam[:, 0], opened[:, 0] = start, False
    far[:, 0] = norms[start] - 2 * (queries @ x[start])
    seen[:, start] = True
    live = np.arange(m)
    while len(live):
        at = np.argmin(opened[live], axis=1)  # beams are sorted: the first unopened one is the nearest
        opened[live, at] = True
        near = graph[beam[live, at]]
        new = near >= 0
        rows = np.broadcast_to(live[:, None], near.shape)
        new[new] = ~seen[rows[new], near[new]]
        safe = np.where(new, near, 0)
        seen[rows[new], near[new]] = True
        d = norms[safe] - 2 * np.einsum("mrd,md->mr", x[safe], queries[live])
        d[~new] = np.inf
        ids = np.concatenate([beam[live], safe], axis=1)
        dist = np.concatenate([far[live], d], axis=1)
        done = np.concatenate([opened[live], ~new], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        beam[live], far[live], opened[live] = (np.take_along_axis(v, order, axis=1) for v in (ids, dist, done))
        live = live[~opened[live].all(axis=1)]
    beam[np.isinf(far)] = -1
    return beam, far + np.einsum("ij,ij->i", queries, queries)[:, None], int(seen.sum())


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point keep up to `degree` of its candidates (-1: none): the nearest one, then drop those that alpha * it is nearer to, again and again."""
    b, c = candidates.shape
    ok = (candidates >= 0) & (candidates != points[:, None])
    safe = np.where(ok, candidates, 0)
    v = x[safe]
    d = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    d[~ok] = np.inf
    kept = np.full((b, degree), -1, dtype=np.int32)
    rows = np.arange(b)
    alive = d.copy()
    for slot in range(degree):
        pick = np.argmin(alive, axis=1)
        some = np.isfinite(alive[rows, pick])
        if not some.any():
            break
        kept[some, slot] = safe[rows, pick][some]
        between = ((v - v[rows, pick][:, None, :]) ** 2).sum(axis=2)
        alive[(alpha * alpha * between <= d) | (safe == safe[rows, pick][:, None])] = np.inf
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, alpha: float = 1.2, batch: int = 512, passes: int = 1) -> tuple[np.ndarray, int]:
    """The graph as an array (points, degree) of neighbours, -1 where none, and the start point (the one nearest to the mean)."""
    n = len(x)
    rng = np.random.default_rng(n)
    start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    if n == 1:
        return np.full((1, degree), -1, dtype=np.int32), 0
    graph = rng.integers(0, n, size=(n, degree), dtype=np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    for _ in range(passes):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            points = order[a : a + batch]
            found, _, _ = beam_search(x, graph, start, x[points], width)
            graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1), degree, alpha)
            source = np.repeat(points, degree)
            target = graph[points].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            hit, first, number = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(hit), int(number.max(initial=1))), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(hit)), number), np.arange(len(target)) - np.repeat(first, number)] = source
            for b in range(0, len(hit), batch):
                own = hit[b : b + batch]
                wide = int(number[b : b + batch].max(initial=1))
                graph[own] = robust_prune(x, own, np.concatenate([graph[own], extra[b : b + batch, :wide]], axis=1), degree, alpha)
    return graph, start


def _lifted(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / (np.abs(matrix).max(initial=0.0) or 1.0)  # squares of very large or small components would leave the range of doubles
    norms = np.einsum("ij,ij->i", matrix, matrix)
    scale = np.sqrt(norms.max()) or 1.0
    last = np.sqrt(np.maximum(0.0, 1.0 - norms / scale**2))
    return np.concatenate([matrix / scale, last[:, None]], axis=1).astype(np.float32)


def _directions(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; a query's length changes no order."""
    matrix = matrix / np.maximum(np.abs(matrix).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return matrix / np.maximum(np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None], np.finfo(float).tiny)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision. Where a term or a sum leaves its range, the scaled product decides: a number, or an infinity of the right sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", a, b)
        odd = np.flatnonzero(~np.isfinite(out))
        if odd.size:
            p, q = (np.abs(m[odd]).max(axis=1, keepdims=True) for m in (a, b))
            out[odd] = np.einsum("ij,ij->i", a[odd] / p, b[odd] / q) * p[:, 0] * q[:, 0]
            out[np.isnan(out)] = 0.0  # terms that cancel exactly
    return out


def graph_block(ids: np.ndarray, matrix: np.ndarray, degree: int, width: int) -> pd.DataFrame:
    """The graph spans the distinct vectors: among equal ones pruning would keep a single edge. The ids are sorted by vector, then ascending;
    those of distinct vector i are ids[first[i] : first[i + 1]]."""
    distinct, which, number = np.unique(matrix + 0.0, axis=0, return_inverse=True, return_counts=True)  # + 0.0: -0.0 is 0.0
    ids = ids[np.lexsort((ids, which.ravel()))]
    first = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    graph, start = build_graph(_lifted(distinct), degree, width)
    return plain_block(ids, distinct).assign(graph=[graph.astype(np.int32).tobytes()], start=[np.int32(start)], first=[first.tobytes()])


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, shard: int = SHARD, query_block: int = 4096, degree: int = DEGREE, build_width: int = BUILD_WIDTH, width: int = SEARCH_WIDTH) -> DataFrame:
    """Each query's k nearest found, by inner product in double precision: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    Queries are the rows whose key is divisible by `every`; candidates are all rows but the query's own. Every usable row is indexed (see
    usable_vectors; zero vectors take no part). An empty table gives no rows; shards of at most `width` distinct vectors, which a beam
    holds whole, are searched whole. Any finite components will do: a score beyond the range of doubles is infinite, ties as above. Columns other
    than key and vector are not read, whatever their names.
    """
    vectors = usable_vectors(table, key, vector, zero_ok=False).select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    largest = F.array_max(F.transform("vector", F.abs))
    norm = F.log2(largest) + F.log2(F.aggregate("vector", F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))) / 2
    band = F.floor(BANDS * norm + 0.5).cast("int")
    index, shards = in_blocks(vectors, shard, lambda ids, m: graph_block(ids, m, degree, build_width), GRAPH, band)
    queries, query_blocks = in_blocks(vectors.where(F.col("vec_id") % every == 0), query_block, plain_block, BLOCK)

    def search(row: pd.Series, query_ids: np.ndarray, w: np.ndarray) -> tuple:
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        first = np.frombuffer(row["first"], dtype=np.int64)
        n = len(first) - 1
        x = np.frombuffer(row["data"]).reshape(n, -1)
        if n <= width:
            found = np.broadcast_to(np.arange(n), (len(w), n))
        else:
            graph = np.frombuffer(row["graph"], dtype=np.int32).reshape(n, degree)
            lifted = np.concatenate([_directions(w), np.zeros((len(w), 1))], axis=1).astype(np.float32)
            own = _lifted(x)
            found = np.concatenate([beam_search(own, graph, int(row["start"]), lifted[a : a + BATCH], width)[0] for a in range(0, len(w), BATCH)])
        q, at = np.nonzero(found >= 0)
        at = found[q, at]
        score = inner_products(x[at], w[q])
        # a found vector stands for its smallest ids, one more than k as the query itself may be among them
        number = np.minimum(first[at + 1] - first[at], k + 1)
        place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        q, score, own_ids = np.repeat(q, number), np.repeat(score, number), ids[np.repeat(first[at], number) + place]
        other = own_ids != query_ids[q]
        q, score, own_ids = q[other], score[other], own_ids[other]
        order = np.lexsort((own_ids, -score, q))
        q, own_ids, score = q[order], own_ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], own_ids[place < k], score[place < k]

    return search_blocks(saved(index, "graphs"), queries, query_blocks, shards, search, "double", k)
