"""Operator 5: exact top-k inner products by no-random-access aggregation (NRA).

Per block of candidates, every component has a list of the candidates sorted by its value; a query reads a list from the top where its
weight is positive and from the bottom where it is negative. After each read depth a candidate's lower bound takes the worst value of
the component for what was not read yet, the upper bound takes the value at the reading position. Reading stops once the candidates
whose upper bound reaches the k-th lower bound are few against the rest; the scores of these are then resolved. At full depth both
bounds are the score, so the answer is exact whatever the data.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, usable_vectors
from .vector_blocks import BLOCK, in_blocks, plain_block, search_blocks

#: Read depths as shares of a list; the last one reads everything.
DEPTHS = (0.125, 0.4, 1.0)
#: Reading stops when at most this share of a block's candidates can still qualify.
FEW = 0.02
#: Queries that read the lists together.
BATCH = 256
#: Vectors with a component of this size or more stand in blocks of their own, so that only these need whole numbers without bound.
LARGE = 2.0**19
#: Scores are whole 64-bit numbers; what lies beyond counts as one of these.
LOWEST, HIGHEST = -(2**63 - 1), 2**63 - 1


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Lists:
    """The sorted lists of a block of candidates: list j holds the candidates by their component j, ascending."""

    def __init__(self, x: np.ndarray) -> None:
        order = np.argsort(x, axis=0, kind="stable")
        self.by_value = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty(x.shape, dtype=np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)


def nra(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, w: np.ndarray, k: int, cells: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query row of w among the rows of x (integers): (query row, id, score), exact.

    `cells`, if given, gets the list cells read, counted for each query: a depth step reads, and adds to the lower bounds, only the cells
    between its depth and the one before.
    """
    n, dim = x.shape
    bound = float(np.abs(x).max(initial=0.0)) * float(np.abs(w).max(initial=0.0)) * dim
    kind = np.float32 if bound < 2**22 else np.float64 if bound < 2**51 else object
    x, w = x.astype(kind), w.astype(kind)
    if kind is object:  # sums beyond 2**51: whole numbers of Python
        x, w = np.vectorize(int, otypes=[object])(x), np.vectorize(int, otypes=[object])(w)
        bound = int(np.abs(x).max(initial=0)) * int(np.abs(w).max(initial=0)) * dim
    lists = Lists(x)
    parts = [_nra(ids, x, lists, query_ids[a : a + BATCH], w[a : a + BATCH], k, bound, cells) for a in range(0, len(w), BATCH)]
    empty = np.zeros(0, dtype=np.int64)
    out = [[p[0] + a for p, a in zip(parts, range(0, len(w), BATCH), strict=True)], [p[1] for p in parts], [p[2] for p in parts]]
    return tuple(np.concatenate(v) if v else empty for v in out)  # type: ignore[return-value]


def _nra(ids: np.ndarray, x: np.ndarray, lists: Lists, query_ids: np.ndarray, w: np.ndarray, k: int, bound: float | int, cells: list[int] | None) -> tuple:
    n = len(x)
    by_value, rank = lists.by_value, lists.rank
    up, down = np.where(w > 0, w, 0), np.where(w < 0, w, 0)
    own = ids[None, :] == query_ids[:, None]
    keep = min(k, n)
    out_q, out_id, out_s = [], [], []
    left = np.arange(len(w))
    # lower bounds, one row a candidate: at first of all lists the value at the end that is read last, then what is read beyond it
    lower = np.tile(up @ by_value[0] + down @ by_value[-1], (n, 1))
    before = 0
    for share in DEPTHS:
        depth = n if share == 1.0 else max(1, int(n * share))
        u, d = up[left], down[left]
        top, bottom = rank >= n - depth, rank < depth
        lower += np.where(top & (rank < n - before), x - by_value[0], 0) @ u.T  # the cells between the depths; the others are not read again
        lower += np.where(bottom & (rank >= before), x - by_value[-1], 0) @ d.T
        if cells is not None:
            cells.append(int((w[left] != 0).sum()) * (depth - before))
        before = depth
        slack_up, slack_down = u * (by_value[n - depth] - by_value[0]), d * (by_value[depth - 1] - by_value[-1])
        # what the unread lists may still add: the value at the reading position against the worst one
        gap = (slack_up.sum(axis=1) + slack_down.sum(axis=1))[None, :] - top.astype(x.dtype) @ slack_up.T - bottom.astype(x.dtype) @ slack_down.T
        lower[own[left].T] = -2 * bound - 1  # a query's own row never competes; without it fewer than k may stand
        floor = _kth(lower.T, keep)
        if floor.dtype == object:  # candidates that differ only beyond the range of a score are ties
            floor = np.array([-np.inf if f <= LOWEST else min(f, HIGHEST) for f in floor], dtype=object)
        open_ = (lower + gap >= floor[None, :]).T & ~own[left]
        done = (open_.sum(axis=1) <= max(4 * k, FEW * n)) | (depth == n)
        for row, q in zip(np.flatnonzero(done), left[done], strict=True):
            at = np.flatnonzero(open_[row])
            score = x[at] @ w[q]  # resolves the scores of those that may qualify
            if score.dtype == object:
                score = np.array([min(max(s, LOWEST), HIGHEST) for s in score], dtype=object)
            best = np.lexsort((ids[at], -score))[:k]
            out_q.append(np.full(len(best), q))
            out_id.append(ids[at][best])
            out_s.append(score[best].astype(np.int64))
        left, lower = left[~done], lower[:, ~done]
        if not len(left):
            break
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(v) if v else empty for v in (out_q, out_id, out_s))


def top_k(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, every: int = 20, k: int = 20, block: int = 4096, query_block: int = 4096) -> DataFrame:
    """Each query's k highest integer inner products: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    Components become floor(scale * x). Queries are the rows whose key is divisible by `every`; candidates are all rows but the query's
    own. See usable_vectors for nulls, repeated keys and odd lengths; an empty table gives no rows. All candidates are searched, in
    blocks; a block and the bounds of a query block against it are all that a task holds. Any finite components will do: scale * x beyond the
    range of doubles counts as the last double, a score beyond 64 bits as LOWEST or HIGHEST (ties by vec_id). Columns other than
    key and vector are not read, whatever their names.
    """
    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x.cast("double") * scale, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(y) >= 2.0**53, y).otherwise(F.floor(y).cast("double"))  # from there on every double is whole, and may exceed a bigint

    vectors = usable_vectors(table, key, vector).select("vec_id", F.transform("vector", whole).alias("vector"))
    large = F.exists("vector", lambda x: F.abs(x) >= LARGE).cast("int")
    index, blocks = in_blocks(vectors, block, plain_block, BLOCK, large)
    queries, query_blocks = in_blocks(vectors.where(F.col("vec_id") % every == 0), query_block, plain_block, BLOCK, large)

    def search(row: pd.Series, query_ids: np.ndarray, w: np.ndarray) -> tuple:
        ids = np.frombuffer(row["ids"], dtype=np.int64)
        return nra(ids, np.frombuffer(row["data"]).reshape(len(ids), -1), query_ids, w, k)

    return search_blocks(saved(index, "lists"), queries, query_blocks, blocks, search, "long", k)
