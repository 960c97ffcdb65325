"""Vectors in blocks: each row holds up to a few thousand vectors as one binary matrix, so that a stated query set meets all rows block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "block int, ids binary, data binary, dim int"
#: Index blocks that one task holds together with one query block.
TOGETHER = 8


def in_blocks(vectors: DataFrame, size: int, build: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, apart: Column | None = None) -> tuple[DataFrame, int]:
    """Deal (vec_id, vector) by hash to about count / size blocks and reduce each one with build(ids, matrix); also the number of blocks.

    Rows of different values of `apart`, a whole number of few values, never share a block.
    """
    rows = vectors.withColumn("apart", (F.lit(0) if apart is None else apart).cast("int"))
    numbers = rows.groupBy("apart").agg(F.ceil(F.count("*") / size).cast("int").alias("n")).orderBy("apart").collect()
    first, blocks = {}, 0
    for r in numbers:
        first[r["apart"]] = (blocks, r["n"])
        blocks += r["n"]
    if not first:
        first, blocks = {0: (0, 1)}, 1

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        out = build(rows["vec_id"].to_numpy(dtype=np.int64), np.stack(rows["vector"].to_numpy()).astype(np.float64))
        return out.assign(block=np.int32(key[0]))

    keys = F.lit(list(first))
    start, number = (F.element_at(F.lit([v[i] for v in first.values()]), F.array_position(keys, F.col("apart")).cast("int")) for i in (0, 1))
    dealt = rows.withColumn("block", (start + F.pmod(F.xxhash64("vec_id"), number)).cast("int")).select("vec_id", "vector", "block")
    return dealt.groupBy("block").applyInPandas(pack, schema), blocks


def plain_block(ids: np.ndarray, matrix: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"ids": [ids.tobytes()], "data": [matrix.tobytes()], "dim": [np.int32(matrix.shape[1])]})


def _best_of(rows: list[tuple], k: int) -> tuple:
    """The k best of each query among (query row numbers, candidate ids, scores) of several searches, ties to the smaller id."""
    q, vec, score = (np.concatenate([r[i] for r in rows]) for i in range(3))
    order = np.lexsort((vec, -score, q))
    q, vec, score = q[order], vec[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], vec[first], score[first]


def search_blocks(index: DataFrame, queries: DataFrame, query_blocks: int, index_blocks: int, search: Callable[[pd.Series, np.ndarray, np.ndarray], tuple], score: str, k: int) -> DataFrame:
    """Meet every index block with every query block and keep each query's k best.

    search(index_row, query_ids, query_matrix) returns (query row numbers, candidate ids, scores). TOGETHER index blocks meet one query block in
    a task, which is all that the task holds; of each such group only the k best of a query come out. Through the shuffle go the index once
    for each query block and the queries once for each group, so both kinds of block are thousands of vectors.
    """
    groups = -(-index_blocks // TOGETHER)
    left = index.withColumn("g", F.pmod("block", F.lit(groups))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumnRenamed("block", "q").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(blocks: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        best, ids = None, np.zeros(0, dtype=np.int64)
        for _, own in query.iterrows():  # one row, none where the query block is empty
            ids = np.frombuffer(own["ids"], dtype=np.int64)
            matrix = np.frombuffer(own["data"]).reshape(len(ids), int(own["dim"]))
            for _, row in blocks.sort_values("block").iterrows():
                found = search(row, ids, matrix)
                best = _best_of([found] if best is None else [best, found], k)
        if best is None:
            return pd.DataFrame({"query_id": ids[:0], "vec_id": ids[:0], "score": ids[:0]})
        return pd.DataFrame({"query_id": ids[best[0]], "vec_id": best[1], "score": best[2]})

    found = left.groupBy("q", "g").cogroup(right.groupBy("q", "g")).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
