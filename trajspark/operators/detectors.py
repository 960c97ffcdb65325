"""Detectors that built-in expressions can't express: isolation forest, reconstruction error and Fréchet distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that go down a tree together.
CHUNK = 4096


def isolation_forest(train: DataFrame, columns: list[str], trees: int = 200, rows: int = 256, seed: int = 42) -> DataFrame:
    """(tree, node, feature, cut, size): each tree is grown in its own task from `rows` rows drawn by hash.

    A row draws its trees from its hash: half as many again as are needed in all are drawn, so that the rows on their way to the trees stay about
    1.5 * trees * rows however many there are; a tree keeps the `rows` ones of smallest hash. Up to 4 * rows rows all go to all trees.
    """
    keys = train.select(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("x"), F.xxhash64(*columns, "trajectory_id", "source_point_index", F.lit(seed)).alias("h"))
    n = train.count()
    if n <= 4 * rows:
        drawn = keys.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    else:
        wanted = 1.5 * trees * rows / n  # trees of a row on average
        even = F.pmod(F.xxhash64("h", F.lit("some")), F.lit(1_000_000)) / 1e6
        number = (F.floor(F.lit(wanted)) + (even < wanted % 1).cast("int")).cast("int")
        some = keys.withColumn("number", number).where("number > 0")
        drawn = some.withColumn("tree", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("number")), lambda j: F.pmod(F.xxhash64("h", j), F.lit(trees)).cast("int")))))
    drawn = drawn.withColumn("k", F.xxhash64("h", "tree", F.lit(seed)))
    w = Window.partitionBy("tree").orderBy("k")
    drawn = drawn.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).select("tree", "x.*")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        x = pdf[columns].to_numpy(dtype=float)
        limit, out = int(np.ceil(np.log2(max(2, rows)))), []
        stack = [(1, x, 0)]
        while stack:
            node, part, depth = stack.pop()
            spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
            if depth >= limit or not len(spread):
                out.append((key[0], node, -1, 0.0, len(part)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            out.append((key[0], node, f, cut, len(part)))
            stack += [(2 * node, part[part[:, f] < cut], depth + 1), (2 * node + 1, part[part[:, f] >= cut], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])

    return drawn.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, cut double, size long")


def _path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, model: DataFrame, columns: list[str], rows: int = 256, to: str = "isolation_score") -> DataFrame:
    """Adds `to`, isolation_score in (0, 1), higher for rows that few cuts part from the rest. The model has at most trees * 2 * rows nodes."""
    scores = forest_scorer(model.toPandas(), rows)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(scores(part.to_numpy(dtype=float)))

    return df.withColumn(to, score(F.struct(*columns)))


def forest_scorer(nodes: pd.DataFrame, rows: int = 256) -> Callable[[np.ndarray], np.ndarray]:
    """A function from rows (a NaN goes left) to scores of the forest of these nodes.

    Trees are filled up to even depth, below a leaf with the leaf itself, so that all rows of a chunk go down a tree in step, without asking who has arrived.
    """
    trees = []
    for _, t in nodes.groupby("tree"):
        depth = int(np.log2(t["node"].max()))
        size = 2 ** (depth + 1)
        feature, cut, length = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = t["node"].to_numpy()
        feature[at], cut[at] = t["feature"], t["cut"]
        length[at] = np.floor(np.log2(at)) + _path(t["size"].to_numpy())
        inner = feature >= 0
        for k in range(2, size):  # parents come first
            if not inner[k // 2]:
                length[k] = length[k // 2]
        trees.append((depth, np.maximum(feature, 0), cut, length))
    norm = float(_path(np.array([rows]))[0])

    def paths(x: np.ndarray) -> np.ndarray:
        n = len(x)
        flat, row, total = np.ascontiguousarray(x.T).ravel(), np.arange(n), np.zeros(n)
        at, where, value, limit = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n)
        for depth, feature, cut, length in trees:
            at.fill(1)
            first = feature * n
            for _ in range(depth):
                np.take(first, at, out=where, mode="clip")
                np.add(where, row, out=where)
                np.take(flat, where, out=value, mode="clip")
                np.take(cut, at, out=limit, mode="clip")
                at *= 2
                at += value >= limit
            total += length[at]
        return total

    def scores(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([paths(x[a : a + CHUNK]) for a in range(0, len(x), CHUNK)] or [np.zeros(0)])
        return 2.0 ** (-total / max(1, len(trees)) / norm)

    return scores


def linear_reconstruction(train: DataFrame, columns: list[str], rank: int) -> dict:
    """Mean, scale and leading directions from one aggregate of moments: a linear autoencoder solved in closed form."""
    moments = [F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in columns for b in columns]]
    r = train.agg(*moments).collect()[0]
    mean = np.array([r[f"m_{c}"] or 0.0 for c in columns])
    cov = np.array([[r[f"c_{a}_{b}"] or 0.0 for b in columns] for a in columns])
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    _, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    return {"mean": mean.tolist(), "scale": scale.tolist(), "directions": vectors[:, ::-1][:, :rank].T.tolist()}


def reconstruction_scores(df: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """Mean squared error of rebuilding the scaled row from the leading directions; plain expressions."""
    z = [(F.col(c) - m) / s for c, m, s in zip(columns, model["mean"], model["scale"], strict=True)]
    codes = [sum((v * x for v, x in zip(d, z, strict=True)), F.lit(0.0)) for d in model["directions"]]
    errors = [F.pow(x - sum((c * d[i] for c, d in zip(codes, model["directions"], strict=True)), F.lit(0.0)), F.lit(2.0)) for i, x in enumerate(z)]
    return df.withColumn("reconstruction_error", sum(errors, F.lit(0.0)) / len(columns))


def frechet_within(a: np.ndarray, b: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discrete Fréchet distances as far as they may be no larger than `best`, and the cells computed; pairs in lock step, row by row.

    No path leaves a row for less than the row's smallest value, so a pair whose row exceeds its best is given up: its distance is NaN. Others are exact,
    also where they end above their best.
    """
    n, width = len(a), a.shape[1]
    out, cells = np.full(n, np.nan), np.zeros(n, dtype=np.int64)
    live, before = np.arange(n), np.zeros((n, 0))
    for i in range(width):
        row = np.sqrt(((a[live, i, None, :] - b[live]) ** 2).sum(axis=2))
        cells[live] += width
        if i == 0:
            row = np.maximum.accumulate(row, axis=1)
        else:
            reach = np.minimum(before[:, 1:], before[:, :-1])
            row[:, 0] = np.maximum(row[:, 0], before[:, 0])
            for j in range(1, width):
                row[:, j] = np.maximum(row[:, j], np.minimum(reach[:, j - 1], row[:, j - 1]))
        keep = row.min(axis=1) <= best[live]
        live, before = live[keep], row[keep]
        if not len(live):
            return out, cells
    out[live] = before[:, -1]
    return out, cells


def frechet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Discrete Fréchet distances of many pairs of equally long windows, (pairs, points, dims) each, in lock step."""
    d = np.sqrt(((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(axis=3))
    reach = d.copy()
    for i in range(d.shape[1]):
        for j in range(d.shape[2]):
            before = [reach[:, p, q] for p, q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p >= 0 and q >= 0]
            if before:
                reach[:, i, j] = np.maximum(d[:, i, j], np.minimum.reduce(before))
    return reach[:, -1, -1]
