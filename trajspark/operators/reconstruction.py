"""The reconstruction detector: a small autoencoder trained by data-parallel gradient descent, and scored from a table of its parameters.

The rows stay where they are, packed in blocks and held in memory or on disk: every epoch is one job in which each task sums the gradients and losses of its
own blocks for all seeds together, and only the sums, PARAMETERS + 4 numbers a seed and task, reach the driver, which holds the weights and takes one step. The
tasks' sums are added exactly, so that they do not depend on the order of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.sources.scratch import saved

# The layers as (inputs, outputs); a rectifier stands behind all but the last.
LAYERS = ((8, 16), (16, 8), (8, 4), (4, 8), (8, 16), (16, 8))
PARAMETERS = sum(a * b + b for a, b in LAYERS)
EPOCHS, PATIENCE, RATE = 100, 15, 0.01
#: Rows of a block, and tasks a core of an epoch.
BLOCK, TASKS = 4096, 2
#: Indices of the sums beside the gradient's.
ROWS, LOSS, HELD_ROWS, HELD_LOSS = range(PARAMETERS, PARAMETERS + 4)
PARAMETER_SCHEMA = "seed int, part string, layer int, i int, j int, value double"
HISTORY_SCHEMA = "seed int, epoch int, train_loss double, validation_loss double, best_loss double, best_epoch int, patience int"


def initial(seed: int) -> np.ndarray:
    """Weights and biases drawn evenly within 1 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b + b) / np.sqrt(a) for a, b in LAYERS])


def layers(vector: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of each layer."""
    out, at = [], 0
    for a, b in LAYERS:
        out.append((vector[at : at + a * b].reshape(a, b), vector[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def rebuilt(vector: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """The rows and what each layer makes of them; the last entry is the rebuilt rows."""
    out = [x]
    for k, (w, b) in enumerate(layers(vector)):
        y = out[-1] @ w + b
        out.append(np.maximum(y, 0.0) if k < len(LAYERS) - 1 else y)
    return out


def errors(vector: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean squared error of each row."""
    return ((rebuilt(vector, x)[-1] - x) ** 2).mean(axis=1)


def gradient(vector: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of the rows' errors and its gradient."""
    return _block_gradient(layers(vector), np.ascontiguousarray(x.T))


def _forward(parts: list[tuple[np.ndarray, np.ndarray]], xt: np.ndarray) -> list[np.ndarray]:
    """`rebuilt` of rows that stand in columns."""
    out = [xt]
    for k, (w, b) in enumerate(parts):
        y = w.T @ out[-1]
        y += b[:, None]
        out.append(np.maximum(y, 0.0, out=y) if k < len(LAYERS) - 1 else y)
    return out


def _block_errors(parts: list[tuple[np.ndarray, np.ndarray]], xt: np.ndarray) -> float:
    d = _forward(parts, xt)[-1] - xt
    return float(np.vdot(d, d)) / len(xt)


def _block_gradient(parts: list[tuple[np.ndarray, np.ndarray]], xt: np.ndarray) -> tuple[float, np.ndarray]:
    values = _forward(parts, xt)
    d = values[-1] - xt
    back, out = d * (2.0 / len(xt)), []
    for k in reversed(range(len(parts))):
        out = [(values[k] @ back.T).ravel(), back.sum(axis=1), *out]
        if k:
            back = parts[k][0] @ back
            back *= values[k] > 0
    return float(np.vdot(d, d)) / len(xt), np.concatenate(out)


@dataclass
class Adam:
    """One seed's weights with the running moments of their gradient, the best weights and the epochs since."""

    weights: np.ndarray
    rate: float
    first: np.ndarray = field(default_factory=lambda: np.zeros(PARAMETERS))
    second: np.ndarray = field(default_factory=lambda: np.zeros(PARAMETERS))
    steps: int = 0
    best: np.ndarray | None = None
    best_loss: float = float("inf")
    best_epoch: int = 0

    def step(self, g: np.ndarray) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        self.weights = self.weights - self.rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)

    def judge(self, epoch: int, loss: float) -> int:
        """Keeps the weights of the smallest loss; the epochs since then."""
        if loss < self.best_loss:
            self.best, self.best_loss, self.best_epoch = self.weights, loss, epoch
        return epoch - self.best_epoch


def blocks(rows: DataFrame) -> DataFrame:
    """(held, x) as (held, n, x): n rows in one binary, column after column, at most BLOCK of them. An epoch reads blocks, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[np.ndarray]] = {False: [], True: []}

        def out(held: bool, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([len(x)], pa.int32()), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], ["held", "n", "x"])

        for batch in batches:
            mask = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, LAYERS[0][0])
            for held in (False, True):
                waiting[held].append(x[mask == held])
                if sum(map(len, waiting[held])) >= BLOCK:
                    own = np.concatenate(waiting[held])
                    whole = len(own) // BLOCK * BLOCK
                    for a in range(0, whole, BLOCK):
                        yield out(held, own[a : a + BLOCK])
                    waiting[held] = [own[whole:]]
        for held, parts in waiting.items():
            if sum(map(len, parts)):
                yield out(held, np.concatenate(parts))

    return rows.select("held", "x").mapInArrow(run, "held boolean, n int, x binary")


def epoch_sums(dealt: DataFrame, weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per seed: the gradient of the training rows' error and ROWS, LOSS, HELD_ROWS, HELD_LOSS, all as sums, from one pass over the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros(PARAMETERS + 4) for s in weights}
        parts = {s: layers(w) for s, w in weights.items()}
        for batch in batches:
            for held, n, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                xt = np.frombuffer(x).reshape(LAYERS[0][0], n)
                for s, total in sums.items():
                    if held:
                        total[HELD_ROWS:] += (n, _block_errors(parts[s], xt))
                    else:
                        loss, g = _block_gradient(parts[s], xt)
                        total[:PARAMETERS] += g
                        total[ROWS : LOSS + 1] += (n, loss)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["seed", "sums"])

    found: dict[int, list] = {s: [] for s in weights}
    for r in dealt.mapInArrow(run, "seed int, sums array<double>").collect():  # PARAMETERS + 4 numbers a seed and task
        found[r["seed"]].append(r["sums"])
    return {s: np.array([math.fsum(c) for c in zip(*own, strict=True)] or [0.0] * (PARAMETERS + 4)) for s, own in found.items()}


def _scaled(df: DataFrame, columns: list[str], mean: list[float], scale: list[float]) -> DataFrame:
    return df.select(*df.columns, F.array(*[(F.col(c).cast("double") - m) / s for c, m, s in zip(columns, mean, scale, strict=True)]).alias("x"))


def scaler(train: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each column; a constant one is divided by 1."""
    r = train.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    if not r["n"]:
        raise ValueError("no training rows")
    return [r[f"m_{c}"] for c in columns], [r[f"s_{c}"] or 1.0 for c in columns]


def fit(train: DataFrame, validation: DataFrame, columns: list[str], seeds: list[int], epochs: int = EPOCHS, patience: int = PATIENCE, rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """(parameters, history) of one autoencoder for each seed, trained on all rows of `train` and stopped by the loss on `validation`.

    Rows are scaled by the training rows' mean and population deviation and saved once, in blocks. An epoch takes one Adam step along the gradient over all training
    rows; its losses are those after the step. The weights of the smallest validation loss are kept; a seed ends after `patience` epochs without a
    smaller one, or after `epochs`. parameters: PARAMETER_SCHEMA, with the scaler as parts mean and scale. Without training or validation rows: ValueError. Rows
    with a null or non-finite feature take no part.
    """
    if len(columns) != LAYERS[0][0]:
        raise ValueError(f"{LAYERS[0][0]} columns expected")
    sound = lambda df: df.where(" and ".join(f"coalesce(abs(cast(`{c}` AS double)) < double('Infinity'), false)" for c in columns))
    train, validation = sound(train), sound(validation)
    mean, scale = scaler(train, columns)
    part = lambda df, held: _scaled(df.select(*columns), columns, mean, scale).select(F.lit(held).alias("held"), "x")
    rows = saved(blocks(part(train, False).unionByName(part(validation, True))), "matrix")
    dealt = rows.repartition(TASKS * train.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found, history = _descend(dealt, seeds, epochs, patience, rate)
    finally:
        dealt.unpersist()
    spark = train.sparkSession
    return parameter_table(spark, found, mean, scale), spark.createDataFrame(history, HISTORY_SCHEMA)


def _descend(rows: DataFrame, seeds: list[int], epochs: int, patience: int, rate: float) -> tuple[dict[int, np.ndarray], list[tuple]]:
    """Each seed's best weights and the history."""
    states = {s: Adam(initial(s), rate) for s in seeds}
    history: list[tuple] = []
    sums = epoch_sums(rows, {s: a.weights for s, a in states.items()})
    if not all(t[HELD_ROWS] for t in sums.values()):
        raise ValueError("no validation rows")
    live = list(seeds)
    for epoch in range(1, epochs + 1):
        for s in live:
            states[s].step(sums[s][:PARAMETERS] / sums[s][ROWS])
        sums = epoch_sums(rows, {s: states[s].weights for s in live})
        for s in list(live):
            t, a = sums[s], states[s]
            waited = a.judge(epoch, t[HELD_LOSS] / t[HELD_ROWS])
            history.append((s, epoch, float(t[LOSS] / t[ROWS]), float(t[HELD_LOSS] / t[HELD_ROWS]), float(a.best_loss), a.best_epoch, waited))
            if waited >= patience:
                live.remove(s)
        if not live:
            break
    return {s: a.best if a.best is not None else a.weights for s, a in states.items()}, history


def parameter_table(spark: SparkSession, weights: dict[int, np.ndarray], mean: list[float], scale: list[float]) -> DataFrame:
    rows: list[tuple] = []
    for s, vector in weights.items():
        rows += [(s, name, None, i, None, float(v)) for name, values in (("mean", mean), ("scale", scale)) for i, v in enumerate(values)]
        for k, (w, b) in enumerate(layers(vector)):
            rows += [(s, "weight", k, i, j, float(v)) for (i, j), v in np.ndenumerate(w)] + [(s, "bias", k, None, j, float(v)) for j, v in enumerate(b)]
    return spark.createDataFrame(rows, PARAMETER_SCHEMA)


def read_parameters(table: DataFrame) -> dict[int, tuple[np.ndarray, list[float], list[float]]]:
    """seed -> (weights, mean, scale) of a parameter table; a fixed number of rows a seed. Raises where some are missing or stand twice."""
    out: dict[int, tuple[np.ndarray, list[float], list[float]]] = {}
    frame = table.toPandas()
    for s, own in frame.groupby("seed"):
        at, found = 0, np.full(PARAMETERS, np.nan)
        for k, (a, b) in enumerate(LAYERS):
            w, c = (own[(own["part"] == p) & (own["layer"] == k)] for p in ("weight", "bias"))
            found[(at + w["i"] * b + w["j"]).astype(int)] = w["value"]
            found[(at + a * b + c["j"]).astype(int)] = c["value"]
            at += a * b + b
        rest = [own[own["part"] == p].sort_values("i")["value"].tolist() for p in ("mean", "scale")]
        if np.isnan(found).any() or len(own) != PARAMETERS + 2 * LAYERS[0][0] or any(len(r) != LAYERS[0][0] for r in rest):
            raise ValueError(f"the parameters of seed {s} are not complete")
        out[int(s)] = (found, rest[0], rest[1])
    return out


def scaled_errors(weights: np.ndarray, mean: list[float], scale: list[float], x: np.ndarray) -> np.ndarray:
    """Mean squared error of rebuilding each row, scaled; NaN where a value is NaN."""
    parts, out = layers(weights), np.empty(len(x))
    for a in range(0, len(x), BLOCK):
        xt = np.ascontiguousarray(((x[a : a + BLOCK] - np.array(mean)) / np.array(scale)).T)
        out[a : a + BLOCK] = ((_forward(parts, xt)[-1] - xt) ** 2).mean(axis=0)
    return out


def with_errors(df: DataFrame, table: DataFrame, columns: list[str], to: str = "reconstruction") -> DataFrame:
    """Adds `to`, an array of struct(seed, score): each seed's mean squared error of rebuilding the scaled row, in batches of rows. Null features give null."""
    models = read_parameters(table)

    @F.pandas_udf("array<struct<seed:int,score:double>>")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = part.to_numpy(dtype=float)
            found = {s: errors(w, (x - np.array(mean)) / np.array(scale)) for s, (w, mean, scale) in models.items()}
            yield pd.Series([[{"seed": s, "score": None if np.isnan(e[k]) else float(e[k])} for s, e in found.items()] for k in range(len(x))], dtype=object)

    return df.withColumn(to, score(F.struct(*[F.col(c).cast("double") for c in columns])))
