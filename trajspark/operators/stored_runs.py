"""Stored detector runs: fitted models, frozen thresholds and predictions partitioned by run, and the scan that checks them."""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.sources.scratch import saved

from . import audits, detectors, movement, reconstruction

SEEDS = (1, 2, 3, 4, 5)
RULE, FOREST, AUTOENCODER = "statistical_rule", "isolation_forest", "autoencoder"
#: The runs as (model, seed, number); the rule has no seed.
RUNS = ((RULE, None, 0), *[(FOREST, s, s) for s in SEEDS], *[(AUTOENCODER, s, 5 + s) for s in SEEDS])
#: Share of the validation-normal scores below a run's threshold.
SHARE = 0.95


class Models:
    """The fitted detectors as tables: the rule a row a feature, the forests' nodes with their seed, the autoencoders' parameters and history.

    Each is fitted when it is first asked for, so that who needs one waits for no other.
    """

    def __init__(self, train: DataFrame, validation: DataFrame, columns: list[str], seeds: tuple[int, ...] = SEEDS, trees: int = 200, epochs: int = reconstruction.EPOCHS, patience: int = reconstruction.PATIENCE):
        self._train, self._validation, self._columns, self._seeds, self._trees, self._epochs, self._patience = train, validation, columns, seeds, trees, epochs, patience

    @cached_property
    def _autoencoders(self) -> tuple[DataFrame, DataFrame]:
        parameters, history = reconstruction.fit(self._train, self._validation, self._columns, list(self._seeds), self._epochs, self._patience)
        return saved(parameters, "parameters"), saved(history, "history")

    @property
    def parameters(self) -> DataFrame:
        return self._autoencoders[0]

    @property
    def history(self) -> DataFrame:
        return self._autoencoders[1]

    @cached_property
    def rule(self) -> DataFrame:
        return saved(movement.statistical_rule(self._train, self._columns), "rule")

    @cached_property
    def forest(self) -> DataFrame:
        grown = [detectors.isolation_forest(self._train, self._columns, trees=self._trees, seed=s).withColumn("seed", F.lit(s)) for s in self._seeds]
        return saved(reduce(DataFrame.unionByName, grown), "forest")


def run_numbers(seeds: tuple[int, ...] = SEEDS) -> list[tuple[str, int | None, int]]:
    return [r for r in RUNS if r[1] is None or r[1] in seeds]


def with_scores(rows: DataFrame, models: Models, columns: list[str], seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Adds `scores`, each row's score under every run, in the order of run_numbers. A row passes through all learned detectors in one batch of Python."""
    nodes = models.forest.toPandas()  # at most trees * 2 * rows a seed
    forests = [detectors.forest_scorer(nodes[nodes["seed"] == s]) for s in seeds]
    parameters = reconstruction.read_parameters(models.parameters)
    coders = [parameters[s] for s in seeds]

    @F.arrow_udf("array<double>")
    def learned(*parts: pa.Array) -> pa.Array:
        x = np.column_stack([p.to_numpy(zero_copy_only=False).astype(float) for p in parts])
        found = [f(x) for f in forests] + [reconstruction.scaled_errors(*c, x) for c in coders]
        flat = pa.array(np.column_stack(found).ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(found)), flat)

    p = movement.rule_score(rows, models.rule, columns)
    return p.withColumn("scores", F.concat(F.array(F.col("rule_score").cast("double")), learned(*[F.col(c).cast("double") for c in columns]))).drop("rule_score")


def spread(rows: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """A row with `scores` once a run: model, seed, run and run_score."""
    runs = [F.struct(F.lit(m).alias("model"), F.lit(s).cast("int").alias("seed"), F.lit(k).alias("run"), F.col("scores")[i].alias("run_score")) for i, (m, s, k) in enumerate(run_numbers(seeds))]
    return rows.select(*[c for c in rows.columns if c != "scores"], F.inline(F.array(*runs)))


def scored(rows: DataFrame, models: Models, columns: list[str], seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Every row under every run: model, seed, run and run_score; a row with a null feature has no autoencoder scores."""
    return spread(with_scores(rows, models, columns, seeds), seeds)


def frozen_thresholds(validation_scores: DataFrame, share: float = SHARE) -> DataFrame:
    """(model, seed, run, threshold): the linear percentile of each run's validation-normal scores, saved before anything else is decided.

    No task holds a run's scores: see audits.percentiles.
    """
    names = validation_scores.select("model", "seed", "run").distinct()
    values = validation_scores.select("run", F.col("run_score").alias("value"))
    return saved(names.join(F.broadcast(audits.percentiles(values, (share,), "run")), "run", "left").select("model", "seed", "run", F.col("percentile").alias("threshold")), "thresholds")


def write_predictions(scores: DataFrame, thresholds: DataFrame, path: str) -> None:
    """Scores with their decisions (score > threshold; null without a score), one folder a model and seed. An existing store is never overwritten.

    Nothing is shuffled or sorted: a task holds one open file a run.
    """
    limits = thresholds.select("run", "threshold")
    decided = scores.join(F.broadcast(limits), "run").withColumn("predicted", (F.col("run_score") > F.col("threshold")).cast("int")).drop("threshold")  # a row a run
    conf, name = scores.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, str(2 * len(RUNS)))
    try:
        decided.write.mode("errorifexists").partitionBy("model", "seed").parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def scan(spark: SparkSession, path: str, thresholds: DataFrame, model: str | None = None, seed: int | None = None) -> DataFrame:
    """The stored predictions with their run's frozen threshold; naming a model or seed reads those folders alone."""
    p = spark.read.parquet(path)
    if model is not None:
        p = p.where(F.col("model") == model)
    if seed is not None:
        p = p.where(F.col("seed") == seed)
    return p.join(F.broadcast(thresholds.select("run", "threshold")), "run", "left")  # a row a run


def run_audit(predictions: DataFrame, key: tuple[str, ...] = ("trajectory_id", "source_point_index")) -> DataFrame:
    """Per run: points, positives, what contradicts the frozen threshold, repeated keys, keys that other runs have and it lacks, and its classes.

    Every run must score the same rows: a key's runs are counted, nothing is compared with a driver-side list.
    """
    wrong = ~F.col("predicted").eqNullSafe((F.col("run_score") > F.col("threshold")).cast("int")) | F.col("threshold").isNull()
    own = predictions.groupBy("model", "seed", "run", *key).agg(F.count("*").alias("n"), F.sum("predicted").alias("positives"), F.count_if(wrong).alias("wrong"), F.min("anomaly_label").alias("low"), F.max("anomaly_label").alias("high"))
    r = own.groupBy("model", "seed", "run").agg(
        F.sum("n").alias("points"), F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"), F.sum("wrong").alias("mismatches"), F.sum(F.col("n") - 1).alias("repeated"), F.count("*").alias("keys"),
        (F.min("low") == 0).alias("has_normal"), (F.max("high") == 1).alias("has_anomalous"),
    )
    every = own.select(*key).distinct().agg(F.count("*").alias("universe"))
    return r.join(F.broadcast(every), F.lit(True)).withColumn("missing", F.col("universe") - F.col("keys")).drop("universe", "keys")  # one row

