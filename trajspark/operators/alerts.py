"""Runs, vote gates with cooldown, exposure: the causal alert operators, on streams keyed by trajectory_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds

MAX_LINK_US = 300_000_000
# Gates as (window points, votes) and cooldowns in seconds.
GATES = ((1, 1), (2, 2), (3, 3), (5, 5), (3, 2), (5, 3), (10, 5))
COOLDOWNS = (0, 60, 300)


def _w(*keys: str):
    return Window.partitionBy(*(keys or ("trajectory_id",))).orderBy("source_point_index")


def links(points: DataFrame, *keys: str) -> DataFrame:
    """linked: the next index, and later by at most 300 s, after the point before."""
    w = _w(*keys)
    gap = F.col("elapsed_us") - F.lag("elapsed_us").over(w)
    near = (F.col("source_point_index") - F.lag("source_point_index").over(w) == 1) & (gap > 0) & (gap <= MAX_LINK_US)
    return points.withColumns({"linked": F.coalesce(near, F.lit(False)), "gap_us": gap})


def positive_runs(points: DataFrame, flag: str = "predicted", *keys: str) -> DataFrame:
    """Longest chains of positive linked points: start, end, length and duration of each."""
    keys = keys or ("trajectory_id",)
    w = _w(*keys)
    p = links(points, *keys).withColumn("_on", F.coalesce(F.col(flag) == 1, F.lit(False)))
    start = F.col("_on") & ~(F.col("linked") & F.coalesce(F.lag("_on").over(w), F.lit(False)))
    p = p.withColumn("_run", F.sum(start.cast("int")).over(w)).where("_on")
    runs = p.groupBy(*keys, "_run").agg(F.min("source_point_index").alias("start_index"), F.max("source_point_index").alias("end_index"), F.count("*").alias("points"), ((F.max("elapsed_us") - F.min("elapsed_us")) / 1e6).alias("duration_s"))
    return runs.drop("_run")


def vote_gate(points: DataFrame, window: int, votes: int, flag: str = "predicted") -> DataFrame:
    """gate: at least `votes` positives among the last `window` points of a linked block; candidate: a gate run starts here."""
    w = _w()
    p = links(points).withColumn("_block", F.sum((~F.col("linked")).cast("int")).over(w))
    inner = Window.partitionBy("trajectory_id", "_block").orderBy("source_point_index")
    full = F.row_number().over(inner) >= window
    n = F.sum(flag).over(inner.rowsBetween(1 - window, 0))
    p = p.withColumns({"votes": n, "supported": full, "gate": full & (n >= votes)})
    before = F.coalesce(F.lag("gate").over(w), F.lit(False)) & F.col("linked")
    return p.withColumn("candidate", F.col("gate") & ~before).drop("_block")


def cooldown(gated: DataFrame, seconds: int) -> DataFrame:
    """Greedy cooldown: a candidate is emitted if the last emitted one is at least `seconds` ago; suppressed ones don't restart the clock.

    Only the candidates of a trajectory are folded, in order and without holding them. See folds.cooldown.
    """
    return folds.cooldown(gated.where("candidate"), seconds)


def exposure(points: DataFrame, *keys: str) -> DataFrame:
    """Seconds and number of linked intervals, and intervals that are no links."""
    keys = keys or ("trajectory_id",)
    p = links(points, *keys)
    return p.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("linked"), F.col("gap_us"))), F.lit(0)).alias("exposure_us"), F.count_if("linked").alias("linked_intervals"), F.count_if(~F.col("linked") & F.col("gap_us").isNotNull()).alias("excluded_intervals"))


def suppression_reason(gated: DataFrame, window: int, votes: int, flag: str = "predicted") -> DataFrame:
    reason = F.when(F.col("gate"), "").when(F.col(flag) == 0, "").when(~F.col("supported"), "warm_up").when(F.lit(window == votes), "insufficient_consecutive").otherwise("vote_requirement")
    return gated.withColumn("reason", reason)


