"""Where the queries of the trajectory operators and their SQL are entered, and the derived tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajspark.operators import datasets, movement
from trajspark.sources.gps import gps_points
from trajspark.sources.scratch import saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def long_counts(text: str) -> str:
    """count_if as BIGINT, the type Spark gives it, and 0 where there is nothing but nulls."""
    out, at = "", 0
    while (i := text.find("count_if(", at)) >= 0:
        depth, end = 1, i + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out, at = f"{out}{text[at:i]}CAST(coalesce({text[i:end]}, 0) AS BIGINT)", end
    return out + text[at:]


def register(name: str, base: str = "", select: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if select:
            SQL[name] = long_counts(f"WITH {'RECURSIVE ' * recursive}{base}\n{select}")
        return f

    return add


def once(f: Query) -> Query:
    """f's table is saved once a session and folder of tables, for the queries that share it; the tables must not change in between."""
    held: dict[tuple[str, str], DataFrame] = {}

    def kept(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d)
        if key not in held:
            held[key] = saved(f(spark, d), f.__name__.strip("_"))
        return held[key]

    return kept


def features(spark: SparkSession, d: str) -> DataFrame:
    return movement.movement_features(gps_points(spark, d))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return movement.quality_flags(features(spark, d))


def split_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Flagged points with the split of their user."""
    p = flagged(spark, d)
    return p.join(datasets.user_splits(gps_points(spark, d)), "user_id")  # adaptive execution broadcasts the users while they are few


def copies(spark: SparkSession, d: str) -> DataFrame:
    """Injected copies of the trajectories of validation and test users, featured and flagged anew."""
    return datasets.injected(split_flagged(spark, d).where("dataset_split <> 'train'"))
