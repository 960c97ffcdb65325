"""Joins that are complete or fail, and guards that raise inside the job: nothing is counted on the driver first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(keys: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})


def exact_join(left: DataFrame, right: DataFrame, keys: list[str], whole_right: bool = False, one_to_one: bool = False) -> DataFrame:
    """left with the columns of the one right row of equal keys. The job fails with the key in its message where a left row has none or several.

    whole_right: where a right row is not used, too. one_to_one: where several left rows share a right one, too. Null keys match nothing, so they fail as
    left rows and, with whole_right, as right rows. Both sides meet in one shuffle by the keys; the right side's other columns need names of their own.
    """
    rest = [c for c in right.columns if c not in keys]
    clash = set(rest) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    r = right.groupBy(*keys).agg(F.count("*").alias("_several"), F.first(F.struct(F.lit(1).alias("_one"), *rest)).alias("_right"))
    if one_to_one:
        left_side = left.groupBy(*keys).agg(F.count("*").alias("_shared"), F.first(F.struct(F.lit(1).alias("_one"), *[c for c in left.columns if c not in keys])).alias("_left"))
    else:
        left_side = left.withColumn("_shared", F.lit(1)).withColumn("_left", F.struct(F.lit(1).alias("_one"), *[c for c in left.columns if c not in keys]))
        left_side = left_side.select(*keys, "_shared", "_left")
    j = left_side.join(r, keys, "full" if whole_right else "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(f"{text} "), _named(keys)))
    sound = F.when(F.col("_left").isNull(), fail("no left row uses")).when(F.col("_right").isNull(), fail("no right row for")).when(F.col("_several") > 1, fail("several right rows for")).when(F.col("_shared") > 1, fail("several left rows for")).otherwise(F.lit(True))
    j = j.where(sound.cast("boolean"))
    return j.select(*[F.col(f"_left.{c}") if c not in keys else F.col(c) for c in left.columns], *[F.col(f"_right.{c}") for c in rest])


def attach_scores(evaluation: DataFrame, scores: DataFrame, keys: list[str], identity: list[str], tolerance: float = 0.0) -> DataFrame:
    """Every evaluation row with its score row: exact_join by keys, and the job fails where a column of `identity`, which both have, differs.

    Numbers may differ by `tolerance`, null equals null. The identity columns come from the evaluation side.
    """
    taken = scores.select(*[F.col(c).alias(f"_seen_{c}") if c in identity else F.col(c) for c in scores.columns])
    j = exact_join(evaluation, taken, keys)
    kinds = dict(evaluation.dtypes)

    def same(c: str) -> Column:
        a, b = F.col(c), F.col(f"_seen_{c}")
        near = a.eqNullSafe(b)
        return near | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) if kinds[c] in ("double", "float") else near

    all_same = reduce(lambda x, y: x & y, [same(c) for c in identity])
    sound = F.when(all_same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("scored as another row: "), _named(keys))).cast("boolean"))
    return j.where(sound).drop(*[f"_seen_{c}" for c in identity])


def guarded(df: DataFrame, violations: DataFrame) -> DataFrame:
    """df, or a failing job: violations is one row of counts, and every one must be 0 (null counts as a violation); they stand in the message.

    The row is a branch of a union that gives no rows or raises, so that it is looked at even where df is empty, and no join is needed.
    """
    bad = reduce(lambda x, y: x | y, [F.coalesce(F.col(c) != 0, F.lit(True)) for c in violations.columns])
    text = F.concat(F.lit("violations: "), F.to_json(F.struct(*violations.columns)))
    none = violations.where(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(False)))
    return none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).union(df)
