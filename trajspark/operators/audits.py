"""Audits of points against their neighbours and of scores against a reference: residuals, segments with context, mid-ranks, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.sources.scratch import saved

#: Ranges that distinct values are dealt into before they are ranked.
RANGES = 200
#: Ranks on either side of a percentile that are put in order, as a share, and the values that a group has at least for that.
BRACKET, BRACKETED = 0.002, 2000


def _w():
    return Window.partitionBy("trajectory_id").orderBy("source_point_index")


def neighbour_distances(points: DataFrame) -> DataFrame:
    """previous_m, next_m: metres to the neighbours in the whole trajectory; null at its ends."""
    w = _w()
    to = lambda f: geo.haversine(F.col("latitude"), F.col("longitude"), f("latitude").over(w), f("longitude").over(w))
    return points.withColumns({"previous_m": to(F.lag), "next_m": to(F.lead)})


def interpolation_residual(flagged: DataFrame) -> DataFrame:
    """residual_m of the middle of each triplet without low-quality points: metres to the place that time-linear interpolation gives.

    Longitudes are unwrapped across the antimeridian. stationary: middle and last point moved at most 3 m at no more than 0.5 m/s.
    """
    w = _w()
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    share = (F.col("elapsed_us") - before("elapsed_us")) / (after("elapsed_us") - before("elapsed_us"))
    turn = F.pmod(after("longitude") - before("longitude") + 180.0, F.lit(360.0)) - 180.0
    lat = before("latitude") + share * (after("latitude") - before("latitude"))
    still = (F.col("distance") <= 3) & (after("distance") <= 3) & (F.col("speed") <= 0.5) & (after("speed") <= 0.5)
    sound = ~F.col("is_low_quality") & ~before("is_low_quality") & ~after("is_low_quality")
    p = flagged.withColumns({"residual_m": geo.haversine(F.col("latitude"), F.col("longitude"), lat, before("longitude") + share * turn), "stationary": still, "_sound": sound})
    return p.where("_sound").drop("_sound")


def segments_with_context(points: DataFrame, label: str = "anomaly_label") -> DataFrame:
    """Rows of each run of labelled points and the one before and after it; a point between two runs stands in both."""
    w = _w()
    on = F.coalesce(F.col(label) == 1, F.lit(False))
    p = points.withColumn("_on", on).withColumns({"_was": F.coalesce(F.lag("_on").over(w), F.lit(False)), "_will": F.coalesce(F.lead("_on").over(w), F.lit(False))})
    p = p.withColumn("_run", F.sum((F.col("_on") & ~F.col("_was")).cast("int")).over(w))
    part = lambda when, run, name: F.when(when, F.struct(run.alias("segment"), F.lit(name).alias("part")))
    parts = F.array_compact(F.array(part(F.col("_on"), F.col("_run"), "inside"), part(~F.col("_on") & F.col("_was"), F.col("_run"), "after"), part(~F.col("_on") & F.col("_will"), F.col("_run") + 1, "before")))
    return p.select(*points.columns, F.inline(parts))


def sums_below(values: DataFrame, columns: tuple[str, ...], *keys: str) -> DataFrame:
    """Per group of keys (there are few) and distinct value: the sum of each column, and as <column>_below that of smaller values, exactly.

    Distinct values are dealt into ranges by approximate quantiles, every group into its own, and summed within each; only the ranges' totals meet in one
    task. Quantiles of many values may come out otherwise when they are computed once more, so the values are saved with their ranges: both sums read the same.
    """
    h = values.groupBy(*keys, "value").agg(*[F.sum(c).alias(c) for c in columns])
    cuts = h.groupBy(*keys).agg(F.percentile_approx("value", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])).alias("cuts"))
    h = h.join(F.broadcast(cuts), list(keys) if keys else F.lit(True))  # a row a group
    h = saved(h.withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts"), "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = h.groupBy(*keys, "part").agg(*[F.sum(c).alias(c) for c in columns])
    parts = parts.select(*keys, "part", *[F.sum(c).over(before(Window.partitionBy(*keys).orderBy("part"))).alias(f"_{c}_base") for c in columns])
    out = h.withColumns({f"_{c}_inner": F.sum(c).over(before(Window.partitionBy(*keys, "part").orderBy("value"))) for c in columns})
    out = out.join(F.broadcast(parts), [*keys, "part"])  # at most RANGES rows a group
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*keys, "value", *columns, *[(z(f"_{c}_inner") + z(f"_{c}_base")).alias(f"{c}_below") for c in columns])


def counts_below(values: DataFrame) -> DataFrame:
    """(value, n) -> per distinct value: n and `below`, the sum of n of smaller values, exactly. See sums_below."""
    return sums_below(values, ("n",)).withColumnRenamed("n_below", "below")


def percentiles(values: DataFrame, shares: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, share, percentile): the linear percentile of the non-null values of each group, as F.percentile gives it, without holding a group's values.

    Approximate quantiles bracket each percentile (they are off by a ten-thousandth of the ranks, the bracket reaches BRACKET); the values below are counted,
    and only those within are put in order, equal ones as one. Groups of fewer than BRACKETED values are taken whole.
    """
    rows = values.where("value is not null").select(*keys, "value")
    edges = [x for s in shares for x in (max(0.0, s - BRACKET), min(1.0, s + BRACKET))]
    few = F.col("_total") < BRACKETED
    side = lambda s, k, outer: F.when(~few & F.lit(not outer), F.col("_q")[k])  # noqa: E731  null: no bound
    each = F.array(*[F.struct(F.lit(s).alias("share"), side(s, 2 * i, s <= BRACKET).alias("_low"), side(s, 2 * i + 1, s >= 1 - BRACKET).alias("_high")) for i, s in enumerate(shares)])
    brackets = rows.groupBy(*keys).agg(F.count("*").alias("_total"), F.percentile_approx("value", F.array(*map(F.lit, edges)), F.lit(10_000)).alias("_q"))
    brackets = saved(brackets.where("_total > 0").select(*keys, "_total", F.inline(each)), "brackets")  # all passes must use the same
    j = rows.join(F.broadcast(brackets), list(keys) if keys else F.lit(True))  # a row a group and share
    under, over = F.coalesce(F.col("value") < F.col("_low"), F.lit(False)), F.coalesce(F.col("value") > F.col("_high"), F.lit(False))
    group = [*keys, "share", "_total"]
    steps = j.where(~over).select(*group, F.when(~under, F.col("value")).alias("value")).groupBy(*group, "value").agg(F.count("*").alias("n"))  # null: what lies below
    w = Window.partitionBy(*group).orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("_upto", F.sum("n").over(w))
    at = F.col("share") * (F.col("_total") - 1)
    reaches = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "value")))["value"]
    found = steps.groupBy(*group).agg(reaches(F.floor(at)).alias("_a"), reaches(F.ceil(at)).alias("_b"))
    low, high = F.floor(at), F.ceil(at)
    return found.select(*keys, "share", F.when(low == high, F.col("_a")).otherwise((high - at) * F.col("_a") + (at - low) * F.col("_b")).alias("percentile"))


def empirical_percentile(values: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """percentile: the mid-rank of each value in the reference, 0 to 100; null for null values or an empty reference."""
    rows = reference.select(F.col(column).alias("value"), F.lit(1).alias("n")).union(values.select(column, F.lit(0))).where("value is not null")
    ranks = counts_below(rows)
    total = reference.agg(F.count(column).alias("_total"))
    out = values.join(ranks.select(F.col("value").alias(column), F.col("n").alias("_n"), F.col("below").alias("_below")), column, "left").join(F.broadcast(total))
    return out.select(*values.columns, (100 * (2 * F.col("_below") + F.col("_n")) / F.nullif(2 * F.col("_total"), F.lit(0))).alias("percentile"))


def correlation(df: DataFrame, x: str, y: str, absolute: float = 1e-5, relative: float = 1e-8) -> DataFrame:
    """n, equal_fraction, pearson and spearman (average ranks) of the rows where both are finite; a reason where they are undefined."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.where(finite(x) & finite(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for c in ("x", "y"):
        ranks = counts_below(rows.select(F.col(c).alias("value"), F.lit(1).alias("n")))
        rows = rows.join(ranks.select(F.col("value").alias(c), (F.col("below") + (F.col("n") + 1) / 2).alias(f"rank_{c}")), c)
    same = F.abs(F.col("x") - F.col("y")) <= absolute + relative * F.abs("y")
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    pearson = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # noqa: E731  corr() fails on constant columns
    r = lambda c: F.round(c, 6)
    reason: Column = F.when(F.count("*") == 0, "no_paired_finite_rows").when(~varied, "constant_or_insufficient_rows").otherwise("")
    return rows.agg(F.count("*").alias("n"), r(F.avg(same.cast("double"))).alias("equal_fraction"), r(F.when(varied, pearson("x", "y"))).alias("pearson"), r(F.when(varied, pearson("rank_x", "rank_y"))).alias("spearman"), reason.alias("reason"))
