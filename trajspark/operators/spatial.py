"""Nearest-neighbour joins on a grid and causal context joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions import geo
from trajspark.sources.scratch import saved

#: Radii of the coverage report, in metres.
RADII = (10, 25, 50, 100, 200, 500, 1000)
#: Search radii of nearest_reference; what lies further off is searched by bounds of one-degree cells.
RUNGS = (3.0, 12.0, 50.0, 200.0, 1000.0, 5000.0, 50_000.0)
#: Places that a query may meet in the cells of the smallest radius on average; where they lie closer, halved radii come before it.
MET = 16
#: Pairs to be met in the smallest radius from which on that is worth the jobs of more radii.
WORTH = 100_000_000
#: No point of a one-degree cell is further from its centre.
CELL_REACH_M = 80_000.0


def _good(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))


def _cells(radius_m: float) -> tuple[float, Column]:
    """Height of the cells of a radius in degrees, and their width in the row `cy`. Rows of cells near a pole are one cell."""
    step = math.degrees(radius_m / geo.EARTH_RADIUS_M) * 1.01
    edge = F.greatest(F.abs(F.col("cy") * step), F.abs((F.col("cy") + 1) * step)) + step
    return step, F.when((edge < 90) & (step / F.cos(F.radians(edge)) < 10), step / F.cos(F.radians(edge))).otherwise(F.lit(720.0))


def _in_cells(reference: DataFrame, radius_m: float) -> DataFrame:
    step, width = _cells(radius_m)
    return reference.withColumn("cy", F.floor(F.col("ref_lat") / step)).withColumn("cx", F.floor(F.col("ref_lon") / width))


def rungs(places: DataFrame, keys: tuple[str, ...], asked: int) -> tuple[float, ...]:
    """RUNGS; for `asked` queries that would meet very many pairs, with halved radii before while the nine cells about a place hold more than MET places on average."""
    own = _in_cells(places, RUNGS[0]).groupBy(*keys, "cy", "cx").agg(F.count("*").alias("n"))
    mean = own.agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean")).first()["mean"] or 0.0
    more, met = [], 9 * mean
    while met > MET and asked * met > WORTH and len(more) < 10:
        more.append((more[-1] if more else RUNGS[0]) / 2)
        met /= 4
    return (*reversed(more), *RUNGS)


def _within_rung(queries: DataFrame, reference: DataFrame, radius_m: float, keys: tuple[str, ...], allowed: Column) -> DataFrame:
    """(_q, b): allowed reference places within radius_m of each query. Longitudes wrap."""
    step, width = _cells(radius_m)
    ref = _in_cells(reference, radius_m)
    q = queries.withColumn("cy", F.explode(F.array(*[F.floor(F.col("latitude") / step) + k for k in (-1, 0, 1)]))).withColumn("width", width)
    cells = F.array(*[F.floor((F.col("longitude") + turn) / F.col("width")) + k for turn in (0, -360, 360) for k in (-1, 0, 1)])
    q = q.withColumn("cx", F.explode(F.array_distinct(cells)))
    d = geo.haversine(F.col("latitude"), F.col("longitude"), F.col("ref_lat"), F.col("ref_lon"))
    near = q.join(ref, [*keys, "cy", "cx"]).where(allowed).withColumn("d", d).where(F.col("d") <= radius_m)
    return near.select("_q", F.struct("d", "ref_lat", "ref_lon", "ref_us", "ref_trajectory").alias("b"))


def _beyond_rungs(queries: DataFrame, reference: DataFrame, keys: tuple[str, ...], before: str | None, allowed: Column) -> DataFrame:
    """The same without a radius: one-degree cells whose lower bound exceeds the smallest distance to any cell's earliest place are left out.

    With `before`, a cell has one earliest place for each of its values, so that a place is allowed if any of its cell and value is.
    """
    at = [F.col("latitude"), F.col("longitude")]
    cell = [*keys, *([f"ref_{before}"] if before else []), "cy", "cx"]
    one = reference.withColumns({"cy": F.floor("ref_lat"), "cx": F.floor("ref_lon")})
    cells = one.groupBy(*cell).agg(F.min(F.struct("ref_us", "ref_lat", "ref_lon")).alias("s")).select(*cell, "s.*")
    met = queries.join(cells, list(keys)) if keys else queries.join(F.broadcast(cells), F.lit(True))  # without keys at most 64,800 cells
    met = met.where(allowed).withColumns({"high": geo.haversine(*at, F.col("ref_lat"), F.col("ref_lon")), "low": geo.haversine(*at, F.col("cy") + 0.5, F.col("cx") + 0.5) - CELL_REACH_M}).drop("ref_us", "ref_lat", "ref_lon")
    best = met.groupBy("_q").agg(F.min("high").alias("bound"))
    near = met.join(best, "_q").where("low <= bound").join(one, cell).where(allowed)
    near = near.withColumn("d", geo.haversine(*at, F.col("ref_lat"), F.col("ref_lon")))
    return near.select("_q", F.struct("d", "ref_lat", "ref_lon", "ref_us", "ref_trajectory").alias("b"))


def _search(queries: DataFrame, places: DataFrame, keys: tuple[str, ...], moment: tuple[str, ...], before: str | None, allowed: Column) -> DataFrame:
    """queries with nearest_m, nearest_us and nearest_trajectory: radius by radius, each for what the smaller ones left open. Where places lie close together
    the radii begin smaller, so that the pairs grow with the queries and not with their product with the places about them.

    Queries are reduced to distinct (keys, coordinates, moment) first; a radius is one aggregation of the pairs found and the queries asked, so that
    those without a pair stay. Queries with null or non-finite coordinates stay with nulls.
    """
    parts = [*keys, "latitude", "longitude", *moment]
    left = saved(queries.where(_good("latitude") & _good("longitude")).select(*parts).distinct().select(F.struct(*parts).alias("_q")), "left")
    found = []
    for radius in (*rungs(places, keys, left.count()), None):
        asked = left.select("_q", "_q.*")
        near = _beyond_rungs(asked, places, keys, before, allowed) if radius is None else _within_rung(asked, places, radius, keys, allowed)
        none = left.select("_q", F.lit(None).cast(near.schema["b"].dataType).alias("b"))
        step = saved(near.unionByName(none).groupBy("_q").agg(F.min("b").alias("b")), "nearest")
        found.append(step.where("b is not null"))
        left = step.where("b is null").select("_q")
        if left.isEmpty():
            break
    best = reduce(DataFrame.union, found).select("_q.*", F.col("b.d").alias("nearest_m"), F.col("b.ref_us").alias("nearest_us"), F.col("b.ref_trajectory").alias("nearest_trajectory"))
    return queries.join(best, parts, "left").select(*queries.columns, "nearest_m", "nearest_us", "nearest_trajectory")


def nearest_reference(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """Each query's nearest reference point at whatever distance, of equal places the smallest trajectory. All where the reference is empty stay with nulls.

    Both sides are reduced to distinct coordinates, so that much-visited places cost one row.
    """
    places = reference.where(_good("latitude") & _good("longitude")).groupBy(F.col("latitude").alias("ref_lat"), F.col("longitude").alias("ref_lon")).agg(F.min("trajectory_id").alias("ref_trajectory"), F.lit(0).cast("bigint").alias("ref_us"))
    return _search(queries, saved(places, "places"), (), (), None, F.lit(True)).drop("nearest_us")


def causal_nearest(queries: DataFrame, reference: DataFrame, keys: tuple[str, ...] = (), before: str | None = None) -> DataFrame:
    """Each query's nearest earlier reference point (elapsed_us strictly smaller) among those of equal keys.

    With `before`, a column of both sides that orders trajectories, only points of a smaller value count. A place is kept once per key (and value
    of `before`) with its earliest time, for it may serve all later queries; queries that nothing precedes are set aside by count first.
    """
    extra = (before,) if before else ()
    ref = reference.where(_good("latitude") & _good("longitude"))
    queries = saved(queries, "asked")
    places = saved(ref.groupBy(*keys, *[F.col(c).alias(f"ref_{c}") for c in extra], F.col("latitude").alias("ref_lat"), F.col("longitude").alias("ref_lon")).agg(F.min("elapsed_us").alias("ref_us"), F.min_by("trajectory_id", F.struct("elapsed_us", "trajectory_id")).alias("ref_trajectory")), "places")
    allowed = F.col("ref_us") < F.col("elapsed_us")
    if before:
        allowed = allowed & (F.col(f"ref_{before}") < F.col(before))
    first = places.groupBy(*keys).agg(F.min("ref_us").alias("_first"), *[F.min(f"ref_{c}").alias(f"_{c}") for c in extra])
    marked = queries.join(first, list(keys), "left") if keys else queries.join(F.broadcast(first), F.lit(True), "left")  # one row without keys
    some = F.coalesce(F.col("_first") < F.col("elapsed_us"), F.lit(False))
    if before:
        some = some & F.coalesce(F.col(f"_{before}") < F.col(before), F.lit(False))
    marked = marked.withColumn("_some", some).drop("_first", *[f"_{c}" for c in extra])
    names = {"nearest_m": "double", "nearest_us": "bigint", "nearest_trajectory": "string"}
    none = marked.where("not _some").drop("_some").withColumns({k: F.lit(None).cast(t) for k, t in names.items()})
    return _search(marked.where("_some").drop("_some"), places, keys, ("elapsed_us", *extra), before, allowed).select(*queries.columns, *names).unionByName(none.select(*queries.columns, *names))


def coverage_by_radius(nearest: DataFrame, radii_m: tuple[int, ...] = RADII) -> DataFrame:
    """Points, covered points and their share by radius (inclusive), for all ('ALL') and each user. Points without a reference are uncovered."""
    rows = nearest.select("user_id", "nearest_m", F.explode(F.lit(list(radii_m))).alias("radius_m"))
    covered = F.count_if(F.col("nearest_m") <= F.col("radius_m"))
    out = rows.groupingSets([["radius_m"], ["radius_m", "user_id"]], "radius_m", "user_id").agg(F.count("*").alias("points"), covered.alias("covered"), F.round(covered / F.count("*"), 6).alias("share"))
    return out.withColumn("user_id", F.coalesce("user_id", F.lit("ALL")))


def nearest_users(nearest: DataFrame, reference: DataFrame) -> DataFrame:
    """How often each user of the reference points is the nearest one to each user's points, and the share of these points."""
    owners = reference.select(F.col("trajectory_id").alias("nearest_trajectory"), F.col("user_id").alias("reference_user")).distinct()
    found = nearest.where("nearest_m is not null").join(owners, "nearest_trajectory").groupBy("user_id", "reference_user").agg(F.count("*").alias("points"))
    return found.withColumn("fraction", F.round(F.col("points") / F.sum("points").over(Window.partitionBy("user_id")), 6))


def trajectory_order(points: DataFrame) -> DataFrame:
    """Trajectories of each user in order of their starts."""
    t = points.groupBy("user_id", "trajectory_id").agg(F.min("elapsed_us").alias("start_us"), F.max("elapsed_us").alias("end_us"), F.count("*").alias("points"))
    return t.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("start_us", "trajectory_id")))


def prior_context(points: DataFrame) -> DataFrame:
    """Per trajectory: earlier completed trajectories of the same user and their points, the context that a causal scorer may use."""
    t = trajectory_order(points)
    a, b = t.alias("a"), t.alias("b")
    j = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.end_us") < F.col("a.start_us")), "left")
    return j.groupBy(F.col("a.trajectory_id").alias("trajectory_id")).agg(F.count("b.trajectory_id").alias("prior_trajectories"), F.coalesce(F.sum("b.points"), F.lit(0)).alias("prior_points"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The last value of right strictly before each left row: both sides are merged in one ordered window, nothing is joined."""
    extra = [c for c in left.columns if c not in (key, time)]
    rows = left.select(key, time, F.struct(*extra).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(0).alias("_side"))
    rows = rows.unionByName(right.select(key, time, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(1).alias("_side")))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 0")
    return out.select(key, time, "_row.*", F.col("_last").alias(value))


def causal_context(queries: DataFrame, train: DataFrame) -> DataFrame:
    """Metres to the nearest earlier point among the user's prior trajectories, the own prefix and the train points, and the smaller of the first two.

    The first two are one search over scopes: within the user only points of earlier trajectories count, within the trajectory all of them.
    """
    keys = ["trajectory_id", "source_point_index"]
    queries = saved(queries, "context")  # read by three joins
    q = queries.join(trajectory_order(queries).select("trajectory_id", "nth"), "trajectory_id")
    scope = lambda name, key, turn: F.struct(F.lit(name).alias("scope"), key.alias("key"), turn.cast("int").alias("turn"))
    in_scopes = lambda own_turn: F.inline(F.array(scope("prior", F.col("user_id"), F.col("nth")), scope("prefix", F.col("trajectory_id"), F.lit(own_turn))))
    columns = [*keys, "latitude", "longitude", "elapsed_us"]
    own = causal_nearest(q.select(*columns, in_scopes(1)), q.select(*columns, in_scopes(0)), ("scope", "key"), "turn")
    own = own.groupBy(*keys).agg(*[F.min(F.when(F.col("scope") == c, F.col("nearest_m"))).alias(f"{c}_m") for c in ("prior", "prefix")])
    world = causal_nearest(queries.select(*columns), train).select(*keys, F.col("nearest_m").alias("global_m"))
    return queries.join(own, keys).join(world, keys).withColumn("combined_m", F.least("prior_m", "prefix_m"))


def context_support(context: DataFrame, references: tuple[str, ...]) -> DataFrame:
    """Availability, coverage and quantiles of each reference, for all and each user."""
    rows = context.select("user_id", "anomaly_label", F.inline(F.array(*[F.struct(F.lit(c).alias("reference"), F.col(c).alias("m")) for c in references])))
    q = lambda c, x: F.round(F.percentile(c, x), 3)
    g = rows.groupingSets([["reference"], ["reference", "user_id"]], "reference", "user_id").agg(F.count("*").alias("points"), F.count("m").alias("available"), F.count_if(F.col("m") <= 50).alias("within_50"), q("m", 0.5).alias("median"), q("m", 0.9).alias("p90"), q(F.when(F.col("anomaly_label") == 1, F.col("m")), 0.5).alias("labelled_median"))
    return g.withColumn("user_id", F.coalesce("user_id", F.lit("ALL")))
