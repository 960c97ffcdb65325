"""Labelled events of injected copies, their detection by run, and false alerts on normal points: complete rows and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.geo import safe_ratio

from .alerts import MAX_LINK_US
from .routes import TIERS

EARLY = (10, 25, 50)


def _label_run(w) -> Column:
    on = F.col("anomaly_label") == 1
    return F.sum((on & ~F.coalesce(F.lag("anomaly_label").over(w) == 1, F.lit(False))).cast("int")).over(w)


def with_events(copies: DataFrame) -> DataFrame:
    """The labelled points of full copies with their event_id, sample and run of labels; copies need all their points, so that runs part where labels do."""
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index")
    p = copies.withColumn("label_run", _label_run(w)).where("anomaly_label = 1")
    number = F.lpad(F.col("label_run").cast("string"), F.greatest(F.lit(2), F.length(F.col("label_run").cast("string"))), F.lit("0"))
    return p.withColumn("event_id", F.concat(F.col("trajectory_id"), F.lit("__run_"), number))


def catalog(labelled: DataFrame, evaluated: Column, tier: str | None = None) -> DataFrame:
    """One row an event: boundaries, points, duration (null across a long gap), evaluated and excluded points, tier counts where a tier column is named.

    length_group and duration_group are short, medium or long by the 33rd and 66th percentile over all events; not_available without a duration.
    """
    w = Window.partitionBy("event_id").orderBy("source_point_index")
    gap = F.col("elapsed_us") - F.lag("elapsed_us").over(w)
    p = labelled.withColumns({"_sound": F.coalesce((gap > 0) & (gap <= MAX_LINK_US), gap.isNull()), "_in": F.coalesce(evaluated, F.lit(False))})
    n = lambda c: F.count_if(F.col("_in") & c)
    tiers = [n(F.col(tier) == t).alias(f"{t}_count") for t in TIERS] if tier else []
    e = p.groupBy("event_id", F.col("trajectory_id").alias("sample_id"), "user_id", "source_trajectory_id", "anomaly_type").agg(
        F.min("source_point_index").alias("start_index"), F.max("source_point_index").alias("end_index"), F.min_by("elapsed_us", "source_point_index").alias("start_us"), F.max_by("elapsed_us", "source_point_index").alias("end_us"),
        F.count("*").alias("event_points"), F.count_if("_in").alias("evaluated_points"), F.bool_and("_sound").alias("_all"), *tiers,
    )
    span = (F.col("end_us") - F.col("start_us")) / 1e6
    e = e.withColumns({"excluded_points": F.col("event_points") - F.col("evaluated_points"), "span_s": span, "duration_s": F.when(F.col("_all"), span), "duration_reason": F.when(F.col("_all"), "").otherwise("long_gap_inside_labelled_event")}).drop("_all")
    if tier:
        e = e.withColumns({"observable_ratio": F.round(safe_ratio(F.col("evaluated_points") - F.col("tier4_count"), F.col("evaluated_points")), 6), "contains_tier4": F.col("tier4_count") > 0})
    cuts = e.agg(*[F.percentile(c, F.array(F.lit(0.33), F.lit(0.66))).alias(f"_{c}") for c in ("event_points", "duration_s")])
    e = e.join(F.broadcast(cuts), F.lit(True))  # one row

    def group(c: str) -> Column:
        return F.when(F.col(c).isNull(), "not_available").when(F.col(c) <= F.col(f"_{c}")[0], "short").when(F.col(c) <= F.col(f"_{c}")[1], "medium").otherwise("long")

    return e.withColumns({"length_group": group("event_points"), "duration_group": group("duration_s")}).drop("_event_points", "_duration_s")


def detections(points: DataFrame, events: DataFrame) -> DataFrame:
    """Per run (model, seed, run) and event, from the event's evaluated points with their decisions: the full detection row.

    points: model, seed, run, event_id, source_point_index, elapsed_us, predicted. Runs of positives are as in alerts.positive_runs. Every event stands under every
    run of the points; the job fails, naming event and run, where a run lacks or adds evaluated points.
    """
    w = Window.partitionBy("run", "event_id").orderBy("source_point_index")
    whole = Window.partitionBy("run", "event_id")
    on = F.col("predicted") == 1
    gap = F.col("elapsed_us") - F.lag("elapsed_us").over(w)
    near = F.coalesce((F.col("source_point_index") - F.lag("source_point_index").over(w) == 1) & (gap > 0) & (gap <= MAX_LINK_US), F.lit(False))
    starts = on & ~(near & F.coalesce(F.lag("predicted").over(w) == 1, F.lit(False)))
    p = points.withColumns({"_gap": gap, "_start": starts, "_nth": F.row_number().over(w), "_first": F.min(F.when(on, F.col("source_point_index"))).over(whole)})
    p = p.withColumn("_length", F.when(on, F.col("_nth") - F.last(F.when(F.col("_start"), F.col("_nth")), ignorenulls=True).over(w) + 1))
    g = p.groupBy("model", "seed", "run", "event_id").agg(
        F.count("*").alias("_n"), F.count_if(on).alias("detected_points"), F.min("_first").alias("first_index"), F.min(F.when(on, F.struct("source_point_index", "elapsed_us")))["elapsed_us"].alias("first_us"),
        F.coalesce(F.bool_or((F.col("_gap") > MAX_LINK_US) & (F.col("source_point_index") <= F.col("_first"))), F.lit(False)).alias("_crossed"), F.coalesce(F.max("_length"), F.lit(0)).cast("bigint").alias("longest_run_points"), F.count_if("_start").alias("run_count"),
    )
    runs = points.select("model", "seed", "run").distinct()
    every = events.select("event_id", "sample_id", "user_id", "anomaly_type", "start_index", "start_us", "event_points", "evaluated_points").crossJoin(F.broadcast(runs))  # a row a run
    d = every.join(g.drop("model", "seed"), ["run", "event_id"], "left")
    n = F.coalesce("_n", F.lit(0))
    sound = F.when(n == F.col("evaluated_points"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("evaluated points differ: "), F.to_json(F.struct("run", "event_id")))).cast("boolean"))
    d = d.where(sound).fillna(0, ["detected_points", "longest_run_points", "run_count"]).fillna(False, ["_crossed"])
    hit = F.col("first_index").isNotNull()
    d = d.withColumns({"detected": hit, "delay_points": F.col("first_index") - F.col("start_index"), "delay_s": (F.col("first_us") - F.col("start_us")) / 1e6})
    relative = F.col("delay_points") / F.greatest(F.col("event_points") - 1, F.lit(1))
    r = lambda a, b: F.round(safe_ratio(F.col(a), F.col(b)), 6)
    return d.withColumns({
        "status": F.when(hit, "detected").otherwise("missed_event"), "relative_position": F.round(relative, 6), "delay_crosses_gap": hit & (F.col("delay_s") > 0) & F.col("_crossed"),
        "event_coverage": r("detected_points", "event_points"), "evaluated_coverage": r("detected_points", "evaluated_points"), "available_ratio": r("evaluated_points", "event_points"),
        "longest_run_ratio": r("longest_run_points", "event_points"), "mean_run_points": r("detected_points", "run_count"), **{f"early_{k}": F.coalesce(relative <= k / 100, F.lit(False)) for k in EARLY},
    }).drop("_n", "_crossed")


def summary(rows: DataFrame, *more: str) -> DataFrame:
    """Per run, and for each value of `more` beside 'ALL': detection, misses, early rates of all and of detected events, recall, runs, delays, coverage."""
    r = lambda c: F.round(c, 6)
    rate = lambda c: r(F.avg(c.cast("double")))
    digits = lambda c: 3 if c == "delay_s" else 6
    shares = lambda c, of: {f"{c}_{name}": F.round(F.percentile(c, q), digits(c)) for name, q in of}
    delays = {k: v for c in ("delay_points", "delay_s", "relative_position") for k, v in {f"{c}_mean": F.round(F.avg(c), digits(c)), **shares(c, (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)))}.items()}
    coverage = {k: v for c in ("event_coverage", "evaluated_coverage") for k, v in {f"{c}_mean": r(F.avg(c)), **shares(c, (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))}.items()}
    aggregates = {
        "events": F.count("*"), "detected_events": F.count_if("detected"), "missed_events": F.count_if(~F.col("detected")), "detection_rate": rate(F.col("detected")),
        "point_recall": r(safe_ratio(F.sum("detected_points"), F.sum("evaluated_points"))), "full_label_fraction": r(F.sum("detected_points") / F.sum("event_points")),
        "median_longest_run": r(F.percentile("longest_run_points", 0.5)), "median_longest_ratio": r(F.percentile("longest_run_ratio", 0.5)), "mean_run_count": r(F.avg("run_count")), "total_runs": F.sum("run_count"),
        **{f"early_{k}_rate": rate(F.col(f"early_{k}")) for k in EARLY}, **{f"early_{k}_conditional_rate": rate(F.when(F.col("detected"), F.col(f"early_{k}"))) for k in EARLY}, **delays, **coverage,
        "delay_reason": F.when(F.count_if("detected") == 0, "all_events_missed").otherwise(""),
    }
    run = ["model", "seed", "run"]
    sets = [run, *[[*run, c] for c in more]]
    ratio = lambda a, b: safe_ratio(F.col(a), F.col(b))  # noqa: E731  the rows' own ratios are rounded
    rows = rows.withColumns({"relative_position": F.col("delay_points") / F.greatest(F.col("event_points") - 1, F.lit(1)), "event_coverage": ratio("detected_points", "event_points"), "evaluated_coverage": ratio("detected_points", "evaluated_points"), "longest_run_ratio": ratio("longest_run_points", "event_points")})
    g = rows.groupingSets(sets, *run, *more).agg(*[v.alias(k) for k, v in aggregates.items()])
    return g.withColumns({c: F.coalesce(c, F.lit("ALL")) for c in more}) if more else g


def false_rows(normal: DataFrame) -> DataFrame:
    """Per run, user and trajectory of normal points with decisions: points, false positives, their runs and the longest one, linked intervals and seconds.

    normal: model, seed, run, user_id, trajectory_id, source_point_index, elapsed_us, predicted.
    """
    keys = ("run", "trajectory_id")
    w = Window.partitionBy(*keys).orderBy("source_point_index")
    gap = F.col("elapsed_us") - F.lag("elapsed_us").over(w)
    near = F.coalesce((F.col("source_point_index") - F.lag("source_point_index").over(w) == 1) & (gap > 0) & (gap <= MAX_LINK_US), F.lit(False))
    on = F.col("predicted") == 1
    p = normal.withColumns({"_gap": gap, "_linked": near, "_start": on & ~(near & F.coalesce(F.lag("predicted").over(w) == 1, F.lit(False))), "_nth": F.row_number().over(w)})
    p = p.withColumn("_length", F.when(on, F.col("_nth") - F.last(F.when(F.col("_start"), F.col("_nth")), ignorenulls=True).over(w) + 1))
    return p.groupBy("model", "seed", "run", "user_id", "trajectory_id").agg(
        F.count("*").alias("points"), F.count_if(on).alias("false_points"), F.count_if("_start").alias("false_runs"), F.coalesce(F.max("_length"), F.lit(0)).cast("bigint").alias("longest_run_points"),
        F.coalesce(F.sum(F.when(F.col("_linked"), F.col("_gap"))), F.lit(0)).alias("exposure_us"), F.count_if("_linked").alias("intervals"),
    )


def false_summary(rows: DataFrame, *more: str) -> DataFrame:
    """Per run, and for each value of `more` beside 'ALL': rates per point, per 1,000, per trajectory and per hour, and the share of trajectories with an alert."""
    r = lambda c: F.round(c, 6)
    total = {c: F.sum(c) for c in ("points", "false_points", "false_runs", "exposure_us", "intervals")}
    aggregates = {
        "trajectories": F.count("*"), **total, "fpr": r(safe_ratio(total["false_points"], total["points"])), "runs_per_trajectory": r(total["false_runs"] / F.count("*")),
        "alerted_percent": r(100 * F.count_if(F.col("false_runs") > 0) / F.count("*")), "false_per_1000": r(safe_ratio(1000 * total["false_points"], total["points"])),
        "runs_per_hour": r(safe_ratio(total["false_runs"] * 3.6e9, total["exposure_us"])), "exposure_reason": F.when(total["exposure_us"] > 0, "").otherwise("no_valid_adjacent_observation_intervals"), "longest_run_points": F.max("longest_run_points"),
    }
    run = ["model", "seed", "run"]
    g = rows.groupingSets([run, *[[*run, c] for c in more]], *run, *more).agg(*[v.alias(k) for k, v in aggregates.items()])
    return g.withColumns({c: F.coalesce(c, F.lit("ALL")) for c in more}) if more else g


def user_alerts(event_summary: DataFrame, false_alerts: DataFrame, keys: tuple[str, ...] = ("run", "user_id")) -> DataFrame:
    """Both summaries in one row a run and user; a user with only one of them keeps nulls in the other."""
    clash = [c for c in false_alerts.columns if c in event_summary.columns and c not in keys]
    both = event_summary.join(false_alerts.drop(*clash), list(keys), "full")
    missing = [c for c in clash if c in ("model", "seed")]
    if missing:  # a row with false alerts alone takes its run's names from that side
        names = false_alerts.select("run", "model", F.col("seed").alias("_seed")).distinct().withColumnRenamed("model", "_model")
        both = both.join(F.broadcast(names), "run", "left").withColumns({"model": F.coalesce("model", "_model"), "seed": F.coalesce("seed", "_seed")}).drop("_model", "_seed")  # a row a run
    return both


def family_means(rows: DataFrame, metrics: tuple[str, ...], *keys: str) -> DataFrame:
    """Means over the runs of each model (and `keys`), with the number of runs and of defined values of each metric."""
    columns = reduce(lambda x, m: [*x, F.round(F.avg(m), 6).alias(m), F.count(m).alias(f"{m}_defined")], metrics, [])
    return rows.groupBy("model", *keys).agg(F.count("*").alias("runs"), *columns)
