"""Detector runs, (model, seed) with a null seed for the rule: their metrics, summaries over seeds, policies and what these cost and save."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.geo import safe_ratio

from .alerts import COOLDOWNS, GATES, links

#: The runs as (model, seed, number).
RUNS = (("statistical_rule", None, 0), *[(m, s, 5 * i + s) for i, m in enumerate(("isolation_forest", "autoencoder")) for s in range(1, 6)])
METRICS = ("accuracy", "precision", "recall", "f1", "fpr")


def run_table() -> Column:
    rows = [F.struct(F.lit(m).alias("model"), F.lit(s).cast("int").alias("seed"), F.lit(k).alias("run")) for m, s, k in RUNS]
    return F.array(*rows)


def detector_runs(points: DataFrame, raised: str | None = None) -> DataFrame:
    """Every point under every run: run_score, the run's threshold and the decision (score > threshold).

    Stand-in scores in whole numbers, so that every engine agrees; `raised` names a 0/1 column whose points score 60 more.
    """
    p = points.select("*", F.inline(run_table()))
    noise = (F.round(F.col("score") * 100).cast("bigint") * (F.col("run") + 1)) % 997
    score = F.col("score") + noise / 10.0 + (60.0 * F.col(raised) if raised else F.lit(0.0))
    p = p.withColumns({"run_score": score, "threshold": 180.0 + 2 * F.col("run")})
    return p.withColumn("predicted", (F.col("run_score") > F.col("threshold")).cast("int"))


def unpivoted(metrics: DataFrame, keys: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    return metrics.unpivot(keys, list(columns), "metric", "value")


def group_summary(long: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation (null under two), smallest, largest and number of defined values, with a reason where there are too few."""
    g = long.groupBy(*keys).agg(F.count("*").alias("runs"), F.count("value").alias("defined"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    reason = F.when(F.col("defined") == 0, "undefined").when(F.col("runs") == 1, "single_run").when(F.col("defined") < 2, "one_defined_value").otherwise("")
    return g.withColumn("reason", reason)


def seed_ranks(long: DataFrame) -> DataFrame:
    """Rank of each seed among its model's runs (ties take the smallest) and its distance from the mean in deviations."""
    own = Window.partitionBy("model", "metric")
    z = (F.col("value") - F.avg("value").over(own)) / F.nullif(F.stddev_samp("value").over(own), F.lit(0.0))
    return long.where("value is not null").select("model", "seed", "metric", F.rank().over(own.orderBy(F.desc("value"))).alias("rank"), F.round(z, 4).alias("z"))


def null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls equal each other; right's other columns must have names of their own."""
    a, b = left.alias("a"), right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"_{k}")) for k in keys])
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return a.join(b, same, how).select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"_{k}")).alias(k) for k in keys], *rest)


# Policies.


def gated(streams: DataFrame) -> DataFrame:
    """Each point of each stream with gate and candidate of every gate, as columns _g0, _c0, _g1 ... in the order of GATES: one pass and one sort.

    The points of a linked block have indices without holes, so a point's place in its block is told by the block's first index.
    """
    w = Window.partitionBy("trajectory_id").orderBy("source_point_index")
    p = links(streams)
    first = F.last(F.when(~F.col("linked"), F.col("source_point_index")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("_n", F.col("source_point_index") - first + 1)
    p = p.withColumns({f"_g{i}": (F.col("_n") >= n) & (F.sum("predicted").over(w.rowsBetween(1 - n, 0)) >= m) for i, (n, m) in enumerate(GATES)})
    return p.withColumns({f"_c{i}": F.col(f"_g{i}") & ~(F.coalesce(F.lag(f"_g{i}").over(w), F.lit(False)) & F.col("linked")) for i in range(len(GATES))})


def _by_gate(**values) -> Column:
    """An array of a struct for each gate: its window and votes, the named values (functions of the gate's number) and its candidates `c` in order."""
    item = F.struct("source_point_index", "elapsed_us")
    candidates = lambda i: F.array_sort(F.collect_list(F.when(F.col(f"_c{i}"), item)))
    return F.array(*[F.struct(F.lit(n).alias("window_points"), F.lit(m).alias("minimum_positive"), *[f(i).alias(k) for k, f in values.items()], candidates(i).alias("c")) for i, (n, m) in enumerate(GATES)])


def _cooled(start: Column, end: Column) -> Column:
    """What the cooldown `cooldown_s` makes of the candidates `c` of a stream and gate, counted from index `start` to before `end`.

    Greedy, in order: a candidate is emitted if the last emitted one, wherever it stands, is at least the cooldown ago. notification_first,
    notification_points, suppressed; suppressed_before: those before the first emitted one; suppressed_by_earlier_alert: one of these by one before `start`.
    """
    long, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    zero = F.struct(none.alias("at"), none.alias("index"), none.alias("notification_first"), long.alias("notification_points"), long.alias("suppressed"), long.alias("suppressed_before"), F.lit(False).alias("suppressed_by_earlier_alert"))

    def step(s: Column, x: Column) -> Column:
        i = x["source_point_index"]
        emit = s["at"].isNull() | (x["elapsed_us"] - s["at"] >= F.col("cooldown_s") * 1_000_000)
        inside = (i >= start) & (i < end)
        early = inside & ~emit & s["notification_first"].isNull()
        more = lambda c, when: (s[c] + F.when(when, 1).otherwise(0)).alias(c)
        return F.struct(
            F.when(emit, x["elapsed_us"]).otherwise(s["at"]).alias("at"), F.when(emit, i).otherwise(s["index"]).alias("index"), F.coalesce(s["notification_first"], F.when(emit & inside, i)).alias("notification_first"),
            more("notification_points", emit & inside), more("suppressed", ~emit & inside), more("suppressed_before", early), (s["suppressed_by_earlier_alert"] | F.coalesce(early & (s["index"] < start), F.lit(False))).alias("suppressed_by_earlier_alert"),
        )

    return F.aggregate("c", zero, step)


def _under_cooldowns(gates: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row of each stream and gate under every cooldown; `c` gives way to what _cooled counts."""
    e = gates.withColumn("cooldown_s", F.explode(F.lit(list(COOLDOWNS))))
    return e.withColumn("_e", _cooled(start, end)).select(*[c for c in e.columns if c != "c"], "_e.*").drop("at", "index")


def context_streams(copied: DataFrame, normal: DataFrame) -> DataFrame:
    """Per run and copy: the source's decisions before the event, where the copy still equals its source, and the copy's decisions inside the event.

    A copy equals its source where its column equals_source says so, else in time and place. Points of low source quality have no decision and
    stay out. trajectory_id becomes the name of the stream.
    """
    inside = copied.where("anomaly_label = 1 and source_quality_valid and not is_low_quality")
    if "equals_source" in copied.columns:
        same = F.col("c.equals_source")
    else:
        same = (F.col("n.elapsed_us") == F.col("c.elapsed_us")) & (F.col("n.latitude") == F.col("c.latitude")) & (F.col("n.longitude") == F.col("c.longitude"))
    before = copied.where("source_point_index < segment_start").alias("c")
    key = (F.col("n.trajectory_id") == F.col("c.source_trajectory_id")) & (F.col("n.source_point_index") == F.col("c.source_point_index")) & (F.col("n.run") == F.col("c.run"))
    pre = before.join(normal.where("is_training_eligible").alias("n"), key & same).select(*[F.col(f"c.{c}") for c in copied.columns if c != "predicted"], F.col("n.predicted").alias("predicted"))
    both = pre.unionByName(inside.select(*pre.columns))
    return both.withColumn("sample_id", F.col("trajectory_id")).withColumn("trajectory_id", F.concat_ws("|", F.col("run").cast("string"), "trajectory_id"))


def own_context_streams(copied: DataFrame) -> DataFrame:
    """context_streams of copies whose points, where equals_source holds, have their source's decision already: nothing is joined."""
    before = "source_point_index < segment_start and equals_source and source_quality_valid"
    streams = copied.where(f"({before}) or (anomaly_label = 1 and source_quality_valid and not is_low_quality)")
    return streams.withColumn("sample_id", F.col("trajectory_id")).withColumn("trajectory_id", F.concat_ws("|", F.col("run").cast("string"), "trajectory_id"))


STREAM = ("model", "seed", "run", "user_id", "sample_id", "segment_start", "segment_end")


def event_rows(streams: DataFrame) -> DataFrame:
    """Per run, copy and policy: raw, gate and notification detection with delays and coverage, and what gate and cooldown suppressed.

    One shuffle by stream: gates are columns, a stream becomes one row, and only its candidates are gathered for the cooldowns.
    """
    start, end = F.col("segment_start"), F.col("segment_end")
    inside = (F.col("source_point_index") >= start) & (F.col("source_point_index") < end)
    on = F.col("predicted") == 1
    first = lambda c: F.min(F.when(inside & c, F.col("source_point_index")))
    by_gate = _by_gate(gate_points=lambda i: F.count_if(inside & F.col(f"_g{i}")), gate_first=lambda i: first(F.col(f"_g{i}")), candidates=lambda i: F.count_if(inside & F.col(f"_c{i}")))
    one = gated(streams).groupBy(*STREAM, "trajectory_id").agg(F.count_if(inside).alias("evaluated"), F.count_if(inside & on).alias("raw_points"), first(on).alias("raw_first"), by_gate.alias("g"))
    gates = one.select(*[c for c in one.columns if c != "g"], F.inline("g"))
    e = _under_cooldowns(gates, start, end)
    points = F.col("segment_end") - F.col("segment_start")
    detected = {k: F.col(f"{k}_first").isNotNull() for k in ("raw", "gate", "notification")}
    out = {f"{k}_detected": v for k, v in detected.items()} | {f"{k}_delay": F.col(f"{k}_first") - F.col("segment_start") for k in detected}
    e = e.withColumns(out | {
        "event_points": points,
        "policy_id": F.concat_ws("", F.col("minimum_positive").cast("string"), F.lit("of"), F.col("window_points").cast("string"), F.lit("_cd"), F.col("cooldown_s").cast("string")),
        "cooldown_miss": detected["gate"] & ~detected["notification"] & (F.col("suppressed") > 0), "cooldown_delay": detected["notification"] & (F.col("suppressed_before") > 0),
        "gate_miss": detected["raw"] & ~detected["gate"], "carried_run": detected["gate"] & ~detected["notification"] & (F.col("candidates") == 0),
    })
    late = F.col("notification_delay") / F.greatest(points - 1, F.lit(1))
    return e.withColumn("early25", F.coalesce(late <= 0.25, F.lit(False))).drop("trajectory_id")


def false_rows(normal_streams: DataFrame) -> DataFrame:
    """Per run, source and policy on normal points: false notifications; exposure comes from the links alone."""
    one = gated(normal_streams).groupBy("model", "seed", "run", "user_id", "trajectory_id").agg(F.count("*").alias("points"), F.sum("predicted").alias("raw_points"), _by_gate().alias("g"))
    gates = one.select(*[c for c in one.columns if c != "g"], F.inline("g"))
    everywhere = F.lit(-(2**63)).cast("bigint"), F.lit(2**63 - 1)
    rows = _under_cooldowns(gates, *everywhere).withColumnRenamed("notification_points", "notifications").drop("notification_first", "suppressed", "suppressed_before", "suppressed_by_earlier_alert")
    name = F.concat_ws("", F.col("minimum_positive").cast("string"), F.lit("of"), F.col("window_points").cast("string"), F.lit("_cd"), F.col("cooldown_s").cast("string"))
    return rows.withColumn("policy_id", name)


def policy_grid(events: DataFrame, false: DataFrame, *more: str) -> DataFrame:
    """Per run and policy (and `more` keys): event detection, early detection, delay, false notifications per trajectory and per 1000 points."""
    keys = ["model", "seed", "run", "policy_id", *more]
    r = lambda c: F.round(c, 6)
    complexity = {"gate_rank": F.first("minimum_positive"), "cooldown_rank": F.first("cooldown_s")}
    e = events.groupBy(*keys).agg(F.count("*").alias("events"), r(F.avg(F.col("raw_detected").cast("int"))).alias("raw_edr"), r(F.avg(F.col("notification_detected").cast("int"))).alias("edr"), r(F.avg(F.col("early25").cast("int"))).alias("early25_rate"), r(F.percentile("notification_delay", 0.5)).alias("delay_median"), F.count_if("cooldown_miss").alias("cooldown_misses"), F.count_if("gate_miss").alias("gate_misses"), *[v.alias(k) for k, v in complexity.items()])
    f = false.groupBy(*keys).agg(F.sum("notifications").alias("false_notifications"), r(1000 * F.sum("notifications") / F.sum("points")).alias("false_per_1000"), r(F.sum("notifications") / F.count("*")).alias("false_per_trajectory"))
    return e.join(f.withColumnRenamed("model", "_m").withColumnRenamed("seed", "_s"), ["run", "policy_id", *more]).drop("_m", "_s")


def select_policies(grid: DataFrame, edr: float = 0.9, early: float = 0.8, seed_edr: float = 0.85, seeds: int = 4, tolerance: float = 1e-12) -> DataFrame:
    """Per model and policy: means over its runs, the three guards against the raw policy, and the lexicographic choice among those that pass."""
    raw = grid.where("policy_id = '1of1_cd0'").select("run", F.col("edr").alias("_raw"), F.col("early25_rate").alias("_raw_early"))
    g = grid.join(F.broadcast(raw), "run")  # a row a run
    m = g.groupBy("model", "policy_id").agg(
        F.count("*").alias("runs"), F.round(F.avg("edr"), 6).alias("edr"), F.round(F.avg("early25_rate"), 6).alias("early25_rate"), F.round(F.avg("_raw"), 6).alias("raw_edr"), F.round(F.avg("_raw_early"), 6).alias("raw_early"),
        F.count_if(F.col("edr") + tolerance >= seed_edr * F.col("_raw")).alias("seeds_passed"), F.round(F.avg("false_per_1000"), 6).alias("false_per_1000"), F.round(F.avg("false_per_trajectory"), 6).alias("false_per_trajectory"),
        F.round(F.avg("delay_median"), 6).alias("delay_median"), F.first("gate_rank").alias("gate_rank"), F.first("cooldown_rank").alias("cooldown_rank"),
    )
    a, b = F.col("edr") + tolerance >= edr * F.col("raw_edr"), F.col("early25_rate") + tolerance >= early * F.col("raw_early")
    c = (F.col("runs") == 1) | (F.col("seeds_passed") >= seeds)
    m = m.withColumn("rejection", F.concat_ws(";", F.when(~a, "mean_edr"), F.when(~b, "mean_early25"), F.when(~c, "seed_edr"))).withColumn("eligible", a & b & c)
    order = [F.desc("eligible"), "false_per_1000", "false_per_trajectory", F.asc_nulls_last("delay_median"), F.desc("edr"), "gate_rank", "cooldown_rank", "policy_id"]
    return m.withColumn("selected", (F.row_number().over(Window.partitionBy("model").orderBy(*order)) == 1) & F.col("eligible"))


def reductions(grid: DataFrame, selected: DataFrame) -> DataFrame:
    """Per run: the chosen policy of its model against the raw one: reduction of false notifications, retention of event detection, change of delay."""
    chosen = grid.join(F.broadcast(selected.where("selected").select("model", "policy_id")), ["model", "policy_id"])
    raw = grid.where("policy_id = '1of1_cd0'").select("run", F.col("false_notifications").alias("_f"), F.col("edr").alias("_e"), F.col("delay_median").alias("_d"))
    j = chosen.join(raw, "run")
    pct = lambda a, b: F.round(100 * safe_ratio(a, b), 4)
    return j.select("model", "seed", "policy_id", F.round(100 * (1 - safe_ratio(F.col("false_notifications"), F.col("_f"))), 4).alias("false_reduction_pct"), pct(F.col("edr"), F.col("_e")).alias("edr_retention_pct"), F.round(F.col("delay_median") - F.col("_d"), 4).alias("delay_change"))
