"""Point and event metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.geo import safe_ratio

from .audits import sums_below


def confusion(df: DataFrame, *keys: str, label: str = "anomaly_label", predicted: str = "predicted") -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and FPR; undefined ratios are null."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    r = lambda a, b: F.round(safe_ratio(a, b), 6)
    return c.withColumns({"accuracy": r(tp + tn, tp + fp + tn + fn), "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn), "fpr": r(fp, fp + tn)})


def score_steps(df: DataFrame, label: str = "anomaly_label", score: str = "score") -> DataFrame:
    """Per distinct score, from the highest: positives and negatives so far. Scores are dealt into ranges, so no task orders them all."""
    y = F.col(label)
    rows = df.where(y.isNotNull()).select(F.col(score).alias("value"), (y == 1).cast("int").alias("a"), (y != 1).cast("int").alias("b"))
    total = rows.agg(F.sum("a").alias("pos"), F.sum("b").alias("neg"))
    s = sums_below(rows, ("a", "b")).where("value is not null").join(F.broadcast(total), F.lit(True))  # one row
    return s.select(F.col("value").alias("threshold"), F.col("a").alias("p"), F.col("b").alias("n"), (F.col("pos") - F.col("a_below")).alias("tp"), (F.col("neg") - F.col("b_below")).alias("fp"))


def ranking_metrics(df: DataFrame, label: str = "anomaly_label", score: str = "score") -> DataFrame:
    """ROC-AUC by mid-ranks and step-wise average precision; null unless both classes stand."""
    s = score_steps(df, label, score)
    t = s.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return t.select("pos", "neg", F.round(F.when(both, F.col("area") / (F.col("pos") * F.col("neg"))), 6).alias("roc_auc"), F.round(F.when(both, F.col("ap") / F.col("pos")), 6).alias("average_precision"))


def grouped_ranking(df: DataFrame, *keys: str, label: str = "anomaly_label", score: str = "score") -> DataFrame:
    """ranking_metrics of each group of keys; null, with a reason, where a group lacks a class. Rows with a null score or label take no part."""
    y = F.col(label)
    rows = df.where(y.isNotNull() & F.col(score).isNotNull()).select(*keys, F.col(score).alias("value"), (y == 1).cast("int").alias("a"), (y != 1).cast("int").alias("b"))
    steps = sums_below(rows, ("a", "b"), *keys)
    total = steps.groupBy(*keys).agg(F.sum("a").alias("pos"), F.sum("b").alias("neg"))
    s = steps.join(F.broadcast(total), list(keys))  # a row a group
    tp, fp = F.col("pos") - F.col("a_below"), F.col("neg") - F.col("b_below")
    t = s.groupBy(*keys).agg(F.first("pos").alias("pos"), F.first("neg").alias("neg"), F.sum(F.col("b") * (tp - F.col("a") / 2)).alias("area"), F.sum(F.col("a") * tp / (tp + fp)).alias("ap"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    reason = F.when(F.col("pos") == 0, "no_positive_rows").when(F.col("neg") == 0, "no_negative_rows").otherwise("")
    return t.select(*keys, "pos", "neg", F.round(F.when(both, F.col("area") / (F.col("pos") * F.col("neg"))), 6).alias("roc_auc"), F.round(F.when(both, F.col("ap") / F.col("pos")), 6).alias("average_precision"), reason.alias("reason"))


def curve(df: DataFrame, label: str = "anomaly_label", score: str = "score") -> DataFrame:
    s = score_steps(df, label, score)
    t = s.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return s.join(F.broadcast(t), F.lit(True)).select("threshold", "tp", "fp", F.round(safe_ratio(F.col("tp"), F.col("pos")), 6).alias("tpr"), F.round(safe_ratio(F.col("fp"), F.col("neg")), 6).alias("fpr"))


def descriptive(df: DataFrame, column: str, *keys: str) -> DataFrame:
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)]))
    d = df.groupBy(*keys).agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), q.alias("q"))
    names = ("p01", "p25", "median", "p75", "p95", "p99")
    return d.select(*keys, "n", "mean", "std", *[F.round(F.col("q")[i], 6).alias(x) for i, x in enumerate(names)], F.round(F.col("q")[3] - F.col("q")[1], 6).alias("iqr"))


def threshold(df: DataFrame, score: str = "score", share: float = 0.95) -> DataFrame:
    return df.agg(F.percentile(score, share).alias("threshold"))


def event_catalog(points: DataFrame) -> DataFrame:
    from .alerts import positive_runs

    runs = positive_runs(points, "anomaly_label")
    return runs.withColumn("event_id", F.concat_ws("#", "trajectory_id", F.col("start_index").cast("string")))


def event_detection(points: DataFrame, events: DataFrame) -> DataFrame:
    """Per event: hit, first detected index, delay in points, coverage, early detection at 10, 25 and 50 per cent."""
    e = events.select("event_id", "trajectory_id", "start_index", "end_index", F.col("points").alias("event_points"))
    p = points.select("user_id", "trajectory_id", "source_point_index", "predicted")
    j = e.join(p, (e.trajectory_id == p.trajectory_id) & p.source_point_index.between(e.start_index, e.end_index)).drop(p.trajectory_id)
    d = j.groupBy("event_id", "user_id", "trajectory_id", "start_index", "end_index", "event_points").agg(F.sum("predicted").alias("detected_points"), F.min(F.when(F.col("predicted") == 1, F.col("source_point_index"))).alias("first_index"))
    d = d.withColumn("delay_points", F.col("first_index") - F.col("start_index"))
    position = F.col("delay_points") / F.greatest(F.col("event_points") - 1, F.lit(1))
    early = {f"early_{k}": F.coalesce(position <= k / 100, F.lit(False)) for k in (10, 25, 50)}
    return d.withColumns({"hit": F.col("first_index").isNotNull(), "coverage": F.round(F.col("detected_points") / F.col("event_points"), 6), **early})


def event_summary(detections: DataFrame) -> DataFrame:
    """By user and for all."""
    r = lambda c: F.round(F.avg(c.cast("double")), 6)
    s = detections.rollup("user_id").agg(F.count("*").alias("events"), F.count_if("hit").alias("detected"), r(F.col("hit")).alias("detection_rate"), r(F.col("early_25")).alias("early_25_rate"), F.round(F.sum("detected_points") / F.sum("event_points"), 6).alias("point_recall"), F.round(F.percentile("delay_points", 0.5), 6).alias("median_delay"))
    return s.withColumn("user_id", F.coalesce("user_id", F.lit("ALL")))


def false_alerts(points: DataFrame) -> DataFrame:
    """Per user over normal points: false positives, alert runs, exposure and runs an hour."""
    from .alerts import exposure, positive_runs

    normal = points.withColumn("fp", F.when((F.col("predicted") == 1) & (F.col("anomaly_label") == 0), 1).otherwise(0))
    counts = normal.groupBy("user_id").agg(F.sum("fp").alias("false_points"), F.count_if(F.col("anomaly_label") == 0).alias("normal_points"))
    runs = positive_runs(normal, "fp", "user_id", "trajectory_id").groupBy("user_id").agg(F.count("*").alias("false_runs"), F.countDistinct("trajectory_id").alias("alerted_trajectories"))
    seconds = exposure(points, "user_id", "trajectory_id").groupBy("user_id").agg(F.sum("exposure_us").alias("exposure_us"))
    j = counts.join(runs, "user_id", "left").join(seconds, "user_id", "left").fillna(0, ["false_runs", "alerted_trajectories"])
    return j.withColumns({"fpr": F.round(safe_ratio(F.col("false_points"), F.col("normal_points")), 6), "runs_per_hour": F.round(safe_ratio(F.col("false_runs") * 3.6e9, F.col("exposure_us")), 6)})


def type_metrics(positives: DataFrame, normals: DataFrame) -> DataFrame:
    """Per run and anomaly type against the common normal negatives: counts, precision, recall, F1 and the positives' scores."""
    neg = normals.groupBy("run").agg(F.count_if(F.col("predicted") == 1).alias("fp"), F.count_if(F.col("predicted") != 1).alias("tn"))
    q = lambda x: F.round(F.percentile("run_score", x), 4)
    pos = positives.groupBy("run", "model", "seed", "anomaly_type").agg(F.count_if(F.col("predicted") == 1).alias("tp"), F.count_if(F.col("predicted") != 1).alias("fn"), F.round(F.avg("run_score"), 6).alias("score_mean"), q(0.5).alias("score_median"), q(0.95).alias("score_p95"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda a, b: F.round(safe_ratio(a, b), 6)
    return pos.join(F.broadcast(neg), "run").drop("run").withColumns({"precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn)})  # a row a run


def prediction_pairs(copied: DataFrame, originals: DataFrame) -> DataFrame:
    """Per run and type: decisions that a copied point gained or lost against its original, and the mean change of its score."""
    o = originals.select(F.col("trajectory_id").alias("source_trajectory_id"), "source_point_index", "run", F.col("predicted").alias("_p"), F.col("run_score").alias("_s"))
    j = copied.join(o, ["source_trajectory_id", "source_point_index", "run"])
    p, q = F.col("predicted"), F.col("_p")
    return j.groupBy("model", "seed", "anomaly_type").agg(F.count("*").alias("points"), F.count_if((p == 1) & (q == 0)).alias("gained"), F.count_if((p == 0) & (q == 1)).alias("lost"), F.round(F.avg(F.col("run_score") - F.col("_s")), 4).alias("score_delta"))


def recall_by_category(scored: DataFrame, column: str, categories: tuple[str, ...], low: int = 30) -> DataFrame:
    """Recall of every run in every category, those without rows too; low_support: fewer than `low` rows."""
    from .runs import run_table

    grid = scored.sparkSession.range(1).select(F.inline(run_table())).select("*", F.explode(F.lit(list(categories))).alias(column))
    found = scored.groupBy("run", column).agg(F.count("*").alias("points"), F.sum("predicted").alias("detected"))
    n = F.coalesce("points", F.lit(0))
    return F.broadcast(grid).join(found, ["run", column], "left").select("model", "seed", column, n.alias("points"), F.coalesce("detected", F.lit(0)).alias("detected"), F.round(safe_ratio(F.col("detected"), F.col("points")), 6).alias("recall"), n.between(1, low - 1).alias("low_support"), F.when(n == 0, "no_rows").otherwise("").alias("reason"))


def abstention(points: DataFrame, distance: str, radii: tuple[int, ...]) -> DataFrame:
    """Rows, and labelled rows, that a radius keeps."""
    p = points.select(distance, "anomaly_label", F.explode(F.lit(list(radii))).alias("radius_m"))
    kept = F.col(distance) <= F.col("radius_m")
    return p.groupBy("radius_m").agg(F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("anomaly_label") == 1)).alias("kept_labelled"))


def minimum_context(points: DataFrame, context: str, minima: tuple[int, ...]) -> DataFrame:
    p = points.select(context, F.explode(F.lit(list(minima))).alias("minimum_points"))
    c, m = F.col(context), F.col("minimum_points")
    return p.groupBy("minimum_points").agg(F.count_if(c >= m).alias("supported"), F.count_if((c > 0) & (c < m)).alias("insufficient"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts and cumulative counts of even bins between the 1st and 99th percentile; -1 and `bins` hold what lies outside."""
    e = df.agg(F.percentile(column, F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    at = F.floor((F.col(column) - F.col("q")[0]) / F.nullif(F.col("q")[1] - F.col("q")[0], F.lit(0.0)) * bins).cast("int")
    h = df.join(F.broadcast(e), F.lit(True)).groupBy(F.least(F.greatest(at, F.lit(-1)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("points"))  # one row
    return h.withColumn("cumulative", F.sum("points").over(Window.orderBy("bin")))  # bins + 2 rows


def precision_recall(df: DataFrame, label: str = "anomaly_label", score: str = "score") -> DataFrame:
    s = score_steps(df, label, score)
    total = s.agg(F.sum("p").alias("pos"))
    tp, fp = F.col("tp"), F.col("fp")
    return s.join(F.broadcast(total), F.lit(True)).select("threshold", (tp / (tp + fp)).alias("precision"), safe_ratio(tp, F.col("pos")).alias("recall"))


def grouped_summary(df: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    """Any aggregates by keys; rows with null keys form groups of their own."""
    return df.groupBy(*keys).agg(*columns)
