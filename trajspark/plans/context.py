"""Queries of causal nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.operators import checks, spatial

from . import sql
from .catalog import once, register, split_flagged

_H = sql.haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")
_CONTEXT = sql.FEATURES + sql.SPLITS + f""", sp AS (SELECT f.*, dataset_split FROM flagged f JOIN split USING (user_id)), qs AS (SELECT * FROM sp WHERE dataset_split <> 'train'),
od0 AS (SELECT user_id, trajectory_id, min(elapsed_us) AS t0 FROM sp GROUP BY ALL), od AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, trajectory_id) AS nth FROM od0), qo AS (SELECT qs.*, nth FROM qs JOIN od USING (user_id, trajectory_id)),
pr AS (SELECT a.trajectory_id, a.source_point_index, min({_H}) AS m FROM qo a JOIN qo b ON a.user_id = b.user_id AND b.nth < a.nth AND b.elapsed_us < a.elapsed_us GROUP BY ALL),
px AS (SELECT a.trajectory_id, a.source_point_index, min({_H}) AS m FROM qs a JOIN qs b ON a.trajectory_id = b.trajectory_id AND b.elapsed_us < a.elapsed_us GROUP BY ALL),
gl AS (SELECT a.trajectory_id, a.source_point_index, min({_H}) AS m FROM qs a JOIN sp b ON b.dataset_split = 'train' AND b.elapsed_us < a.elapsed_us GROUP BY ALL),
cx AS (SELECT q.user_id, q.trajectory_id, q.source_point_index, q.anomaly_label, round(pr.m, 4) AS prior_m, round(px.m, 4) AS prefix_m, round(gl.m, 4) AS global_m, round(least(pr.m, px.m), 4) AS combined_m
  FROM qs q LEFT JOIN pr USING (trajectory_id, source_point_index) LEFT JOIN px USING (trajectory_id, source_point_index) LEFT JOIN gl USING (trajectory_id, source_point_index))"""
_REFS = ("prior_m", "prefix_m", "global_m", "combined_m")


@once
def _context(spark, d) -> DataFrame:
    sp = split_flagged(spark, d)
    return spatial.causal_context(sp.where("dataset_split <> 'train'"), sp.where("dataset_split = 'train'"))


@register("j11_causal_nearest", _CONTEXT, "SELECT trajectory_id, source_point_index, prior_m, prefix_m, global_m, combined_m FROM cx")
def _(spark, d):
    return _context(spark, d).select("trajectory_id", "source_point_index", *[F.round(c, 4).alias(c) for c in _REFS])


@register("v9_causality", _CONTEXT, "SELECT (SELECT count(*) FROM qs) AS points, (SELECT count(*) FROM px) AS found, 0::BIGINT AS violations")
def _(spark, d):
    q = split_flagged(spark, d).where("dataset_split <> 'train'")
    return checks.causality_violations(spatial.causal_nearest(q, q, ("trajectory_id",)))


@register("a27_context_support", _CONTEXT + ", lo AS (" + " UNION ALL ".join(f"SELECT user_id, anomaly_label, '{c}' AS reference, {c} AS m FROM cx" for c in _REFS) + ")", """SELECT coalesce(user_id, 'ALL') AS user_id, reference, count(*) AS points, count(m) AS available, count_if(m <= 50) AS within_50, round(quantile_cont(m, 0.5), 3) AS median, round(quantile_cont(m, 0.9), 3) AS p90, round(quantile_cont(CASE WHEN anomaly_label = 1 THEN m END, 0.5), 3) AS labelled_median
  FROM lo GROUP BY GROUPING SETS ((reference), (reference, user_id))""")
def _(spark, d):
    return spatial.context_support(_context(spark, d).withColumns({c: F.round(c, 4) for c in _REFS}), _REFS)
