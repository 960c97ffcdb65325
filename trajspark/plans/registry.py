"""All queries of the trajectory operators and their SQL."""

from __future__ import annotations

from trajspark.operators import datasets  # noqa: F401
from trajspark.sources.gps import gps_points  # noqa: F401

from . import checks, context, events, files, fills, labels, models, points, runs  # noqa: F401  each enters its queries
from .catalog import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
