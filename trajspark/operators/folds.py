"""Folds over long trajectories: rows stream through a task in order, and only the carried state is held, whatever the length of a trajectory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys in one partition, one after another and in order; the sort spills, so a long trajectory needs no memory of its own."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def cooldown(candidates: DataFrame, seconds: int) -> DataFrame:
    """Greedy cooldown of (trajectory_id, source_point_index, elapsed_us): emitted, and the index of the notification that suppressed a candidate.

    Carried: the trajectory, and time and index of its last notification.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, index = None, 0, 0
        for batch in batches:
            emitted, suppressor = [], []
            for k, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != key or t - at >= seconds * 1_000_000:
                    key, at, index = k, t, i
                    emitted.append(True)
                    suppressor.append(None)
                else:
                    emitted.append(False)
                    suppressor.append(index)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(emitted, pa.bool_()), pa.array(suppressor, pa.int64())], ["trajectory_id", "source_point_index", "elapsed_us", "emitted", "suppressor_index"])

    rows = candidates.select("trajectory_id", F.col("source_point_index").cast("long").alias("source_point_index"), F.col("elapsed_us").cast("long").alias("elapsed_us")).where("trajectory_id is not null")
    return in_order(rows, ["trajectory_id"], ["source_point_index", "elapsed_us"]).mapInArrow(run, "trajectory_id string, source_point_index long, elapsed_us long, emitted boolean, suppressor_index long")


def fingerprints(points: DataFrame) -> DataFrame:
    """(user_id, trajectory_id, fingerprint): SHA-256 of the lines latitude, longitude (millionths of a degree) and microseconds since the first point, in
    order of time. Carried: the trajectory, its first time and the running hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, digest = None, 0, None

        def done(keys: list[tuple], found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(found, pa.string())], ["user_id", "trajectory_id", "fingerprint"])

        for batch in batches:
            users, names, times, lats, lons = (batch.column(c).to_pylist() for c in range(5))
            edges = [0, *[i for i in range(1, len(users)) if (users[i], names[i]) != (users[i - 1], names[i - 1])], len(users)]
            keys, found = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if (users[a], names[a]) != key or digest is None:
                    if digest is not None:
                        keys.append(key)
                        found.append(digest.hexdigest())
                    key, start, digest = (users[a], names[a]), times[a], hashlib.sha256()
                    lead = ""
                else:
                    lead = "\n"
                digest.update((lead + "\n".join([f"{lats[i]},{lons[i]},{times[i] - start}" for i in range(a, b)])).encode())
            if keys:
                yield done(keys, found)
        if digest is not None:
            yield done([key], [digest.hexdigest()])

    rows = points.select("user_id", "trajectory_id", *[F.col(c).cast("long").alias(c) for c in ("elapsed_us", "lat_udeg", "lon_udeg", "source_point_index")])
    ordered = in_order(rows, ["user_id", "trajectory_id"], ["elapsed_us", "source_point_index"])
    return ordered.select("user_id", "trajectory_id", "elapsed_us", "lat_udeg", "lon_udeg").mapInArrow(run, "user_id string, trajectory_id string, fingerprint string")
