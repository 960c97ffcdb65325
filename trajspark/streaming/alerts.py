"""Causal operators on Structured Streaming: movement features and vote gates with cooldown, one state per trajectory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_LINK_US = 300_000_000


def without_late_copies(points: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drops points of a (trajectory, time) seen within the watermark, and points later than it."""
    return points.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["trajectory_id", "timestamp"])


def burden(points: DataFrame, delay: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Positives and points of tumbling or sliding windows."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return points.withWatermark("timestamp", delay).groupBy("trajectory_id", w).agg(F.sum("predicted").alias("positives"), F.count("*").alias("points"))


def sessions(points: DataFrame, delay: str = "10 minutes", gap: str = "300 seconds") -> DataFrame:
    return points.withWatermark("timestamp", delay).groupBy("trajectory_id", F.session_window("timestamp", gap)).agg(F.count("*").alias("points"))


def vote_step(state: tuple, index: int, time: int, predicted: int, window: int, votes: int, cooldown_s: int) -> tuple[tuple, tuple]:
    """One point of the vote gate with greedy cooldown. State: index, time, the trailing votes of the linked block, the gate, the last notification."""
    last, before, recent, gate_before, emitted_at = state
    linked = before >= 0 and index == last + 1 and 0 < time - before <= MAX_LINK_US
    recent = ((recent if linked else "") + str(int(predicted)))[-window:]
    n = recent.count("1")
    gate = len(recent) == window and n >= votes
    candidate = gate and not (gate_before and linked)
    emitted = candidate and (emitted_at < 0 or time - emitted_at >= cooldown_s * 1_000_000)
    return (int(index), int(time), recent, gate, int(time) if emitted else emitted_at), (n, gate, candidate, emitted)


def move_step(state: tuple, time: int, latitude: float, longitude: float) -> tuple[tuple, tuple]:
    """One point of the movement features. State: time and place of the point before, the carried bearing, the stop's seconds."""
    before, lat, lon, bearing, stop = state
    dt = distance = 0.0
    if before >= 0:
        dt = (time - before) / 1e6
        p, q, d = math.radians(lat), math.radians(latitude), math.radians(longitude - lon)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
        distance = 2 * 6_371_000.0 * math.atan2(math.sqrt(min(1.0, x)), math.sqrt(max(0.0, 1 - x)))
        if distance >= 1.0:
            bearing = (math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) + 360) % 360
    speed = distance / dt if dt > 0 else 0.0
    stop = stop + dt if before >= 0 and distance <= 3.0 and speed <= 0.5 else 0.0
    return (int(time), float(latitude), float(longitude), float(bearing), float(stop)), (dt, distance, speed, float(bearing), float(stop))


NO_VOTES, NO_MOVE = (-1, -1, "", False, -1), (-1, 0.0, 0.0, 0.0, 0.0)


def notifications(points: DataFrame, window: int, votes: int, cooldown_s: int) -> DataFrame:
    """Per point: votes, gate, candidate and emitted, from the trailing votes of its linked block and the greedy cooldown.

    For streams that come in order. See trajspark.streaming.ordered for others.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = state.get if state.exists else NO_VOTES, []
        rows = pd.concat(list(frames)).sort_values("source_point_index", kind="stable")
        for i, t, p in zip(rows["source_point_index"], rows["elapsed_us"], rows["predicted"], strict=True):
            held, found = vote_step(held, i, t, p, window, votes, cooldown_s)
            out.append((key[0], int(i), *found))
        state.update(held)
        yield pd.DataFrame(out, columns=["trajectory_id", "source_point_index", "votes", "gate", "candidate", "emitted"])

    return points.groupBy("trajectory_id").applyInPandasWithState(run, "trajectory_id string, source_point_index long, votes long, gate boolean, candidate boolean, emitted boolean", "i long, t long, recent string, gate boolean, at long", "append", GroupStateTimeout.NoTimeout)


def movement(points: DataFrame) -> DataFrame:
    """Per point: dt, distance, speed, bearing and stop duration, from the state of the point before. For streams that come in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = state.get if state.exists else NO_MOVE, []
        rows = pd.concat(list(frames)).sort_values(["elapsed_us", "source_point_index"], kind="stable")
        for i, t, a, o in zip(rows["source_point_index"], rows["elapsed_us"], rows["latitude"], rows["longitude"], strict=True):
            held, found = move_step(held, t, a, o)
            out.append((key[0], int(i), *found))
        state.update(held)
        yield pd.DataFrame(out, columns=["trajectory_id", "source_point_index", "dt", "distance", "speed", "bearing", "stop_s"])

    return points.groupBy("trajectory_id").applyInPandasWithState(run, "trajectory_id string, source_point_index long, dt double, distance double, speed double, bearing double, stop_s double", "t long, lat double, lon double, bearing double, stop double", "append", GroupStateTimeout.NoTimeout)
