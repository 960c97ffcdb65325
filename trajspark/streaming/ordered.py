"""Stateful processors for streams that come out of order: points wait until their trajectory has moved on, late and repeated ones leave by the side.

A trajectory's own frontier is its newest time less `delay`. Points up to it are released in order of time and folded; one that comes behind it is
late, one of a time that waits already is a duplicate; both are put out as such and never change the fold. An event-time timer
fires when the stream's watermark passes the newest time by `idle`: what waits is released and the state is cleared, so that idle trajectories cost nothing.
Points behind the watermark itself never reach a processor; Spark counts them (see dropped_behind_watermark).

Queries need the RocksDB state store: spark.sql.streaming.stateStore.providerClass = ROCKSDB.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .alerts import NO_MOVE, NO_VOTES, move_step, vote_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POINT, LATE, DUPLICATE = "point", "late", "duplicate"


class Ordered(StatefulProcessor):
    """Holds points back and folds them in order of elapsed_us, then source_point_index. Subclasses say how."""

    fields: tuple[str, ...] = ()
    fold_schema = ""
    none: tuple = ()
    made: tuple[str, ...] = ()

    def __init__(self, delay_us: int, idle_us: int) -> None:
        self.delay_us, self.idle_us = delay_us, idle_us

    def step(self, state: tuple, index: int, time: int, values: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", f"{self.fold_schema}, newest long, frontier long, timer long")
        kinds = {"predicted": "int", "latitude": "double", "longitude": "double"}
        self.waiting = handle.getListState("waiting", "time long, i long, " + ", ".join(f"{f} {kinds[f]}" for f in self.fields))

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["kind", "source_point_index", "elapsed_us", *self.made]).assign(trajectory_id=key[0])[["trajectory_id", "kind", "source_point_index", "elapsed_us", *self.made]]

    def _aside(self, kind: str, row: tuple) -> tuple:
        return (kind, row[1], row[0], *[None] * len(self.made))

    def _released(self, state: tuple, rows: Iterable[tuple]) -> tuple[tuple, list[tuple]]:
        out = []
        for time, index, *values in rows:
            state, found = self.step(state, index, time, tuple(values))
            out.append((POINT, index, time, *found))
        return state, out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.fold.get()
        *state, newest, frontier, timer = held if held is not None else (*self.none, -1, -1, -1)
        new = sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for part in rows for r in part[["elapsed_us", "source_point_index", *self.fields]].itertuples(index=False, name=None))
        waiting, out = {r[0]: tuple(r) for r in self.waiting.get()}, []
        for r in new:
            if r[0] <= frontier:
                out.append(self._aside(LATE, r))
            elif r[0] in waiting:
                first, second = sorted([waiting[r[0]], r], key=lambda x: x[1])  # of equal times the smaller index stays, whichever came first
                waiting[r[0]] = first
                out.append(self._aside(DUPLICATE, second))
            else:
                waiting[r[0]] = r
        newest = max([newest, *[r[0] for r in new]])
        frontier = max(frontier, newest - self.delay_us)
        order = sorted(waiting.values())
        folded, points = self._released(tuple(state), [r for r in order if r[0] <= frontier])
        self.waiting.put([r for r in order if r[0] > frontier])
        due = (newest + self.idle_us) // 1000 + 1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.fold.update((*folded, newest, frontier, due))
        yield self._frame(key, out + points)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.fold.get()
        points: list[tuple] = []
        if held is not None:
            _, points = self._released(tuple(held[:-3]), sorted(tuple(r) for r in self.waiting.get()))
        self.fold.clear()
        self.waiting.clear()
        yield self._frame(key, points)

    def close(self) -> None:
        pass


class Notifier(Ordered):
    fields, none = ("predicted",), NO_VOTES
    fold_schema = "i long, t long, recent string, gate boolean, at long"
    made = ("votes", "gate", "candidate", "emitted")

    def __init__(self, delay_us: int, idle_us: int, window: int, votes: int, cooldown_s: int) -> None:
        super().__init__(delay_us, idle_us)
        self.policy = (window, votes, cooldown_s)

    def step(self, state: tuple, index: int, time: int, values: tuple) -> tuple[tuple, tuple]:
        return vote_step(state, index, time, values[0], *self.policy)


class Mover(Ordered):
    fields, none = ("latitude", "longitude"), NO_MOVE
    fold_schema = "t long, lat double, lon double, bearing double, stop double"
    made = ("dt", "distance", "speed", "bearing", "stop_s")

    def step(self, state: tuple, index: int, time: int, values: tuple) -> tuple[tuple, tuple]:
        return move_step(state, time, *values)


def _run(points: DataFrame, processor: Ordered, made: str, watermark: str) -> DataFrame:
    """points need timestamp (its microseconds are elapsed_us from a start of one's own choice), elapsed_us and source_point_index."""
    rows = points.withWatermark("timestamp", watermark)
    return rows.groupBy("trajectory_id").transformWithStateInPandas(processor, f"trajectory_id string, kind string, source_point_index long, elapsed_us long, {made}", "append", "eventTime")


def timed(points: DataFrame) -> DataFrame:
    """elapsed_us as the timestamp column that watermarks and timers count by."""
    return points.withColumn("timestamp", F.timestamp_micros("elapsed_us"))


def notifications(points: DataFrame, window: int, votes: int, cooldown_s: int, delay_s: float = 600, idle_s: float = 3600, watermark: str = "1 hour") -> DataFrame:
    """Per point: votes, gate, candidate and emitted; `kind` tells points from what left by the side (late, duplicate: the made columns are null)."""
    return _run(timed(points), Notifier(int(delay_s * 1e6), int(idle_s * 1e6), window, votes, cooldown_s), "votes long, gate boolean, candidate boolean, emitted boolean", watermark)


def movement(points: DataFrame, delay_s: float = 600, idle_s: float = 3600, watermark: str = "1 hour") -> DataFrame:
    """Per point: dt, distance, speed, bearing and stop duration, with `kind` as in notifications."""
    return _run(timed(points), Mover(int(delay_s * 1e6), int(idle_s * 1e6)), "dt double, distance double, speed double, bearing double, stop_s double", watermark)


def side_counts(out: DataFrame) -> DataFrame:
    """Rows by trajectory and kind."""
    return out.groupBy("trajectory_id", "kind").agg(F.count("*").alias("rows"))


def dropped_behind_watermark(progress: Iterable[Any]) -> int:
    """Rows that Spark itself dropped behind the watermark, over the progress reports of a query."""
    return sum(int(operator["numRowsDroppedByWatermark"]) for report in progress for operator in report["stateOperators"])
