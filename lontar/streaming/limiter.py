"""The rate limiter over a stream: keyed state holds the accepted times, and goes after a while without events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lontar.operators.limiter import Window

#: Decisions that go out at a time.
_ROWS = 10_000


def stream_rate_limit(events: DataFrame, key: str, at: str, most: int = 30, window: float = 60.0, late: str | None = None) -> DataFrame:
    """key, at, allowed. Within a trigger a key's events are taken in time order, however many Arrow batches they come in; only
    their times are held for that.

    State of idle keys goes, which changes nothing, as all its times would have been forgotten. By default a key that is idle
    for two windows of processing time loses it; such a query stays awake for its timeouts. With `late` (an interval, `at` a
    timestamp after 1970) state goes when the watermark passes the window, events later than that are left out, and a query over
    all that is available ends.
    """
    timed = events.withWatermark(at, late) if late else events
    rows = timed.select(key, F.col(at).cast("double").alias("at"), *([F.col(at).alias("_ts")] if late else []))
    out = T.StructType([f for f in rows.schema.fields if f.name != "_ts"] + [T.StructField("allowed", T.BooleanType())])

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = Window(most, window, state.get[0] if state.exists else ())
        times = np.sort(np.concatenate([f["at"].to_numpy(float) for f in frames]))
        allowed = np.array([held.allow(t) for t in times.tolist()])
        for k in range(0, len(times), _ROWS):
            part = slice(k, k + _ROWS)
            yield pd.DataFrame({key: [group[0]] * len(times[part]), "at": times[part], "allowed": allowed[part]})
        state.update((list(held.held),))
        if late:
            state.setTimeoutTimestamp(max(int(1000 * (times[-1] + window)), state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(int(2000 * window))

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, "held array<double>", "append", timeout)


class _InTimeOrder(StatefulProcessor):
    """Holds events until the watermark has passed them, then decides in time order; a timer stands at a key's next event."""

    def __init__(self, key: str, most: int, window: float):
        self.key, self.most, self.window = key, most, window

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double")
        self.accepted = handle.getValueState("accepted", "held array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.concatenate([f["at"].to_numpy(float) for f in rows])
        self.waiting.appendList([(t,) for t in times.tolist()])
        self.handle.registerTimer(int(np.ceil(1000 * times.min())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        times = np.sort(np.array([t for (t,) in self.waiting.get()], float))
        due, rest = times[times <= passed], times[times > passed]
        held = Window(self.most, self.window, self.accepted.get()[0] if self.accepted.exists() else ())
        for k in range(0, len(due), _ROWS):
            part = due[k : k + _ROWS]
            yield pd.DataFrame({self.key: [key[0]] * len(part), "at": part, "allowed": [held.allow(t) for t in part.tolist()]})
        if len(rest):
            self.waiting.put([(t,) for t in rest.tolist()])
            self.handle.registerTimer(int(np.ceil(1000 * rest[0])))
        else:
            self.waiting.clear()
        if len(due):
            self.accepted.update((list(held.held),))
            self.handle.registerTimer(int(np.ceil(1000 * (due[-1] + self.window))))
        elif self.accepted.exists() and (not held.held or held.held[-1] <= passed - self.window):
            self.accepted.clear()

    def close(self) -> None:
        pass


def ordered_rate_limit(events: DataFrame, key: str, at: str, late: str, most: int = 30, window: float = 60.0) -> DataFrame:
    """key, at, allowed, as rate_limit gives them, also if events come late by up to `late` and in other triggers: each waits
    until the watermark has passed it, so decisions are late by as much. Events later than the watermark are left out.

    `at` is a timestamp after 1970. A key holds the times that wait, which `late` bounds, and at most `most` accepted ones; the
    latter go a window after its last decision. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.filter(F.col(at).isNotNull()).withWatermark(at, late).select(key, F.col(at).cast("double").alias("at"), F.col(at).alias("_ts"))
    out = T.StructType([f for f in rows.schema.fields if f.name != "_ts"] + [T.StructField("allowed", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(_InTimeOrder(key, most, window), out, "append", "EventTime")
