"""Sliding-window rate limit. A refused request doesn't use up quota, so a count over a window would be wrong: it is a fold."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Window:
    """Times of one key's accepted requests, at most `most` of them."""

    def __init__(self, most: int, seconds: float, held=()):
        self.most, self.seconds, self.held = most, seconds, deque(held)

    def allow(self, at: float) -> bool:
        while self.held and self.held[0] <= at - self.seconds:
            self.held.popleft()
        if self.most <= 0:
            return True
        if len(self.held) >= self.most:
            return False
        self.held.append(at)
        return True


def rate_limit(events: DataFrame, key: str, seconds: Column, most: int = 30, window: float = 60.0) -> DataFrame:
    """key, at, allowed for each event. `most` of 0 or less lets all pass; events without a time are left out.

    Decisions of a key depend on one another, so a key's events go by in time order in one task; they are sorted by
    Spark, which spills, and read as a stream that keeps the accepted times of one key only.
    """
    rows = events.select(F.col(key), seconds.cast("double").alias("at")).filter("at is not null").repartition(key).sortWithinPartitions(key, "at")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), Window(most, window)
        for frame in frames:
            allowed = []
            for k, at in zip(frame[key], frame["at"], strict=True):
                if not (k == current or (pd.isna(k) and current is None)):
                    current, held = None if pd.isna(k) else k, Window(most, window)
                allowed.append(held.allow(at))
            yield frame.assign(allowed=allowed)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())]))
