"""Keyed state that ends by itself: processors for transformWithStateInPandas, in event time.

State lives in the executors' state store and is kept in the shared checkpoint folder; timers
clear what no later row can need, so it grows with the keys that are active, not with time.
A batch's rows of a key come in pieces, of which only numbers are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for queries that start inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class RateLimit(StatefulProcessor):
    """Accepts at most `most` events of a key in `seconds` from the first that no open window
    holds. The state is when the window began and how many it holds; its timer ends it. Within
    a batch events are taken by time; one that comes after later ones of an earlier batch
    counts to the window that is open then."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "began long, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["t"].to_numpy(np.int64), r["event_id"].to_numpy(np.int64)) for r in rows]
        t, event = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((event, t))
        held = self.window.get() if self.window.exists() else None
        before = began = held[0] if held else None
        n, kept = held[1] if held else 0, []
        for at, i in zip(t[order].tolist(), event[order].tolist()):
            if began is None or at - began >= self.seconds:
                began, n = at, 0
            if n < self.most:
                n += 1
                kept.append(i)
        if began != before:
            if before is not None:
                self.handle.deleteTimer((before + self.seconds) * 1000)
            self.handle.registerTimer((began + self.seconds) * 1000)
        self.window.update((began, n))
        yield pd.DataFrame({"user_id": np.full(len(kept), key[0], np.int64), "event_id": np.array(kept, np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield pd.DataFrame({"user_id": np.zeros(0, np.int64), "event_id": np.zeros(0, np.int64)})

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """Days with an event, the last of them and the best total of a key. Days are counted once:
    a day is remembered until the watermark has passed it, when none of its rows can come."""

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "days long, last_day long, best long")
        self.open = handle.getMapState("open", "dn long", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: set[int] = set()
        days, last, best = self.totals.get() if self.totals.exists() else (0, -(2**62), 0)
        for r in rows:
            new.update(r["dn"].unique().tolist())
            best = max(best, int(r["total"].max()))
        for dn in new:
            if not self.open.containsKey((dn,)):
                self.open.updateValue((dn,), (True,))
                self.handle.registerTimer((dn + 1) * DAY_MS)
                days += 1
        last = max(last, *new)
        self.totals.update((days, last, best))
        yield pd.DataFrame({"user_id": [key[0]], "days": [days], "last_day": [last], "best": [best]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.removeKey((expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1,))
        yield pd.DataFrame({c: np.zeros(0, np.int64) for c in ("user_id", "days", "last_day", "best")})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """user_id and event_id of the events (user_id, event_id, t in seconds, ts with a
    watermark) that the limit accepts."""
    by = events.groupBy("user_id")
    return by.transformWithStateInPandas(RateLimit(most, seconds), "user_id long, event_id long", "Append", "EventTime")


def progress(events: DataFrame) -> DataFrame:
    """A row (user_id, days, last_day, best) for each key that a batch of events (user_id, dn,
    total, ts with a watermark) changes."""
    return events.groupBy("user_id").transformWithStateInPandas(Progress(), "user_id long, days long, last_day long, best long", "Update", "EventTime")
