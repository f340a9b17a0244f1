"""Streams with state of their own: rate limits and health histories, as stateful processors.

State lies in RocksDB, which ``transformWithState`` needs; ``with_rocks`` sets it where a session doesn't. A key's state is a
list of bounded length, and a timer in event time drops what an idle key has left.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quarry.session import ROCKS

LATE = "10 seconds"


def with_rocks(rows: DataFrame) -> DataFrame:
    conf = rows.sparkSession.conf
    if "RocksDB" not in (conf.get("spark.sql.streaming.stateStore.providerClass") or ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["micros", "event_id"])


class RateLimit(StatefulProcessor):
    """At most ``limit`` accepted requests of a key in any ``seconds``; refused ones don't count. The state is the times of
    the accepted ones in the window, oldest first: a batch takes expired ones from the front and appends its own."""

    def __init__(self, limit: int, seconds: int, idle: int):
        self.limit, self.span, self.idle_ms = limit, seconds * 1_000_000, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.taken = handle, handle.getListState("taken", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = deque(t for (t,) in self.taken.get())
        stored, kept, out = len(held), len(held), []
        requests = _in_order(rows)
        for micros, event_id in zip(requests["micros"].tolist(), requests["event_id"].tolist(), strict=True):
            while held and held[0] <= micros - self.span:
                held.popleft()
                kept -= 1
            ok = len(held) < self.limit
            out.append((key[0], event_id, ok, 0 if ok else int((held[0] + self.span - micros) / 1e6) + 1))
            if ok:
                held.append(micros)
        kept = max(kept, 0)
        fresh = [(t,) for t in held][kept:]
        if kept < stored:
            self.taken.put([(t,) for t in held])
        elif fresh:
            self.taken.appendList(fresh)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        latest = int(requests["micros"].max()) // 1000
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=["client", "event_id", "accepted", "retry_after"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.taken.clear()
        return iter([])


class HealthRing(StatefulProcessor):
    """A ring of a monitor's last ``size`` checks. After each batch: what the ring says."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "micros long, event_id long, healthy boolean, ms double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        checks = _in_order(rows)
        fresh = list(zip(checks["micros"].tolist(), checks["event_id"].tolist(), checks["healthy"].tolist(), checks["ms"].tolist(), strict=True))
        before = list(self.ring.get())
        ring = sorted([*before, *fresh], key=lambda c: c[:2])[-self.size :]
        if [*before, *fresh] == ring:
            self.ring.appendList(fresh)
        else:
            self.ring.put(ring)
        good = [c[3] for c in ring if c[2] and c[3] is not None and c[3] == c[3]]
        last_good = max((k for k, c in enumerate(ring) if c[2]), default=-1)
        yield pd.DataFrame([(key[0], len(ring), sum(not c[2] for c in ring), sum(good) / len(good) if good else None, len(ring) - 1 - last_good, ring[-1][1])], columns=["monitor", "checks", "failed", "avg_ms", "consecutive", "last_event"])


def _timed(rows: DataFrame, *columns: str) -> DataFrame:
    at = with_rocks(rows).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    return at.select(*columns, "event_id", "at", F.unix_micros("at").alias("micros"))


def limited(requests: DataFrame, limit: int = 100, seconds: int = 60, idle: int = 120) -> DataFrame:
    """client, event_id, accepted, retry_after: requests (client, ts, event_id) under a limit. A client idle for ``idle``
    seconds leaves no state; its batch twin is ``metrics.rate_decisions``."""
    grouped = _timed(requests, "client").groupBy("client")
    return grouped.transformWithStateInPandas(RateLimit(limit, seconds, idle), "client string, event_id long, accepted boolean, retry_after long", "append", "EventTime")


def health_history(checks: DataFrame, size: int = 100) -> DataFrame:
    """monitor, checks, failed, avg_ms, consecutive, last_event: of each monitor that a batch has checks (monitor, ts,
    event_id, healthy, ms) of, its last ``size``. The batch twin is ``metrics.health_history``."""
    grouped = _timed(checks, "monitor", "healthy", "ms").groupBy("monitor")
    return grouped.transformWithStateInPandas(HealthRing(size), "monitor long, checks long, failed long, avg_ms double, consecutive long, last_event long", "update", "None")
