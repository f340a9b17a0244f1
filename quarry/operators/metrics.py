"""Operational metrics: health, operations, locks, requests, retries, errors, rate limits.

Logs are kept by client or monitor, of which there are many: windows are within one of them, and what looks at the last
n rows keeps n rows before it sorts.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ellipsis, error_class, retryable
from quarry.operators.folds import fold


def last_n(rows: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The last n rows of each key with ``recency``, 1 for the last one."""
    newest_first = [F.col(c).desc() for c in order]
    return rows.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).where(F.col("recency") <= n)


def consecutive_failures(checks: DataFrame) -> DataFrame:
    """checks: monitor, ts, event_id, healthy. With the failures in a row up to each check."""
    order = Window.partitionBy("monitor").orderBy("ts", "event_id")
    island = F.sum(F.col("healthy").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy("monitor", "island").orderBy("ts", "event_id")
    marked = checks.withColumn("island", island)
    return marked.withColumn("in_a_row", F.sum((~F.col("healthy")).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("island")


def health_metrics(checks: DataFrame) -> DataFrame:
    """Per monitor: checks, failures, mean response of the healthy ones, and failures in a row at the end.

    The tail is counted without sorting: failures after the last healthy check."""
    moment = F.struct("ts", "event_id")
    sums = checks.groupBy("monitor").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("healthy"), 1)).alias("healthy"), F.count(F.when(~F.col("healthy"), 1)).alias("failed"),
        F.avg(F.when(F.col("healthy"), F.col("ms"))).alias("avg_ms"), F.max(F.when(F.col("healthy"), moment)).alias("last_good"),
    )
    joined = checks.where(~F.col("healthy")).join(sums.select("monitor", "last_good"), "monitor")
    tail = joined.where(F.col("last_good").isNull() | (moment > F.col("last_good"))).groupBy("monitor").agg(F.count("*").alias("consecutive"))
    return sums.drop("last_good").join(tail, "monitor", "left").withColumn("consecutive", F.coalesce("consecutive", F.lit(0)))


def health_score(metrics: DataFrame) -> DataFrame:
    """Success rate less 10 a failure in a row, 50 at most, less a tenth of the mean beyond 50 ms, 20 at most."""
    rate = 100 * F.col("healthy") / F.col("total")
    slow = F.least(F.lit(20.0), F.greatest(F.lit(0.0), (F.coalesce("avg_ms", F.lit(0.0)) - 50) / 10))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rate - F.least(10 * F.col("consecutive"), F.lit(50)) - slow))
    out = metrics.withColumn("score", score)
    level = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 50, "fair").otherwise("poor")
    return out.withColumn("summary", level)


def health_history(checks: DataFrame, n: int = 100) -> DataFrame:
    """Per monitor, of its last n checks: how many, failures, the mean response of the healthy ones, failures in a row at the
    end, and the last one."""
    last = last_n(checks, ["monitor"], n, "ts", "event_id")
    good = F.when(F.col("healthy"), F.col("recency"))
    return last.groupBy("monitor").agg(
        F.count("*").alias("checks"), F.count(F.when(~F.col("healthy"), 1)).alias("failed"), F.avg(F.when(F.col("healthy"), F.col("ms"))).alias("avg_ms"),
        (F.coalesce(F.min(good), F.count("*") + 1) - 1).alias("consecutive"), F.min_by("event_id", "recency").alias("last_event"),
    )


def trend(checks: DataFrame, n: int = 5) -> DataFrame:
    """monitor, trend: the healthy ones of the last n checks, the last against the first."""
    last = last_n(checks, ["monitor"], n, "ts", "event_id")
    ends = last.groupBy("monitor").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("healthy"), 1)).alias("good"),
        F.max_by("ms", F.when(F.col("healthy"), F.col("recency"))).alias("first_ms"), F.min_by("ms", F.when(F.col("healthy"), F.col("recency"))).alias("last_ms"),
    )
    verdict = F.when((F.col("n") < n) | (F.col("good") < 2), "insufficient_data").when(F.col("last_ms") > 1.5 * F.col("first_ms"), "degrading").when(F.col("last_ms") < 0.7 * F.col("first_ms"), "improving").otherwise("stable")
    return ends.select("monitor", verdict.alias("trend"))


def operation_metrics(log: DataFrame) -> DataFrame:
    ms = F.col("ms")
    return log.groupBy("operation").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("ok"), 1)).alias("succeeded"), F.count(F.when(~F.col("ok"), 1)).alias("failed"),
        F.sum(ms).alias("sum_ms"), F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    )


def lock_frequency(log: DataFrame, now: Column, keep: int = 50, top: int = 5) -> DataFrame:
    """operation, locks, last_hour, total: of the last ``keep`` lock events, the operations with the most."""
    last = log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(keep)
    recent = F.col("ts") >= now - F.expr("INTERVAL 1 HOUR")
    by = last.groupBy("operation").agg(F.count("*").alias("locks"), F.count(F.when(recent, 1)).alias("last_hour"))
    total = by.agg(F.sum("locks").alias("total"))
    return by.crossJoin(total).orderBy(F.col("locks").desc(), "operation").limit(top)


def recent_locks(log: DataFrame, n: int = 10, cut: int = 500) -> DataFrame:
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).select("event_id", "operation", ellipsis(F.col("message"), cut).alias("message"))


def request_metrics(requests: DataFrame, keep: int = 1000) -> DataFrame:
    """Per client: requests, error rate, mean, and the 95th and 99th percentile of the last ``keep``, each an element of
    the sorted times at floor(q * n), counted from 0."""
    sums = requests.groupBy("client").agg(F.count("*").alias("requests"), F.avg((F.col("status") >= 400).cast("double")).alias("error_rate"), F.avg("seconds").alias("avg_seconds"))
    times = last_n(requests, ["client"], keep, "ts", "event_id").groupBy("client").agg(F.sort_array(F.collect_list("seconds")).alias("t"))  # at most ``keep`` each
    at = lambda q: F.element_at("t", F.least(F.floor(F.lit(q) * F.size("t")) + 1, F.size("t")).cast("int"))
    return sums.join(times, "client").select("client", "requests", "error_rate", "avg_seconds", at(0.95).alias("p95"), at(0.99).alias("p99"))


def retry_stats(log: DataFrame) -> DataFrame:
    """One row: operations, shares that succeeded and that did so after a retry, attempts on average; rounded to 2."""
    retried = F.col("ok") & (F.col("attempts") > 1)
    percent = lambda c: F.bround(100 * F.avg(c.cast("double")), 2)
    return log.agg(F.count("*").alias("operations"), percent(F.col("ok")).alias("success_percent"), percent(retried).alias("retry_percent"), F.bround(F.avg("attempts"), 2).alias("avg_attempts"))


def error_stats(log: DataFrame) -> DataFrame:
    """error_class, errors, retryable: how often each class occurs."""
    return log.groupBy(error_class(F.col("message")).alias("error_class"), retryable(F.col("message")).alias("retryable")).agg(F.count("*").alias("errors"))


def top_messages(log: DataFrame, n: int = 5) -> DataFrame:
    return log.groupBy("message").agg(F.count("*").alias("errors")).orderBy(F.col("errors").desc(), "message").limit(n)


def rate_window(requests: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """One row: clients with a request in the window, and those requests."""
    inside = F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds))
    return requests.agg(F.countDistinct(F.when(inside, F.col("client"))).alias("active_clients"), F.count(F.when(inside, 1)).alias("requests_in_window"))


def rate_decisions(requests: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """requests (client, ts, event_id) with accepted and retry_after: at most ``limit`` accepted ones of a client in any
    ``seconds``; a refused one is told after how many the oldest of them leaves the window.

    A fold over a client's requests in order; the state is the times of the accepted ones still in the window."""
    span = seconds * 1_000_000

    def step(taken: deque, row: dict) -> tuple[bool, int]:
        while taken and taken[0] <= row["t"] - span:
            taken.popleft()
        if len(taken) >= limit:
            return False, int((taken[0] + span - row["t"]) / 1e6) + 1
        taken.append(row["t"])
        return True, 0

    timed = requests.select("client", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    told = fold(timed, ["client"], ["t", "event_id"], deque, step, "accepted boolean, retry_after long")
    return told.select("client", "event_id", "accepted", "retry_after")


def rate_limited(requests: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Per client requests, accepted ones, and the largest id of these, as ``rate_decisions`` says."""
    told = rate_decisions(requests, limit, seconds)
    return told.groupBy("client").agg(F.count("*").alias("requests"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.max(F.when(F.col("accepted"), F.col("event_id"))).alias("last_accepted"))


def debounced(changes: DataFrame, seconds: float = 0.1) -> DataFrame:
    """changes: path, ts, event_id. Events at least ``seconds`` after the last accepted one of their path."""
    gap = int(seconds * 1e6)

    def step(last: list, row: dict) -> tuple[bool]:
        if last and row["t"] - last[0] < gap:
            return (False,)
        last[:] = [row["t"]]
        return (True,)

    timed = changes.select("path", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return fold(timed, ["path"], ["t", "event_id"], list, step, "accepted boolean").where("accepted").select("path", "event_id")


def settled(changes: DataFrame, seconds: float = 0.1) -> DataFrame:
    """path, session, events, last_event: events closer than ``seconds`` to the one before are one; the last one counts."""
    order = Window.partitionBy("path").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce(micros - F.lag(micros).over(order) > int(seconds * 1e6), F.lit(True)).cast("int")
    numbered = changes.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "session").agg(F.count("*").alias("events"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
