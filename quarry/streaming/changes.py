"""File events and requests as streams. Each query has a batch twin, which its tests compare it with.

Events carry their own time; a watermark of ten seconds bounds the state, and later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.text import change_type
from quarry.operators.tree import CODE_EXTENSIONS
from quarry.operators.vectors import delete_files, replace_by_file

LATE = "10 seconds"


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files that arrive in a folder; how many a batch takes bounds its size, and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def classify(raw: DataFrame) -> DataFrame:
    """raw: path, event, ts, event_id, dest. With change_type; events of other kinds go. A move keeps both paths."""
    kind = change_type(F.col("event"))
    return raw.withColumn("change_type", kind).where("change_type IS NOT NULL").withColumn("old_path", F.when(F.col("change_type") == "moved", F.col("path"))).drop("event")


def count_by_type(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("events"))


def code_changes(changes: DataFrame) -> DataFrame:
    return changes.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*CODE_EXTENSIONS))


def leading(changes: DataFrame, seconds: float = 0.1) -> DataFrame:
    """path, event_id: events at least ``seconds`` after the last accepted one of their path. The state is that time, and
    goes once the watermark has passed it by more than ``seconds``: then it can't hold back any event."""
    gap = int(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        took = []
        rows = pd.concat(list(batches)).sort_values(["micros", "event_id"])
        for micros, event_id in zip(rows["micros"], rows["event_id"], strict=True):
            if last is None or micros - last >= gap:
                last = int(micros)
                took.append(int(event_id))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"path": [key[0]] * len(took), "event_id": took})

    timed = changes.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE).withColumn("micros", F.unix_micros("at"))
    return timed.select("path", "event_id", "at", "micros").groupBy("path").applyInPandasWithState(step, "path string, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def trailing(changes: DataFrame, gap: str = "100 milliseconds") -> DataFrame:
    """path, events, last_event: the last event of each burst, once the burst is over."""
    timed = changes.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    bursts = timed.groupBy("path", F.session_window("at", gap)).agg(F.count("*").alias("events"), F.max_by("event_id", F.struct("at", "event_id")).alias("last_event"))
    return bursts.select("path", "events", "last_event")


def running_health(checks: DataFrame) -> DataFrame:
    """Per monitor: checks, failures and the mean response of the healthy ones so far."""
    return checks.groupBy("monitor").agg(
        F.count("*").alias("total"), F.count(F.when(~F.col("healthy"), 1)).alias("failed"), F.avg(F.when(F.col("healthy"), F.col("ms"))).alias("avg_ms")
    )


def apply_changes(stored: DataFrame, changes: DataFrame, index: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A batch of changes (project_id, file_path, change_type, ts, event_id) applied to stored vectors: of each file the
    last change counts; deleted files lose theirs, others get what ``index`` makes of them."""
    last = changes.groupBy("project_id", "file_path").agg(F.max_by("change_type", F.struct("ts", "event_id")).alias("change_type"))
    kept = delete_files(stored, last.where(F.col("change_type") == "deleted"))
    return replace_by_file(kept, index(last.where(F.col("change_type") != "deleted")))


def sink(changes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``write`` on each batch of what has arrived, once."""
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
