"""Structured Streaming twins of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
# Which status follows which event; a finished job stays finished.
NEXT = {"view": "running", "click": "running", "signup": "queued", "purchase": "done", "error": "failed"}
FINAL = {"done", "failed"}


def read_events(spark: SparkSession, folder: str, after: int = -1, files: int = 1) -> DataFrame:
    """Events of parquet files as they arrive, after an offset. Where a reader stands is kept by the query's checkpoint."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder).where(F.col("event_id") > after)


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and value by time window and kind; rows later than the watermark are dropped, closed windows are emitted once."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _machine(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seen, offset = state.get if state.exists else ("queued", 0, -1)
    rows = pd.concat(list(parts)).sort_values("event_id")
    for event_id, kind in zip(rows["event_id"], rows["event_type"]):
        if event_id <= offset:
            continue
        seen, offset = seen + 1, int(event_id)
        if status not in FINAL:
            status = NEXT.get(kind, status)
    state.update((status, seen, offset))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "events": [seen], "offset": [offset]})


def job_states(events: DataFrame) -> DataFrame:
    """State machine per user: queued, running, done or failed; events replayed below the offset already seen change nothing."""
    return events.groupBy("user_id").applyInPandasWithState(_machine, "user_id long, status string, events long, offset long", "status string, events long, offset long", "update", GroupStateTimeout.NoTimeout)


def append_new(target: str):
    """A writer for foreachBatch: each batch goes to its own folder, so a batch repeated after a failure overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write
