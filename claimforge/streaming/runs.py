"""Streaming twins of the run lifecycle (T1, T2), and windowed counts as an extension; polling.py has T3, T6, K5 and K6.

The reference has no watermarks or windows; windowed() is labelled an extension. State lives in Spark's
state store; persisted() keeps it in shared storage (T7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import fold


def lifecycle(events: DataFrame, keys: list[str]) -> DataFrame:
    """The batch fold over a stream, in complete or update mode; its state is one row a key."""
    return fold(events, keys)


def persisted(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """The stream's rows as Parquet files at path; offsets and state go to checkpoint, in shared storage, so that
    a restarted query goes on where it was and writes no row twice. Returns the started query."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: events by type in tumbling windows; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def once_per_run(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Extension: each status of a run once, with bounded state; a status that comes back within the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "status"])


def confirmations(requests: DataFrame, seconds: int = 30) -> DataFrame:
    """One row a session when it is confirmed, or when its deadline passes without editing.

    requests has session_id, action (request, editing, confirm) and ts; the deadline is a processing-time timer."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        action = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "state": ["auto_confirmed"]})
            return
        for frame in frames:
            for a in frame.sort_values("ts")["action"]:
                action = a
        if action == "confirm":
            if state.exists:
                state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "state": ["confirmed"]})
            return
        state.update((action,))
        if action != "editing":
            state.setTimeoutDuration(seconds * 1000)

    return requests.groupBy("session_id").applyInPandasWithState(step, "session_id string, state string", "action string", "append", GroupStateTimeout.ProcessingTimeTimeout)
