"""Limits and sessions over a stream of events (event_id, ts, user_id, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3600


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rolling_admissions(events: DataFrame, limit: int, horizon: int = HOUR, late: str = "10 minutes") -> DataFrame:
    """event_id, user_id, ts, admitted, retry_after (seconds): an event is admitted while fewer than `limit` admitted ones of the same user lie within the horizon; refused events don't count.

    The state is the times of admitted events in the horizon: `limit` numbers a user at most, dropped when the watermark
    is past the horizon of the last. Events of one micro-batch are taken in the order of time and id; events later than `late` are dropped.
    """
    out = "event_id long, user_id long, ts timestamp, admitted boolean, retry_after double"

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        admitted, wait = [], []
        for at in (rows["ts"].astype("int64") / {"ns": 1e9, "us": 1e6, "ms": 1e3}[rows["ts"].dt.unit]).tolist():
            held = [t for t in held if t > at - horizon]
            ok = len(held) < limit
            admitted.append(ok)
            wait.append(0.0 if ok else held[0] + horizon - at)
            if ok:
                held.append(at)
        state.update((held,))
        state.setTimeoutTimestamp(max(int((rows["ts"].max().timestamp() + horizon) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "ts": rows["ts"], "admitted": admitted, "retry_after": wait})

    timed = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(admit, out, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by UTC day, with a watermark: a day is final when the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("events")).select(F.to_date("window.start").alias("day"), "events")


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions by user that end after a gap; a session is final when the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ends"), "events")


def first_of_run(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each user and type; repeats within the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(["user_id", "event_type"])


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over all that is there and stops. path and checkpoint lie in a folder that all executors share."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
