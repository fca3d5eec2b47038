"""Streams over the observation log; each equals its batch twin when it has read all files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def first_last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def changes(events: DataFrame) -> DataFrame:
    """(user_id, event_id, change): each observation against the key's latest content, which is all the state there is."""

    def classify(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, content in zip(rows["event_id"], rows["event_type"], strict=True):
            out.append((key[0], event, "new" if last is None else "existing" if last == content else "changed"))
            last = content
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "change"])

    return events.groupBy("user_id").applyInPandasWithState(classify, "user_id long, event_id long, change string", "content string", "append", GroupStateTimeout.NoTimeout)


def pending(events: DataFrame, wait: str = "15 minutes", late: str = "1 minute") -> DataFrame:
    """(user_id, event_id, outcome): each ``ask`` is answered by the key's next event, or expires when the watermark has passed ``wait`` after it.

    The state of a key is its open question, and it is dropped with the answer or
    by the time-out.
    """
    from datetime import timedelta

    amount, unit = wait.split()
    span = timedelta(**{unit if unit.endswith("s") else f"{unit}s": int(amount)})

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        open_id, asked = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            out.append((key[0], open_id, "expired"))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for event, kind, ts in zip(rows["event_id"], rows["event_type"], rows["ts"], strict=True):
                if open_id is not None:
                    out.append((key[0], open_id, "expired" if ts - asked >= span else "answered"))
                    open_id = None
                if kind == "ask":
                    open_id, asked = event, ts
            if open_id is None:
                if state.exists:
                    state.remove()
            else:
                state.update((open_id, asked))
                state.setTimeoutTimestamp(int((asked + span).timestamp() * 1000))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(settle, "user_id long, event_id long, outcome string", "event_id long, asked timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def once(events: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None, slide: str | None = None) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
