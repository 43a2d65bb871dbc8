"""Streaming forms of the log queries, over a file source; each has a batch form in operators.events to test against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_events(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first event of each id; ids older than the watermark are forgotten."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, user: str, ts: str, late: str = "1 day") -> DataFrame:
    """Events a user and day, given out when the day is closed."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, "1 day"), user).agg(F.count("*").alias("n")).select(user, F.to_date("window.start").alias("day"), "n")


def sessions(events: DataFrame, user: str, ts: str, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Closed sessions (user, begin, end, n). A gap of exactly the time to live parts two sessions, which
    session_window would join; so the state is kept by hand. Within a batch events are taken in the order of time, and
    one that comes later than the watermark is left out."""
    gap = minutes * 60_000_000
    src = events.select(F.col(user).cast("string").alias("u"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    src = src.withColumn("t", F.unix_micros("ts"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        begin, end, n = state.get if state.exists else (None, None, 0)
        if not state.hasTimedOut:
            for t in sorted(t for p in parts for t in p.t.tolist()):
                if n and t - end < gap and begin - t < gap:
                    begin, end, n = min(begin, t), max(end, t), n + 1
                else:
                    if n:
                        done.append((key[0], begin, end, n))
                    begin, end, n = t, t, 1
        mark = state.getCurrentWatermarkMs()
        if n and mark * 1000 >= end + gap:
            done.append((key[0], begin, end, n))
            n = 0
        if n:
            state.update((begin, end, n))
            state.setTimeoutTimestamp(max((end + gap) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["user", "begin", "end", "n"])

    out, kept = "user string, begin long, end long, n long", "begin long, end long, n long"
    return src.groupBy("u").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_all(df: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that is there, in micro batches, as parquet files."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_batches(df: DataFrame, out: str, checkpoint: str, allowed: list[str]) -> None:
    """Each micro batch appended as JSON lines, a repeated batch written over its first try."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select(*allowed).write.mode("overwrite").json(f"{out}/batch={number}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
