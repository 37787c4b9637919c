"""Event streams: the same transformations for a table and for a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark, which needs a timestamp with a time zone; a table stays."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each event type in windows of ``width``."""
    grouped = _timed(events, late)
    out = grouped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    grouped = _timed(events, late)
    out = grouped.groupBy(F.window("ts", width, every).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    grouped = _timed(events, late)
    out = grouped.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into an in-memory table (tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total, last) of each user so far: a table once, a stream after every batch.

    A stream keeps a user's count, sum and last time as state and adds to it what a batch
    brings, so no event is kept. Output mode ``update``.
    """
    if not events.isStreaming:
        return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max(F.col("ts").cast("timestamp")).alias("last"))

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for b in batches:
            n, total, last = n + len(b), total + float(b["value"].sum()), max(last, int(b["us"].max()))
        state.update((n, total, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "last": [last]})

    rows = events.select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = rows.groupBy("user_id").applyInPandasWithState(
        add, "user_id long, n long, total double, last long", "n long, total double, last long", "update", GroupStateTimeout.NoTimeout
    )
    return out.withColumn("last", F.timestamp_micros("last"))
