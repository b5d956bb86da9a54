"""Structured Streaming over events: windows, sessions and gaps with late data. The batch forms give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet files of events as they arrive, `files` a trigger; ts as an instant in UTC."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` behind the newest are left out of a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """A user's events no more than `gap` apart as one session."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )


def frequencies(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A running frequency table, for complete or update mode."""
    return events.withWatermark("ts", late).groupBy("event_type").agg(F.count("*").alias("n"))


GAPS = "event_type string, n long, mean double, sd double, burstiness double"


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Gaps' number, sum and sum of squares and the last instant: a few numbers of state for each type."""
    last, n, s, q = state.get if state.exists else (None, 0, 0.0, 0.0)
    times = sorted(t for b in batches for t in b["t"].tolist())
    for t in times:
        if last is not None and t >= last:
            n, s, q = n + 1, s + (t - last), q + (t - last) ** 2
        last = t if last is None else max(last, t)
    state.update((last, n, s, q))
    if n:
        mean = s / n
        sd = max(q / n - mean * mean, 0.0) ** 0.5
        b = (sd - mean) / (sd + mean) if sd + mean > 0 else 0.0
        yield pd.DataFrame([(key[0], n, mean, sd, b)], columns=["event_type", "n", "mean", "sd", "burstiness"])


def gaps(events: DataFrame) -> DataFrame:
    """Burstiness of the seconds between events of a type, updated with every batch; events that arrive out of order
    across batches count from the newest instant before them."""
    timed = events.withColumn("t", F.unix_micros("ts") / 1e6)
    return timed.groupBy("event_type").applyInPandasWithState(
        _gaps, GAPS, "last double, n long, s double, q double", "update", GroupStateTimeout.NoTimeout
    )
