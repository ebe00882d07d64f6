"""Liveness from a heartbeat stream: sessions by window, and transitions by a stateful operator with event-time timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_stream(beats: DataFrame, entity: str, ts: str, seconds: int = 300) -> DataFrame:
    """(entity, started_at, last_at, beats) by session windows of the stream.

    As in batch, a session ends at a silence of more than `seconds`, which is a window's gap of one microsecond more.
    """
    rows = beats.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds")
    out = rows.groupBy(F.session_window(ts, f"{seconds} seconds 1 microsecond").alias("w"), entity).agg(F.min(ts).alias("started_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("beats"))
    return out.select(entity, "started_at", "last_at", "beats")


def transitions(beats: DataFrame, entity: str, ts: str, seconds: int = 300) -> DataFrame:
    """(entity, event, at): became_active at the first heartbeat after silence, became_inactive when it falls silent."""
    rows = beats.select(F.col(entity).cast("string").alias("entity"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", f"{seconds} seconds")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"entity": [key[0]], "event": ["became_inactive"], "at": [pd.Timestamp(last, unit="us") + pd.Timedelta(seconds=seconds)]})
            return
        for at in sorted(int(t.value // 1000) for frame in frames for t in frame["ts"]):
            if last is None:
                out.append(("became_active", at))
            elif at - last > seconds * 1_000_000:
                out += [("became_inactive", last + seconds * 1_000_000), ("became_active", at)]
            last = at if last is None else max(last, at)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"entity": [key[0]] * len(out), "event": [e for e, _ in out], "at": [pd.Timestamp(t, unit="us") for _, t in out]})

    return rows.groupBy("entity").applyInPandasWithState(step, "entity string, event string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def over_limit_stream(events: DataFrame, ts: str, key: str, limit: int = 100, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return out.select(key, F.col("w.start").alias("window_start"), "n")


def activity_stream(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n")
