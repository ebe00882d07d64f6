"""Heartbeats, liveness sweeps and spans of availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heartbeat_fold(beats: DataFrame, entity: str, ts: str) -> DataFrame:
    """The last heartbeat of each entity, which is active by it."""
    return beats.groupBy(entity).agg(F.max(ts).alias("last_heartbeat")).withColumn("status", F.lit("active"))


def became_active(beats: DataFrame, entity: str, ts: str, seconds: int = 300) -> DataFrame:
    """The heartbeats that turn an entity active: its first one, and those after a silence of more than so many seconds."""
    before = F.lag(ts).over(Window.partitionBy(entity).orderBy(ts))
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(before)
    return beats.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > seconds * 1_000_000)).drop("__gap")


def liveness_sweep(entities: DataFrame, as_of: Column, seconds: int = 300, entity: str = "entity_id") -> DataFrame:
    """Ids that are active and whose last heartbeat is missing or older than so many seconds at as_of."""
    stale = F.col("last_heartbeat").isNull() | (F.unix_micros("last_heartbeat") < F.unix_micros(as_of) - seconds * 1_000_000)
    return entities.where((F.col("status") == "active") & stale).select(entity, "last_heartbeat")


def apply_sweep(entities: DataFrame, swept: DataFrame, entity: str = "entity_id") -> DataFrame:
    out = entities.join(swept.select(entity, F.lit(True).alias("__stale")), entity, "left")
    return out.withColumn("status", F.when(F.col("__stale"), "inactive").otherwise(F.col("status"))).drop("__stale")


def active_sessions(beats: DataFrame, entity: str, ts: str, seconds: int = 300) -> DataFrame:
    """(entity, started_at, last_at, beats): spans with no silence of more than so many seconds."""
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(Window.partitionBy(entity).orderBy(ts)))
    opens = beats.withColumn("__open", F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0))
    order = Window.partitionBy(entity).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = opens.withColumn("__session", F.sum("__open").over(order))
    return numbered.groupBy(entity, "__session").agg(F.min(ts).alias("started_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("beats")).drop("__session")


def availability_of(status: Column) -> Column:
    """online 1.0, degraded 0.5, anything else 0."""
    return F.when(status == "online", 1.0).when(status == "degraded", 0.5).otherwise(0.0)
