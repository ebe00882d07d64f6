"""What has run out: tombstones and records that were not refreshed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOMBSTONE_SECONDS = 7 * 86_400
RECORD_SECONDS = 86_400
CARD_SECONDS = 3_600


def expire_tombstones(df: DataFrame, as_of: Column, expires_at: Column | None = None, seconds: int = TOMBSTONE_SECONDS) -> DataFrame:
    """Rows that stay at as_of: live ones, and tombstoned ones whose time isn't over (expires_at, or so long after tombstone_at)."""
    ends = F.unix_micros(expires_at) if expires_at is not None else F.unix_micros("tombstone_at") + seconds * 1_000_000
    dead = F.coalesce("tombstoned", F.lit(False)) & (ends < F.unix_micros(as_of))
    return df.where(~F.coalesce(dead, F.lit(False)))


def expire_records(df: DataFrame, as_of: Column, refreshed: str, seconds: int = RECORD_SECONDS, ttl: str | None = None) -> DataFrame:
    """Rows refreshed in the last so many seconds, or in their own ttl where they have one."""
    life = F.coalesce(F.col(ttl), F.lit(seconds)) if ttl else F.lit(seconds)
    return df.where(F.unix_micros(refreshed) >= F.unix_micros(as_of) - life.cast("long") * 1_000_000)
