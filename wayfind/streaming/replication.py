"""The announcement stream: drops within the watermark, and what is passed on. Dedupe by kept rows is in state, tables in folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.operators import replication as R
from wayfind.operators.filters import signed_only, within_hops


def dedupe_stream(stream: DataFrame, ts: str = "arrived_at", seconds: int = 300, key: Column | None = None) -> DataFrame:
    """Drops repeats of a key within the watermark; timestamps without a zone are read as UTC."""
    keyed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("dedupe_key", key if key is not None else R.dedupe_key())
    return keyed.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark(["dedupe_key"]).drop("dedupe_key")


def forward(stream: DataFrame) -> DataFrame:
    """What is passed on to other registries: signed, one hop further."""
    return within_hops(signed_only(stream))
