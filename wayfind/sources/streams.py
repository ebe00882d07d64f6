"""Streams of announcements and heartbeats: JSON envelopes from files, or the value of any streaming source such as Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.sources.schemas import schema


def encode_envelopes(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as {type, payload} messages in one column; times keep their microseconds, columns without a value are left out."""
    payload = F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload"))).alias("value"))


def decode_envelopes(raw: DataFrame, kind: str, table: str, value: str = "value") -> DataFrame:
    """The payloads of {type, payload} messages of one type, by the table's schema; others and unreadable ones go."""
    message = F.from_json(F.col(value).cast("string"), "type string, payload string", {"mode": "PERMISSIVE"})
    rows = raw.select(message.alias("m")).where(F.col("m.type") == kind)
    return rows.select(F.from_json("m.payload", schema(table), {"mode": "PERMISSIVE"}).alias("p")).where("p is not null").select("p.*")


def announcements(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of announcements from a folder of JSON lines."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return decode_envelopes(reader.load(path), "gossip_announce", "announcements")


def heartbeats(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema("heartbeats"))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def write_activity(events: DataFrame, path: str, batch_id: int) -> None:
    """Activity rows of one micro-batch; a repeated batch replaces its own folder."""
    events.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
