"""Lineage cuts and size checks shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table joined by broadcast on our word has at most so many rows of a few numbers.
SMALL_ROWS = 10_000
#: Rows of a few numbers to a partition, where a table is put together.
PACKED_ROWS = 50_000
#: Bits of the filter of maybe_in: 512 rows of 4 KiB, whatever it is made from.
FILTER_BITS = 1 << 24


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one in the warehouse only where it names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the folder in spark.checkpoint.dir, which all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows cut and in as few partitions as their number needs, and that number: later shuffles of a small table then
    have few map tasks, however many partitions it was made in."""
    df = cut(df)
    n = df.count()
    return df.coalesce(max(1, -(-n // PACKED_ROWS))), n


def with_maybe(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """Adds `flag`: true if the value is in the one column of `keys`, and for some others, the more the fuller the filter is.

    The keys become a bitmap of FILTER_BITS bits, which is broadcast, so that neither side is shuffled. It only spares
    work: who needs exactly these rows joins with the keys as well. A null value counts as any other.
    """
    (key,) = keys.columns
    hashed = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(hashed).alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(hashed)).alias("__bits"))
    own = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS)) + 1
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("__map", F.bitmap_bucket_number(own)).join(F.broadcast(maps), "__map", "left")
    return met.withColumn(flag, F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))).select(*df.columns, flag)


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose value is in the one column of `keys`, and some others (see with_maybe)."""
    return with_maybe(df, column, keys, "__maybe").where("__maybe").drop("__maybe")


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose value is not in the one column of `keys`; only rows that may be in it are shuffled."""
    flagged = with_maybe(df, column, keys, "__maybe")
    (key,) = keys.columns
    listed = keys.select(F.col(key).alias("__key")).distinct()
    unsure = flagged.where("__maybe").join(listed, F.col(column) == F.col("__key"), "left_anti")
    return flagged.where("not __maybe").unionByName(unsure).drop("__maybe")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
