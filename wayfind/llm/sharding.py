"""Sharding by jump consistent hashing, in DataFrame expressions only.

The published generator is key = key * 2862933555777941757 + 1 (mod 2**64), and the next jump goes to
floor((bucket + 1) * 2**31 / ((key >> 33) + 1)). A bigint product overflows under ANSI rules, so the key is carried as
two unsigned 32-bit halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_M = 2862933555777941757
_M_LOW, _M_HIGH = _M & 0xFFFFFFFF, _M >> 32
_HALF = 0xFFFFFFFF

#: Groups that a shard's rows are numbered in, so that no task numbers a whole shard.
SLOT_GROUPS = 256


def _times(a: Column, b: int) -> Column:
    """(a * b) for 32-bit halves as one unsigned product modulo 2**48 pieces: (low 32 bits, carry above them)."""
    low = a * (b & 0xFFFF)
    high = a * (b >> 16)
    total = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
    return F.struct(total.bitwiseAND(F.lit(_HALF)).alias("low"), (F.shiftrightunsigned(total, 32) + F.shiftrightunsigned(high, 16)).alias("carry"))


def _step(s: Column) -> Column:
    """One jump: the generator moves on, bucket takes the last jump, jump the next one."""
    p = _times(s["low"], _M_LOW)
    low = p["low"] + 1
    high = p["carry"] + F.shiftrightunsigned(low, 32) + _times(s["low"], _M_HIGH)["low"] + _times(s["high"], _M_LOW)["low"]
    high = high.bitwiseAND(F.lit(_HALF))
    # bits 33.. of the key are bits 1.. of its high half
    jump = F.floor((s["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(high, 1) + 1).cast("double"))).cast("long")
    return F.struct(high.alias("high"), low.bitwiseAND(F.lit(_HALF)).alias("low"), s["jump"].alias("bucket"), jump.alias("jump"))


def jump_hash(key: Column, shards: int) -> Column:
    """The bucket in 0..shards-1 of a bigint key (as unsigned 64 bits). A null key counts as 0.

    Going from n to n + 1 shards, a key stays or goes to the new shard.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_HALF)).alias("low"), F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("jump"))
    # every jump goes up by one at least, so `shards` steps reach the end
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, lambda s, _: F.when(s["jump"] < shards, _step(s)).otherwise(s))
    return chain["bucket"].cast("int")


def assign_shards(docs: DataFrame, key: str, shards: int, slot_groups: int = SLOT_GROUPS) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard, by group and key) to the rows.

    Numbering counts rows by (shard, group) first, at most shards * slot_groups rows of counts, and then numbers inside
    each group; the hash of the whole row deals out the groups, so rows with one and the same key are spread too as
    long as they differ. An empty table gives an empty result. Rows with a null key go to the shard of key 0. Columns
    of the input named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    dealt = docs.withColumn("shard", jump_hash(F.col(key), shards))
    row = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in docs.columns])
    group = (F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long") % slot_groups).cast("int")
    dealt = dealt.withColumn("__group", group)
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "__group").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("shard", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__group").orderBy(F.col(key).asc_nulls_first())
    numbered = dealt.withColumn("__row", F.row_number().over(inside))
    # at most shards * slot_groups rows of three numbers
    joined = numbered.join(F.broadcast(starts), ["shard", "__group"])
    return joined.withColumn("slot", (F.col("__start") + F.col("__row") - 1).cast("long")).drop("__group", "__start", "__row")


def shard_table(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: its size, checksum, shard, slot and its shard if one more were appended.

    Size is the text's UTF-8 bytes (null: none) plus 16; the checksum of a null text is that of an empty one. Law `key`:
    doc_id and the number of shards decide.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(rows, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard")
    )
