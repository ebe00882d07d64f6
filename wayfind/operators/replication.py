"""Folding the announcement stream into catalog state, in batch: dedupe, routing, authorisation, upserts, tombstones.

Rows carry seq, a total order of arrival. Nothing is folded one row at a time: the pinned key of an entity is the first key
that a register or update brought, so acceptance is a window expression, and state is one aggregate per column group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Announcement types.
TYPES = ["agent_announce", "developer_announce", "dev_handle", "name_binding", "registry_proof", "peer_attestation"]
CONTENT = ["register", "update"]


def dedupe_key(with_type: bool = False) -> Column:
    """What an announcement is told apart by: the id for its type, and its timestamp in seconds."""
    t = F.col("type")
    key = (
        F.when(t.isin("developer_announce", "dev_handle"), F.col("developer_id"))
        .when(t == "name_binding", F.col("fqan"))
        .when(t == "registry_proof", F.col("domain"))
        .when(t == "peer_attestation", F.concat_ws(":", "attester_id", "subject_id"))
        .otherwise(F.col("entity_id"))
    )
    parts = [F.coalesce(key, F.lit("")), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")]
    return F.concat_ws("|", *([t] if with_type else []), *parts)


def dedupe_announcements(df: DataFrame, seconds: int = 300, with_type: bool = False, key: Column | None = None, arrived: str = "arrived_at") -> DataFrame:
    """Drops rows whose key arrived less than so many seconds after the last row of that key that was kept.

    A dropped row does not prolong the silence, so a key that repeats without end is let through once in a window, as in the
    stream. Rows are sorted by key and arrival inside partitions; a task holds the last kept time of one key.
    """
    columns, window = df.columns, seconds * 1_000_000
    sorted_rows = df.withColumns({"__key": key if key is not None else dedupe_key(with_type), "__at": F.unix_micros(F.col(arrived))}).repartition("__key").sortWithinPartitions("__key", "__at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = object(), 0
        for batch in batches:
            keys, at = batch.column("__key").to_pylist(), batch.column("__at").to_numpy()
            kept = np.zeros(len(keys), bool)
            i = 0
            while i < len(keys):
                end = i + 1
                while end < len(keys) and keys[end] == keys[i]:
                    end += 1
                if keys[i] == last_key:
                    i += int(np.searchsorted(at[i:end], last + window))
                while i < end:
                    kept[i] = True
                    last = int(at[i])
                    i += max(1, int(np.searchsorted(at[i:end], last + window)))
                last_key, i = keys[end - 1], end
            yield batch.select(columns).filter(pa.array(kept))

    return sorted_rows.mapInArrow(run, df.schema)


def route(df: DataFrame) -> DataFrame:
    """Adds the table that a row goes to; null for an unknown type."""
    t = F.col("type")
    target = (
        F.when(t == "agent_announce", "remote_entities").when(t.isin("developer_announce", "dev_handle"), "remote_developers")
        .when(t == "name_binding", "remote_names").when(t == "registry_proof", "registry_proofs").when(t == "peer_attestation", "peer_attestations")
    )
    return df.withColumn("target", target)


def authorize(df: DataFrame, entity: str = "entity_id", key: str = "origin_public_key", snapshot: DataFrame | None = None) -> DataFrame:
    """Adds pin (the key that owned the entity before the row) and accepted.

    register: always; update: a new entity, a matching key or no pin; agent_status and deregister: a known entity with a matching
    key or no pin. snapshot (entity, pin) is the state that rows are folded onto.
    """
    if snapshot is not None:
        df = df.join(snapshot.select(entity, F.col("pin").alias("__old")), entity, "left")
    else:
        df = df.withColumn("__old", F.lit(None).cast("string"))
    earlier = Window.partitionBy(entity).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    content = F.col("action").isin(CONTENT)
    own = F.nullif(F.col(key), F.lit(""))
    pin = F.coalesce("__old", F.first(F.when(content, own), ignorenulls=True).over(earlier))
    known = F.col("__old").isNotNull() | F.coalesce(F.max(content).over(earlier), F.lit(False))
    df = df.withColumns({"pin": pin, "__known": known})
    match = F.col("pin").isNull() | (F.col("pin") == own)
    a = F.col("action")
    accepted = F.when(a == "register", True).when(a == "update", ~F.col("__known") | match).when(a.isin("agent_status", "deregister"), F.col("__known") & match).otherwise(False)
    return df.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("__old", "__known")


def entity_state(authorized: DataFrame, columns: list[str], entity: str = "entity_id", key: str = "origin_public_key", ts: str = "arrived_at", revive: bool = True) -> DataFrame:
    """One row per entity from the accepted rows: the last content, the pin, the status and the tombstone.

    revive: content after a deregister lifts the tombstone; otherwise it stays until it is collected.
    """
    rows = authorized.where("accepted")
    content = F.col("action").isin(CONTENT)
    at = F.when(content, F.col("seq"))
    status = F.when(content, F.lit("active")).when(F.col("action") == "agent_status", F.col("status"))
    dead = F.when(F.col("action") == "deregister", F.col("seq"))
    out = rows.groupBy(entity).agg(
        *[F.max_by(c, at).alias(c) for c in columns],
        F.min_by(F.nullif(F.col(key), F.lit("")), F.when(content & F.col(key).isNotNull() & (F.col(key) != ""), F.col("seq"))).alias("pin"),
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"),
        F.max(F.when(content, F.col(ts))).alias("received_at"), F.max(at).alias("__content"), F.max(dead).alias("__dead"), F.max_by(ts, dead).alias("__dead_at"),
    )
    gone = F.col("__dead").isNotNull() & ((F.col("__dead") > F.coalesce("__content", F.lit(-1))) if revive else F.lit(True))
    return out.withColumns({"tombstoned": gone, "tombstone_at": F.when(gone, F.col("__dead_at"))}).drop("__content", "__dead", "__dead_at")


def latest_rows(df: DataFrame, key: list[str], columns: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key, all columns replaced together (names, proofs, attestations)."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*key, "r.*")


def latest_columns(df: DataFrame, key: list[str], columns: list[str], order: str = "seq") -> DataFrame:
    """The last known value of each column of each key; a null doesn't replace (developers with their handle columns)."""
    return df.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def developer_state(df: DataFrame) -> DataFrame:
    """Remote developers from developer_announce and dev_handle rows; a release clears the handle columns, a deregister tombstones."""
    handle = F.when(F.col("type") == "dev_handle", F.col("seq"))
    live = F.col("action") != "release"
    profile = F.when((F.col("type") == "developer_announce") & (F.col("action") != "deregister"), F.col("seq"))
    dead = F.when((F.col("type") == "developer_announce") & (F.col("action") == "deregister"), F.col("seq"))
    return df.groupBy("developer_id").agg(
        F.max_by("name", profile).alias("name"), F.max_by("public_key", profile).alias("public_key"),
        F.max_by(F.when(live, F.col("dev_handle")), handle).alias("dev_handle"),
        F.coalesce(F.max_by(F.col("action") == "verify", handle), F.lit(False)).alias("dev_handle_verified"),
        (F.coalesce(F.max(dead), F.lit(-1)) > F.coalesce(F.max(profile), F.lit(-1))).alias("tombstoned"),
    )


def name_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """Remote names: all columns of the last binding; a later release tombstones, a later binding lifts it."""
    bound = F.when(F.col("action") != "release", F.col("seq"))
    out = df.groupBy("fqan").agg(F.max_by(F.struct(*columns), bound).alias("r"), F.max(bound).alias("b"), F.max(F.when(F.col("action") == "release", F.col("seq"))).alias("d"))
    return out.select("fqan", "r.*", (F.coalesce("d", F.lit(-1)) > F.coalesce("b", F.lit(-1))).alias("tombstoned"))
