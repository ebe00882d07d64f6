"""Bulk name resolution, attachment, availability and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators.sizes import SMALL_ROWS, cut

#: Conflicts of a name are made in tasks of about so many rows, in so many tasks at most; a row stands for so many equal names at most.
PART_PAIRS, MOST_PARTS, COPIES = 1 << 22, 4096, 1 << 12
#: Tasks that the requests for one name go to where the names are too many to be sent out.
SALTS = 16


def one_name_per_entity(names: DataFrame) -> DataFrame:
    """The first registered name of each entity, ties by name."""
    order = Window.partitionBy("entity_id").orderBy(F.asc("registered_at"), F.asc("fqan"))
    return names.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def attach_names(entities: DataFrame, names: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Adds fqan and developer_handle; nulls where an entity has no name."""
    first = one_name_per_entity(names).select(F.col("entity_id").alias(id_col), "fqan", "developer_handle")
    return entities.join(first, id_col, "left")


def resolve_names(requests: DataFrame, names: DataFrame, entities: DataFrame, developers: DataFrame, remote_names: DataFrame) -> DataFrame:
    """(handle, name) requests to fqan, entity_id, status, tier, trust and found_in: local names first, else remote ones.

    Of several names for one pair the first by fqan counts on either side; tombstoned remote names don't.
    """
    first = Window.partitionBy("handle", "name").orderBy("fqan")

    def reduced(df: DataFrame) -> DataFrame:
        shown = df.select(F.col("developer_handle").alias("handle"), F.col("entity_name").alias("name"), "fqan", "entity_id", *(["developer_id"] if "developer_id" in df.columns else []))
        return shown.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")

    local = reduced(names).join(entities.select("entity_id", F.col("status").alias("__status")), "entity_id", "left")
    local = local.join(developers.select("developer_id", F.col("dev_handle_verified").alias("__verified")), "developer_id", "left")
    local = local.select("handle", "name", F.col("fqan").alias("l_fqan"), F.col("entity_id").alias("l_id"), F.coalesce("__status", F.lit("unknown")).alias("l_status"), F.when(F.col("__verified"), "method-verified").otherwise("self-claimed").alias("l_tier"))
    remote = reduced(remote_names.where(~F.coalesce("tombstoned", F.lit(False))).drop("developer_id")).select("handle", "name", F.col("fqan").alias("r_fqan"), F.col("entity_id").alias("r_id"))
    out = requests.join(local, ["handle", "name"], "left").join(remote, ["handle", "name"], "left")
    here, there = F.col("l_fqan").isNotNull(), F.col("r_fqan").isNotNull()
    return out.withColumns({
        "fqan": F.coalesce("l_fqan", "r_fqan"), "entity_id": F.coalesce("l_id", "r_id"),
        "status": F.when(here, F.col("l_status")).when(there, "unknown"), "tier": F.when(here, F.col("l_tier")).when(there, "self-claimed"),
        "trust": F.when(here | there, 0.5), "found_in": F.when(here, "local").when(there, "remote"),
    }).drop("l_fqan", "l_id", "l_status", "l_tier", "r_fqan", "r_id")


def resolve_fqans(requests: DataFrame, names: DataFrame, remote_names: DataFrame) -> DataFrame:
    """fqan requests to the entity, local before live remote names, with score 1."""
    local = names.select("fqan", F.col("entity_id").alias("l"))
    remote = remote_names.where(~F.coalesce("tombstoned", F.lit(False))).select("fqan", F.col("entity_id").alias("r"))
    out = requests.join(local, "fqan", "left").join(remote, "fqan", "left")
    found = F.when(F.col("l").isNotNull(), "local").when(F.col("r").isNotNull(), "remote")
    return out.withColumns({"entity_id": F.coalesce("l", "r"), "found_in": found, "score": F.when(found.isNotNull(), 1.0)}).drop("l", "r")


def lookup_entities(ids: DataFrame, local: DataFrame, remote: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """One row per known id, the local one before the remote one."""
    both = local.withColumn("found_in", F.lit("local")).unionByName(remote.withColumn("found_in", F.lit("remote")), allowMissingColumns=True)
    wanted = both.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return wanted.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy("found_in"))).where("__n = 1").drop("__n")


def handles_to_ids(requests: DataFrame, developers: DataFrame) -> DataFrame:
    """Requests with their developer's id; an unknown handle gives no row."""
    return requests.join(developers.select(F.col("dev_handle").alias("developer_handle"), "developer_id"), "developer_handle")


def check_registrations(requests: DataFrame, developers: DataFrame, remote_developers: DataFrame) -> DataFrame:
    """Adds why a registration is refused, or null: unknown developer, or a proof key that isn't the developer's."""
    local = developers.select("developer_id", F.col("public_key").alias("__l"))
    remote = remote_developers.select("developer_id", F.col("public_key").alias("__r"))
    key = F.coalesce("__l", "__r")
    out = requests.join(local, "developer_id", "left").join(remote, "developer_id", "left")
    why = F.when(key.isNull(), "unknown developer").when(~key.eqNullSafe(F.col("proof_key")), "key mismatch")
    return out.withColumn("refused", why).drop("__l", "__r")


def availability(requests: DataFrame, taken: DataFrame, on: list[str], existing: str) -> DataFrame:
    """Adds whether each wanted key is free, and the id that holds it (the least of several)."""
    held = taken.groupBy(*on).agg(F.min(existing).alias("existing_id"))
    return requests.join(held, on, "left").withColumn("available", F.col("existing_id").isNull())


def name_conflicts(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Requests for a (handle, name) that another public key holds, once for each time that it is held.

    Names are counted by key first, and requests are dealt out by how many rows they give in all, so a name that many ask for
    and many hold is not one task. Runs jobs while it is put together.
    """
    held = names.select(F.col("developer_handle").alias("handle"), F.col("entity_name").alias("name"), F.col("public_key").alias("held_by"))
    times = cut(held.groupBy("handle", "name", "held_by").agg(F.count(F.lit(1)).alias("__n")))
    asked = requests.groupBy("handle", "name", "public_key").agg(F.count(F.lit(1)).alias("__r"))
    pairs = asked.join(times, ["handle", "name"]).where(F.col("held_by") != F.col("public_key"))
    made = pairs.agg(F.sum((F.col("__r") * F.col("__n")).cast("decimal(38,0)"))).first()[0] or 0
    parts = min(MOST_PARTS, max(requests.sparkSession.sparkContext.defaultParallelism, -(-int(made) // PART_PAIRS)))
    # of a name with more copies each range of COPIES is a row, so no row holds them all
    copies = times.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))))
    spread = F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES), F.col("__n") - F.col("__from")).cast("int")))
    dealt = requests.repartition(parts)
    if copies.count() > SMALL_ROWS:
        # too many to send out: salted, so that the requests for one name stand in many tasks
        dealt = requests.withColumn("__salt", F.pmod(F.xxhash64(*requests.columns), F.lit(SALTS)).cast("int"))
        copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.join(copies.repartition(parts, "handle", "name", "__salt"), ["handle", "name", "__salt"]).drop("__salt")
    else:
        met = dealt.join(F.broadcast(copies), ["handle", "name"])
    return met.where(F.col("held_by") != F.col("public_key")).withColumn("__copy", spread).drop("__n", "__from", "__copy")


def entities_by_developer(entities: DataFrame, developers: DataFrame, limit: int = 20, offset: int = 0, newest: str = "updated_at") -> DataFrame:
    """Each developer's entities, newest first: a page per developer, with rank."""
    order = Window.partitionBy("developer_id").orderBy(F.desc(newest), F.asc("entity_id"))
    ranked = entities.join(developers.select("developer_id").distinct(), "developer_id", "left_semi").withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def names_of(names: DataFrame, handle: str, host: str) -> DataFrame:
    return names.where((F.col("developer_handle") == handle) & (F.col("registry_host") == host)).orderBy("entity_name")


def version_history(versions: DataFrame) -> DataFrame:
    """Adds rank (1: newest) and the version before, per name."""
    order = Window.partitionBy("fqan").orderBy(F.desc("registered_at"), F.desc("version"))
    return versions.withColumns({"rank": F.row_number().over(order), "previous_version": F.lead("version").over(order)})


def latest_versions(versions: DataFrame, selector: Column | None = None) -> DataFrame:
    """The newest version per name, among those that the selector takes."""
    from wayfind.functions.naming import version_matches

    if selector is not None:
        versions = versions.where(version_matches(F.col("version"), selector))
    return version_history(versions).where("rank = 1").drop("rank", "previous_version")
