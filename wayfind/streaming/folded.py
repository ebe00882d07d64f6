"""Catalog tables folded from the announcement stream, all six types, kept as runs of partial states.

A micro-batch becomes one small run for each table: for every key that it touches, the last (or first) value of each group of columns with
the seq that brought it. Runs are merged on read by the same aggregation, so a batch never reads or rewrites the state. As
soon as FAN runs of one level stand side by side they become one of the next level, so a row is rewritten once a level. One commit covers all
tables of a batch; a batch that runs again after its commit does nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfind.operators import replication as R
from wayfind.operators.filters import signed_only
from wayfind.sources.commits import Log
from wayfind.sources.streams import write_activity
from wayfind.streaming import state

#: Runs of a level that become one of the next.
FAN = 8
CONTENT = ["name", "category", "tags", "summary", "home_registry", "entity_url"]


@dataclass(frozen=True)
class Table:
    """How a table follows from its announcements: groups gives structs that begin with seq, or null where a row says nothing. The last
    of each group counts, or the first for those named so. result makes the table's columns of the merged groups."""

    types: tuple[str, ...]
    key: tuple[str, ...]
    groups: Callable[[], dict[str, Column]]
    result: Callable[[], list[Column]]
    first: tuple[str, ...] = ()


def _says(condition: Column, *columns: str) -> Column:
    return F.when(condition, F.struct("seq", *columns))


def _entity_groups() -> dict[str, Column]:
    action = F.col("action")
    content = action.isin(R.CONTENT)
    active, told = F.struct("seq", F.lit("active").alias("status")), F.struct("seq", "status")
    return {
        "content": _says(content, *CONTENT), "received": F.when(content, F.struct("arrived_at")), "pinned": _says(content & (F.col("origin_public_key") != ""), "origin_public_key"),
        "state": F.when(content, active).when((action == "agent_status") & F.col("status").isNotNull(), told), "dead": _says(action == "deregister", "arrived_at"),
    }


def _after(a: str, b: str) -> Column:
    """Whether the last row of one group came after that of another."""
    return F.coalesce(F.col(f"{a}.seq"), F.lit(-1)) > F.coalesce(F.col(f"{b}.seq"), F.lit(-1))


def _entity_result() -> list[Column]:
    gone = _after("dead", "content")
    return [
        "entity_id", *[F.col(f"content.{c}").alias(c) for c in CONTENT], F.col("pinned.origin_public_key").alias("pin"), F.col("state.status").alias("status"), F.col("received.arrived_at").alias("received_at"),
        gone.alias("tombstoned"), F.when(gone, F.col("dead.arrived_at")).alias("tombstone_at"),
    ]


def _developer_groups() -> dict[str, Column]:
    profile, out = F.col("type") == "developer_announce", F.col("action") == "deregister"
    handle = F.when(F.col("action") != "release", F.col("dev_handle"))
    return {
        "profile": _says(profile & ~out, "name", "public_key"), "dead": _says(profile & out),
        "handle": F.when(F.col("type") == "dev_handle", F.struct("seq", handle.alias("dev_handle"), (F.col("action") == "verify").alias("verified"))),
    }


def _developer_result() -> list[Column]:
    return [
        "developer_id", F.col("profile.name").alias("name"), F.col("profile.public_key").alias("public_key"), F.col("handle.dev_handle").alias("dev_handle"),
        F.coalesce("handle.verified", F.lit(False)).alias("dev_handle_verified"), _after("dead", "profile").alias("tombstoned"),
    ]


_NAME = ["entity_name", "dev_handle", "registry_host", "entity_id", "version", "capability_tags"]
_PROOF = ["domain", "public_key", "proof_json"]
_ATTEST = ["verified_layers"]


def _released() -> Column:
    return F.col("action") == "release"


TABLES = {
    "remote_entities": Table(("agent_announce",), ("entity_id",), _entity_groups, _entity_result, ("pinned",)),
    "remote_developers": Table(("developer_announce", "dev_handle"), ("developer_id",), _developer_groups, _developer_result),
    "remote_names": Table(
        ("name_binding",), ("fqan",), lambda: {"bound": _says(~_released(), *_NAME), "dead": _says(_released())},
        lambda: ["fqan", *[F.col(f"bound.{c}").alias("developer_handle" if c == "dev_handle" else c) for c in _NAME], _after("dead", "bound").alias("tombstoned")],
    ),
    "registry_proofs": Table(("registry_proof",), ("registry_id",), lambda: {"proof": _says(F.lit(True), *_PROOF)}, lambda: ["registry_id", *[F.col(f"proof.{c}").alias(c) for c in _PROOF]]),
    "peer_attestations": Table(("peer_attestation",), ("attester_id", "subject_id"), lambda: {"seen": _says(F.lit(True), *_ATTEST)}, lambda: ["attester_id", "subject_id", *[F.col(f"seen.{c}").alias(c) for c in _ATTEST]]),
}


def _merged(rows: DataFrame, table: Table, groups: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*table.key).agg(*[(F.min if g in table.first else F.max)(c).alias(g) for g, c in groups.items()])


def partial_state(rows: DataFrame, table: Table) -> DataFrame:
    """One row per key of the announcements, with its groups."""
    return _merged(rows.where(F.col("type").isin(*table.types)), table, table.groups())


def merge_partial(runs: DataFrame, table: Table) -> DataFrame:
    return _merged(runs, table, {g: F.col(g) for g in table.groups()})


class State:
    """The folded tables at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.log = spark, path, Log(spark, path)

    def _runs(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*folders)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, the last one unless another is named."""
        table, folders = TABLES[name], [f for f, _ in self.log.read(version)[1].get("tables", {}).get(name, [])]
        if not folders:
            raise ValueError(f"{self.path} holds no {name}")
        return merge_partial(self._runs(folders), table).select(*table.result())

    def add(self, accepted: DataFrame, batch_id: int, names: list[str] | None = None) -> bool:
        """Folds the accepted announcements of a micro-batch in; False if that batch has been committed before."""
        if self.log.read()[1].get("batch", -1) >= batch_id:
            return False
        fresh = {}
        for name in names or TABLES:
            fresh[name] = self.log.folder(name)
            partial_state(accepted, TABLES[name]).write.parquet(fresh[name])

        def over(_: int, content: dict) -> dict | None:
            if content.get("batch", -1) >= batch_id:
                return None
            tables = {n: [*content.get("tables", {}).get(n, []), [f, 0]] for n, f in fresh.items()}
            return {"batch": batch_id, "tables": {**content.get("tables", {}), **tables}}

        self.log.change(over)
        return True

    def compact(self) -> bool:
        """Makes one run of each FAN of a level; False if there are not so many anywhere."""
        levels = {(name, level) for name, runs in self.log.read()[1].get("tables", {}).items() for _, level in runs if [x for _, x in runs].count(level) >= FAN}
        if not levels:
            return False

        def over(_: int, content: dict) -> dict:
            tables = dict(content["tables"])
            for name, level in sorted(levels):
                old = [f for f, x in tables[name] if x == level]
                if len(old) >= FAN:
                    out = self.log.folder(name)
                    merge_partial(self._runs(old), TABLES[name]).write.parquet(out)
                    tables[name] = [[f, x] for f, x in tables[name] if x != level] + [[out, level + 1]]
            return {**content, "tables": tables}

        self.log.change(over)
        return True

    def sweep(self, keep: int = 2, older_than: float = 3600.0) -> list[str]:
        """Deletes runs that the last commits don't list."""
        return self.log.sweep(lambda c: {f for runs in c.get("tables", {}).values() for f, _ in runs}, keep, older_than)


def start(stream: DataFrame, path: str, checkpoint: str, activity: str | None = None, signed: bool = True, names: list[str] | None = None, available_now: bool = True, types: list[str] | None = None) -> StreamingQuery:
    """Folds a stream of announcements of all types into the tables at a path, with an activity row for each accepted one.

    Announcements of entities are authorised by the key that owns them, which the state store holds; those of other types are taken as they
    come. names restricts the tables. Unsigned rows go unless signed is False. types takes only announcements of these types from the
    stream: without entities among them there is no pin to keep, so the stream is read once and has no state. A checkpoint holds for one choice.
    """
    rows = signed_only(stream) if signed else stream
    rows = rows.where(F.col("type").isin(types)) if types is not None else rows
    agents = F.col("type") == "agent_announce"
    others = rows.where(~agents).withColumn("accepted", F.lit(True))
    judged = state.authorize(rows.where(agents)).drop("pin").unionByName(others) if types is None or "agent_announce" in types else others
    tables = State(stream.sparkSession, path)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.where("accepted").drop("accepted").persist()
        try:
            if activity is not None:
                events = batch.select(F.concat("type", F.lit("_"), "action").alias("type"), F.col("arrived_at").alias("timestamp"), F.to_json(F.struct("seq", "entity_id", "developer_id", "fqan")).alias("payload"))
                write_activity(events, activity, batch_id)
            if tables.add(batch, batch_id, names):
                while tables.compact():
                    pass
        finally:
            batch.unpersist()

    return state.start(judged, step, checkpoint, available_now)
