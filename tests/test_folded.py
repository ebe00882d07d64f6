import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayfind.operators import liveness, replication
from wayfind.sources import schemas, streams
from wayfind.streaming import folded, state

T0 = dt.datetime(2024, 1, 1)


def row(seq, kind, action, **more):
    at = T0 + dt.timedelta(seconds=seq)
    return {"seq": seq, "type": kind, "action": action, "signature": "s", "origin_public_key": "K", "timestamp": at, "arrived_at": at, "hop_count": 0, "max_hops": 3} | more


BATCHES = [
    [
        row(1, "agent_announce", "register", entity_id="a", name="one", tags=["x"]), row(2, "agent_announce", "register", entity_id="b", name="bee", origin_public_key="L"),
        row(3, "developer_announce", "register", developer_id="d", name="dev", public_key="P"), row(4, "peer_attestation", "attest", attester_id="r1", subject_id="s", verified_layers=["l1"]),
    ],
    [
        row(5, "agent_announce", "update", entity_id="a", name="stolen", origin_public_key="X"), row(6, "agent_announce", "update", entity_id="a", name="two"), row(7, "dev_handle", "claim", developer_id="d", dev_handle="h"),
        row(8, "name_binding", "bind", fqan="h/d/n", entity_id="a", version="1", dev_handle="d", entity_name="n"), row(9, "registry_proof", "announce", registry_id="r", domain="x.example", proof_json="{}"),
        row(10, "agent_announce", "register", entity_id="c", name="unsigned", signature=None), row(11, "unknown", "x"),
    ],
    [
        row(12, "agent_announce", "deregister", entity_id="b", origin_public_key="L"), row(13, "agent_announce", "agent_status", entity_id="a", status="inactive"), row(14, "dev_handle", "verify", developer_id="d", dev_handle="h"),
        row(15, "name_binding", "release", fqan="h/d/n"), row(16, "registry_proof", "announce", registry_id="r", domain="y.example"), row(17, "peer_attestation", "attest", attester_id="r1", subject_id="s", verified_layers=["l2"]),
    ],
    [row(18, "agent_announce", "register", entity_id="b", name="back", origin_public_key="Z"), row(19, "dev_handle", "release", developer_id="d"), row(20, "agent_announce", "update", entity_id=None, name="nobody")],
]


def frame(spark, rows):
    schema = schemas.schema("announcements")
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def by_key(df, *columns):
    return {tuple(r[c] for c in columns[:1]): tuple(r[c] for c in columns[1:]) for r in df.collect()}


def test_all_six_types_over_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folded, "FAN", 2)
    at, sizes = str(tmp_path), []
    for rows in BATCHES:
        streams.encode_envelopes(frame(spark, rows).coalesce(1), "gossip_announce").write.mode("append").text(f"{at}/in")
        folded.start(streams.announcements(spark, f"{at}/in"), f"{at}/state", f"{at}/check", f"{at}/activity").awaitTermination()
        held = folded.State(spark, f"{at}/state")
        sizes.append(max(len(runs) for runs in held.log.read()[1]["tables"].values()))
    # four batches are one run of level two
    assert max(sizes) <= 2 and sizes[-1] == 1
    entities = by_key(held.read("remote_entities"), "entity_id", "name", "tags", "pin", "status", "tombstoned")
    assert entities == {("a",): ("two", None, "K", "inactive", False), ("b",): ("back", None, "L", "active", False), (None,): ("nobody", None, "K", "active", False)}
    assert by_key(held.read("remote_developers"), "developer_id", "name", "public_key", "dev_handle", "dev_handle_verified", "tombstoned") == {("d",): ("dev", "P", None, False, False)}
    assert by_key(held.read("remote_names"), "fqan", "entity_id", "version", "developer_handle", "tombstoned") == {("h/d/n",): ("a", "1", "d", True)}
    assert by_key(held.read("registry_proofs"), "registry_id", "domain", "proof_json") == {("r",): ("y.example", None)}
    assert by_key(held.read("peer_attestations"), "attester_id", "subject_id", "verified_layers") == {("r1",): ("s", ["l2"])}
    whole = replication.entity_state(replication.authorize(frame(spark, [r for b in BATCHES for r in b if r["type"] == "agent_announce" and r["signature"]])), ["name"])
    assert by_key(whole, "entity_id", "name", "pin", "status", "tombstoned") == {k: (v[0], *v[2:]) for k, v in entities.items()}
    activity = {r["type"]: r["count"] for r in spark.read.parquet(f"{at}/activity").groupBy("type").count().collect()}
    assert activity["agent_announce_register"] == 3 and activity["agent_announce_update"] == 2 and activity["dev_handle_release"] == 1
    # a batch that was committed is not folded in again
    assert not held.add(frame(spark, BATCHES[0]), 3)
    gone = held.sweep(keep=1, older_than=0)
    assert gone and by_key(held.read("registry_proofs"), "registry_id", "domain") == {("r",): ("y.example",)}


def test_a_batch_writes_only_its_own_keys(spark, tmp_path):
    held = folded.State(spark, str(tmp_path))
    with pytest.raises(ValueError, match="holds no"):
        held.read("remote_names")
    held.add(frame(spark, [row(i, "name_binding", "bind", fqan=f"n{i}") for i in range(100)]), 0, ["remote_names"])
    held.add(frame(spark, [row(200, "name_binding", "release", fqan="n7")]), 1, ["remote_names"])
    runs = [spark.read.parquet(f).count() for f, _ in held.log.read()[1]["tables"]["remote_names"]]
    assert runs == [100, 1]
    assert held.read("remote_names").where("tombstoned").count() == 1
    # the state before is still there
    assert held.read("remote_names", 1).where("tombstoned").count() == 0


def test_dedupe_keeps_what_batch_keeps(spark, tmp_path):
    times = [0, 100, 299, 300, 450, 599, 601, 900, 1500]
    rows = [row(i, "agent_announce", "update", entity_id=e) | {"arrived_at": T0 + dt.timedelta(seconds=s)} for i, (s, e) in enumerate((s, e) for s in times for e in ("a", "b", None))]
    for part in (rows[:12], rows[12:20], rows[20:]):
        streams.encode_envelopes(frame(spark, part).coalesce(1), "gossip_announce").write.mode("append").text(str(tmp_path / "in"))
        kept = state.dedupe(streams.announcements(spark, str(tmp_path / "in")), 300, F.col("entity_id"))
        state.start(kept, state.to_folder(str(tmp_path / "out")), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = replication.dedupe_announcements(frame(spark, rows), 300, key=F.coalesce("entity_id", F.lit("")))
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in want.collect())
    assert got.select("arrived_at", "timestamp").distinct().count() == want.select("arrived_at", "timestamp").distinct().count()


def test_transitions_and_timers(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 100, 2), ("a", 401, 3), ("b", 50, 4), ("z", 9000, 5), ("z", 20000, 6)]
    beats = spark.createDataFrame([(e, T0 + dt.timedelta(seconds=s), None, str(i)) for e, s, i in rows], schemas.schema("heartbeats"))
    for part in ("signature < 5", "signature >= 5"):
        beats.where(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        moves = state.transitions(streams.heartbeats(spark, str(tmp_path / "in")), "entity_id", "timestamp", "signature", 300, "10 seconds")
        state.start(moves, state.to_folder(str(tmp_path / "out")), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r["entity"], r["event"], int((r["at"] - T0).total_seconds()), r["beat"]) for r in out}
    active = {("a", 0, 1), ("a", 401, 3), ("b", 50, 4), ("z", 9000, 5), ("z", 20000, 6)}
    assert {(e, at, i) for e, x, at, i in got if x == "became_active"} == active
    batch = liveness.became_active(beats, "entity_id", "timestamp", 300).collect()
    assert {int(r["signature"]) for r in batch} == {i for _, _, i in active}
    # silence is told by a later heartbeat or, where none comes, by the timer
    assert {(e, at) for e, x, at, _ in got if x == "became_inactive"} == {("a", 400), ("a", 701), ("b", 350), ("z", 9300)}


def test_keys_of_one_bucket_do_not_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 1)
    for test in (test_dedupe_keeps_what_batch_keeps, test_transitions_and_timers):
        (tmp_path / test.__name__).mkdir()
        test(spark, tmp_path / test.__name__)
    with pytest.MonkeyPatch.context() as patch:
        test_all_six_types_over_restarts(spark, tmp_path, patch)


def test_without_entities_the_stream_is_read_once_and_has_no_state(spark, tmp_path):
    at, types = str(tmp_path), ["name_binding", "registry_proof"]
    rows = [r for batch in BATCHES for r in batch]
    streams.encode_envelopes(frame(spark, rows).coalesce(1), "gossip_announce").write.text(f"{at}/in")
    query = folded.start(streams.announcements(spark, f"{at}/in"), f"{at}/state", f"{at}/check", f"{at}/activity", names=["remote_names", "registry_proofs"], types=types)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"] == [] and len(query.lastProgress["sources"]) == 1
    held = folded.State(spark, f"{at}/state")
    assert by_key(held.read("remote_names"), "fqan", "entity_id", "version", "tombstoned") == {("h/d/n",): ("a", "1", True)}
    assert by_key(held.read("registry_proofs"), "registry_id", "domain", "proof_json") == {("r",): ("y.example", None)}
    assert {r["type"]: r["count"] for r in spark.read.parquet(f"{at}/activity").groupBy("type").count().collect()} == {"name_binding_bind": 1, "name_binding_release": 1, "registry_proof_announce": 2}


def test_developer_rows_parse_the_text_of_an_event_once(spark, tmp_path):
    from wayfind import catalog_queries

    spark.createDataFrame([(1, 2, '{"k": 3}')], "event_id long, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    rows = catalog_queries._developer_rows(spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
    (got,) = rows.collect()
    assert (got["seq"], got["type"], got["action"], got["dev_handle"]) == (1, "dev_handle", "verify", "h3")
