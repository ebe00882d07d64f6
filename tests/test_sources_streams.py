import datetime as dt
import json

from pyspark.sql import functions as F

from wayfind.operators import liveness
from wayfind.sources import catalog, schemas, streams
from wayfind.streaming import liveness as sl
from wayfind.streaming import replication as sr


def test_every_schema_parses(spark):
    for name in schemas.DDL:
        assert schemas.schema(name).fields


def test_insert_and_rejects(spark, tmp_path):
    path = str(tmp_path / "tombstones")
    row = lambda i, r: (str(i), r, None, None, "s")
    one = spark.createDataFrame([row(1, "a"), row(2, "b"), row(2, "c")], schemas.schema("tombstones"))
    bad = catalog.write_catalog(one, path, "tombstones", "reason")
    assert [(r["reason"]) for r in bad.collect()] == ["repeated in the batch"]
    bad = catalog.write_catalog(spark.createDataFrame([row(1, "x"), row(3, "y")], schemas.schema("tombstones")), path, "tombstones")
    assert [(r["entity_id"], r["reason"]) for r in bad.collect()] == [("1", "already registered")]
    assert sorted(r["entity_id"] for r in catalog.read_catalog(spark, path, "tombstones").collect()) == ["1", "2", "3"]


def test_retries_and_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    catalog.insert_rows(df((1, "a"), (2, "b")), path, ["k"], "v", "first")
    for _ in range(2):
        bad = catalog.insert_rows(df((2, "x"), (3, "c"), (3, "d")), path, ["k"], "v", "second")
        assert sorted((r["k"], r["v"], r["reason"]) for r in bad.collect()) == [(2, "x", "already registered"), (3, "d", "repeated in the batch")]
    # another writer commits while this one has read the table
    split, once = catalog.split_new, []

    def slow(rows, existing, key, order=None):
        if not once:
            once.append(1)
            catalog.insert_rows(df((4, "theirs")), path, ["k"], "v", "theirs")
        return split(rows, existing, key, order)

    monkeypatch.setattr(catalog, "split_new", slow)
    bad = catalog.insert_rows(df((4, "mine"), (5, "e")), path, ["k"], "v", "mine")
    assert [(r["k"], r["reason"]) for r in bad.collect()] == [(4, "already registered")]
    held = catalog.read_rows(spark, path, df().schema)
    assert sorted(tuple(r) for r in held.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "theirs"), (5, "e")]
    assert catalog.read_rows(spark, path, df().schema, 1).count() == 2


def test_jdbc_partitions_are_even(spark, tmp_path):
    """Skewed numbers, times and nulls, in the embedded database that comes with Spark."""
    url = f"jdbc:derby:memory:{tmp_path.name.replace('-', '_')};create=true"
    at = F.timestamp_seconds(F.col("id") * F.col("id") * 600)
    rows = spark.range(400).select("id", F.when(F.col("id") % 50 != 0, F.pow(F.lit(1.03), "id").cast("long")).alias("skewed"), at.alias("seen"), F.to_date(at).alias("dayof"), F.concat(F.lit("n"), "id").alias("name"))
    rows.write.format("jdbc").options(url=url, dbtable="catalog", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    for column in ("skewed", "seen", "dayof"):
        df = catalog.read_catalog_jdbc(spark, url, "catalog", column, 8, driver="org.apache.derby.jdbc.EmbeddedDriver")
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400 and max(sizes) <= 100, (column, sizes)
        one = df.where("id = 7")
        assert one.select("name").first()["name"] == "n7"
        assert "EqualTo(id,7)" in one._jdf.queryExecution().executedPlan().toString()
    assert catalog.read_catalog_jdbc(spark, url, "catalog", driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 400


def test_cards(spark, tmp_path):
    lines = [json.dumps({"entity_id": "a", "status": "online", "capabilities": [{"name": "x"}]}), json.dumps({"status": "online", "wanted_id": "b"}), json.dumps({"entity_id": "c", "wanted_id": "d"}), "not json", json.dumps({"entity_id": "e", "version": "v" * 60_000})]
    (tmp_path / "cards.json").write_text("\n".join(lines))
    assert sorted(r["entity_id"] for r in catalog.read_cards(spark, str(tmp_path / "cards.json")).collect()) == ["a", "b"]


def test_results_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "query long, doc long")
    for day in ("2024-01-01", "2024-01-02", "2024-01-01"):
        catalog.write_results(df, str(tmp_path / "r"), day)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def envelope(seq, entity, action, key, minute, status=None, name=None):
    at = f"2024-01-01T00:{minute:02d}:00Z"
    payload = {"seq": seq, "type": "agent_announce", "action": action, "entity_id": entity, "origin_public_key": key, "signature": "s", "timestamp": at, "arrived_at": at, "status": status, "name": name, "hop_count": 0, "max_hops": 3}
    return json.dumps({"type": "gossip_announce", "payload": json.dumps(payload)})


def test_dedupe_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("\n".join([envelope(1, "a", "register", "K", 1), envelope(2, "a", "update", "K", 1), envelope(3, "b", "register", "K", 1)]))
    out = sr.dedupe_stream(streams.announcements(spark, str(source)))
    q = out.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 2


def beats(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", 0), ("a", 100), ("a", 700), ("b", 50), ("z", 5000)]
    folder = tmp_path / "beats"
    df = spark.createDataFrame([(e, base + dt.timedelta(seconds=s), None, "s") for e, s in rows], schemas.schema("heartbeats"))
    df.coalesce(1).write.json(str(folder))
    return df, str(folder)


def test_session_stream_is_the_batch(spark, tmp_path):
    df, folder = beats(spark, tmp_path)
    stream = sl.session_stream(streams.heartbeats(spark, folder), "entity_id", "timestamp", 300)
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("sessions").collect()}
    want = {tuple(r) for r in liveness.active_sessions(df, "entity_id", "timestamp", 300).select("entity_id", "started_at", "last_at", "beats").where("entity_id <> 'z'").collect()}
    assert got == want


def test_transitions(spark, tmp_path):
    _, folder = beats(spark, tmp_path)
    stream = sl.transitions(streams.heartbeats(spark, folder), "entity_id", "timestamp", 300)
    q = stream.writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("moves").groupBy("entity", "event").count().collect()
    got = {(r["entity"], r["event"]): r["count"] for r in rows}
    assert got[("a", "became_active")] == 2
    assert got[("b", "became_active")] == 1
    assert got[("a", "became_inactive")] >= 1


def test_limits_and_hops(spark):
    from wayfind.operators.filters import signed_only, within_hops

    df = spark.createDataFrame([(1, 0, 3, "s", "k"), (2, 3, 3, "s", "k"), (3, 0, 3, None, "k"), (4, 0, 3, "s", "")], "id int, hop_count int, max_hops int, signature string, origin_public_key string")
    assert [(r["id"], r["hop_count"]) for r in within_hops(signed_only(df)).collect()] == [(1, 1)]
    assert df.select(F.lit(1)).count() == 4
