import math
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfind.functions import identity
from wayfind.operators import blocks, bm25, filters, index, liveness, names, rank, replication, retention, routing, similarity, trust, validate

ENTITIES = [(1, "CodeReviewer agent reviews python security"), (2, "Translator translates japanese english"), (3, "DataAnalyzer statistics python charts")]


def scores(spark, docs, queries):
    d = spark.createDataFrame(docs, "id long, t string")
    q = spark.createDataFrame(queries, "q long, t string")
    return bm25.top_k(blocks.bm25(q, d, "q", F.col("t"), "id", F.col("t")), 10)


def test_bm25_finds(spark):
    rows = scores(spark, ENTITIES, [(1, "python security"), (2, "translates japanese"), (3, ""), (4, None)]).where("rank = 1").collect()
    assert {r["query"]: r["doc"] for r in rows} == {1: 1, 2: 2}


def test_bm25_empty_corpus(spark):
    assert scores(spark, [], [(1, "python")]).count() == 0


def test_bm25_value(spark):
    r = scores(spark, [(1, "red red blue"), (2, "blue green")], [(1, "red red")]).first()
    idf = math.log((2 - 1 + 0.5) / (1 + 0.5) + 1)
    want = 2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5))
    assert abs(r["score"] - want) < 1e-6


def test_phrase_alone_is_a_hit(spark):
    q = spark.createDataFrame([(1, '"green tea" zzz')], "q long, t string")
    d = spark.createDataFrame([(1, "Green Tea shop", "x"), (2, "green and tea", "y")], "id long, name string, c string")
    none = F.array().cast("array<string>")
    bonus = bm25.phrase_hits(q, d, "q", F.col("t"), "id", F.col("name"), F.lit(None).cast("string"), F.col("c"), none)
    empty = spark.createDataFrame([], "query long, doc long, score double")
    assert [tuple(r) for r in bm25.with_phrases(empty, bonus).collect()] == [(1, 1, 5.0)]


def test_index_changes(spark):
    docs = spark.createDataFrame([(1, "old-tag text"), (2, "other")], "id long, t string")
    base = index.postings(index.token_rows(docs, "id", F.col("t")))
    new = spark.createDataFrame([(1, "python")], "id long, t string")
    gone = spark.createDataFrame([(2,)], "id long")
    terms = {r["term"] for r in index.apply_changes(base, new, gone, "id", F.col("t")).collect()}
    assert terms == {"python"}


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [1.0]), (5, None), (6, [0.0, 0.0])], "id long, v array<float>")
    out = similarity.cosine_hits(v.where("id = 1"), v, "id", "v", "id", "v", 2, 10).orderBy("rank").collect()
    assert [r["doc"] for r in out] == [1, 3]
    assert similarity.wrong_dimensions(v, "v", 2).count() == 2


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query long, doc string, source string, text double, semantic double, trust double, freshness double, availability double")


def test_rank_and_dedupe(spark):
    c = candidates(spark, [(1, "a", "remote", 0.9, 0.1, 0.5, 0.5, 1.0), (1, "a", "local", 0.5, 0.1, 0.5, 0.5, 1.0), (1, "b", "local", 0.9, 0.9, 0.9, 0.5, 1.0)])
    d = rank.dedupe_candidates(c)
    assert {(r["doc"], r["source"]) for r in d.collect()} == {("a", "local"), ("b", "local")}
    assert rank.rank_candidates(d).where("rank = 1").first()["doc"] == "b"
    top = rank.rank_candidates(d, "rrf").where("rank = 1").first()
    assert top["doc"] == "b"
    assert abs(top["score"] - 3 / 61) < 1e-9


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=6))
def test_rrf_is_bounded(spark, rows):
    c = candidates(spark, [(1, str(i), "local", *r, 0.5, 1.0) for i, r in enumerate(rows)])
    assert all(0 < r["score"] <= round(3 / 61, 9) for r in rank.rank_rrf(c).collect())


def test_freshness(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(rank.freshness(ts("2024-01-01"), ts("2024-01-31")).alias("a"), rank.freshness(ts("2024-02-01"), ts("2024-01-31")).alias("b"), rank.freshness(ts(None), ts("2024-01-31")).alias("c"), rank.freshness(ts("2024-01-01"), ts("2024-04-10")).alias("d")).first()
    assert [round(x, 4) for x in row] == [0.5016, 1.0, 0.5, 0.1003]


def test_page(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 26)], "query long, doc long, rank int")
    first = rank.page(ranked).collect()
    assert len(first) == 20
    assert all(r["has_more"] for r in first)
    last = rank.page(ranked, 10, 20).collect()
    assert [r["rank"] for r in last] == [21, 22, 23, 24, 25]
    assert not last[0]["has_more"]


def test_keyword_filter(spark):
    e = spark.createDataFrame([(1, "PythonReviewer", "reviews", ["Legal-docs", "x"], "legal", 5), (2, "JapaneseTranslator", "100% python_free", [], "lang", 9), (3, None, None, None, None, None)], "entity_id long, name string, summary string, tags array<string>, category string, updated_at int")
    assert [r["entity_id"] for r in filters.keyword_filter(e, "python").collect()] == [2, 1]
    assert [r["entity_id"] for r in filters.keyword_filter(e, "legal", "legal", ["docs", "X"]).collect()] == [1]
    assert filters.keyword_filter(e, "p_t").count() == 0


def test_validation(spark):
    rows = [
        ("1", "n", "o", "u", "c", "s", "k", ["t"], "agent", None, None), (None, "", "o", None, "c", "s" * 201, "k", ["t"] * 21, "robot", None, None), ("3", "é" * 51, "o", None, "c", None, "k", None, "service", None, "barter"),
    ]
    e = spark.createDataFrame(rows, "entity_id string, name string, owner string, entity_url string, category string, summary string, public_key string, tags array<string>, entity_type string, service_endpoint string, pricing_model string")
    got = [(r["valid"], r["reasons"]) for r in validate.validate_entities(e).collect()]
    assert got[0] == (True, [])
    assert got[1][1] == ["entity_id is required", "name is required", "summary is too long", "too many tags", "unknown entity_type"]
    assert got[2][1] == ["name is too long", "service_endpoint is required", "unknown pricing model"]
    good, bad = validate.split_valid(validate.validate_entities(e))
    assert (good.count(), bad.count()) == (1, 2)


def authorised(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, entity_id string, action string, origin_public_key string, status string, name string, arrived_at int")
    return replication.authorize(df)


def test_key_pinning(spark):
    rows = [("e", "register", "A", None, "one", 1), ("e", "update", "B", None, "two", 2), ("e", "agent_status", "A", "inactive", None, 3), ("e", "agent_status", "B", "active", None, 4), ("e", "register", "B", None, "three", 5), ("e", "deregister", "B", None, None, 6), ("e", "deregister", "A", None, None, 7), ("x", "deregister", "A", None, None, 8), ("y", "update", "C", None, "new", 9)]
    a = authorised(spark, rows)
    assert [r["accepted"] for r in a.orderBy("seq").collect()] == [True, False, True, False, True, False, True, False, True]
    state = {r["entity_id"]: r for r in replication.entity_state(a, ["name"]).collect()}
    assert (state["e"]["name"], state["e"]["pin"], state["e"]["status"], state["e"]["tombstoned"]) == ("three", "A", "active", True)
    assert state["y"]["pin"] == "C"
    assert set(state) == {"e", "y"}


def sequential(rows):
    pins, known, out = {}, set(), []
    for entity, action, key, *_ in rows:
        pin = pins.get(entity)
        ok = action == "register" or (action == "update" and (entity not in known or pin in (None, key))) or (action in ("agent_status", "deregister") and entity in known and pin in (None, key))
        out.append(ok)
        if action in ("register", "update"):
            known.add(entity)
            pins.setdefault(entity, key) if ok else None
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["register", "update", "agent_status", "deregister"]), st.sampled_from(["K", "L"])), min_size=1, max_size=14))
def test_authorisation_is_the_sequential_fold(spark, rows):
    full = [(*r, "active", "n", i) for i, r in enumerate(rows)]
    assert [r["accepted"] for r in authorised(spark, full).orderBy("seq").collect()] == sequential(full)


def test_bloom_has_no_false_negative(spark):
    m, k = routing.bloom_size(500_000, 0.01)
    assert (m, k) == (4_792_530, 7)
    m, k = routing.bloom_size(4, 0.01)
    items = spark.createDataFrame([("r", t) for t in ("python", "code", "review", "test")], "registry string, token string")
    filters_ = routing.bloom_build(items, m, k)
    want = items.select("registry", F.explode(routing.bloom_positions(F.col("token"), m, k)).alias("pos")).distinct()
    assert sorted(map(tuple, routing.unpack_filters(filters_).collect())) == sorted(map(tuple, want.collect()))
    tokens = spark.createDataFrame([(1, t) for t in ("python", "code", "absent")], "query long, token string")
    assert routing.bloom_match(tokens, filters_, m, k).first()["matches"] >= 2


def test_trust(spark):
    r = spark.range(1).select(*[trust.reputation(F.lit(10), F.lit(0), F.lit(x), F.lit(0.0)).alias(f"r{i}") for i, x in enumerate((100.0, 1000.0, 5000.0))], trust.reputation(F.lit(0), F.lit(0), F.lit(1000.0), F.lit(9.0)).alias("z")).first()
    assert [round(r[i] / 0.3, 4) for i in range(2)] == [0.9526, 0.5]
    assert r[2] / 0.3 < 1e-5
    assert abs(r["z"] - 0.45) < 1e-9
    t = trust.verification_tiers(spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "s"), ("c", "s"), ("a", "t")], "attester_id string, subject_id string"))
    assert {r["subject_id"]: r["tier"] for r in t.collect()} == {"s": "mesh-verified", "t": "self-announced"}


def test_liveness(spark):
    e = spark.sql("select * from values (1, 'active', timestamp'2024-01-01 00:04:00'), (2, 'active', timestamp'2024-01-01 00:00:00'), (3, 'active', null), (4, 'inactive', null) as t(entity_id, status, last_heartbeat)")
    swept = liveness.liveness_sweep(e, F.lit("2024-01-01 00:06:00").cast("timestamp"))
    assert {r["entity_id"] for r in swept.collect()} == {2, 3}
    after = liveness.apply_sweep(e, swept)
    assert {r["entity_id"] for r in after.where("status = 'active'").collect()} == {1}


def test_retention(spark):
    e = spark.sql("select * from values (1, true, timestamp'2024-01-01'), (2, true, timestamp'2024-01-09'), (3, false, null) as t(id, tombstoned, tombstone_at)")
    kept = retention.expire_tombstones(e, F.lit("2024-01-10").cast("timestamp"))
    assert {r["id"] for r in kept.collect()} == {2, 3}


def test_names_and_versions(spark):
    v = spark.createDataFrame([("f", "1.0", 1), ("f", "2.0", 2), ("f", "2.1", 3), ("f", "21.0", 4)], "fqan string, version string, registered_at int")
    assert [r["version"] for r in names.version_history(v).orderBy("rank").collect()] == ["21.0", "2.1", "2.0", "1.0"]
    assert names.latest_versions(v, F.lit("2")).first()["version"] == "2.1"


def test_ids_and_defaults(spark):
    import base64
    import hashlib

    key = base64.b64encode(b"k" * 32).decode()
    row = spark.createDataFrame([(f"ed25519:{key}",), ("not base64!",)], "k string").select(identity.make_id("agent", F.col("k")).alias("x")).collect()
    assert row[0]["x"] == "zns:" + hashlib.sha256(b"k" * 32).hexdigest()[:32]
    assert row[1]["x"] is None
    assert spark.range(1).select(identity.registry_host(F.lit("https://a.b:80/c")).alias("h")).first()["h"] == "a.b"


def test_dedupe_lets_one_row_through_in_a_window(spark):
    """Repeats every 200 s from 0 to 800 for a window of 300 s, and a key that is silent for exactly the window."""
    from wayfind.operators import replication

    rows = [(i, "a", 200 * i) for i in range(5)] + [(9, "b", 0), (10, "b", 300), (11, "b", 300), (12, None, 5), (13, None, 5)]
    df = spark.createDataFrame(rows, "seq long, who string, s long").selectExpr("seq", "who", "timestamp_seconds(s) as arrived_at")
    for parts in (1, 4):
        out = replication.dedupe_announcements(df.repartition(parts), 300, key=F.col("who"))
        assert out.columns == df.columns
        assert sorted(r["seq"] for r in out.collect()) == [0, 2, 4, 9, 10, 12]
    assert replication.dedupe_announcements(df.limit(0), 300, key=F.col("who")).count() == 0


def test_phrases_are_found_wherever_they_stand(spark, monkeypatch):
    from wayfind.operators import bm25

    q = spark.createDataFrame([(1, 'x "big red" "big red"'), (2, '"ed ca" and "tag one"'), (3, 'none'), (4, '""')], "i long, t string")
    d = spark.createDataFrame([(1, "A Big Red car", ["x"]), (2, None, ["Tag One", None]), (3, "bigred", None)], "d long, s string, tags array<string>")
    none = F.lit(None).cast("string")
    for block in (1 << 16, 1):
        monkeypatch.setattr(bm25, "PHRASE_BLOCK", block)
        got = {(r["query"], r["doc"]): r["bonus"] for r in bm25.phrase_hits(q, d, "i", F.col("t"), "d", F.col("s"), none, none, F.col("tags")).collect()}
        assert got == {(1, 1): 10.0, (2, 1): 5.0, (2, 2): 5.0}


def test_routing_takes_the_first_registries_without_a_filter(spark):
    from wayfind.operators import routing

    q = spark.createDataFrame([(1,), (2,)], "query long")
    matches = spark.createDataFrame([(1, "z", 3), (1, "b", 1)], "query long, registry string, matches long")
    bare = spark.createDataFrame([(f"r{i}",) for i in range(9)], "registry string")
    got = defaultdict(list)
    for r in routing.route_queries(q, matches, bare, 3).orderBy("query", "rank").collect():
        got[r["query"]].append(r["registry"])
    assert got == {1: ["z", "b", "r0"], 2: ["r0", "r1", "r2"]}


def test_filters_are_probed_in_parts_and_hot_tokens_are_dealt_out(spark, monkeypatch):
    """Many probes in a part, many queries with one token; no false negatives, and what the positions say."""
    monkeypatch.setattr(routing, "PROBES", 5)
    m, k = routing.bloom_size(40_000, 0.01)
    assert m > 3 * routing.BITMAP_BITS
    items = spark.range(300).select(F.concat(F.lit("r"), F.col("id") % 3).alias("registry"), F.concat(F.lit("t"), F.col("id") % 100).alias("token")).distinct()
    tokens = spark.range(400).select((F.col("id") % 50).alias("query"), F.when(F.col("id") % 2 == 0, "t1").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("token")).distinct()
    filters_ = routing.bloom_build(items, m, k)
    key = lambda df: {(r["query"], r["registry"]): r["matches"] for r in df.collect()}
    got, exact = key(routing.bloom_match(tokens, filters_, m, k)), key(routing.exact_match(tokens, items))
    assert all(got.get(p, 0) >= n for p, n in exact.items())
    held = {}
    for r in routing.unpack_filters(filters_).collect():
        held.setdefault(r["registry"], set()).add(r["pos"])
    want = {}
    for r in tokens.withColumn("p", routing.bloom_positions(F.col("token"), m, k)).collect():
        for g, bits in held.items():
            if set(r["p"]) <= bits:
                want[r["query"], g] = want.get((r["query"], g), 0) + 1
    assert got == want
    assert routing.bloom_match(tokens.limit(0), filters_, m, k).count() == 0 and routing.bloom_match(tokens, filters_.limit(0), m, k).count() == 0


def test_conflicts_of_one_name_are_many_tasks(spark, monkeypatch):
    held = spark.range(60).select(F.lit("h").alias("developer_handle"), F.when(F.col("id") < 50, "n").otherwise("m").alias("entity_name"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("public_key"))
    asked = spark.range(40).select("id", F.lit("h").alias("handle"), F.lit("n").alias("name"), F.concat(F.lit("k"), F.col("id") % 2).alias("public_key")).coalesce(1)
    plain = asked.join(held.select(F.col("developer_handle").alias("handle"), F.col("entity_name").alias("name"), F.col("public_key").alias("held_by")), ["handle", "name"]).where("held_by <> public_key")
    want = sorted((r["id"], r["public_key"], r["held_by"]) for r in plain.collect())
    for rows in (100_000, 0):
        monkeypatch.setattr(names, "COPIES", 5)
        monkeypatch.setattr(names, "SMALL_ROWS", rows)
        got = names.name_conflicts(asked, held)
        assert sorted((r["id"], r["public_key"], r["held_by"]) for r in got.collect()) == want
        assert got.columns == plain.columns
        tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(tasks) > 1


def test_attestations_take_as_many_tasks_as_rows_want(spark, monkeypatch):
    from wayfind import catalog_queries
    from wayfind.operators import sizes

    monkeypatch.setattr(sizes, "TASK_ROWS", 500)
    made = catalog_queries._attestations(spark, "/root/testdata/sf0.001")
    n = sizes.tasks_for(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    assert n > 8
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n}), REPARTITION_BY_NUM") == 2


def test_few_rows_beside_many(spark, monkeypatch):
    from wayfind.operators import sizes

    many = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.1), (None, 1, 0.2), (2, 1, 0.3)], "query int, doc int, text double")
    few = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (None, 1, 0.7)], "query int, doc int, sim double")
    want = {(1, 1, 0.5, None), (1, 2, 0.1, 0.9), (1, 3, None, 0.8), (None, 1, 0.2, None), (None, 1, None, 0.7), (2, 1, 0.3, None)}
    for rows in (100_000, 0):
        monkeypatch.setattr(sizes, "SMALL_ROWS", rows)
        got = sizes.beside(many, few, ["query", "doc"]).collect()
        assert {tuple(r) for r in got} == want and len(got) == 6
    best = rank.normalise_by_max(many, "text")
    assert {tuple(r) for r in best.collect()} == {(1, 1, 1.0), (1, 2, 0.2), (None, 1, 1.0), (2, 1, 1.0)}
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()
