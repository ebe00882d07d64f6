"""Registration of the catalog queries and their DuckDB twins.

The driver's tables stand in for registry data: documents and parts for entities, benchmark items for requests, suppliers and
nations for names and hosts, events for announcements, heartbeats and latencies, order lines for attestations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.catalog_oracles import ORACLES
from wayfind.functions import identity, naming
from wayfind.functions import text as T
from wayfind.functions import vectors as V
from wayfind.operators import filters, index, liveness, metrics, names, rank, replication, retention, routing, segments, similarity, trust, validate
from wayfind.operators.blocks import bm25, bm25_fielded_top, bm25_top, fielded_phrases_top
from wayfind.operators.sizes import beside, cut, new_folder, small, tasks_for
from wayfind.plans import search as plan
from wayfind.sources import catalog, streams
from wayfind.streaming import folded, state

AS_OF = "2024-02-01 00:00:00"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that come in fewer partitions than there are cores, so a small table, are dealt out over them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: the first line names them, the source tags them, the language is their category."""
    d = _t(spark, sf_dir, "documents")
    sid = F.substring_index("source", "src", -1).cast("int")
    return d.select(
        F.col("doc_id").alias("entity_id"), F.substring_index("text", "\n", 1).alias("name"), F.array("source").alias("tags"), F.col("lang").alias("category"), F.col("text").alias("summary"),
        F.col("source").alias("home_registry"), F.when(F.col("doc_id") % 11 == 0, "inactive").otherwise("active").alias("status"), F.concat(F.lit("dev"), F.col("doc_id") % 7).alias("developer_id"),
        F.when(F.col("doc_id") % 5 == 0, "service").otherwise("agent").alias("entity_type"),
        F.timestamp_micros(F.unix_micros(_as_of()) - F.col("n_chars") % 90 * F.lit(86_400_000_000)).alias("updated_at"), sid.alias("sid"),
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark")
    none = F.lit(None).cast("string")
    return b.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), none.alias("category"), F.lit(None).cast("array<string>").alias("tags"), none.alias("developer_id"),
        F.when(F.col("item_id") % 3 == 0, "agent").alias("entity_type"), F.lit(10).alias("max_results"), F.lit(0).alias("offset"),
    )


def bm25_topk(spark, sf_dir):
    """BM25 top 10 of each benchmark item, by bounds over blocks of postings."""
    return bm25_top(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"), 10, "item_id", F.col("text"), "doc_id", F.col("text"))


def _fields() -> dict[str, Column]:
    return {"name": F.substring_index("text", "\n", 1), "tags": F.col("source"), "category": F.col("lang"), "summary": F.col("text")}


def _quoted(b: DataFrame) -> DataFrame:
    """Requests that quote their third and fourth word."""
    words = F.split("text", " ")
    return b.withColumn("text", F.concat(F.col("text"), F.lit(' "'), F.concat_ws(" ", F.get(words, F.lit(2)), F.get(words, F.lit(3))), F.lit('"')))


def bm25_fielded_topk(spark, sf_dir):
    """Fielded BM25 with the advanced tokenizer, top 10."""
    return bm25_fielded_top(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"), 10, "item_id", F.col("text"), "doc_id", _fields())


def phrase_bonus(spark, sf_dir):
    """Fielded scores with a bonus for quoted phrases, top 10."""
    return fielded_phrases_top(_quoted(_t(spark, sf_dir, "benchmark")), _t(spark, sf_dir, "documents"), 10, "item_id", F.col("text"), "doc_id", _fields(), F.array("source"))


def corpus_statistics(spark, sf_dir):
    """Postings and statistics of the whole corpus: each term's document and collection frequency."""
    tokens = index.token_rows(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    posted = index.postings(tokens)
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _updated_index(spark, sf_dir) -> segments.Index:
    """A stored index of all documents, after a third of them was replaced by other texts and a fifth was removed."""
    d = _t(spark, sf_dir, "documents")
    stored = segments.Index(spark, new_folder(spark, "index"), "doc_id", {"text": F.col("text")})
    stored.create(d)
    changed = d.where("doc_id % 3 = 0").withColumn("text", F.concat_ws(" ", F.lit("fresh-token"), "lang", "source"))
    stored.update(changed, d.where("doc_id % 5 = 1").select("doc_id"))
    return stored


def index_update(spark, sf_dir):
    """The terms of a stored index after changes, from its segments and deletions."""
    return _updated_index(spark, sf_dir).terms()


def stored_index_topk(spark, sf_dir):
    """BM25 top 10 from a stored index, changed and with its segments merged."""
    stored = _updated_index(spark, sf_dir)
    stored.merge(most=1)
    return stored.top(_t(spark, sf_dir, "benchmark"), 10, "item_id", F.col("text"))


def cosine_topk(spark, sf_dir):
    """The ten nearest vectors of each vector whose id is divisible by 100."""
    e = _t(spark, sf_dir, "embeddings")
    return similarity.cosine_hits(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", 64, 10)


def cosine_by_label(spark, sf_dir):
    """How many vectors of each label a query vector is close to."""
    e = _t(spark, sf_dir, "embeddings")
    hits = similarity.cosine_hits(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", 64, least=0.25)
    joined = hits.join(e.select(F.col("vec_id").alias("doc"), "label"), "doc")
    return joined.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))


def token_hash_vectors(spark, sf_dir):
    """Hashed token and bigram vectors of all documents, sparse."""
    out = V.hashed_slots(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return out.select(F.col("id").alias("doc_id"), "slot", F.round("value", 6).alias("value"))


def _hash_similarity(requests: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query, doc, sim): the k nearest hashed vectors of (id, text) rows for each (id, text) request."""
    def vectors(rows: DataFrame) -> DataFrame:
        return V.hashed_vectors(rows, rows.columns[0], F.col(rows.columns[1]), 384)

    return similarity.cosine_hits(vectors(requests), vectors(docs), "id", "vector", "id", "vector", 384, k)


def _candidates(spark, sf_dir) -> DataFrame:
    """Scored candidates of each request, all keyword hits and the 50 nearest hashed vectors, with source, trust, freshness and
    availability."""
    b, d = _t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents")
    labels = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    source = F.when(F.substring_index("source", "src", -1).cast("int") % 2 == 0, "local").otherwise("remote")
    age = F.timestamp_micros(F.unix_micros(_as_of()) - F.col("n_chars") % 90 * F.lit(86_400_000_000))
    known = F.struct(F.col("doc_id").alias("doc"), source.alias("source"), (F.col("quality") * 0.4 + 0.5).alias("trust"), rank.freshness(age, _as_of()).alias("freshness"))
    # what is known of a document goes with it into its block, so no pair has to be joined with it
    told = d.join(labels, "doc_id", "left").select("doc_id", "text", known.alias("known"))
    text = bm25(b, told, "item_id", F.col("text"), "known", F.col("text")).select("query", "doc.*", F.col("score").alias("text"))
    near = cut(_hash_similarity(b.select("item_id", "text"), d.select("doc_id", "text"), 50)).select("query", "doc", "sim")
    near = told.join(small(near), F.col("doc_id") == F.col("doc")).select("query", "doc", F.col("sim").alias("semantic"), F.col("known").alias("near"))
    hits = beside(rank.normalise_by_max(text, "text"), near, ["query", "doc"])
    own = {c: F.coalesce(c, f"near.{c}") for c in ("source", "trust", "freshness")}
    scores = {"text": F.round(F.coalesce("text", F.lit(0.0)), 6), "semantic": F.coalesce("semantic", F.lit(0.0))}
    return rank.source_defaults(hits.select("query", "doc", *[e.alias(c) for c, e in (scores | own).items()]))


def hybrid_weighted(spark, sf_dir):
    """Weighted ranking with its breakdown, top 10 above a least score."""
    ranked = filters.min_score(rank.rank_weighted(_candidates(spark, sf_dir)), 0.3)
    return ranked.where("rank <= 10").select("query", "doc", "source", "text", "semantic", "trust", F.round("freshness", 6).alias("freshness"), "availability", "score", "rank")


def hybrid_rrf(spark, sf_dir):
    """Reciprocal rank fusion, top 10."""
    return rank.rank_candidates(_candidates(spark, sf_dir), "rrf").where("rank <= 10").select("query", "doc", "score", "rank")


def candidates_dedupe(spark, sf_dir):
    """Candidates of two sources, one row per request and document."""
    c = _candidates(spark, sf_dir).select("query", "doc", "source", "text")
    again = c.where("doc % 2 = 0").withColumns({"source": F.lit("federated"), "text": F.lit(1.0)})
    return rank.dedupe_candidates(c.unionByName(again))


def merge_hits(spark, sf_dir):
    """The 50 best keyword hits and the 50 best hashed-vector hits of each request side by side."""
    b, d = _t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents")
    text = cut(bm25_top(b, d, 50, "item_id", F.col("text"), "doc_id", F.col("text")).withColumnRenamed("score", "text"))
    return plan.merge_hits(text, _hash_similarity(b.select("item_id", "text"), d.select("doc_id", "text"), 50))


def search_page(spark, sf_dir):
    """L3, L4: the second page of each request with counts."""
    ranked = rank.rank_weighted(_candidates(spark, sf_dir))
    return rank.page(ranked, 5, 5).select("query", "doc", "score", "rank", "n_distinct", "has_more")


def default_page(spark, sf_dir):
    """The first page of each request at the usual length, each row with the parts of its score."""
    out = rank.page(rank.rank_weighted(_candidates(spark, sf_dir))).withColumn("b", rank.score_breakdown())
    return out.select("query", "doc", "rank", "has_more", *[F.round(F.col("b")[c], 6).alias(c) for c in ("text_relevance", "semantic_similarity", "trust_score", "freshness", "availability")])


def _plan(spark, sf_dir, config: plan.SearchConfig) -> DataFrame:
    e = _entities(spark, sf_dir)
    d = _t(spark, sf_dir, "documents")
    sources = {"local": e.where("sid % 2 = 0"), "remote": e.where("sid % 2 = 1")}
    trust = _t(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("entity_id")).agg((F.max("quality") * 0.4 + 0.5).alias("trust"))
    cards = d.select(F.col("doc_id").alias("entity_id"), F.when(F.col("n_chars") % 3 == 0, "online").when(F.col("n_chars") % 3 == 1, "degraded").otherwise("offline").alias("status"))

    def semantic(requests: DataFrame, entities: DataFrame) -> DataFrame:
        return _hash_similarity(requests.select("query_id", "query"), entities.select("entity_id", T.embedding_text(F.col("name"), F.col("summary"), F.col("tags")).alias("t")), 50)

    out = plan.search(_requests(spark, sf_dir), sources, semantic, _as_of(), names=_host_names(spark, sf_dir), cards=cards, trust=trust, config=config)
    return out.select("query", "doc", "source", F.round("text", 6).alias("text"), F.round("semantic", 6).alias("semantic"), "trust", F.round("freshness", 6).alias("freshness"), "availability", "score", "rank", "n_distinct", "total_found", "has_more", "fqan", "developer_handle")


def search_plan(spark, sf_dir):
    """The whole discovery plan over a local and a remote catalog: keyword and vector hits,
    trust from labels, pages with names and live availability from cards."""
    return _plan(spark, sf_dir, plan.SearchConfig())


def search_plan_fielded(spark, sf_dir):
    """The same with the fielded engine."""
    return _plan(spark, sf_dir, plan.SearchConfig(engine="fielded"))


def vector_functions(spark, sf_dir):
    """Vectors at length 1, their products with the first ten axes, padded and trimmed, and those of a wrong length."""
    e = _t(spark, sf_dir, "embeddings").withColumn("unit", V.l2_normalize(F.col("embedding")))
    axis = F.array_repeat(F.lit(1.0), 64)
    wrong = similarity.wrong_dimensions(e.withColumn("cut", F.when(F.col("vec_id") % 9 != 0, V.pad_or_trim(F.col("embedding"), 64)).otherwise(V.pad_or_trim(F.col("embedding"), 63))), "cut", 64)
    rows = e.join(wrong.select("vec_id", F.lit(True).alias("wrong")), "vec_id", "left")
    return rows.select(
        "vec_id", F.round(V.dot(F.col("unit"), axis), 6).alias("along"), V.dot(F.col("unit"), F.array(F.lit(1.0))).alias("unequal"), F.round(V.dot(F.col("unit"), F.col("unit")), 6).alias("self"),
        F.size(V.pad_or_trim(F.col("unit"), 70)).alias("padded"), F.round(V.dot(V.pad_or_trim(F.col("unit"), 10), F.array_repeat(F.lit(1.0), 10)), 6).alias("first_ten"), F.coalesce("wrong", F.lit(False)).alias("wrong"),
    )


def query_hashes(spark, sf_dir):
    """Hashes of requests as compact JSON."""
    return _t(spark, sf_dir, "benchmark").select("item_id", identity.query_hash(F.struct("item_id", F.length("text").alias("n"))).alias("hash"))


def handle_filter(spark, sf_dir):
    """Requests by developer handle; unknown handles give no row."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("s-"), F.col("c_custkey") % 1500).alias("developer_handle"))
    s = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), F.col("s_suppkey")).alias("dev_handle"), F.col("s_suppkey").alias("developer_id"))
    return names.handles_to_ids(c, s)


def keyword_filter(spark, sf_dir):
    """F1, L1: parts whose name or type has a keyword, of one brand group."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"), F.col("p_brand").alias("category"), F.array("p_type", "p_brand").alias("tags"), F.col("p_size").alias("updated_at"))
    return filters.keyword_filter(p, "RED", None, ["econ"]).select("entity_id", "name", "category")


def remote_keyword_filter(spark, sf_dir):
    """the same over remote entities, without tombstoned ones."""
    d = _t(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").alias("entity_id"), F.col("text").alias("summary"), F.col("source").alias("name"), F.col("lang").alias("category"), F.array("source").alias("tags"), (F.col("doc_id") % 4 == 0).alias("tombstoned"), F.col("n_chars").alias("received_at"))
    return filters.keyword_filter(e, "License", "en", newest="received_at", live_only=True).select("entity_id", "name")


def any_tag_filter(spark, sf_dir):
    """parts with any of some tags and one size or none asked for."""
    p = _t(spark, sf_dir, "part")
    kept = p.where(filters.has_any_tag(F.array("p_type", "p_brand"), F.array(F.lit("economy"), F.lit("BRAND#3"))) & filters.equal_or_open(F.col("p_name"), F.lit("")))
    return kept.select("p_partkey", "p_type", "p_brand")


def capability_filter(spark, sf_dir):
    """entities by skills, languages, trust and status."""
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    caps = d.select("doc_id", F.struct(F.array("source").alias("skills"), F.array("lang").alias("languages")).alias("capability_summary"), F.col("quality").cast("double").alias("trust_score"), F.when(F.col("toxic") == 0, "active").otherwise("inactive").alias("status"))
    return filters.capability_filter(caps, skills=["SRC1", "src2", "src3"], languages=["EN", "fr"], min_trust=0.5, status="active").select("doc_id")


def facets(spark, sf_dir):
    """A3: categories and tags with counts."""
    return metrics.facets(_t(spark, sf_dir, "part"), F.col("p_brand"), F.array("p_type", "p_name"))


def catalog_counts(spark, sf_dir):
    """A1, A2: counts of local and live remote entities and developers."""
    d = _t(spark, sf_dir, "documents")
    remote = d.where("doc_id % 2 = 1").withColumn("tombstoned", F.col("doc_id") % 3 == 0)
    return metrics.network_rollup(d.where("doc_id % 2 = 0"), remote, _t(spark, sf_dir, "supplier"), 4)


def list_page(spark, sf_dir):
    """L1: the third page of 25 economy parts."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("category"), F.col("p_size").alias("updated_at"))
    return filters.list_page(p, 25, 50, "ECONOMY")


def entity_patch(spark, sf_dir):
    """F16: parts with patched sizes and types."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.lit(0).alias("updated_at"))
    patch = _t(spark, sf_dir, "part").where("p_partkey % 10 = 0").select("p_partkey", F.when(F.col("p_partkey") % 20 == 0, "PATCHED").alias("p_type"), (F.col("p_size") + 100).alias("p_size"))
    return filters.apply_patches(p, patch, "p_partkey", ["p_type", "p_size"], F.lit(7))


def request_defaults(spark, sf_dir):
    """requests with defaults filled in and public output redacted."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "service").when(F.col("p_size") % 3 == 1, "").alias("entity_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("entity_url"), F.col("p_type").alias("service_endpoint"), F.when(F.col("p_size") > 25, F.array("p_brand")).alias("tags"))
    full = identity.default_request(p)
    return full.select("p_partkey", "entity_type", F.nullif(F.col("entity_url"), F.lit("")).alias("url"), F.size("tags").alias("n_tags")).join(identity.redact(full).select("p_partkey", F.col("entity_url").alias("public_url")), "p_partkey")


def _validation_input(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("entity_id"), F.substring_index("text", "\n", 1).alias("name"), F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("owner"),
        F.when(F.col("doc_id") % 7 != 0, "https://x.example").alias("entity_url"), F.col("lang").alias("category"), F.col("text").alias("summary"), F.lit("key").alias("public_key"),
        F.array_repeat(F.col("source"), (F.col("doc_id") % 23).cast("int")).alias("tags"), F.when(F.col("doc_id") % 3 == 0, "service").when(F.col("doc_id") % 17 == 0, "robot").otherwise("agent").alias("entity_type"),
        F.when(F.col("doc_id") % 2 == 0, "https://s.example").alias("service_endpoint"), F.when(F.col("doc_id") % 5 == 0, "barter").alias("pricing_model"),
    )


def validate_entities(spark, sf_dir):
    """Every reason why an entity is invalid."""
    out = validate.validate_entities(_validation_input(spark, sf_dir))
    return out.select("entity_id", F.array_join("reasons", "; ").alias("reasons"), "first_reason", "valid")


def validate_developers(spark, sf_dir):
    """developers and names with missing fields."""
    s = _t(spark, sf_dir, "supplier")
    dev = validate.validate_developers(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("developer_id"), F.when(F.col("s_suppkey") % 4 != 0, F.repeat("s_name", F.col("s_nationkey") % 8)).alias("name"), F.when(F.col("s_acctbal") > 0, "k").alias("public_key")))
    nam = validate.validate_names(s.select(F.col("s_suppkey").alias("key"), F.lit("h/d/n").alias("fqan"), F.when(F.col("s_suppkey") % 3 != 0, "n").alias("entity_name"), F.lit("d").alias("developer_handle"), F.when(F.col("s_suppkey") % 5 != 0, "h").otherwise("").alias("registry_host"), F.lit("e").alias("entity_id"), F.lit("d").alias("developer_id")))
    return dev.select(F.lit("developer").alias("kind"), "key", F.array_join("reasons", "; ").alias("reasons")).unionByName(nam.select(F.lit("name").alias("kind"), "key", F.array_join("reasons", "; ").alias("reasons")))


def validate_handles(spark, sf_dir):
    """which words of the documents make handles, and why others don't."""
    words = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    tried = words.unionByName(words.where(F.length("w") > 4).select(F.concat(F.lower("w"), F.lit("-")).alias("w"))).unionByName(words.select(F.concat(F.lower("w"), F.lit("--x")).alias("w"))).unionByName(words.limit(1).select(F.lit("admin").alias("w"))).distinct()
    return tried.select("w", naming.handle_error(F.col("w")).alias("error"))


def _host_names(spark, sf_dir) -> DataFrame:
    """Suppliers as names at their nation's host."""
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    host = F.lower(F.regexp_replace("n_name", "_", "-"))
    handle = F.concat(F.lit("dev-"), F.col("s_suppkey") % 40)
    name = F.concat(F.lit("agent-"), F.col("s_suppkey") % 60)
    return j.select(
        naming.build_fqan(host, handle, name).alias("fqan"), name.alias("entity_name"), handle.alias("developer_handle"), host.alias("registry_host"), (F.col("s_suppkey") % 80).alias("entity_id"),
        (F.col("s_suppkey") % 40).alias("developer_id"), F.col("s_suppkey").alias("registered_at"), F.concat(F.lit("k"), F.col("s_suppkey") % 9).alias("public_key"),
    )


def parse_fqan(spark, sf_dir):
    """Names built from page URLs, parsed again with their qualifiers, and hosts of URLs."""
    p = _t(spark, sf_dir, "pages")
    host = identity.registry_host(F.col("url"))
    raw = F.concat(F.when(F.col("page_id") % 2 == 0, "zns://").otherwise(""), host, F.lit("/dev-"), F.col("page_id").cast("string"), F.lit("/agent"), F.when(F.col("page_id") % 3 == 0, "@2.1.0").when(F.col("page_id") % 7 == 1, "@").otherwise(""), F.when(F.col("page_id") % 5 == 0, "#text.summary").otherwise(""))
    rows = p.select("page_id", host.alias("host"), raw.alias("raw"))
    q, f = naming.parse_qualified(F.col("raw")), naming.parse_fqan(F.col("raw"))
    return rows.select("page_id", "host", q["base"].alias("base"), q["version"].alias("version"), q["capability"].alias("capability"), f["handle"].alias("handle"), f["name"].alias("name"), f["error"].alias("error"))


def txt_records(spark, sf_dir):
    """TXT records of page hosts that carry the wanted version and key."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("v=dns"), F.col("page_id") % 3, F.lit("  key=k"), F.col("page_id") % 5, F.lit(" fqan=h/d/n")).alias("txt"))
    return p.select("page_id", naming.txt_matches(F.col("txt"), F.lit("dns1"), F.lit("k2"), F.lit("h/d/n")).alias("matches"))


def names_join(spark, sf_dir):
    """Entities with their first name."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"))
    return names.attach_names(s, _host_names(spark, sf_dir))


def resolve_name(spark, sf_dir):
    """(handle, name) requests against local names, then remote ones."""
    n = _host_names(spark, sf_dir)
    req = _t(spark, sf_dir, "customer").select(F.concat(F.lit("dev-"), F.col("c_custkey") % 45).alias("handle"), F.concat(F.lit("agent-"), F.col("c_custkey") % 65).alias("name")).distinct()
    ent = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_acctbal") > 5000, "active").otherwise("inactive").alias("status"))
    dev = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("developer_id"), (F.col("s_suppkey") % 2 == 0).alias("dev_handle_verified"))
    remote = n.where("registered_at % 2 = 1").withColumn("tombstoned", F.col("registered_at") % 5 == 0)
    return names.resolve_names(req, n.where("registered_at % 2 = 0"), ent, dev, remote)


def resolve_fqan(spark, sf_dir):
    """Exact names, local before remote; entity lookups likewise."""
    n = _host_names(spark, sf_dir)
    remote = n.where("registered_at % 2 = 1").withColumn("tombstoned", F.col("registered_at") % 5 == 0)
    req = n.select("fqan").unionByName(n.select(F.concat("fqan", F.lit("-x")).alias("fqan"))).distinct()
    return names.resolve_fqans(req, n.where("registered_at % 2 = 0"), remote)


def lookup_entity(spark, sf_dir):
    """Parts by id, local before remote."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), "p_name")
    ids = p.select("entity_id").unionByName(p.select((-F.col("entity_id")).alias("entity_id")))
    return names.lookup_entities(ids, p.where("entity_id % 2 = 0"), p.withColumn("p_name", F.concat(F.lit("far "), "p_name")))


def registration_check(spark, sf_dir):
    """Registrations by unknown developers or with another key."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 120).alias("developer_id"), F.concat(F.lit("k"), F.col("c_nationkey")).alias("proof_key"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("developer_id"), F.concat(F.lit("k"), F.col("s_nationkey")).alias("public_key"))
    return names.check_registrations(c, s.where("developer_id % 2 = 0"), s.where("developer_id % 2 = 1"))


def registration_insert(spark, sf_dir):
    """Rows with new keys and rejects of a batch of registrations."""
    c = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("entity_id"), "c_custkey")
    held = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"))
    fresh, bad = catalog.split_new(c, held, ["entity_id"], "c_custkey")
    return fresh.withColumn("reason", F.lit("")).unionByName(bad)


def catalog_inserts(spark, sf_dir):
    """A table after two batches of keyed inserts, the second of them sent twice."""
    path = new_folder(spark, "table")
    c = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("entity_id"), "c_custkey")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit(None).cast(c.schema["c_custkey"].dataType).alias("c_custkey"))
    catalog.insert_rows(s, path, ["entity_id"], batch="suppliers")
    for _ in range(2):
        catalog.insert_rows(c, path, ["entity_id"], "c_custkey", batch="customers")
    return catalog.read_rows(spark, path, c.schema)


def cards_read(spark, sf_dir):
    """S3: cards written as JSON lines and read back: ids from the request where the card has none, none where the two differ."""
    d, folder = _t(spark, sf_dir, "documents"), new_folder(spark, "cards")
    own = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("e"), "doc_id"))
    wanted = F.when(F.col("doc_id") % 7 == 0, F.lit("other")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("e"), "doc_id"))
    skills = F.transform(F.array_repeat("lang", (F.col("doc_id") % 4).cast("int")), lambda x: F.struct(x.alias("name")))
    card = F.struct(own.alias("entity_id"), F.when(F.col("n_chars") % 3 == 0, "online").otherwise("degraded").alias("status"), skills.alias("capabilities"), F.struct(F.col("source").alias("framework")).alias("metadata"), wanted.alias("wanted_id"))
    lines = d.select(F.when(F.col("doc_id") % 11 == 0, "not json").when(F.col("doc_id") % 13 == 0, F.concat(F.lit('{"entity_id": "'), F.repeat(F.lit("x"), 60_000), F.lit('"}'))).otherwise(F.to_json(card)).alias("value"))
    lines.write.text(folder)
    return catalog.read_cards(spark, folder).select("entity_id", "status", F.size("capabilities").alias("n_capabilities"), F.col("metadata.framework").alias("framework"))


def results_by_date(spark, sf_dir):
    """Ranked results of two days, the first of which was written again."""
    ranked, path = cosine_topk(spark, sf_dir), new_folder(spark, "results")
    for day, rows in (("2024-01-01", ranked), ("2024-01-02", ranked), ("2024-01-01", ranked.where("rank = 1"))):
        catalog.write_results(rows, path, day)
    return spark.read.parquet(path).select("query", "doc", "sim", "rank", F.col("query_date").cast("string").alias("query_date"))


def named_embedder(spark, sf_dir):
    """Vectors of all documents by the embedder that is registered as hash."""
    made = V.embedder("hash", dims=384)(F.col("text"))
    out = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(made).alias("slot", "value"))
    return out.where("value <> 0").select("doc_id", "slot", F.round(F.col("value").cast("double"), 4).alias("value"))


def name_availability(spark, sf_dir):
    """Which handles are free, and who holds the others."""
    req = _t(spark, sf_dir, "customer").select(F.concat(F.lit("dev-"), F.col("c_custkey") % 60).alias("developer_handle")).distinct()
    return names.availability(req, _host_names(spark, sf_dir), ["developer_handle"], "entity_id")


def name_conflicts(spark, sf_dir):
    """Names that another key holds."""
    req = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("dev-"), F.col("c_custkey") % 40).alias("handle"), F.concat(F.lit("agent-"), F.col("c_custkey") % 60).alias("name"), F.concat(F.lit("k"), F.col("c_custkey") % 9).alias("public_key"))
    return names.name_conflicts(req, _host_names(spark, sf_dir)).select("c_custkey", "handle", "name", "public_key", "held_by")


def developer_entities(spark, sf_dir):
    """Each customer's newest three orders as entities of a developer."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("developer_id"), F.col("o_orderdate").alias("updated_at"))
    dev = _t(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("developer_id"))
    return names.entities_by_developer(o, dev, 3).select("entity_id", "developer_id", "rank")


def names_by_host(spark, sf_dir):
    """The names of one handle at one host."""
    return names.names_of(_host_names(spark, sf_dir).withColumn("registry_host", F.lit("host")), "dev-7", "host").select("fqan", "entity_name")


def latest_version(spark, sf_dir):
    """The newest 2.x version of each name, with orders as versions."""
    v = _versions(spark, sf_dir)
    return names.latest_versions(v, F.lit("2")).select("fqan", "version", "entity_id")


def _versions(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("fqan"), F.concat(F.col("o_orderkey") % 4, F.lit("."), F.col("o_orderkey") % 10).alias("version"), F.col("o_orderkey").alias("entity_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("registered_at"))


def version_history(spark, sf_dir):
    """All versions of each name, newest first, with the one before."""
    return names.version_history(_versions(spark, sf_dir)).select("fqan", "version", "entity_id", "rank", "previous_version")


def _announcements(spark, sf_dir) -> DataFrame:
    """Events as announcements: the user is the entity, the kind of event the action, and props say whose key signed."""
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "register", "click": "update", "purchase": "update", "view": "agent_status", "error": "deregister"}.items() for x in kv]), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), F.lit("agent_announce").alias("type"), action.alias("action"), F.concat(F.lit("key"), k % 3).alias("origin_public_key"),
        F.when(k % 2 == 0, "active").otherwise("inactive").alias("status"), F.concat(F.lit("name-"), F.col("event_id")).alias("name"), F.concat(F.lit("cat-"), k % 10).alias("category"),
        F.col("ts").cast("timestamp").alias("arrived_at"), (k % 4).alias("hop_count"), F.lit(3).alias("max_hops"), F.when(k % 20 != 0, "sig").alias("signature"),
    )


def announce_dedupe(spark, sf_dir):
    """Announcements without repeats of an entity's action within an hour."""
    a = _announcements(spark, sf_dir)
    out = replication.dedupe_announcements(a, 3600, key=F.concat_ws("|", "entity_id", "action"))
    return out.select("seq", "entity_id", "action")


def announce_forward(spark, sf_dir):
    """signed announcements with hops left, one hop further."""
    return filters.within_hops(filters.signed_only(_announcements(spark, sf_dir))).select("seq", "entity_id", "hop_count")


def announce_route(spark, sf_dir):
    """Announcements by target table."""
    kinds = F.array(*map(F.lit, [*replication.TYPES, "other"]))
    a = _announcements(spark, sf_dir).withColumn("type", F.get(kinds, (F.col("seq") % 7).cast("int")))
    return replication.route(a).groupBy("type", "target").agg(F.count(F.lit(1)).alias("n"))


def announce_authorize(spark, sf_dir):
    """Which announcements are accepted, by the pinned key."""
    return replication.authorize(_announcements(spark, sf_dir)).select("seq", "entity_id", "action", "pin", "accepted")


def entity_state(spark, sf_dir):
    """The state of each entity after all accepted announcements."""
    s = replication.entity_state(replication.authorize(_announcements(spark, sf_dir)), ["name", "category"])
    return s.select("entity_id", "name", "category", "pin", "status", F.unix_micros("received_at").alias("received_us"), "tombstoned", F.unix_micros("tombstone_at").alias("tombstone_us"))


def _in_turn(rows: DataFrame, folder: str, run, by: Column, parts: int = 3) -> None:
    """Writes rows as envelopes in the order of a number, a part at a time, and has the stream read each part: every part is a restart."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    part = F.least(F.lit(parts - 1), F.floor((by - low) * parts / max(1, (high or 0) - (low or 0))))
    for p in range(parts):
        streams.encode_envelopes(rows.where(part == p), "gossip_announce").write.mode("append").text(f"{folder}/in")
        run().awaitTermination()


def _folded(spark, rows: DataFrame, *names: str) -> folded.State:
    """The tables that a stream of their announcements leaves."""
    folder = new_folder(spark, "stream")
    types = [t for n in names for t in folded.TABLES[n].types]
    _in_turn(rows, folder, lambda: folded.start(streams.announcements(spark, f"{folder}/in"), f"{folder}/state", f"{folder}/check", f"{folder}/activity", signed=False, names=list(names), types=types), F.col("seq"))
    return folded.State(spark, f"{folder}/state")


def stream_entities(spark, sf_dir):
    """entity_state from a stream that was stopped and started between its parts."""
    rows = _announcements(spark, sf_dir).withColumns({"entity_id": F.col("entity_id").cast("string"), "timestamp": F.col("arrived_at")})
    s = _folded(spark, rows, "remote_entities").read("remote_entities")
    return s.select(F.col("entity_id").cast("long").alias("entity_id"), "name", "category", "pin", "status", F.unix_micros("received_at").alias("received_us"), "tombstoned", F.unix_micros("tombstone_at").alias("tombstone_us"))


def stream_developers(spark, sf_dir):
    """developer_state from a stream."""
    rows = _developer_rows(spark, sf_dir).withColumns({"developer_id": F.col("developer_id").cast("string"), "arrived_at": _as_of()})
    return _folded(spark, rows, "remote_developers").read("remote_developers").withColumn("developer_id", F.col("developer_id").cast("long"))


def stream_names(spark, sf_dir):
    """name_state from a stream."""
    rows = _binding_rows(spark, sf_dir).withColumns({"entity_id": F.col("entity_id").cast("string"), "type": F.lit("name_binding"), "arrived_at": _as_of()})
    return _folded(spark, rows, "remote_names").read("remote_names").select("fqan", F.col("entity_id").cast("long").alias("entity_id"), "version", "tombstoned")


def stream_proofs(spark, sf_dir):
    """proof_state from a stream."""
    p = _proof_rows(spark, sf_dir)
    rows = p.select("seq", F.lit("registry_proof").alias("type"), F.lit("announce").alias("action"), F.col("registry_id").cast("string").alias("registry_id"), "domain", F.col("proof").cast("string").alias("proof_json"), _as_of().alias("arrived_at"))
    out = _folded(spark, rows, "registry_proofs").read("registry_proofs")
    return out.select(F.col("registry_id").cast("int").alias("registry_id"), "domain", F.col("proof_json").cast("long").alias("proof"))


def stream_tiers(spark, sf_dir):
    """Verification tiers from a stream of attestations."""
    o = _t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("seq"), F.lit("peer_attestation").alias("type"), F.lit("attest").alias("action"), F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("attester_id"), _as_of().alias("arrived_at"))
    return trust.verification_tiers(_folded(spark, rows, "peer_attestations").read("peer_attestations").select(F.col("subject_id").cast("long").alias("subject_id"), "attester_id"))


def stream_activity(spark, sf_dir):
    """How many announcements of each kind the activity feed of a stream has got."""
    rows = _announcements(spark, sf_dir).withColumn("entity_id", F.col("entity_id").cast("string"))
    folder = new_folder(spark, "stream")
    _in_turn(rows, folder, lambda: folded.start(streams.announcements(spark, f"{folder}/in"), f"{folder}/state", f"{folder}/check", f"{folder}/activity", signed=False, names=["remote_entities"]), F.col("seq"))
    return spark.read.parquet(f"{folder}/activity").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def stream_dedupe(spark, sf_dir):
    """announce_dedupe as a stateful stream."""
    rows = _announcements(spark, sf_dir).withColumn("entity_id", F.col("entity_id").cast("string"))
    folder = new_folder(spark, "stream")

    def run():
        kept = state.dedupe(streams.announcements(spark, f"{folder}/in"), 3600, F.concat_ws("|", "entity_id", "action"))
        return state.start(kept, state.to_folder(f"{folder}/out"), f"{folder}/check")

    _in_turn(rows, folder, run, F.unix_micros("arrived_at"))
    return spark.read.parquet(f"{folder}/out").select("seq", F.col("entity_id").cast("long").alias("entity_id"), "action")


def stream_became_active(spark, sf_dir):
    """became_active as a stateful stream of heartbeats, whose timers also tell who has fallen silent."""
    rows = _beats(spark, sf_dir).select(F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("signature"))
    folder = new_folder(spark, "stream")

    def run():
        moves = state.transitions(streams.heartbeats(spark, f"{folder}/in"), "entity_id", "timestamp", "signature", 3600)
        return state.start(moves, state.to_folder(f"{folder}/out"), f"{folder}/check")

    low, high = rows.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    for p in range(3):
        span = F.least(F.lit(2), F.floor((F.unix_micros("timestamp") - low) * 3 / max(1, (high or 0) - (low or 0))))
        rows.where(span == p).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in")
        run().awaitTermination()
    out = spark.read.parquet(f"{folder}/out").where("event = 'became_active'")
    return out.select(F.col("beat").alias("event_id"), F.col("entity").cast("long").alias("user_id"))


def expire_tombstones(spark, sf_dir):
    """Entities that are still held, those without a tombstone or with one that is at most a day old."""
    s = replication.entity_state(replication.authorize(_announcements(spark, sf_dir)), ["name"])
    return retention.expire_tombstones(s, _as_of(), seconds=86_400).select("entity_id", "tombstoned")


def _developer_rows(spark, sf_dir) -> DataFrame:
    # a projection of its own: the text is parsed once, not for every use of the number
    e, k = _t(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k")), F.col("k")
    d = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("developer_id"), F.when(k % 2 == 0, "developer_announce").otherwise("dev_handle").alias("type"), F.when(k % 2 == 0, F.when(k % 10 == 0, "deregister").otherwise("register")).otherwise(F.when(k % 9 == 0, "release").when(k % 3 == 0, "verify").otherwise("claim")).alias("action"), F.concat(F.lit("n"), k).alias("name"), F.concat(F.lit("k"), k % 3).alias("public_key"), F.concat(F.lit("h"), k % 7).alias("dev_handle"))
    return d


def developer_state(spark, sf_dir):
    """Remote developers with their handles, folded from the stream."""
    return replication.developer_state(_developer_rows(spark, sf_dir))


def _binding_rows(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("h/d/"), F.col("user_id")).alias("fqan"), F.when(k % 6 == 0, "release").otherwise("bind").alias("action"), F.col("user_id").alias("entity_id"), F.concat(F.lit("1."), k).alias("version"))


def name_state(spark, sf_dir):
    """Bindings, proofs and attestations: the last row of each key, releases tombstone."""
    return replication.name_state(_binding_rows(spark, sf_dir), ["entity_id", "version"])


def _proof_rows(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), k.alias("registry_id"), F.col("event_type").alias("domain"), F.col("user_id").alias("proof"))


def proof_state(spark, sf_dir):
    """The last proof of each registry, all columns together."""
    return replication.latest_rows(_proof_rows(spark, sf_dir), ["registry_id"], ["domain", "proof"])


def record_expiry(spark, sf_dir):
    """Users whose last event is at most four hours old."""
    last = liveness.heartbeat_fold(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return retention.expire_records(last, as_of, "last_heartbeat", 14_400).select("user_id")


def _beats(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")


def heartbeats_in_skew(spark, sf_dir):
    """Heartbeats whose clock is at most a minute off; unreadable times go."""
    b = _beats(spark, sf_dir)
    claimed = F.when(F.col("event_id") % 50 == 0, "yesterday").otherwise(identity.format_rfc3339(F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 121 - 60) * 1_500_000)))
    return filters.within_skew(b.withColumn("claimed", claimed), identity.parse_rfc3339(F.col("claimed")), F.col("ts")).select("event_id", "user_id")


def liveness_sweep(spark, sf_dir):
    """Users that count as active and were silent for an hour at as_of."""
    state = liveness.heartbeat_fold(_beats(spark, sf_dir), "user_id", "ts")
    out = liveness.liveness_sweep(state, F.lit("2024-01-31 00:00:00").cast("timestamp"), 3600, "user_id")
    return out.select("user_id", F.unix_micros("last_heartbeat").alias("last_us"))


def active_sessions(spark, sf_dir):
    """Spans of each user's activity without an hour's silence."""
    s = liveness.active_sessions(_beats(spark, sf_dir), "user_id", "ts", 3600)
    return s.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_at").alias("last_us"), "beats")


def became_active(spark, sf_dir):
    """The events that turn a user active."""
    return liveness.became_active(_beats(spark, sf_dir), "user_id", "ts", 3600).select("event_id", "user_id")


def over_limit(spark, sf_dir):
    """Users with more than two events in an hour."""
    out = metrics.over_limit(_beats(spark, sf_dir), "ts", "user_id", 2, "1 hour")
    return out.select("user_id", F.unix_micros("window_start").alias("window_us"), "n")


def activity_hourly(spark, sf_dir):
    """Events of each type by hour."""
    out = metrics.activity_counts(_beats(spark, sf_dir), "ts", "event_type")
    return out.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


def latency_summary(spark, sf_dir):
    """Latency percentiles of each event type; errors count as failed."""
    rows = _beats(spark, sf_dir).withColumn("kind", F.col("user_id") % 5)
    return metrics.latency_summary(rows, ["kind"], "value", F.col("event_type") != "error")


def _attestations(spark, sf_dir) -> DataFrame:
    """Order lines as observations: the supplier is the entity, the customer's nation the observer, returned lines fail."""
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # as many tasks as the rows want: sorting for the joins then takes no more memory however large the tables are
    own, n = tasks_for(o), tasks_for(l)
    o = o.repartition(own, "o_custkey").join(c.repartition(own, "c_custkey"), o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey")
    j = l.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), l.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col("l_suppkey").alias("entity_id"), F.col("c_nationkey").alias("observer_registry")).agg(
        F.count(F.lit(1)).alias("invocations"), F.count_if(F.col("l_returnflag") != "R").alias("successes"), (F.avg("l_quantity") * 40).alias("avg_latency_ms"), (F.avg("l_discount") * 60).alias("avg_rating")
    )


def reputation(spark, sf_dir):
    """Reputation of each attestation."""
    a = _attestations(spark, sf_dir)
    r = trust.reputation(F.col("invocations"), F.col("successes"), F.col("avg_latency_ms"), F.col("avg_rating"))
    return a.select("entity_id", "observer_registry", "invocations", "successes", F.round(r, 6).alias("reputation"))


def entity_trust(spark, sf_dir):
    """Trust and confidence of each entity, with weights of some observers."""
    w = _t(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("observer_registry"), (F.col("n_nationkey") / 10.0).alias("weight"))
    out = trust.entity_trust(_attestations(spark, sf_dir), w)
    return out.select("entity_id", F.round("trust", 6).alias("trust"), F.round("confidence", 6).alias("confidence"), "attestations", "invocations")


def verification_tiers(spark, sf_dir):
    """A4: distinct attesters per subject and the tier they give."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("attester_id"))
    return trust.verification_tiers(o)


def _registry_items(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return routing.registry_tokens(d, "source", F.substring_index("text", "\n", 1), F.col("lang"), F.array("source"), F.col("text"))


_M, _K = routing.bloom_size(500_000, 0.01)


def registry_tokens(spark, sf_dir):
    """B2: how many distinct tokens each registry holds."""
    return _registry_items(spark, sf_dir).groupBy("registry").agg(F.count(F.lit(1)).alias("n_tokens"))


def bloom_filters(spark, sf_dir):
    """Set bits of each registry's filter after writing it and reading it back."""
    built = routing.bloom_build(_registry_items(spark, sf_dir), _M, _K)
    path = new_folder(spark, "filters")
    built.write.parquet(path)
    back = routing.unpack_filters(spark.read.parquet(path))
    return back.groupBy("registry").agg(F.count(F.lit(1)).alias("bits_set"), F.sum("pos").alias("pos_sum"))


def bloom_match(spark, sf_dir):
    """How many of a request's tokens each registry may hold."""
    tokens = routing.query_tokens(_t(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return routing.bloom_match(tokens, routing.bloom_build(_registry_items(spark, sf_dir), _M, _K), _M, _K)


def registry_routing(spark, sf_dir):
    """The five best registries of each request by exact matches, with one registry that sent no filter."""
    q = _t(spark, sf_dir, "benchmark")
    tokens = routing.query_tokens(q, "item_id", F.col("text"))
    matches = routing.exact_match(tokens, _registry_items(spark, sf_dir).where("registry <> 'src3'"))
    return routing.route_queries(q, matches, q.sparkSession.range(1).select(F.lit("src3").alias("registry")), 5, "item_id")


def federated_topk(spark, sf_dir):
    """Registries rank their own documents, the results are merged, top 5."""
    q = _requests(spark, sf_dir)
    tokens = routing.query_tokens(_t(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    routes = routing.route_queries(_t(spark, sf_dir, "benchmark"), routing.exact_match(tokens, _registry_items(spark, sf_dir)), None, 3)
    return plan.federated_top(q, _entities(spark, sf_dir), routes, 5).select("query", "registry", "doc", "score", "rank")


def advanced_tokens(spark, sf_dir):
    """Advanced tokens with bigrams of every request."""
    config = T.TokenizerConfig(ngram_min=2, ngram_max=2, synonyms={"the": ["x"], "thing": ["object", "item"]})
    b = _t(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(T.tokenize_advanced(F.col("text"), config)).alias("token")).groupBy("item_id", "token").agg(F.count(F.lit(1)).alias("n"))


def entity_ids(spark, sf_dir):
    """Ids from keys and fingerprints of records."""
    s = _t(spark, sf_dir, "supplier")
    key = F.concat(F.lit("ed25519:"), F.base64(F.col("s_name").cast("binary")))
    return s.select("s_suppkey", identity.make_id("agent", key).alias("agent_id"), identity.make_id("developer", key).alias("developer_id"), identity.fingerprint("s_name", "s_nationkey").alias("fingerprint"))


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_fielded_topk, phrase_bonus, corpus_statistics, index_update, stored_index_topk, cosine_topk, cosine_by_label, token_hash_vectors, hybrid_weighted, hybrid_rrf, candidates_dedupe, merge_hits,
    search_page, default_page, search_plan, search_plan_fielded, vector_functions, query_hashes, handle_filter, keyword_filter, remote_keyword_filter, any_tag_filter, capability_filter, facets, catalog_counts, list_page, entity_patch, request_defaults, validate_entities,
    validate_developers, validate_handles, parse_fqan, txt_records, names_join, resolve_name, resolve_fqan, lookup_entity, registration_check, registration_insert, catalog_inserts, cards_read, results_by_date, named_embedder, name_availability, name_conflicts,
    developer_entities, names_by_host, latest_version, version_history, announce_dedupe, announce_forward, announce_route, announce_authorize, entity_state, expire_tombstones, developer_state,
    name_state, proof_state, stream_entities, stream_developers, stream_names, stream_proofs, stream_tiers, stream_activity, stream_dedupe, stream_became_active, record_expiry, heartbeats_in_skew, liveness_sweep, active_sessions, became_active, over_limit, activity_hourly, latency_summary, reputation, entity_trust,
    verification_tiers, registry_tokens, bloom_filters, bloom_match, registry_routing, federated_topk, advanced_tokens, entity_ids,
)}
