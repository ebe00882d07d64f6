"""The discovery plan: many requests in, ranked pages out, as one logical plan.

Keyword and vector hits are joined per request, hydrated with entity rows, filtered before any cut, united over sources, made
distinct, ranked, cut to a page and enriched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.text import embedding_text, tokenize_advanced, tokenize_basic
from wayfind.operators import rank as K
from wayfind.operators.blocks import bm25, bm25_fielded, blocks_for, counted_blocks, keyword_engine, mixed_scores, parts_of_requests
from wayfind.operators.bm25 import BOOSTS, idf, phrase_hits, query_terms, saturation, top_k, with_phrases
from wayfind.operators.filters import equal_or_open, has_any_tag, min_score, not_inactive
from wayfind.operators.index import token_rows, wanted_postings
from wayfind.operators.liveness import availability_of
from wayfind.operators.names import attach_names
from wayfind.operators.sizes import beside, cut, small


@dataclass(frozen=True)
class SearchConfig:
    engine: str = "basic"
    method: str = "weighted"
    weights: K.Weights = field(default_factory=K.Weights)
    min_score: float = 0.0
    enrich_top: int = 10


def _text() -> Column:
    return F.concat_ws(" ", embedding_text(F.col("name"), F.col("summary"), F.col("tags")), "category")


def _fields() -> dict[str, Column]:
    return {"name": F.col("name"), "tags": F.array_join("tags", " "), "category": F.col("category"), "summary": F.col("summary")}


def text_hits(requests: DataFrame, entities: DataFrame, config: SearchConfig) -> DataFrame:
    """(query, doc, text): normalised keyword scores of all hits."""
    keyword_engine(config.engine)
    if config.engine == "basic":
        scores = bm25(requests, entities, "query_id", F.col("query"), "entity_id", _text())
    else:
        scores = bm25_fielded(requests, entities, "query_id", F.col("query"), "entity_id", _fields())
        scores = with_phrases(scores, phrase_hits(requests, entities, "query_id", F.col("query"), "entity_id", F.col("name"), F.col("summary"), F.col("category"), F.col("tags")))
    return K.normalise_by_max(scores.withColumnRenamed("score", "text"), "text")


def merge_hits(text: DataFrame, semantic: DataFrame) -> DataFrame:
    """Keyword and vector hits of each query side by side; a missing score is 0. See sizes.beside: vector hits are few as a rule."""
    both = beside(text, semantic.select("query", "doc", F.col("sim").alias("semantic")), ["query", "doc"])
    return both.select("query", "doc", F.coalesce("text", F.lit(0.0)).alias("text"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))


def request_filters() -> Column:
    """The filters of a request (r.*) on an entity's columns; whatever a request leaves open passes."""
    tags = F.col("r.tags").isNull() | (F.size("r.tags") == 0) | has_any_tag(F.col("e.tags"), F.col("r.tags"))
    return (
        equal_or_open(F.col("e.category"), F.col("r.category")) & tags & equal_or_open(F.col("e.developer_id"), F.col("r.developer_id"))
        & equal_or_open(F.col("e.entity_type"), F.col("r.entity_type")) & not_inactive(F.col("e.status"))
    )


#: What filters and ranks need of an entity, and what only the rows of a page show.
_RANKED, _SHOWN = ("category", "tags", "developer_id", "entity_type", "status"), ("name", "category", "tags", "summary", "home_registry", "status", "developer_id", "entity_type")


def _ranked_by(as_of: Column) -> Column:
    return F.struct(F.col("entity_id").alias("doc"), *_RANKED, K.freshness(F.col("updated_at"), as_of).alias("freshness"))


def candidates(requests: DataFrame, entities: DataFrame, hits: DataFrame, source: str, as_of: Column, trust: DataFrame | None = None) -> DataFrame:
    """(query, doc, text, semantic, source, freshness, trust, availability) of hits after the request's filters; hits without an entity go."""
    out = hits.alias("h").join(entities.select("entity_id", _ranked_by(as_of).alias("e")), F.col("h.doc") == F.col("entity_id")).join(requests.alias("r"), F.col("h.query") == F.col("r.query_id")).where(request_filters())
    out = out.select("h.query", "h.doc", "h.text", "h.semantic", F.lit(source).alias("source"), "e.freshness")
    if trust is not None:
        out = out.join(trust.select(F.col("entity_id").alias("doc"), "trust"), "doc", "left")
    return K.source_defaults(out)


def _with_trust(blocks: DataFrame, trust: DataFrame) -> DataFrame:
    """Blocks whose documents have their trust beside them. Texts are not shuffled for it, only ids and postings."""
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))
    placed = blocks.select("block", F.posexplode("docs").alias("ord", "e")).withColumn("entity_id", F.col("e.doc"))
    told = placed.join(trust.select("entity_id", "trust"), "entity_id", "left").select("block", F.struct("ord", F.struct("e.*", "trust").alias("e")).alias("at"))
    docs = told.groupBy("block").agg(F.array_sort(F.collect_list("at")).alias("at")).select("block", F.col("at.e").alias("docs"))
    return cut(blocks.drop("docs").join(docs, "block").drop("block"))


def best_candidates(requests: DataFrame, entities: DataFrame, near: DataFrame, source: str, as_of: Column, trust: DataFrame | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The rows of `candidates` that may be among a request's branch_depth best by the weighted sum, and some others.

    near: (query, doc, sim). What filters and weights need of an entity goes with it into its block of postings, so neither texts nor scored
    pairs are shuffled. Runs jobs while it is put together.
    """
    keyword_engine(config.engine)
    w, basic = config.weights, config.engine == "basic"
    requests = requests.where(F.col("query_id").isNotNull())
    told = entities.select("*", _ranked_by(as_of).alias("e"))
    fields, tags, tokenizer = ({"text": _text()}, None, tokenize_basic) if basic else (_fields(), F.col("tags"), tokenize_advanced)
    terms, phrases, blocks = blocks_for(requests, told, "query_id", F.col("query"), "e", fields, tokenizer, tags)
    blocks = blocks if trust is None else _with_trust(blocks, trust)
    kind = blocks.schema["docs"].dataType.elementType

    def base(e: Column) -> Column:
        own = F.lit(K.TRUST[source]) if trust is None else F.coalesce(e["trust"], F.lit(K.TRUST[source]))
        return w.trust * own + w.freshness * e["freshness"] + F.lit(w.availability * K.AVAILABILITY[source])

    blocks = blocks.withColumns({"base": F.transform("docs", base), "key": F.transform("docs", lambda e: F.xxhash64(e["doc"]))})
    near = cut(near.select("query", F.col("doc").cast(kind["doc"].dataType).alias("doc"), "sim"))
    keys = near.select("query", F.xxhash64("doc").alias("key"))
    depths = requests.select(F.col("query_id").alias("query"), _depth().alias("depth"))
    wanted = small(cut(requests.select("query_id", "category", "tags", "developer_id", "entity_type"))).alias("r")

    def passing(rows: DataFrame) -> DataFrame:
        named = rows.withColumnRenamed("doc", "e").where(F.col("e.doc").isNotNull())
        met = named.join(wanted, F.col("query") == F.col("r.query_id")).where(request_filters())
        return met.select(*[F.col("e").alias(c) if c == "doc" else F.col(c) for c in rows.columns])

    boosts = [1.0 if basic else BOOSTS[f] for f in fields]
    df, n_docs, averages = counted_blocks(blocks, len(fields), None)
    query_kind, found = terms.schema["query"].dataType, None
    for part in parts_of_requests(terms, df, n_docs, averages, boosts, phrases, keys, depths):
        more = mixed_scores(blocks, part, passing, w.text, query_kind, kind)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = requests.sparkSession.createDataFrame([], f"query {query_kind.simpleString()}, doc {kind.simpleString()}, text double")
    sims = small(near).select(F.col("query").alias("__query"), F.col("doc").alias("__doc"), F.col("sim").alias("__sim"))
    out = passing(found).join(sims, (F.col("query") == F.col("__query")) & (F.col("doc.doc") == F.col("__doc")), "left").where("text > 0 or __sim is not null")
    own = [] if trust is None else ["doc.trust"]
    return K.source_defaults(out.select("query", "doc.doc", "text", F.coalesce("__sim", F.lit(0.0)).alias("semantic"), F.lit(source).alias("source"), "doc.freshness", *own))


def _depth() -> Column:
    return K.branch_depth(F.coalesce("max_results", F.lit(20)))


def _shown(paged: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """The rows of the pages with what they show of their entities, whose texts are read for these rows only."""
    paged = cut(paged)
    ids = small(cut(paged.select("source", "doc").distinct()))
    shown = None
    for source, entities in sources.items():
        own = entities.join(ids.where(F.col("source") == source), F.col("entity_id") == F.col("doc"), "left_semi").dropDuplicates(["entity_id"])
        own = own.select(F.lit(source).alias("source"), F.col("entity_id").alias("doc"), *_SHOWN)
        shown = own if shown is None else shown.unionByName(own)
    return paged.join(shown, ["source", "doc"])


def search(requests: DataFrame, sources: dict[str, DataFrame], semantic: Callable[[DataFrame, DataFrame], DataFrame], as_of: Column, names: DataFrame | None = None, cards: DataFrame | None = None, trust: DataFrame | None = None, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Ranked pages of all requests over the sources (local, remote, federated), each a catalog with its own statistics.

    semantic gives (query, doc, sim) for the requests and a source's entities. Each source hands on its best candidates per request,
    at most branch_depth, chosen after the filters. total_found counts before candidates are made distinct. Runs jobs while it is put together.
    """
    parts = None
    depths = requests.select(F.col("query_id").alias("query"), _depth().alias("__depth"))
    deepest = depths.agg(F.max("__depth")).first()[0] or 0
    for source, entities in sources.items():
        if config.method == "rrf" or min(config.weights.semantic, config.weights.text) < 0:
            hits = merge_hits(text_hits(requests, entities, config), semantic(requests, entities))
            found = candidates(requests, entities, hits, source, as_of, trust)
        else:
            found = best_candidates(requests, entities, semantic(requests, entities), source, as_of, trust, config)
        # by a number first: then only the best rows of a request are shuffled
        best = K.rank_candidates(found, config.method, config.weights).where(F.col("rank") <= deepest).join(depths, "query")
        best = best.where(F.col("rank") <= F.col("__depth")).drop("__depth", "rank", "score")
        parts = best if parts is None else parts.unionByName(best)
    parts = cut(parts)  # at most branch_depth rows a request and source, and used more than once
    counts = parts.groupBy("query").agg(F.count(F.lit(1)).alias("total_found"))
    ranked = K.rank_candidates(K.dedupe_candidates(parts), config.method, config.weights)
    ranked = min_score(ranked, config.min_score)
    wanted = requests.select(F.col("query_id").alias("query"), "max_results", F.coalesce("offset", F.lit(0)).alias("offset"))
    paged = K.page(ranked.join(wanted, "query"), F.col("max_results"), F.col("offset"), counts=counts).drop("max_results", "offset")
    paged = _shown(paged, sources)
    if cards is not None:
        shown = cards.select(F.col("entity_id").alias("doc"), availability_of(F.col("status")).alias("__live"))
        paged = paged.join(shown, "doc", "left").withColumn("availability", F.when(F.col("rank") <= config.enrich_top, F.coalesce("__live", "availability")).otherwise(F.col("availability"))).drop("__live")
    if names is not None:
        paged = attach_names(paged, names, "doc")
    return paged.withColumn("breakdown", K.score_breakdown())


def federated_top(requests: DataFrame, entities: DataFrame, routes: DataFrame, k: int, registry: str = "home_registry") -> DataFrame:
    """(query, doc, registry, score, rank): each chosen registry ranks its own entities, then the results are merged.

    routes: (query, registry). Statistics are those of the registry, as if it answered alone.
    """
    text = F.concat_ws(" ", embedding_text(F.col("name"), F.col("summary"), F.col("tags")), "category")
    terms = cut(query_terms(requests, "query_id", F.col("query"), tokenize_basic))
    rows = entities.withColumn("registry", F.col(registry))
    posted = wanted_postings(token_rows(rows, "entity_id", text, tokenize_basic, ("registry",)), terms)
    stats = posted.where("term = ''").groupBy("registry").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    real = posted.where("term <> ''")
    df = real.groupBy("registry", "term").agg(F.count(F.lit(1)).alias("df"))
    wanted = terms.join(routes.select("query", "registry"), "query").join(df, ["registry", "term"]).join(stats, "registry")
    weights = wanted.select("query", "registry", "term", "avg_length", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("w"))
    hits = real.join(small(cut(weights)), ["registry", "term"])
    scores = hits.groupBy("query", "registry", "doc").agg(F.round(F.sum(F.col("w") * saturation(F.col("tf"), F.col("length"), F.col("avg_length"))), 6).alias("score"))
    order = Window.partitionBy("query", "registry").orderBy(F.desc("score"), F.asc("doc"))
    own = scores.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")
    return top_k(own, k)
