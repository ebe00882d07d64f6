"""Scores, ranks and pages of candidates, many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators.sizes import cut, small

RRF_K = 60.0
DECAY = 0.023
#: Order of sources where one entity comes from several.
SOURCES = ["local", "remote", "federated"]
TRUST = {"local": 0.5, "remote": 0.3, "federated": 0.3}
AVAILABILITY = {"local": 1.0, "remote": 0.9, "federated": 0.7}


@dataclass(frozen=True)
class Weights:
    text: float = 0.30
    semantic: float = 0.30
    trust: float = 0.20
    freshness: float = 0.10
    availability: float = 0.10


def _by_source(table: dict[str, float], source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), source)


def source_defaults(df: DataFrame) -> DataFrame:
    """Trust and availability by source where they are unknown."""
    for c, table in (("trust", TRUST), ("availability", AVAILABILITY)):
        known = F.col(c) if c in df.columns else F.lit(None).cast("double")
        df = df.withColumn(c, F.coalesce(known, _by_source(table, F.col("source"))))
    return df


def freshness(updated_at: Column, as_of: Column) -> Column:
    """exp(-0.023 * days); the future counts as now, an unknown time as 0.5."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(updated_at)) / 86_400e6)
    return F.when(updated_at.isNull(), 0.5).otherwise(F.exp(-DECAY * days))


def normalise_by_max(df: DataFrame, score: str, query: str = "query") -> DataFrame:
    """A query's scores over its best one, before any filter. The best ones are found in a job of their own, so scores are not shuffled."""
    best = small(cut(df.groupBy(F.col(query).alias("__query")).agg(F.max(score).alias("__best"))))
    out = df.join(best, F.col(query).eqNullSafe(F.col("__query")), "left")
    return out.withColumn(score, F.when(F.col("__best") > 0, F.col(score) / F.col("__best")).otherwise(0.0)).drop("__query", "__best")


def dedupe_candidates(df: DataFrame, query: str = "query", doc: str = "doc", score: str = "text") -> DataFrame:
    """One row per query and entity: of the first source, then the best score."""
    order = Window.partitionBy(query, doc).orderBy(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), F.desc(score))
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def weighted_score(w: Weights = Weights()) -> Column:
    return w.text * F.col("text") + w.semantic * F.col("semantic") + w.trust * F.col("trust") + w.freshness * F.col("freshness") + w.availability * F.col("availability")


def rank_weighted(df: DataFrame, w: Weights = Weights(), query: str = "query", doc: str = "doc", digits: int = 6) -> DataFrame:
    """Adds score and rank by the weighted sum of text, semantic, trust, freshness and availability."""
    scored = df.withColumn("score", F.round(weighted_score(w), digits))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc))))


def rank_rrf(df: DataFrame, query: str = "query", doc: str = "doc", digits: int = 6) -> DataFrame:
    """Adds score and rank by reciprocal rank fusion of text, semantic and trust; input scores are rounded, ties go by id."""
    out = df
    for c in ("text", "semantic", "trust"):
        order = Window.partitionBy(query).orderBy(F.desc(F.round(c, digits)), F.asc(doc))
        out = out.withColumn(f"__{c}", 1.0 / (RRF_K + F.row_number().over(order)))
    out = out.withColumn("score", F.round(F.col("__text") + F.col("__semantic") + F.col("__trust"), 9)).drop("__text", "__semantic", "__trust")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc))))


def rank_candidates(df: DataFrame, method: str = "weighted", w: Weights = Weights(), **names) -> DataFrame:
    """rrf by name, weighted by any other."""
    return rank_rrf(df, **names) if method == "rrf" else rank_weighted(df, w, **names)


def score_breakdown() -> Column:
    return F.struct(*[F.col(c).alias(n) for c, n in (("text", "text_relevance"), ("semantic", "semantic_similarity"), ("trust", "trust_score"), ("freshness", "freshness"), ("availability", "availability"))])


def branch_depth(max_results: Column | int) -> Column:
    """How many candidates each branch hands on: 3 * max_results, 50 at least."""
    return F.greatest(F.lit(50), 3 * (max_results if isinstance(max_results, Column) else F.lit(max_results)))


def page(ranked: DataFrame, max_results: Column | int | None = None, offset: Column | int = 0, query: str = "query", counts: DataFrame | None = None) -> DataFrame:
    """Ranks offset + 1 .. offset + max_results (20 if none is given) with n_distinct, has_more, and total_found if counts
    (query, total_found: candidates before they were made distinct) is given."""
    most = max_results if isinstance(max_results, Column) else F.lit(20 if max_results is None else max_results)
    most = F.coalesce(most, F.lit(20))
    start = offset if isinstance(offset, Column) else F.lit(offset)
    # counted in a job of its own: then only the best rows of a query need to be shuffled for their ranks
    n = small(cut(ranked.groupBy(F.col(query).alias("__query")).agg(F.count(F.lit(1)).alias("n_distinct"))))
    out = ranked.where((F.col("rank") > start) & (F.col("rank") <= start + most)).join(n, F.col(query).eqNullSafe(F.col("__query"))).drop("__query")
    out = out.withColumn("has_more", F.col("n_distinct") > start + most)
    return out.join(counts, query, "left") if counts is not None else out
