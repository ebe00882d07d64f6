"""Keyword, tag, equality and capability filters, hop and signature filters, paging and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_match(query: Column, name: Column, summary: Column, tags: Column) -> Column:
    """Whether the name, the summary or the tags contain the query text, whatever the case; the text is literal."""
    q = F.lower(query)
    return F.coalesce(F.lower(name).contains(q), F.lit(False)) | F.coalesce(F.lower(summary).contains(q), F.lit(False)) | F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(q)), F.lit(False))


def _holds(part: str):
    return lambda tag: F.lower(tag).contains(part)


def keyword_filter(entities: DataFrame, query: str, category: str | None = None, tags: list[str] | None = None, limit: int | None = None, newest: str = "updated_at", id_col: str = "entity_id", live_only: bool = False) -> DataFrame:
    """Entities that match a keyword, an optional category and all wanted tags (as substrings), newest first.

    live_only leaves out tombstoned rows (remote entities).
    """
    out = entities.where(keyword_match(F.lit(query), F.col("name"), F.col("summary"), F.col("tags")))
    if live_only:
        out = out.where(~F.coalesce("tombstoned", F.lit(False)))
    if category:
        out = out.where(F.col("category") == category)
    for wanted in tags or []:
        out = out.where(F.exists("tags", _holds(wanted.lower())))
    out = out.orderBy(F.desc(newest), F.asc(id_col))
    return out.limit(limit) if limit else out


def has_any_tag(tags: Column, wanted: Column) -> Column:
    """Whether two tag lists overlap, whatever the case."""
    return F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.transform(wanted, F.lower)), F.lit(False))


def equal_or_open(value: Column, wanted: Column) -> Column:
    """Equality with a wanted value; null or '' asks for nothing."""
    return wanted.isNull() | (wanted == "") | (value == wanted)


def not_inactive(status: Column) -> Column:
    return F.coalesce(status, F.lit("")) != "inactive"


def capability_filter(df: DataFrame, skills=None, protocols=None, languages=None, models=None, min_trust: float | None = None, status: str | None = None, summary: str = "capability_summary") -> DataFrame:
    """Rows whose capability lists overlap each wanted one, with enough trust and the wanted status; what isn't given is off."""
    for name, wanted in (("skills", skills), ("protocols", protocols), ("languages", languages), ("models", models)):
        if wanted:
            df = df.where(has_any_tag(F.col(f"{summary}.{name}"), F.array(*map(F.lit, wanted))))
    if min_trust:
        df = df.where(F.col("trust_score") >= min_trust)
    return df.where(F.col("status") == status) if status else df


def min_score(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Drops rows under the least score; 0 is off."""
    return df.where(F.col(score) >= least) if least > 0 else df


def within_hops(announcements: DataFrame) -> DataFrame:
    """Announcements that may be passed on, one hop further."""
    return announcements.where(F.col("hop_count") < F.col("max_hops")).withColumn("hop_count", F.col("hop_count") + 1)


def signed_only(announcements: DataFrame) -> DataFrame:
    return announcements.where((F.coalesce("signature", F.lit("")) != "") & (F.coalesce("origin_public_key", F.lit("")) != ""))


def within_skew(heartbeats: DataFrame, ts: Column, arrived: Column, seconds: int = 60) -> DataFrame:
    """Heartbeats whose clock is at most so many seconds off; unreadable times go."""
    return heartbeats.where(F.abs(F.unix_micros(arrived) - F.unix_micros(ts)) <= seconds * 1_000_000)


def apply_patches(current: DataFrame, patches: DataFrame, key: str, columns: list[str], as_of: Column, stamp: str = "updated_at", keep_empty: bool = False) -> DataFrame:
    """Rows with the non-null values of their patch; patched rows get a new stamp. keep_empty reads '' as no change, too."""
    new = patches.select(key, *[(F.nullif(F.col(c), F.lit("")) if keep_empty else F.col(c)).alias(f"__{c}") for c in columns], F.lit(True).alias("__patched"))
    out = current.join(new, key, "left")
    out = out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns} | {stamp: F.when(F.col("__patched"), as_of).otherwise(F.col(stamp))})
    return out.drop("__patched", *[f"__{c}" for c in columns])


def list_page(entities: DataFrame, limit: int, offset: int = 0, category: str | None = None, entity_type: str | None = None, newest: str = "updated_at", id_col: str = "entity_id") -> DataFrame:
    """A page, newest first; filters come before the page."""
    if category:
        entities = entities.where(F.col("category") == category)
    if entity_type:
        entities = entities.where(F.col("entity_type") == entity_type)
    return entities.orderBy(F.desc(newest), F.asc(id_col)).offset(offset).limit(limit)
