"""The inverted index as tables: postings, lengths and corpus statistics, built whole or kept up by changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import tokenize_basic
from wayfind.operators.sizes import cut, small


def token_rows(docs: DataFrame, id_col: str, text: Column, tokenizer: Callable[[Column], Column] = tokenize_basic, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc, tokens, length) of each document, without a shuffle. The tokens are made by an explode of one row, so that
    whatever uses them refers to them and does not tokenize again."""
    return docs.select(F.col(id_col).alias("doc"), *extra, F.explode(F.array(tokenizer(text))).alias("tokens")).withColumn("length", F.size("tokens"))


def postings(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc, length, tf). Given terms (a distinct `term` column), only those are counted, which keeps all other tokens
    out of the shuffle."""
    rows = tokens.select("doc", "length", F.explode("tokens").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term"), "term", "left_semi")
    return rows.groupBy("term", "doc", "length").agg(F.count(F.lit(1)).alias("tf"))


def wanted_postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, length, tf, and what else the rows have) for the terms of `terms`, and a row with the empty term for every
    row of `tokens`, from which lengths and numbers follow: one pass over the documents gives postings and statistics.

    Only wanted tokens are shuffled. The result is cut, as it is used more than once.
    """
    own = [c for c in tokens.columns if c != "tokens"]
    wanted = cut(terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct())
    rows = tokens.select(*own, F.explode(F.concat(F.array(F.lit("")), F.col("tokens"))).alias("term")).join(small(wanted), "term", "left_semi")
    return cut(rows.groupBy("term", *own).agg(F.count(F.lit(1)).alias("tf")))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n_docs and avg_length."""
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def field_rows(docs: DataFrame, id_col: str, fields: dict[str, Column], tokenizer: Callable[[Column], Column]) -> DataFrame:
    """(doc, field, tokens, length), a row per field of each document."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), tokenizer(c).alias("tokens")) for f, c in fields.items()])
    return docs.select(F.col(id_col).alias("doc"), F.explode(parts).alias("p")).select("doc", "p.field", "p.tokens", F.size("p.tokens").alias("length"))


def apply_changes(index: DataFrame, changed: DataFrame, removed: DataFrame | None, id_col: str, text: Column, tokenizer: Callable[[Column], Column] = tokenize_basic) -> DataFrame:
    """The postings after documents were added, replaced or removed: those of touched ids go, then the new ones come, so an
    id that is both removed and changed stands with its new text.

    Frequencies and lengths follow from the result by aggregation; they are never stored apart.
    """
    touched = changed.select(F.col(id_col).alias("doc"))
    if removed is not None:
        touched = touched.unionByName(removed.select(F.col(id_col).alias("doc")))
    fresh = postings(token_rows(changed, id_col, text, tokenizer))
    return index.join(touched.distinct(), "doc", "left_anti").select(fresh.columns).unionByName(fresh)
