"""Tokenizers and phrase tests as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopwords, synonyms and suffixes of the advanced tokenizer.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with"]
SYNONYMS = {
    "ai": ["artificial-intelligence", "machine-learning", "ml"],
    "ml": ["machine-learning", "ai"],
    "llm": ["large-language-model", "language-model"],
    "gpt": ["openai", "chatgpt"],
    "code": ["programming", "software", "development"],
    "review": ["analysis", "audit", "check"],
    "translate": ["translation", "translator"],
    "python": ["py"],
    "javascript": ["js", "node"],
    "typescript": ["ts"],
}
SUFFIXES = ["ing", "ed", "ly", "ness", "ment", "able", "ible", "tion", "sion", "ation", "ies", "es", "s"]


def _with_parts(tokens: Column) -> Column:
    """Each token followed by its parts between hyphens and underscores, of 2 bytes at least."""

    def parts(t: Column) -> Column:
        pieces = F.filter(F.split(t, "[-_]"), lambda p: (F.octet_length(p) >= 2) & (p != t))
        return F.when(t.contains("-") | t.contains("_"), F.concat(F.array(t), pieces)).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, parts))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokenize_routing(text: Column) -> Column:
    """Lower-cased ASCII runs of letters, digits, - and _ of 2 bytes at least; a null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_-]{2,}"), F.lit(0))
    return found


def tokenize_basic(text: Column) -> Column:
    """tokenize_routing, and the parts of compound tokens after each."""
    return _with_parts(tokenize_routing(text))


def stem(token: Column) -> Column:
    """Cuts the first of SUFFIXES that leaves 3 bytes at least; tokens under 4 bytes stay."""
    out = token
    for suffix in reversed(SUFFIXES):
        fits = token.endswith(suffix) & (F.octet_length(token) - len(suffix) >= 3)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return F.when(F.octet_length(token) < 4, token).otherwise(out)


@dataclass(frozen=True)
class TokenizerConfig:
    """Parameters of tokenize_advanced. n-grams are off while either bound is 0."""

    min_term_length: int = 2
    stemming: bool = True
    stopwords: list[str] = field(default_factory=lambda: list(STOPWORDS))
    synonyms: dict[str, list[str]] = field(default_factory=lambda: dict(SYNONYMS))
    ngram_min: int = 0
    ngram_max: int = 0


def _joined(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), "_")


def tokenize_advanced(text: Column, config: TokenizerConfig | None = None) -> Column:
    """Runs of letters, digits, - and _ with parts; stopwords out, stemmed, synonyms and n-grams appended unstemmed."""
    config = config or TokenizerConfig()
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}_-]+"), F.lit(0))
    kept = F.filter(_with_parts(raw), lambda t: F.octet_length(t) >= config.min_term_length)
    if config.stopwords:
        kept = F.filter(kept, lambda t: ~t.isin(config.stopwords))
    return held(kept, lambda k: _finished(k, config))


def _finished(kept: Column, config: TokenizerConfig) -> Column:
    out = F.transform(kept, stem) if config.stemming else kept
    if config.synonyms:
        table = F.create_map(*[x for k, v in config.synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        more = F.flatten(F.transform(kept, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
        out = F.concat(out, more)
    if config.ngram_min > 0 and config.ngram_max > 0:
        for n in range(config.ngram_min, config.ngram_max + 1):
            starts = F.when(F.size(kept) >= n, F.sequence(F.lit(1), F.size(kept) - n + 1)).otherwise(F.array().cast("array<int>"))
            out = F.concat(out, F.transform(starts, _joined(kept, n)))
    return out


def quoted_phrases(query: Column) -> Column:
    """Lower-cased texts between paired double quotes; empty ones are left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit('"([^"]*)"'), F.lit(1))
    return F.filter(found, lambda p: p != "")


def contains_phrase(phrase: Column, name: Column, summary: Column, category: Column, tags: Column) -> Column:
    """Whether a lower-cased phrase stands in the name, summary, category or any tag, whatever their case."""
    fields = F.lit(False)
    for c in (name, summary, category):
        fields = fields | F.coalesce(F.lower(c).contains(phrase), F.lit(False))
    return fields | F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(phrase)), F.lit(False))


def embedding_text(name: Column, summary: Column, tags: Column) -> Column:
    return F.concat_ws(" ", name, summary, F.array_join(tags, " "))
