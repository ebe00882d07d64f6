"""Ids, fingerprints, times and defaults as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id prefixes by kind.
ID_PREFIX = {"agent": "zns:", "service": "zns:svc:", "developer": "zns:dev:", "registry": "zns:registry:"}


def strip_key_prefix(key: Column) -> Column:
    return F.regexp_replace(key, "^ed25519:", "")


def make_id(kind: str, public_key: Column) -> Column:
    """Prefix and the first 16 bytes of the SHA-256 of the decoded base64 key, in hex; null for a key that isn't base64."""
    return F.concat(F.lit(ID_PREFIX[kind]), F.substring(F.sha2(F.try_to_binary(strip_key_prefix(public_key), F.lit("base64")), 256), 1, 32))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalise_strings(df: DataFrame) -> DataFrame:
    """Empty strings as nulls in all string columns, as catalog tables hold them."""
    return df.select(*[empty_to_null(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the columns as compact JSON; give them in name order for a canonical form."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def query_hash(request: Column) -> Column:
    return F.sha2(F.to_json(request), 256)


def parse_rfc3339(c: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(c)


def format_rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def registry_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def default_request(df: DataFrame) -> DataFrame:
    """entity_type '' -> agent; a service's entity_url falls back on its endpoint; null tags -> none."""
    kind = F.coalesce(empty_to_null(F.col("entity_type")), F.lit("agent"))
    url = F.when((kind == "service") & empty_to_null(F.col("entity_url")).isNull(), F.col("service_endpoint")).otherwise(F.col("entity_url"))
    return df.withColumns({"entity_type": kind, "entity_url": url, "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def redact(df: DataFrame) -> DataFrame:
    """Blanks what must not be public."""
    return df.withColumns({c: F.lit("") for c in ("entity_url", "service_endpoint") if c in df.columns})
