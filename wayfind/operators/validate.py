"""Bulk validation: every reason a row fails, the first one apart, and the split into valid rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity types and pricing models.
ENTITY_TYPES = ["agent", "service"]
PRICING_MODELS = ["per_request", "subscription", "free"]


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in rules]))


def _checked(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    out = df.withColumn("reasons", _reasons(*rules))
    return out.withColumns({"first_reason": F.get("reasons", F.lit(0)), "valid": F.size("reasons") == 0})


def _service_rules() -> list[tuple[Column, str]]:
    model = F.col("pricing_model")
    return [
        (_missing(F.col("service_endpoint")), "service_endpoint is required"),
        (~_missing(model) & ~model.isin(PRICING_MODELS), "unknown pricing model"),
    ]


def validate_entities(df: DataFrame) -> DataFrame:
    """Adds reasons, first_reason and valid, in the order of the rules; lengths are bytes. Reads pricing_model if present."""
    c = F.col
    kind = F.coalesce("entity_type", F.lit(""))
    rules = [
        (_missing(c("entity_id")), "entity_id is required"),
        (_missing(c("name")), "name is required"),
        (F.octet_length("name") > 100, "name is too long"),
        (_missing(c("owner")), "owner is required"),
        (kind.isin("", "agent") & _missing(c("entity_url")), "entity_url is required"),
        (_missing(c("category")), "category is required"),
        (F.octet_length("summary") > 200, "summary is too long"),
        (_missing(c("public_key")), "public_key is required"),
        (F.size("tags") > 20, "too many tags"),
        ((kind != "") & ~kind.isin(ENTITY_TYPES), "unknown entity_type"),
    ]
    if "service_endpoint" in df.columns:
        frame = df if "pricing_model" in df.columns else df.withColumn("pricing_model", F.lit(None).cast("string"))
        rules += [((kind == "service") & bad, why) for bad, why in _service_rules()]
        out = _checked(frame, *rules)
        return out if "pricing_model" in df.columns else out.drop("pricing_model")
    return _checked(df, *rules)


def validate_services(df: DataFrame) -> DataFrame:
    return _checked(df, *_service_rules())


def validate_developers(df: DataFrame) -> DataFrame:
    c = F.col
    return _checked(df, (_missing(c("developer_id")), "developer_id is required"), (_missing(c("name")), "name is required"), (F.octet_length("name") > 100, "name is too long"), (_missing(c("public_key")), "public_key is required"))


def validate_names(df: DataFrame) -> DataFrame:
    needed = ["fqan", "entity_name", "developer_handle", "registry_host", "entity_id", "developer_id"]
    return _checked(df, *[(_missing(F.col(c)), f"{c} is required") for c in needed])


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows as they came, rejects with their reasons)."""
    return checked.where("valid").drop("reasons", "first_reason", "valid"), checked.where(~F.col("valid")).drop("valid")
