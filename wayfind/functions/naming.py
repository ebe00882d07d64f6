"""Hierarchical names: host/handle/name, with version and capability qualifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The general reserved handles. A registry passes its own product names in addition.
RESERVED = ["system", "admin", "test", "root", "registry", "anonymous", "unknown"]
_PATTERN = "^[a-z][a-z0-9-]{2,39}$"
SCHEMES = ["zns://"]


def name_error(name: Column) -> Column:
    """Why an entity name is invalid, or null."""
    return (
        F.when(name.isNull() | (name == ""), "required")
        .when(~name.rlike(_PATTERN), "malformed")
        .when(name.endswith("-"), "ends with a hyphen")
        .when(name.contains("--"), "consecutive hyphens")
    )


def handle_error(handle: Column, reserved: list[str] = RESERVED) -> Column:
    """Why a developer handle is invalid, or null."""
    return F.when(handle.isin(reserved), "reserved").otherwise(name_error(handle))


def build_fqan(host: Column, handle: Column, name: Column) -> Column:
    return F.concat_ws("/", host, handle, name)


def build_uri(fqan: Column) -> Column:
    return F.concat(F.lit(SCHEMES[0]), fqan)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def parse_qualified(fqan: Column, schemes: list[str] = SCHEMES) -> Column:
    """struct(base, version, capability, error): the last # and then the last @ split off; empty parts are errors."""
    plain = F.regexp_replace(F.coalesce(fqan, F.lit("")), "^(" + "|".join(schemes) + ")", "")

    def split(s: Column, mark: str) -> Column:
        part = F.when(s.contains(mark), F.substring_index(s, mark, -1))
        return F.struct(F.regexp_replace(s, f"(?s){mark}[^{mark}]*$", "").alias("rest"), part.alias("part"))

    def parts(c: Column) -> Column:
        v = split(c["rest"], "@")
        return F.struct(v["rest"].alias("base"), v["part"].alias("version"), c["part"].alias("capability"))

    def checked(q: Column) -> Column:
        error = F.when(q["capability"] == "", "empty capability").when(q["version"] == "", "empty version").when(q["base"] == "", "empty base")
        return F.struct(*[F.when(error.isNull(), q[c]).alias(c) for c in ("base", "version", "capability")], error.alias("error"))

    found = _let(plain, lambda s: _let(split(s, "#"), lambda c: _let(parts(c), checked)))
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("base"), none.alias("version"), none.alias("capability"), F.lit("empty name").alias("error"))
    return F.when(fqan.isNull() | (fqan == ""), empty).otherwise(found)


def parse_fqan(fqan: Column, schemes: list[str] = SCHEMES, reserved: list[str] = RESERVED) -> Column:
    """struct(host, handle, name, error) of the base name."""

    def checked(p: Column) -> Column:
        parts = p["parts"]
        host, handle, name = (F.get(parts, F.lit(i)) for i in range(3))
        error = (
            F.when(p["error"].isNotNull(), p["error"])
            .when(F.size(parts) != 3, "not host/handle/name")
            .when(host == "", "empty host")
            .otherwise(F.coalesce(F.concat(F.lit("handle: "), handle_error(handle, reserved)), F.concat(F.lit("name: "), name_error(name))))
        )
        return F.struct(host.alias("host"), handle.alias("handle"), name.alias("name"), error.alias("error"))

    def good(f: Column) -> Column:
        return F.struct(*[F.when(f["error"].isNull(), f[c]).alias(c) for c in ("host", "handle", "name")], f["error"].alias("error"))

    pieces = _let(parse_qualified(fqan, schemes), lambda q: F.struct(F.split(q["base"], "/", 3).alias("parts"), q["error"].alias("error")))
    return _let(_let(pieces, checked), good)


def version_matches(version: Column, selector: Column) -> Column:
    """Whether a version is the selector or one below it (2 selects 2.1.0); a null selector takes all."""
    return selector.isNull() | (version == selector) | version.startswith(F.concat(selector, F.lit(".")))


def parse_txt(record: Column) -> Column:
    """The k=v pairs of a TXT record, separated by white space."""
    return F.str_to_map(F.regexp_replace(F.trim(record), "\\s+", " "), F.lit(" "), F.lit("="))


def txt_matches(record: Column, version: Column | None = None, key: Column | None = None, fqan: Column | None = None) -> Column:
    """Whether a TXT record has the wanted v, key and fqan."""
    fields = parse_txt(record)
    out = F.lit(True)
    for name, want in (("v", version), ("key", key), ("fqan", fqan)):
        if want is not None:
            out = out & F.coalesce(F.try_element_at(fields, F.lit(name)) == want, F.lit(False))
    return out
