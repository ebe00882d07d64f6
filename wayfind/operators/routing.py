"""Routing sketches: which registries may hold what a query asks for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from wayfind.functions.text import tokenize_routing
from wayfind.operators.sizes import cut

#: One part of a packed filter holds so many bits.
BITMAP_BITS = 32_768
#: Places that are looked up in one row of a filter, and keys that a common token is dealt to.
PROBES, SALTS = 4096, 8


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for so many items at a false positive rate; bad values fall back on 1000 and 0.01."""
    items = items if items > 0 else 1000
    rate = rate if 0 < rate < 1 else 0.01
    m = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
    return m, min(30, max(1, math.ceil(m / items * math.log(2))))


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """The k positions of an item: (h1 + i h2) mod m, from two parts of its MD5."""
    def part(at: int) -> Column:
        return F.conv(F.substring(F.md5(item), at, 8), 16, 10).cast("long") % m

    h2 = F.when(part(9) == 0, F.lit(1)).otherwise(part(9))
    return F.array(*[((part(1) + i * h2) % m).cast("long") for i in range(k)])


def registry_tokens(entities: DataFrame, registry: str, name: Column, category: Column, tags: Column, summary: Column) -> DataFrame:
    """The distinct (registry, token) of names, categories, tags and summaries."""
    found = F.concat(tokenize_routing(name), F.array(F.lower(category)), F.coalesce(F.transform(tags, F.lower), F.array().cast("array<string>")), tokenize_routing(summary))
    rows = entities.select(F.col(registry).alias("registry"), F.explode(F.array_distinct(found)).alias("token"))
    return rows.where("token is not null and token <> ''").distinct()


def _placed(positions: Column) -> Column:
    """(part, at): the part of a filter that a position lies in, and its place there."""
    return F.transform(positions, lambda p: F.struct(F.bitmap_bucket_number(p + 1).alias("part"), F.bitmap_bit_position(p + 1).alias("at")))


def bloom_build(items: DataFrame, m: int, k: int) -> DataFrame:
    """(registry, part, bits): the filters of (registry, token) rows, in parts of BITMAP_BITS bits. Positions become bits where the
    items are read; parts are put together by or."""
    placed = items.select("registry", F.explode(_placed(bloom_positions(F.col("token"), m, k))).alias("x"))
    return placed.groupBy("registry", "x.part").agg(F.bitmap_construct_agg("x.at").alias("bits"))


def unpack_filters(packed: DataFrame) -> DataFrame:
    """The distinct (registry, pos) that are set in packed filters."""
    bytes_ = F.sequence(F.lit(0), F.octet_length("bits") - 1)
    one = F.conv(F.hex(F.substring(F.col("bits"), F.col("byte") + 1, F.lit(1))), 16, 10).cast("int")
    rows = packed.select("registry", "part", "bits", F.explode(bytes_).alias("byte")).select("registry", "part", "byte", one.alias("b")).where("b <> 0")
    rows = rows.select("registry", "part", "byte", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).where(F.expr("shiftright(b, i) & 1 = 1"))
    return rows.select("registry", ((F.col("part") - 1) * BITMAP_BITS + F.col("byte") * 8 + F.col("i")).cast("long").alias("pos"))


def query_tokens(queries: DataFrame, id_col: str, text: Column) -> DataFrame:
    return queries.select(F.col(id_col).alias("query"), F.explode(F.array_distinct(tokenize_routing(text))).alias("token"))


def _by_token(tokens: DataFrame, held: DataFrame) -> DataFrame:
    """(query, registry, matches) from (query, token) and (token, registry). A token that many queries have is dealt to SALTS keys, to
    each of which the token's registries are sent."""
    salted = tokens.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(SALTS)))
    sent = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(sent, ["token", "salt"]).groupBy("query", "registry").agg(F.count(F.lit(1)).alias("matches"))


def bloom_match(tokens: DataFrame, filters: DataFrame, m: int, k: int) -> DataFrame:
    """(query, registry, matches): how many of a query's tokens a registry may hold, no false negatives.

    filters as bloom_build makes them. Distinct tokens are probed: their places in a part go together, at most PROBES at a time, to that
    part of each registry's filter, and what comes out are the places that are set there. A token is in if all its places are.
    """
    placed = tokens.select("token").distinct().select("token", F.array_distinct(_placed(F.array_distinct(bloom_positions(F.col("token"), m, k)))).alias("x"))
    probes = placed.select("token", F.size("x").alias("need"), F.explode("x").alias("x")).select("token", "need", "x.*")
    groups = cut(probes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("groups", F.ceil(F.col("n") / PROBES)).drop("n"))
    dealt = probes.join(groups, "part").withColumn("group", F.pmod(F.xxhash64("token", "at"), F.col("groups")))
    dealt = dealt.groupBy("part", "group").agg(F.collect_list(F.struct("token", "need", "at")).alias("probes"))

    def is_set(x: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", F.floor(x["at"] / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(x["at"], F.lit(8)).cast("int")) == 1

    met = filters.join(dealt, "part").select("registry", F.explode(F.filter("probes", is_set)).alias("x"))
    held = met.groupBy("x.token", "registry").agg(F.count(F.lit(1)).alias("got"), F.max("x.need").alias("need")).where("got = need").select("token", "registry")
    return _by_token(tokens, held)


def exact_match(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """The exact twin of bloom_match."""
    return _by_token(tokens, items.join(tokens.select("token").distinct(), "token", "left_semi").select("token", "registry"))


def route_queries(queries: DataFrame, matches: DataFrame, without_filter: DataFrame | None = None, top: int = 10, id_col: str = "query") -> DataFrame:
    """(query, registry, matches, rank): the registries with most matches, one at least; those without a filter score 1."""
    scored = matches
    if without_filter is not None:
        # all of these score the same for every query, so beyond the first `top` of them none can be among a query's best
        first = [r["registry"] for r in without_filter.select("registry").distinct().orderBy("registry").limit(top).collect()]
        kind = without_filter.schema["registry"].dataType
        named = F.array(*[F.lit(x).cast(kind) for x in first]).cast(ArrayType(kind))
        scored = scored.unionByName(queries.select(F.col(id_col).alias("query")).distinct().select("query", F.explode(named).alias("registry"), F.lit(1).cast("long").alias("matches")))
    order = Window.partitionBy("query").orderBy(F.desc("matches"), F.asc("registry"))
    return scored.where("matches >= 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
