"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.support import cut

#: A mean repetition rate above this is drawn as a sum of equal parts: a part's distribution is an array of about so many numbers.
PART_RATE = 1000.0
#: The rates and distributions of all sources are broadcast if they are at most so many numbers (8 MB).
MOST_NUMBERS = 1_000_000


def unit_hash(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the parts; null parts read as an empty text."""
    joined = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def _terms(rate: float | Column) -> Column:
    """So many terms that what is left of the distribution is under 2**-53."""
    if isinstance(rate, Column):
        return F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")
    return F.lit(math.ceil(rate + 10 * math.sqrt(rate) + 40))


def poisson_cdf(rate: Column, most: float | Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for X ~ Poisson(rate) as an array, for rates up to `most`.

    Terms are carried as logarithms, so large rates don't vanish.
    """
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("below"))

    def on(s: Column, i: Column) -> Column:
        log = s["log"] + F.log(rate / i)
        return F.struct(log.alias("log"), F.concat(s["below"], F.array(F.element_at(s["below"], -1) + F.exp(log))).alias("below"))

    return F.aggregate(F.sequence(F.lit(1), _terms(most)), start, on)["below"]


def poisson_count(u: Column, cdf: Column) -> Column:
    """The inverse: how many of P(X <= 0), P(X <= 1), ... are at most u."""
    return F.size(F.filter(cdf, lambda below: below <= u))


def source_rates(docs: DataFrame, source: str, weights: dict[str, float] | None, temperature: float, output_share: float, most_rate: float | None = None) -> DataFrame:
    """A row per source: its mean repetition rate, the parts of at most PART_RATE that it is split into and their distribution.

    The target share of a source is its weight over the sum of weights, or without weights its share of the bytes to
    the power `temperature`. The rate makes the expected bytes of the output output_share times the input's.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    sizes = cut(docs.groupBy(F.col(source).alias("__source")).agg(F.sum(size).cast("double").alias("__bytes")))
    if weights is None:
        weight = F.pow(F.col("__bytes"), F.lit(float(temperature)))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("__source")), F.lit(0.0))
    sizes = sizes.withColumn("__weight", weight)
    total, weighed = sizes.agg(F.sum("__bytes"), F.sum("__weight")).first()
    if not total or not weighed:
        return sizes.select("__source", F.lit(0.0).alias("rate"), F.lit(1).alias("__parts"), F.array(F.lit(1.0)).alias("__cdf"))
    rate = F.lit(float(output_share)) * total * F.col("__weight") / F.lit(weighed) / F.col("__bytes")
    rated = cut(sizes.select("__source", rate.alias("rate")))
    if most_rate is not None and (top := rated.agg(F.max("rate")).first()[0]) > most_rate:
        raise ValueError(f"a source's repetition rate would be {top:.3g}; the most is {most_rate:g}")
    rated = rated.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    part = F.col("rate") / F.col("__parts")
    rated = rated.withColumn("__cdf", F.when(F.col("rate") > 0, poisson_cdf(part, part)).otherwise(F.array(F.lit(1.0))))
    # a row holds a part's distribution: what is broadcast is bounded by its numbers, not by its rows
    rows, numbers = rated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__cdf")), F.lit(0))).first()
    return F.broadcast(rated) if rows + numbers <= MOST_NUMBERS else rated


def mix_sources(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, output_share: float = 1.0, seed: str = "mix-1", most_rate: float | None = None) -> DataFrame:
    """Each document as often as its hash-seeded Poisson draw says, in a global order.

    The draw depends on the seed, doc_id and the source's rate only, so a rerun and another partitioning give the same
    rows. A rate above PART_RATE is the sum of draws of equal parts, each with a hash of its own; one above most_rate, if
    that is given, fails. Adds rate, n_copies, copy (from 0) and shuffle_key, the hash that orders all
    copies: the key is uniform on [0, 1), so its equal ranges are dealt out without a sample, and sorted. Rows with a null source are a source of their own;
    null and empty texts count one byte. Rows that share a doc_id share the draw, and ties of the key (equal doc_id and
    copy) stay together in any order. Columns of the input with these names are replaced. No rows in, none out. The
    rates, a row per source, are broadcast if they are at most MOST_NUMBERS numbers, else joined as Spark sees fit.
    """
    docs = docs.drop("rate", "n_copies", "copy", "shuffle_key")
    rates = source_rates(docs, source, weights, temperature, output_share, most_rate)
    joined = docs.join(rates, docs[source].eqNullSafe(rates["__source"])).drop("__source")
    one = poisson_count(unit_hash(seed, F.col("doc_id")), F.col("__cdf"))
    parts = F.sequence(F.lit(0), F.col("__parts") - 1)
    several = F.aggregate(parts, F.lit(0), lambda n, k: n + poisson_count(unit_hash(seed + "/part", F.col("doc_id"), k), F.col("__cdf")))
    copies = joined.withColumn("n_copies", F.when(F.col("__parts") > 1, several).otherwise(one)).drop("__cdf", "__parts")
    copies = copies.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("n_copies"))).alias("copy", "__one")).drop("__one")
    copies = copies.withColumn("shuffle_key", unit_hash(seed + "/order", F.col("doc_id"), F.col("copy")))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.repartitionById(ranges, F.floor(F.col("shuffle_key") * ranges).cast("int"))
    return dealt.sortWithinPartitions("shuffle_key", "doc_id", "copy")
