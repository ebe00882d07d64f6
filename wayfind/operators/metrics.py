"""Counts, facets, latency summaries, activity and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators.sizes import cut, small

#: Exact percentiles: parts of a range in a round, and rows of one place that are numbered.
BINS, FEW = 4096, 50_000


def network_rollup(local: DataFrame, remote: DataFrame, developers: DataFrame, peers: int) -> DataFrame:
    """One row: local, remote (live), estimated and developer counts, and registries."""
    one = local.agg(F.count(F.lit(1)).alias("local")).join(remote.agg(F.count_if(~F.coalesce("tombstoned", F.lit(False))).alias("remote"))).join(developers.agg(F.count(F.lit(1)).alias("developers")))
    return one.withColumns({"estimated": F.col("local") + F.col("remote"), "registries": F.lit(peers + 1)})


def facets(entities: DataFrame, category: Column, tags: Column) -> DataFrame:
    """(kind, value, n): categories and tags with how many entities have them."""
    shown = entities.select(F.explode(F.concat(F.array(F.struct(F.lit("category").alias("kind"), category.alias("value"))), F.transform(F.array_distinct(tags), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))))).alias("f"))
    return shown.select("f.*").where("value is not null and value <> ''").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def _of_group(by: list[str], left: DataFrame, right: DataFrame) -> Column:
    """The join condition on group columns, which `right` has as __g0, __g1, ...; a null is a group of its own."""
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & left[c].eqNullSafe(right[f"__g{i}"])
    return same


def select_places(rows: DataFrame, by: list[str], value: str, places: DataFrame) -> DataFrame:
    """(__g0, ..., name, value): the values at given places of each group in ascending order, counted from 0, exactly.

    places: (__g0, ..., name, place, low, high, size) with the group's least and greatest value and its number of values. No group is
    sorted as a whole: a round counts the values between low and high in BINS even parts, where they are, and goes on with the part that
    holds the place, until it has one value only or at most FEW rows, which are then numbered. Nulls are no values;
    values must be finite.
    """
    groups = [f"__g{i}" for i in range(len(by))]
    known = [*groups, "name", "place", "low", "high", "size", "below"]
    values = rows.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null")
    state = cut(places.select(*groups, "name", "place", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "size", F.lit(0).cast("long").alias("below")).where("size > 0"))
    wide = (F.col("low") < F.col("high")) & (F.col("size") > FEW)
    while state.where(wide).count():
        todo = state.where(wide)
        met = values.join(small(todo), _of_group(by, values, todo)).where("__v between low and high")
        part = F.least(F.lit(BINS - 1), F.floor((F.col("__v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).alias("bin")
        counted = met.groupBy(*groups, "name", "place", "below", part).agg(F.count(F.lit(1)).alias("size"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        # at most BINS rows for each place
        upto = F.sum("size").over(Window.partitionBy(*groups, "name").orderBy("bin"))
        placed = counted.withColumn("upto", F.col("below") + upto).where("place < upto and place >= upto - size")
        state = cut(state.where(~wide).select(*known).unionByName(placed.withColumn("below", F.col("upto") - F.col("size")).select(*known)))
    flat = state.where("low = high").select(*groups, "name", F.col("low").alias("value"))
    rest = state.where("low < high")
    met = values.join(small(rest), _of_group(by, values, rest)).where("__v between low and high")
    # at most FEW rows for each place
    order = Window.partitionBy(*groups, "name").orderBy("__v")
    numbered = met.withColumn("__n", F.row_number().over(order) - 1).where(F.col("__n") == F.col("place") - F.col("below"))
    return flat.unionByName(numbered.select(*groups, "name", F.col("__v").alias("value")))


def latency_summary(rows: DataFrame, by: list[str], latency: str, ok: Column, ts: str | None = None) -> DataFrame:
    """total, ok, failed, p50, p90, p99, least, most (of successful rows) and, given a time, rows per second.

    A percentile is the value at place trunc((n - 1) p / 100) of the sorted ones, exactly; see select_places. Runs jobs while it is put together.
    """
    marked = rows.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("__latency", F.when(F.col("__ok"), F.col(latency)))
    extra = [] if ts is None else [(F.count(F.lit(1)) / ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6)).alias("per_second")]
    whole = cut(marked.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("__ok").alias("ok"), F.count_if(~F.col("__ok")).alias("failed"), F.min("__latency").alias("least"), F.max("__latency").alias("most"), F.count("__latency").alias("__n"), *extra))
    groups = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    asked = F.explode(F.array(*[F.struct(F.lit(f"p{p}").alias("name"), F.floor((F.col("__n") - 1) * p / 100).alias("place")) for p in (50, 90, 99)])).alias("x")
    places = whole.select(*groups, F.col("least").alias("low"), F.col("most").alias("high"), F.col("__n").alias("size"), asked).select("*", "x.*").drop("x")
    found = select_places(marked, by, "__latency", places)
    kind = rows.schema[latency].dataType
    wide = found.groupBy(*[f"__g{i}" for i in range(len(by))]).agg(*[F.max(F.when(F.col("name") == p, F.col("value"))).cast(kind).alias(p) for p in ("p50", "p90", "p99")])
    out = whole.join(wide, _of_group(by, whole, wide), "left")
    return out.select(*by, "total", "ok", "failed", "p50", "p90", "p99", "least", "most", *(["per_second"] if ts else []))


def activity_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour") -> DataFrame:
    """(window_start, kind, n) by tumbling windows."""
    out = events.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n")


def over_limit(events: DataFrame, ts: str, key: str, limit: int = 100, width: str = "1 minute") -> DataFrame:
    """(key, window_start, n) where a key passes its limit in an aligned window."""
    out = events.groupBy(key, F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return out.select(key, F.col("w.start").alias("window_start"), "n")
