"""Connected components of an undirected edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.support import packed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; a component is named by its smallest node.

    Edges are bigint pairs in any direction, repeated or not; loops and nulls are ignored. Every round joins each edge
    with one minimum per node, so a node with many edges is a skewed join side that can be split, not a group that is
    held. No edges give an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"), (x != y).alias("keep")).where("keep").select("u", "v")
    edges, _ = packed(edges.distinct())
    state = _state(edges)
    while state[0]:
        # large star: neighbours above a node go to the smallest one around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, _ = packed(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    tops = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
