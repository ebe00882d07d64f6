"""Catalog tables with keyed inserts as commits; partitioned reads of live stores; cards from JSON; ranked results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.sources.commits import Log
from wayfind.sources.schemas import KEYS, schema

CARD_BYTES = 51_200


def read_catalog(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """A stored table by its fixed schema; columns that a file lacks are null. A table that was written by commits is read as of a
    commit, the last one unless another is named; any other folder of Parquet files is read as it is."""
    return read_rows(spark, path, schema(table), version)


def read_rows(spark: SparkSession, path: str, columns: T.StructType, version: int | None = None) -> DataFrame:
    number, content = Log(spark, path).read(version)
    if not number:
        return spark.read.schema(columns).parquet(path)
    folders = [f for f, _ in content["batches"].values()]
    return spark.read.schema(columns).parquet(*folders) if folders else spark.createDataFrame([], columns)


def _even_bounds(df: DataFrame, column: str, parts: int) -> list:
    """Values that cut a column into parts of about as many rows each, as literals of SQL."""
    kind = df.schema[column].dataType
    number = F.col(column) if isinstance(kind, T.NumericType) else F.unix_micros(F.col(column).cast("timestamp"))
    found = df.select(F.percentile_approx(number, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    if isinstance(kind, T.NumericType):
        return sorted(set(found))
    text = "yyyy-MM-dd" if isinstance(kind, T.DateType) else "yyyy-MM-dd HH:mm:ss.SSSSSS"
    mark = "d" if isinstance(kind, T.DateType) else "ts"
    shown = df.sparkSession.createDataFrame([(x,) for x in sorted(set(found))], "u long").select(F.date_format(F.timestamp_micros("u"), text).alias("t"))
    return [f"{{{mark} '{r['t']}'}}" for r in shown.collect()]  # one for each part; escapes that every driver reads


def read_catalog_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a live store in partitions of about as many rows each; Spark pushes column lists and filters down into each.

    The bounds are quantiles of the column itself (a number, date or time), which is read once for them, so skewed values make no
    partition larger. Nulls belong to the first partition. Needs the store's driver on the class path.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if not partition_column or partitions < 2:
        return reader.load()
    bounds = _even_bounds(reader.load().select(partition_column), partition_column, partitions)
    if not bounds:
        return reader.load()
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(partition_column)
    ranges = [f"{name} < {bounds[0]} OR {name} IS NULL", *[f"{name} >= {x} AND {name} < {y}" for x, y in zip(bounds, bounds[1:])], f"{name} >= {bounds[-1]}"]
    return spark.read.options(**options).jdbc(url, table, predicates=ranges)


def split_new(rows: DataFrame, existing: DataFrame, key: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rejects): a row whose key is stored already, or came in an earlier row of the batch, is rejected.

    order names the column that says which of several came first; without one, the first by all columns.
    """
    by = [F.col(order)] if order else [F.to_json(F.struct("*"))]
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    held = existing.select(*key).distinct().withColumn("__held", F.lit(True))
    marked = placed.join(held, key, "left").withColumn("__bad", F.col("__held").isNotNull() | (F.col("__n") > 1))
    drop = ["__n", "__held", "__bad"]
    rejects = marked.where("__bad").withColumn("reason", F.when(F.col("__held"), "already registered").otherwise("repeated in the batch"))
    return marked.where(~F.col("__bad")).drop(*drop), rejects.drop(*drop)


def insert_rows(rows: DataFrame, path: str, key: list[str], order: str | None = None, batch: str | None = None) -> DataFrame:
    """Inserts the rows with new keys as one commit, and returns the rejects with a reason.

    A batch that is named is inserted once: a retry changes nothing and gives the same rejects. Of two writers at once one commits
    first; the other checks its keys against what is there then. So a key is never stored twice.
    """
    spark, log = rows.sparkSession, Log(rows.sparkSession, path)
    batch = batch or uuid.uuid4().hex

    def over(number: int, content: dict) -> dict | None:
        batches = content.get("batches", {})
        if batch in batches:
            return None
        existing = read_rows(spark, path, rows.schema, number) if number else spark.createDataFrame([], rows.schema)
        fresh, rejects = split_new(rows, existing, key, order)
        out, refused = log.folder("rows"), log.folder("rejects")
        fresh.write.parquet(out)
        rejects.write.parquet(refused)
        return {"batches": {**batches, batch: [out, refused]}}

    return spark.read.parquet(log.read(log.change(over))[1]["batches"][batch][1])


def write_catalog(rows: DataFrame, path: str, table: str, order: str | None = None, batch: str | None = None) -> DataFrame:
    """insert_rows by the table's key."""
    return insert_rows(rows, path, KEYS[table], order, batch)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """One card from each JSON line of at most CARD_BYTES bytes; larger and unreadable ones go.

    An id in the document must be the wanted one where the lines carry a wanted_id next to the card.
    """
    lines = spark.read.text(path).where(F.octet_length("value") <= CARD_BYTES)
    parsed = lines.select(F.from_json("value", schema("cards"), {"mode": "PERMISSIVE"}).alias("card"), F.get_json_object("value", "$.wanted_id").alias("wanted"))
    good = parsed.where("card is not null and (wanted is null or card.entity_id is null or card.entity_id = wanted)")
    shown = good.select("card.*", "wanted")
    return shown.withColumn("entity_id", F.coalesce("entity_id", "wanted")).drop("wanted").where("entity_id is not null")


def write_results(ranked: DataFrame, path: str, query_date: str) -> None:
    """Ranked results by date; writing a date again replaces it."""
    ranked.withColumn("query_date", F.lit(query_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("query_date").parquet(path)
