"""Lineage cuts and size checks shared by the operators."""

from __future__ import annotations

import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table joined by broadcast on our word has at most so many rows of a few short values.
SMALL_ROWS = 100_000
#: Large tables are dealt out for a join so that a task has about so many rows, whatever the session's number of partitions.
TASK_ROWS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one in the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return named or spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has been counted and is small; else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def beside(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """A full outer join with a table that is small as a rule: then no row of the large one is shuffled, but it is made twice.

    Runs jobs while it is put together.
    """
    few = cut(few)
    if few.count() > SMALL_ROWS:
        return many.join(few, on, "full")
    few = F.broadcast(few)
    met = cut(many.select(*on).join(few.select(*on), on, "left_semi").distinct())
    alone = few.join(F.broadcast(met), on, "left_anti")
    return many.join(few, on, "left").unionByName(alone, allowMissingColumns=True)


def tasks_for(df: DataFrame) -> int:
    """How many tasks a table is dealt out over, by a count of its rows; one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def in_turn(shared: list[Broadcast]):
    """One broadcast value after the other; of several, each leaves a worker's memory before the next one is read."""
    for each in shared:
        yield each.value
        if len(shared) > 1:
            vars(each).pop("_value", None)
