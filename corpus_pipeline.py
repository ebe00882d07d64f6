"""The corpus pipeline: documents in, a cleaned, mixed and sharded corpus out.

Each stage takes (spark, docs, sf_dir) with docs as the stage before left them, and returns a DataFrame that is written as
Parquet and read again for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import decontamination, language, minhash, mixing, sharding
from wayfind.llm.support import checkpoint_dir, cut, table, without

#: A document of whose letters less than this share is in a script of a learned language goes, as does one without letters.
LEAST_KNOWN = 0.02
SHARDS = 40


def _beside(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs, beside the whole row as a struct, so that no column clashes with what it adds."""
    return docs.select(*needed, F.struct(*docs.columns).alias("whole_row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one or more languages that the labelled texts teach; null, empty and letterless texts go.

    Repeated rows are each judged by their text. Where nothing is labelled no text is known and none stays. No rows in, none out.
    """
    found = language.identify_languages(_beside(docs, "text"), language.learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN)).select("whole_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Null, empty and very short texts have shingles of their own or none and stay. Rows that share an id are one document: they
    stay or go together. A row without an id stays. No rows in, none out.
    """
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).where("not kept").select("doc_id")
    return without(docs, "doc_id", cut(gone))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are each judged by their text."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws it, in a global order; a null source is one of its own, rows that
    share an id share the draw."""
    return mixing.mix_sources(_beside(docs, "doc_id", "source", "text"), temperature=0.5, seed="mix-1").select("whole_row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All copies with their shard and their slot in it, which replace columns of these names."""
    return sharding.assign_shards(docs, "doc_id", SHARDS)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Language models and bands of hashes are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what each one returns is written under the shared checkpoint folder, and emptied
    once the next one has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs, before, last = spark.read.parquet(out), last, out
        if before:
            docs.limit(0).write.mode("overwrite").parquet(before)
    return docs
