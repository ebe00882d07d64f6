"""A stored index: immutable segments of posting blocks, deletion bitmaps beside them, and a job that merges segments.

A change writes the postings of the changed documents as a new segment and marks their old places as deleted. To find those
places only the ids of the stored blocks are read, no text and no posting. Every state of the index is a commit that lists its
segments and its deletion table, so readers go on with the state that they have opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.operators import blocks as B
from wayfind.operators.bm25 import query_terms
from wayfind.operators.sizes import cut, small
from wayfind.sources.commits import Log

#: Blocks to a row group of a segment's files: a row group is what a task that writes or reads them holds at once.
GROUP_BLOCKS = 4
_GONE = "segment string, block long, gone array<int>"


def _write_blocks(made: DataFrame, segment: str) -> None:
    """Parquet looks at the size of a row group after a hundred rows only, here of some megabytes each, so their number is limited."""
    made.withColumn("block", F.monotonically_increasing_id()).write.option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(f"{segment}/blocks")


class Index:
    """A stored index at a path. fields name the indexed texts; they, the tokenizer and the boosts must be the same at each use."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, fields: dict[str, Column], tokenizer: Callable[[Column], Column] = T.tokenize_basic, boosts: dict[str, float] | None = None) -> None:
        self.spark, self.log, self.id_col, self.fields, self.tokenizer = spark, Log(spark, path), id_col, fields, tokenizer
        self.boosts = [(boosts or {}).get(f, 1.0) for f in fields]

    def _write_segment(self, docs: DataFrame) -> str:
        """Blocks and dictionary of the documents' tokens; each is a read of the documents."""
        out = self.log.folder("segment")
        made = B.make_blocks(B.hashed_tokens(docs, self.id_col, self.fields, self.tokenizer), len(self.fields))
        _write_blocks(made, out)
        tokens = F.flatten(F.array(*[self.tokenizer(c) for c in self.fields.values()]))
        docs.select(F.explode(F.array_distinct(tokens)).alias("term")).distinct().withColumn("id", B.term_id(F.col("term"))).write.parquet(f"{out}/terms")
        return out

    def _gone(self, content: dict) -> DataFrame:
        return self.spark.read.schema(_GONE).parquet(content["gone"]) if content.get("gone") else self.spark.createDataFrame([], _GONE)

    def _stored(self, content: dict) -> DataFrame:
        parts = [self.spark.read.parquet(f"{s}/blocks").withColumn("segment", F.lit(s)) for s in content.get("segments", [])]
        if not parts:
            raise ValueError(f"{self.log.path} holds no index")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def _live(self, content: dict) -> DataFrame:
        whole = self._stored(content)
        if content.get("gone"):
            whole = whole.join(small(self._gone(content)), ["segment", "block"], "left")
        return whole.drop("segment", "block")

    def blocks(self, version: int | None = None) -> DataFrame:
        """The posting blocks of a state of the index, the last one unless another is named, with the places of deleted documents."""
        return self._live(self.log.read(version)[1])

    def create(self, docs: DataFrame) -> int:
        """Makes the index anew from all documents."""
        segment = self._write_segment(docs)
        return self.log.change(lambda _, old: {"segments": [segment], "gone": None})

    def update(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Adds or replaces documents, and takes out others by their ids; an id that is both stands with its new text.

        Only the changed documents' texts are read, and the ids of the stored ones. Null ids can be added but not replaced. On a
        conflict with another writer the deletions are made anew over what that one has left.
        """
        touched = [x.select(F.col(self.id_col).alias("doc")) for x in (changed, removed) if x is not None]
        if not touched:
            return self.log.version()
        ids = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
        ids = small(cut(ids.distinct()))
        segment = self._write_segment(changed) if changed is not None else None

        def over(_: int, content: dict) -> dict:
            placed = self._stored(content).select("segment", "block", F.posexplode("docs").alias("ord", "doc"))
            hit = placed.join(ids, "doc", "left_semi").select("segment", "block", F.array("ord").alias("gone"))
            both = self._gone(content).unionByName(hit).groupBy("segment", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
            out = self.log.folder("gone")
            both.write.parquet(out)
            return {"segments": content.get("segments", []) + ([segment] if segment else []), "gone": out}

        return self.log.change(over)

    def merge(self, most: int = 10) -> int:
        """One segment in place of several, if there are more than `most`: blocks are put together without their deleted documents,
        from postings alone. A commit that came in between is kept: the merge then begins again."""

        def over(_: int, content: dict) -> dict | None:
            if len(content.get("segments", [])) <= most:
                return None
            out, live = self.log.folder("segment"), self._live(content)
            kind = live.schema["docs"].dataType.elementType.simpleString()
            made = live.mapInArrow(_put_together(len(self.fields)), B.block_schema(kind))
            _write_blocks(made, out)
            terms = self.spark.read.parquet(*[f"{s}/terms" for s in content["segments"]])
            terms.distinct().write.parquet(f"{out}/terms")
            return {"segments": [out], "gone": None}

        return self.log.change(over)

    def sweep(self, keep: int = 2, older_than: float = 3600.0) -> list[str]:
        return self.log.sweep(lambda c: {*c.get("segments", []), *([c["gone"]] if c.get("gone") else [])}, keep, older_than)

    def terms(self) -> DataFrame:
        """(term, df, cf): every term that a live document has, with its documents and its occurrences."""
        content = self.log.read()[1]
        counted = self._live(content).mapInArrow(_term_counts(len(self.fields)), "id long, df long, cf long").groupBy("id").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        names = self.spark.read.parquet(*[f"{s}/terms" for s in content["segments"]]).distinct()
        return counted.join(names, "id").select("term", "df", "cf")

    def top(self, queries: DataFrame, k: int, query_id: str, query_text: Column, digits: int = 6) -> DataFrame:
        """(query, doc, score, rank): the k best documents of each query by BM25 over the stored postings."""
        terms = cut(query_terms(queries, query_id, query_text, self.tokenizer))
        stored = self.blocks()
        return B.top_of_blocks(stored, terms, k, stored.schema["docs"].dataType.elementType, self.boosts, digits, B.wanted_ids(terms))


def _term_counts(n_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = B.Block(batch, row, n_fields)
                terms, df = block.statistics(None)
                lists = np.repeat(np.arange(len(block.term)), np.diff(block.start))
                cf = np.zeros(len(terms), np.int64)
                np.add.at(cf, np.searchsorted(terms, block.term[lists]), block.tf)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df, pa.int64()), pa.array(cf)], names=["id", "df", "cf"])

    return run


def _put_together(n_fields: int):
    """Blocks in, blocks of up to BLOCK_DOCS live documents and about BLOCK_TOKENS postings out."""

    def joined(held: list[B.Block]) -> pa.RecordBatch:
        docs, lengths, parts, first = [], [], [], 0
        for b in held:
            place = first + np.cumsum(b.live) - 1
            counts = np.diff(b.start)
            lists = np.repeat(np.arange(len(counts)), counts)
            parts.append((b.field[lists], b.term[lists], place[b.ord], b.tf))
            docs.append(b.docs.filter(pa.array(b.live)))
            lengths.append(b.lengths[:, b.live])
            first += int(b.live.sum())
        field, term, ord_, tf = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ord_, term, field))
        field, term, ord_, tf = field[order], term[order], ord_[order], tf[order]
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (field[1:] != field[:-1])
        heads = np.flatnonzero(fresh)
        return B._one_row(pa.concat_arrays(docs), np.concatenate(lengths, axis=1).reshape(-1), {"field": field[heads], "term": term[heads], "start": np.append(heads, len(term)), "ord": ord_, "tf": tf})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                block = B.Block(batch, row, n_fields)
                live = int(block.live.sum())
                if held and (docs + live > B.BLOCK_DOCS or size + len(block.ord) > B.BLOCK_TOKENS):
                    yield joined(held)
                    held, docs, size = [], 0, 0
                if live:
                    held.append(block)
                    docs, size = docs + live, size + len(block.ord)
        if held:
            yield joined(held)

    return run
