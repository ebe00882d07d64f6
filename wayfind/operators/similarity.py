"""Vector retrieval: a stated set of query vectors against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.operators.sizes import cut, in_turn

#: Query vectors go out in blocks of so many; a block is what a task holds.
QUERY_BLOCK = 4096


def wrong_dimensions(vectors: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows that retrieval leaves out for their length."""
    return vectors.where(F.col(vector).isNull() | (F.size(vector) != dims))


def cosine_hits(queries: DataFrame, vectors: DataFrame, query_id: str, query_vector: str, id_col: str, vector: str, dims: int, k: int | None = None, least: float = 0.0) -> DataFrame:
    """(query, doc, sim) of pairs with a cosine above `least`; with k, the k best of each query.

    Vectors of other lengths than dims are left out. Queries are dealt into blocks by hash, each a bounded broadcast;
    vectors are read once, and each batch is multiplied with one block after the other. With k, each batch hands on its k best
    per query only, ties by id.
    """
    ids = cut(queries.where(F.size(query_vector) == dims).select(F.col(query_id).cast("long").alias("i"), F.transform(query_vector, lambda x: x.cast("double")).alias("v")))
    usable = vectors.where(F.size(vector) == dims).select(F.col(id_col).cast("long").alias("doc"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    blocks = max(1, -(-ids.count() // QUERY_BLOCK))
    shared = []
    for b in range(blocks):
        block = ids.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toPandas()
        matrix = np.array(block["v"].tolist(), np.float64).reshape(len(block), dims)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
        shared.append(queries.sparkSession.sparkContext.broadcast((block["i"].to_numpy(np.int64), matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qid, q in in_turn(shared):
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    doc = part.column(0).to_numpy()
                    x = np.asarray(part.column(1).flatten(), np.float64).reshape(len(doc), dims)
                    n = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                    sims = np.round(q @ x.T, 6) if k else q @ x.T
                    i, j = np.nonzero(sims > least)
                    if k and len(i):
                        order = np.lexsort((doc[j], -sims[i, j], i))
                        i, j = i[order], j[order]
                        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
                        i, j = i[place < k], j[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(doc[j]), pa.array(sims[i, j])], names=["query", "doc", "sim"])

    out = usable.mapInArrow(run, "query long, doc long, sim double")
    if k:
        from wayfind.operators.bm25 import top_k

        out = top_k(out, k, score="sim")
    return out
