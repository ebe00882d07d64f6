"""Near-duplicate vectors by an inverted multi-index.

The halves of a unit vector have codebooks of their own; a pair of nearest codes is a cell of the product grid. A query
visits cells in order of how much farther their codes are than its own (the sum over both halves: the multi-sequence
order) up to a margin, which is set so that the pairs of a sample reach the target recall. A pair counts if either of the
two visits the other's cell, and every pair is verified by its cosine in double precision. Neighbouring cells of a row of
the grid lie together in a strip, and a vector is sent once to each strip in which it visits a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.components import connected_components
from wayfind.llm.support import cut
from wayfind.llm.textarrays import list_array

#: Codebooks and margin are fitted on at most so many distinct vectors, the first by a hash; all vectors are indexed.
SAMPLE = 8_192
#: Vectors of a cell, and queries to it, are compared in blocks of about so many.
BLOCK = 1_024
MOST_CODES = 512
#: Share of the sample's own pairs that must be met, and of made pairs right at the threshold (from one side).
RECALL, RECALL_AT_THRESHOLD = 0.999, 0.9


def _codebook(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres by Lloyd's algorithm from a seeded choice of points."""
    rng = np.random.RandomState(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(12):
        own = (((centres**2).sum(1))[None, :] - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    # along their main direction, so that near codes have near numbers
    main = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    return centres[np.argsort(centres @ main, kind="stable")]


@dataclass
class MultiIndex:
    """Codebooks of the two halves and the margin up to which cells are visited."""

    books: tuple[np.ndarray, np.ndarray]
    margin: float

    @classmethod
    def fit(cls, sample: np.ndarray, threshold: float, codes: int) -> MultiIndex:
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        half = unit.shape[1] // 2
        books = _codebook(unit[:, :half], codes, 1), _codebook(unit[:, half:], codes, 2)
        index = cls(books, 0.0)
        cells, far = index.cells(unit), index.farther(unit)
        needs = []
        for a in range(0, len(unit), BLOCK):
            q, v = np.nonzero(unit[a : a + BLOCK] @ unit.T >= threshold)
            q += a
            q, v = q[q < v], v[q < v]
            needs.append(np.minimum(index.needed(far, q, cells[v]), index.needed(far, v, cells[q])))
        needs = np.concatenate(needs)
        # made pairs: each vector turned to the threshold in a random direction
        rng = np.random.RandomState(3)
        side = rng.standard_normal(unit.shape)
        side -= (side * unit).sum(1, keepdims=True) * unit
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        turned = threshold * unit + math.sqrt(max(0.0, 1 - threshold**2)) * side
        made = index.needed(far, np.arange(len(unit)), index.cells(turned))
        own = float(np.quantile(needs, RECALL)) if len(needs) else 0.0
        index.margin = max(own, float(np.quantile(made, RECALL_AT_THRESHOLD))) + 1e-9
        return index

    def farther(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and code of each half, the squared distance less that of the nearest code."""
        half = self.books[0].shape[1]
        out = []
        for points, book in ((unit[:, :half], self.books[0]), (unit[:, half:], self.books[1])):
            d = (book**2).sum(1)[None, :] - 2 * points @ book.T
            out.append(d - d.min(1, keepdims=True))
        return out[0], out[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        one, two = self.farther(unit)
        return one.argmin(1) * len(self.books[1]) + two.argmin(1)

    def needed(self, far: tuple[np.ndarray, np.ndarray], query: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The margin at which each query visits the cell."""
        k = len(self.books[1])
        return far[0][query, cell // k] + far[1][query, cell % k]

    def strips(self, cells: np.ndarray, width: int) -> np.ndarray:
        """The strip of each cell: `width` codes of the second half beside each other, in one row of the grid."""
        k = len(self.books[1])
        return cells // k * -(-k // width) + cells % k // width

    def visits(self, unit: np.ndarray) -> list[np.ndarray]:
        """The cells that each vector visits, nearest codes of the first half first."""
        one, two = self.farther(unit)
        k = len(self.books[1])
        out = []
        for a, b in zip(one, two, strict=True):
            first = np.flatnonzero(a <= self.margin)
            first = first[np.argsort(a[first], kind="stable")]
            order = np.argsort(b, kind="stable")
            # the staircase of the two sequences: as far along the second as the first leaves room for
            upto = np.searchsorted(b[order], self.margin - a[first], side="right")
            out.append(np.concatenate([i * k + order[:n] for i, n in zip(first.tolist(), upto.tolist(), strict=True)]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each one's component, by repeated minima over the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(nodes: DataFrame, dims: int, threshold: float, n: int) -> DataFrame:
    """(node, links, other): how many vectors each node was found linked with, and edges that join what is linked.

    nodes: node bigint, weight bigint, vector of dims numbers. Each strip's vectors and queries are dealt into blocks, and a
    task compares one block of each; it returns a row per vector and one edge per vector at most, not the pairs.
    """
    context = nodes.sparkSession.sparkContext
    rows = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").toPandas()["vector"]
    codes = int(min(MOST_CODES, max(2, math.ceil(math.sqrt(n / 64)))))
    index = MultiIndex.fit(np.array(rows.tolist(), np.float64), threshold, codes)
    shared = context.broadcast(index)
    # about a block of vectors to a strip
    width = max(1, min(codes, BLOCK * codes**2 // max(n, 1)))
    kind = nodes.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                unit = _unit(_matrix(part.column(2)))
                visits = [np.unique(shared.value.strips(v, width)) for v in shared.value.visits(unit)]
                flat = np.concatenate(visits).astype(np.int32)
                home = shared.value.cells(unit)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(home.astype(np.int32)), pa.array(shared.value.strips(home, width).astype(np.int32)), list_array(flat, np.array([len(v) for v in visits]), pa.int32())],
                    names=["node", "weight", "vector", "home", "strip", "visits"],
                )

    placed = cut(nodes.select("node", "weight", "vector").mapInArrow(place, f"node long, weight long, vector {kind}, home int, strip int, visits array<int>"))
    held = placed.groupBy("strip").agg(F.count(F.lit(1)).alias("held"))
    asked = placed.select(F.explode("visits").alias("strip")).groupBy("strip").agg(F.count(F.lit(1)).alias("asked"))
    sizes = cut(held.join(asked, "strip").select("strip", F.ceil(F.col("held") / BLOCK).cast("int").alias("vb"), F.ceil(F.col("asked") / (4 * BLOCK)).cast("int").alias("qb")))
    # a row of three numbers for each strip of the grid: MOST_CODES ** 2 at most
    sizes = F.broadcast(sizes)
    deal = F.xxhash64("node")
    own = placed.join(sizes, "strip").select("strip", F.pmod(deal, F.col("vb")).alias("v"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("query"), "node", "weight", "vector", "home")
    ask = placed.select("node", "weight", "vector", "home", F.explode("visits").alias("strip")).join(sizes, "strip")
    ask = ask.select("strip", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("v"), F.pmod(deal, F.col("qb")).alias("q"), F.lit(True).alias("query"), "node", "weight", "vector", "home")

    def compare(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
        node, weight, home = (group.column(c).to_numpy() for c in ("node", "weight", "home"))
        unit = _unit(_matrix(group.column("vector")))
        qs, vs = np.flatnonzero(query), np.flatnonzero(~query)
        links = np.zeros(len(node), np.int64)
        ends: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        index = shared.value
        goes = index.farther(unit[qs])
        for cell in np.unique(home[vs]).tolist():
            inside = vs[home[vs] == cell]
            far = index.farther(unit[inside])
            comes = np.flatnonzero(index.needed(goes, np.arange(len(qs)), np.full(len(qs), cell)) <= index.margin)
            for a in range(0, len(comes), 256):
                some = qs[comes[a : a + 256]]
                i, j = np.nonzero(unit[some] @ unit[inside].T >= threshold)
                q, v = some[i], inside[j]
                other = node[q] != node[v]
                q, v, j = q[other], v[other], j[other]
                np.add.at(links, q, weight[v])
                # the other side counts it here if it doesn't come to the query's own cell
                alone = index.needed(far, j, home[q]) > index.margin
                np.add.at(links, v[alone], weight[q[alone]])
                if len(q):
                    roots = _roots(len(node), q, v)
                    moved = np.flatnonzero(roots != np.arange(len(node)))
                    starts.append(moved)
                    ends.append(roots[moved])
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        to = np.concatenate(ends) if ends else at
        roots = _roots(len(node), at, to) if len(at) else np.arange(len(node))
        some = np.flatnonzero((links > 0) | (roots != np.arange(len(node))))
        return pa.table({"node": node[some], "links": links[some], "other": node[roots[some]]})

    return own.unionByName(ask).groupBy("strip", "v", "q").applyInArrow(compare, "node long, links long, other long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id (the smallest id reachable by links) and kept.

    Links are pairs with a cosine of at least the threshold; none below it is reported, and the target recall is above. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors without an id,
    whose component_id is null. Vectors of different lengths are never linked. Equal vectors are one node with a weight, so copies
    cost nothing; each still counts the others as links. Rows that share an id count as one in links between different
    vectors. Other columns are not looked at.
    """
    # floats are sent about as they are, and compared as doubles
    number = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast(number)).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.col("id").isNotNull() & fine, F.col("vector")))
    nodes = cut(rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")))
    found = None
    for dims, n in sorted(tuple(r) for r in nodes.groupBy(F.size("vector")).count().collect()):
        part = _pairs(nodes.where(F.size("vector") == dims), dims, threshold, n)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = nodes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("other")).limit(0)
    found = cut(found)
    labels = connected_components(found.where("node <> other"), "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.join(links, "node", "left").join(labels, "node", "left")
    labelled = labelled.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(labelled, "vector", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
