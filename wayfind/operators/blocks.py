"""Postings in blocks of documents, and top-k BM25 that skips what cannot reach a request's k best.

A block is one row: the postings of up to BLOCK_DOCS documents, with all that is needed to score them. Blocks are made where their documents
are read, without a shuffle. Requests go out to the blocks as weighted terms. A first pass scores the few documents of each block
that do best by their weightiest terms, which gives every request a score that its k-th best hit reaches at least. The second pass
takes a request's terms by falling bound: documents without any of the first ones cannot reach that score, and a
candidate goes as soon as what it has and what is left to come stay below it. At most k rows per request and block are
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfind.functions import text as T
from wayfind.operators.bm25 import B, BOOSTS, K1, PHRASE_BONUS, found_phrases, idf, phrase_parts, phrase_rows, query_terms, searched_texts, top_k
from wayfind.operators.sizes import cut

#: A block ends after so many documents, or after the document that brings it to so many tokens.
BLOCK_DOCS, BLOCK_TOKENS = 1024, 1 << 20
#: Requests go out in parts of about so many weighted terms; the terms they have in all are sent as a filter up to this number.
PART_TERMS, MOST_WANTED = 1 << 20, 1 << 22
#: The share of a request's bound that the first pass goes by, and how many documents per wanted hit it scores.
FIRST_SHARE, FIRST_DOCS = 0.5, 2

_LISTS = {"field": pa.int32(), "term": pa.int64(), "start": pa.int32(), "ord": pa.int32(), "tf": pa.int32()}


def term_id(term: Column) -> Column:
    """Terms are told apart by 64 bits of their hash."""
    return F.xxhash64(term)


def hashed_tokens(docs: DataFrame, id_col: str, fields: dict[str, Column], tokenizer: Callable[[Column], Column], *extra: str) -> DataFrame:
    """(doc, f0, f1, ...): the ids of each field's tokens in order."""
    return docs.select(F.col(id_col).alias("doc"), *extra, *[F.transform(tokenizer(c), term_id).alias(f"f{i}") for i, c in enumerate(fields.values())])


def block_schema(kind: str) -> str:
    return f"docs array<{kind}>, lengths array<int>, field array<int>, term array<long>, start array<int>, ord array<int>, tf array<int>"


#: What a block of documents that were searched for phrases has besides: each meeting's phrase, and the place of its document.
_MET = "phrase array<long>, phrase_at array<int>"


def _lists(values: np.ndarray, rows: np.ndarray, fields: np.ndarray) -> dict[str, np.ndarray]:
    """Postings sorted by field, term and document from one entry per token."""
    order = np.lexsort((rows, values, fields))
    values, rows, fields = values[order], rows[order], fields[order]
    fresh_list = np.ones(len(values), bool)
    fresh_list[1:] = (values[1:] != values[:-1]) | (fields[1:] != fields[:-1])
    fresh = fresh_list.copy()
    fresh[1:] |= rows[1:] != rows[:-1]
    at = np.flatnonzero(fresh)
    heads = np.flatnonzero(fresh_list[at])
    return {"field": fields[at][heads], "term": values[at][heads], "start": np.append(heads, len(at)), "ord": rows[at], "tf": np.diff(np.append(at, len(values)))}


def _one_row(docs: pa.Array, lengths: np.ndarray, lists: dict[str, np.ndarray]) -> pa.RecordBatch:
    def single(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [single(docs), single(pa.array(lengths, pa.int32())), *[single(pa.array(lists[c], t)) for c, t in _LISTS.items()]]
    return pa.RecordBatch.from_arrays(columns, names=["docs", "lengths", *_LISTS])


def make_blocks(tokens: DataFrame, n_fields: int, wanted: Broadcast | None = None, phrases: list[Broadcast] | None = None) -> DataFrame:
    """Blocks of hashed_tokens rows. Given wanted term ids (sorted), only those are posted; lengths always count all tokens. Given
    phrase_parts, the `texts` of the rows are searched for them."""
    kind = tokens.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        search = found_phrases(phrases) if phrases is not None else None
        held: list[pa.RecordBatch] = []
        docs = size = 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            n, parts, lengths = len(rows), [], []
            for f in range(n_fields):
                column = rows.column(f"f{f}").chunk(0)
                own = np.diff(column.offsets.to_numpy())
                values, at = column.flatten().to_numpy(), np.repeat(np.arange(n), own)
                if keep is not None:
                    place = np.minimum(np.searchsorted(keep, values), max(0, len(keep) - 1))
                    met = keep[place] == values if len(keep) else np.zeros(len(values), bool)
                    values, at = values[met], at[met]
                lengths.append(own)
                parts.append((values, at, np.full(len(values), f)))
            lists = _lists(*[np.concatenate(x) for x in zip(*parts)])
            made = _one_row(rows.column("doc").chunk(0), np.concatenate(lengths), lists)
            if search is None:
                return made
            at, met = search(rows.column("texts").chunk(0))
            both = [pa.ListArray.from_arrays(pa.array([0, len(met)], pa.int32()), v) for v in (pa.array(met), pa.array(at.astype(np.int32)))]
            return pa.RecordBatch.from_arrays([*made.columns, *both], names=[*made.schema.names, "phrase", "phrase_at"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # whole rows until the block is full
                counts = sum(np.diff(batch.column(f"f{f}").offsets.to_numpy())[at:] for f in range(n_fields))
                fits = int(np.searchsorted(np.cumsum(counts), BLOCK_TOKENS - size, side="left")) + 1
                take = min(fits, BLOCK_DOCS - docs, batch.num_rows - at)
                held.append(batch.slice(at, take))
                docs, size, at = docs + take, size + int(counts[:take].sum()), at + take
                if docs >= BLOCK_DOCS or size >= BLOCK_TOKENS:
                    yield block()
                    held, docs, size = [], 0, 0
        if held:
            yield block()

    return tokens.mapInArrow(run, block_schema(kind.simpleString()) + (f", {_MET}" if phrases is not None else ""))


class Block:
    """One block as arrays; documents whose places are in `gone` have no postings any more."""

    def __init__(self, batch: pa.RecordBatch, row: int, n_fields: int) -> None:
        self.docs = batch.column("docs")[row].values
        self.lengths = batch.column("lengths")[row].values.to_numpy().reshape(n_fields, len(self.docs))
        self.field, self.term, self.start, self.ord, self.tf = (batch.column(c)[row].values.to_numpy() for c in _LISTS)
        self.n = len(self.docs)
        searched = "phrase" in batch.schema.names
        self.phrase, self.phrase_at = (batch.column(c)[row].values.to_numpy() if searched else np.zeros(0, np.int64) for c in ("phrase", "phrase_at"))
        self.live = np.ones(self.n, bool)
        names = batch.schema.names
        self.base, self.key = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) if c in names else None for c in ("base", "key"))
        gone = batch.column("gone")[row].values if "gone" in names else None
        if gone is not None and len(gone):
            self.live[gone.to_numpy()] = False
            counts = np.diff(self.start)
            keep = self.live[self.ord]
            lists = np.repeat(np.arange(len(counts)), counts)[keep]
            self.ord, self.tf = self.ord[keep], self.tf[keep]
            self.start = np.concatenate([[0], np.cumsum(np.bincount(lists, minlength=len(counts)))])

    def statistics(self, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Wanted terms and the number of documents that have each in any field."""
        counts = np.diff(self.start)
        terms, docs = np.repeat(self.term, counts), self.ord
        if wanted is not None:
            met = np.isin(terms, wanted, kind="sort")
            terms, docs = terms[met], docs[met]
        order = np.lexsort((docs, terms))
        terms, docs = terms[order], docs[order]
        fresh = np.ones(len(terms), bool)
        fresh[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
        return np.unique(terms[fresh], return_counts=True)


def block_statistics(blocks: DataFrame, n_fields: int, wanted: Broadcast | None = None) -> DataFrame:
    """(term, n, total): for each block its documents and tokens by field under a null term, and the documents that have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, n_fields)
                terms, df = block.statistics(keep)
                total = [block.lengths[:, block.live].sum(axis=1).tolist()] + [None] * len(terms)
                yield pa.RecordBatch.from_arrays([pa.array([None, *terms.tolist()], pa.int64()), pa.array([int(block.live.sum()), *df.tolist()], pa.int64()), pa.array(total, pa.list_(pa.int64()))], names=["term", "n", "total"])

    return blocks.mapInArrow(run, "term long, n long, total array<long>")


class _Requests:
    """Weighted terms of a part of the requests, sorted by request, and (phrase, request, bonus) of what they quote, sorted by phrase.

    near: (document key, request) of documents that are wanted whatever they score, sorted by key; depth: how many each request wants.
    """

    def __init__(self, ids: list, first: np.ndarray, terms: np.ndarray, weights: np.ndarray, averages: list[float], boosts: list[float], quoted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, near: tuple[np.ndarray, np.ndarray] | None = None, depth: np.ndarray | None = None) -> None:
        self.quoted, self.near, self.depth = quoted, near, depth
        self.ids, self.first, self.terms, self.weights = ids, first, terms, weights
        self.averages, self.boosts = averages, boosts
        self.least = np.zeros(len(ids))


class _Scorer:
    """A block against requests: for each request the lists that it meets, what each gives at most, and the scores themselves."""

    def __init__(self, block: Block, requests: _Requests) -> None:
        self.block, counts = block, np.diff(block.start)
        lists = np.repeat(np.arange(len(counts)), counts)
        fields = block.field[lists] if len(lists) else lists
        average, boost = np.asarray(requests.averages), np.asarray(requests.boosts)
        length = block.lengths[fields, block.ord] if len(lists) else lists
        self.impact = block.tf * (K1 + 1) / (block.tf + K1 * (1 - B + B * length / average[fields])) * boost[fields]
        most = np.zeros(len(counts))
        np.maximum.at(most, lists, self.impact)
        owner = np.repeat(np.arange(len(requests.ids)), np.diff(requests.first))
        met, places = [], []
        for f in range(len(requests.averages)):
            a, b = np.searchsorted(block.field, [f, f + 1])
            own = block.term[a:b]
            if len(own):
                place = np.minimum(np.searchsorted(own, requests.terms), len(own) - 1)
                hit = np.flatnonzero((own[place] == requests.terms) & (counts[a + place] > 0))
                met.append(hit)
                places.append(a + place[hit])
        met = np.concatenate(met) if met else np.zeros(0, np.int64)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        bound = requests.weights[met] * most[places]
        order = np.lexsort((-bound, owner[met]))
        self.owner, self.lists, self.weights, self.bound = owner[met][order], places[order], requests.weights[met][order], bound[order]
        self.reach = np.bincount(self.owner, self.bound, minlength=len(requests.ids))

    def open(self, least: np.ndarray, slack: float) -> np.ndarray:
        """The requests that may find something here."""
        return np.flatnonzero((self.reach > 0) & (self.reach >= least - slack))

    def own(self, request: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.owner, [request, request + 1])
        return self.lists[a:b], self.weights[a:b], self.bound[a:b]

    def add(self, scores: np.ndarray, at: int, weight: float, only: np.ndarray | None = None) -> None:
        """One list's part of the scores, of all documents or of some (in ascending order)."""
        a, b = self.block.start[at], self.block.start[at + 1]
        docs = self.block.ord[a:b]
        if only is None:
            scores[docs] += weight * self.impact[a:b]
        elif len(only):
            place = np.minimum(np.searchsorted(docs, only), len(docs) - 1)
            hit = docs[place] == only
            scores[only[hit]] += weight * self.impact[a + place[hit]]

    def first(self, request: int, k: int) -> np.ndarray:
        """The k best scores among the documents that do best by the weightiest terms."""
        lists, weights, bound = self.own(request)
        enough = int(np.searchsorted(np.cumsum(bound), FIRST_SHARE * bound.sum())) + 1
        scores = np.zeros(self.block.n)
        for at, w in zip(lists[:enough].tolist(), weights[:enough].tolist()):
            self.add(scores, at, w)
        some = np.flatnonzero(scores)
        some = np.sort(some[np.argsort(-scores[some], kind="stable")[: FIRST_DOCS * k]])
        for at, w in zip(lists[enough:].tolist(), weights[enough:].tolist()):
            self.add(scores, at, w, some)
        return np.sort(scores[some])[::-1][:k]

    def best(self, request: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The documents that reach `least` with their scores, and perhaps some others, in ascending order."""
        lists, weights, bound = self.own(request)
        scores, rest, kept = np.zeros(self.block.n), float(bound.sum()), None
        for at, w, most in zip(lists.tolist(), weights.tolist(), bound.tolist()):
            if kept is None and rest < least:
                kept = np.flatnonzero(scores)
            if kept is not None:
                kept = kept[scores[kept] + rest >= least]
                if not len(kept):
                    break
            self.add(scores, at, w, kept)
            rest -= most
        if kept is None:
            kept = np.flatnonzero(scores)
        return kept, scores[kept]

    def of(self, request: int, docs: np.ndarray) -> np.ndarray:
        """The whole scores of some documents (in ascending order)."""
        scores = np.zeros(self.block.n)
        lists, weights, _ = self.own(request)
        for at, w in zip(lists.tolist(), weights.tolist()):
            self.add(scores, at, w, docs)
        return scores[docs]

    def near(self, requests: _Requests) -> dict[int, np.ndarray]:
        """By request: its near documents in this block, in ascending order."""
        if requests.near is None:
            return {}
        key, request = requests.near
        low, high = (np.searchsorted(key, self.block.key, side=s) for s in ("left", "right"))
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique(request[at] * self.block.n + np.repeat(np.arange(self.block.n), n))
        own = pair // self.block.n
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        return dict(zip(own[heads].tolist(), np.split(pair % self.block.n, heads[1:])))

    def with_phrases(self, requests: _Requests) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By request: the documents with a phrase that it quotes, in ascending order, and their whole scores with the bonus."""
        if requests.quoted is None or not len(self.block.phrase):
            return {}
        quoted, request, bonus = requests.quoted
        low, high = (np.searchsorted(quoted, self.block.phrase, side=s) for s in ("left", "right"))
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair, place = np.unique(request[at] * self.block.n + np.repeat(self.block.phrase_at, n), return_inverse=True)
        more, own = np.bincount(place, bonus[at], minlength=len(pair)), pair // self.block.n
        heads, out = np.flatnonzero(np.diff(own, prepend=-1)), {}
        for q, docs, add in zip(own[heads].tolist(), np.split(pair % self.block.n, heads[1:]), np.split(more, heads[1:])):
            out[q] = docs, self.of(q, docs) + add
        return out

    def reached(self, request: int, least: float, bonus: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """As best, and the documents with a phrase, for which `bonus` has their scores."""
        at, scores = self.best(request, least)
        if request in bonus:
            plain = ~np.isin(at, bonus[request][0])
            at, scores = np.concatenate([at[plain], bonus[request][0]]), np.concatenate([scores[plain], bonus[request][1]])
        return at, scores


def bounded_scores(blocks: DataFrame, requests: _Requests, k: int, query_kind, doc_kind, digits: int = 6, scored: Accumulator | None = None) -> DataFrame:
    """(query, doc, score): of each block the k best documents of each request, or fewer where they cannot be among its k best of all.

    Scores are compared as rounded, ties go by id. `scored` counts the pairs whose whole score was made.
    """
    context, slack = blocks.sparkSession.sparkContext, 10.0**-digits
    n_fields = len(requests.averages)
    shared = context.broadcast(requests)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[_Scorer]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _Scorer(Block(batch, row, n_fields), shared.value)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scorer in opened(batches):
            found = [(q, s) for q in scorer.open(shared.value.least, slack).tolist() for s in scorer.first(q, k).tolist()]
            if scored is not None:
                scored.add(len(found))
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["request", "score"])

    reached = top_k(blocks.mapInArrow(first, "request long, score double").withColumn("doc", F.lit(0)), k, "request", digits=12)
    least = requests.least.copy()
    for r in reached.where(F.col("rank") == k).select("request", "score").collect():  # a number for each request of this part
        least[r["request"]] = r["score"]
    known = context.broadcast(least)
    names = pa.array(requests.ids, to_arrow_type(query_kind))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = known.value.copy()
        for scorer in opened(batches):
            docs, by_id = scorer.block.docs, None
            request, place, value = [], [], []
            bonus, reached = scorer.with_phrases(shared.value), scorer.open(floor, slack).tolist()
            for q in [*reached, *(bonus.keys() - set(reached))]:
                at, scores = scorer.reached(q, floor[q] - slack, bonus)
                if scored is not None:
                    scored.add(len(at))
                if len(at) > k:
                    if by_id is None:
                        by_id = np.empty(len(docs), np.int64)
                        by_id[pa.compute.array_sort_indices(docs, null_placement="at_start").to_numpy()] = np.arange(len(docs))
                    top = np.lexsort((by_id[at], -np.floor(scores / slack + 0.5)))[:k]
                    at, scores = at[top], scores[top]
                if len(at) == k:
                    floor[q] = max(floor[q], float(scores.min()))
                request += [q] * len(at)
                place.append(at)
                value.append(scores)
            if request:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(request)), docs.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(value))], names=["query", "doc", "score"])

    return blocks.mapInArrow(best, f"query {query_kind.simpleString()}, doc {doc_kind.simpleString()}, score double")


def every_score(blocks: DataFrame, requests: _Requests, query_kind, doc_kind) -> DataFrame:
    """(query, doc, score) of every pair that shares a term, made where the blocks are."""
    n_fields = len(requests.averages)
    shared = blocks.sparkSession.sparkContext.broadcast(requests)
    names = pa.array(requests.ids, to_arrow_type(query_kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                scorer = _Scorer(Block(batch, row, n_fields), shared.value)
                for q in scorer.open(shared.value.least, 0.0).tolist():
                    at, scores = scorer.best(q, -np.inf)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(at), q))), scorer.block.docs.take(pa.array(at)), pa.array(scores)], names=["query", "doc", "score"])

    return blocks.mapInArrow(run, f"query {query_kind.simpleString()}, doc {doc_kind.simpleString()}, score double")


#: What the rows of a part of the requests are.
_TERM, _PHRASE, _NEAR, _DEPTH = range(4)


def parts_of_requests(terms: DataFrame, df: DataFrame, n_docs: int, averages: list[float], boosts: list[float], phrases: DataFrame | None = None, near: DataFrame | None = None, depths: DataFrame | None = None) -> Iterator[_Requests]:
    """The weighted terms of (query, term, qtf) rows, PART_TERMS at a time, with the phrases of these queries as phrase_rows gives them,
    their near documents (query, key) and how many they want (query, depth)."""
    weights = cut(terms.withColumn("id", term_id(F.col("term"))).join(df, "id").select("query", "id", (F.col("qtf") * idf(F.lit(float(n_docs)), F.col("df"))).alias("w"), F.lit(_TERM).alias("kind")))
    more = []
    if phrases is not None:
        more.append(phrases.groupBy("query", "id").agg((F.count(F.lit(1)) * PHRASE_BONUS).alias("w"), F.lit(_PHRASE).alias("kind")))
    if near is not None:
        more.append(near.select("query", F.col("key").alias("id"), F.lit(0.0).alias("w"), F.lit(_NEAR).alias("kind")))
    if depths is not None:
        more.append(depths.select("query", F.col("depth").cast("long").alias("id"), F.lit(0.0).alias("w"), F.lit(_DEPTH).alias("kind")))
    for rows in more:
        weights = weights.unionByName(rows)
    weights = cut(weights) if more else weights
    parts = max(1, -(-weights.count() // PART_TERMS))
    for p in range(parts):
        part = weights.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == p).orderBy("query", "id").toArrow()  # about PART_TERMS rows
        query = part.column("query").combine_chunks().dictionary_encode(null_encoding="encode") if part.num_rows else None
        if query is not None:
            query = query.combine_chunks() if isinstance(query, pa.ChunkedArray) else query
            names, codes = query.dictionary.to_pylist(), query.indices.to_numpy().astype(np.int64)
            ids, w, kind, by_phrase, by_key, depth = part.column("id").to_numpy(), part.column("w").to_numpy(), part.column("kind").to_numpy(), None, None, None
            if phrases is not None:
                met = kind == _PHRASE
                # null ids are not equal, here as in a join: their phrases are hits of their own
                codes[met & np.array([n is None for n in names])[codes]] = len(names)
                names.append(None)
                order = np.argsort(ids[met], kind="stable")
                by_phrase = ids[met][order], codes[met][order], w[met][order]
            if near is not None:
                met = kind == _NEAR
                order = np.argsort(ids[met], kind="stable")
                by_key = ids[met][order], codes[met][order]
            if depths is not None:
                depth = np.zeros(len(names), np.int64)
                depth[codes[kind == _DEPTH]] = ids[kind == _DEPTH]
            met = kind == _TERM
            codes, ids, w = codes[met], ids[met], w[met]
            n = np.bincount(codes, minlength=len(names))
            yield _Requests(names, np.append(0, np.cumsum(n)), ids, w, averages, boosts, by_phrase, by_key, depth)


def counted_blocks(blocks: DataFrame, n_fields: int, wanted: Broadcast | None) -> tuple[DataFrame, int, list[float]]:
    """(id, df) of the terms, the number of documents and each field's average length."""
    counted = cut(block_statistics(blocks, n_fields, wanted).groupBy("term").agg(F.sum("n").alias("df"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(n_fields)]))
    whole = counted.where("term is null").first()
    n_docs = whole["df"] if whole else 0
    averages = [float(whole[f"t{i}"]) / n_docs or 1.0 if n_docs else 1.0 for i in range(n_fields)]
    return counted.where("term is not null").select(F.col("term").alias("id"), "df"), n_docs, averages


def top_of_blocks(blocks: DataFrame, terms: DataFrame, k: int | None, doc_kind, boosts: list[float], digits: int = 6, wanted: Broadcast | None = None, scored: Accumulator | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best documents for (query, term, qtf) rows, or without k the scores of all that share a term
    with them. Statistics are those of all blocks. phrases (with k): phrase_rows of the queries, which add their bonus."""
    query_kind = terms.schema["query"].dataType
    df, n_docs, averages = counted_blocks(blocks, len(boosts), wanted)
    found = terms.sparkSession.createDataFrame([], f"query {query_kind.simpleString()}, doc {doc_kind.simpleString()}, score double")
    for requests in parts_of_requests(terms, df, n_docs, averages, boosts, phrases):
        more = every_score(blocks, requests, query_kind, doc_kind) if k is None else bounded_scores(blocks, requests, k, query_kind, doc_kind, digits, scored)
        found = found.unionByName(more)
    return found if k is None else top_k(found, k, digits=digits)


def mixed_scores(blocks: DataFrame, requests: _Requests, passing: Callable[[DataFrame], DataFrame], weight: float, query_kind, doc_kind, digits: int = 6) -> DataFrame:
    """(query, doc, text): every pair that may be among a request's `depth` best that pass, and its near ones, with its score over the
    request's best one of all.

    Pairs are compared by weight * text + the block's `base` of the document, as rounded; what a near pair has on top of that is not negative. passing
    leaves out rows of (query, doc, value) that don't pass. A first pass finds each request's best score, a second one a value that `depth`
    passing pairs reach, from twice as many of each block. The third one gives the pairs from there on, or all where too few have passed.
    """
    context, slack, n = blocks.sparkSession.sparkContext, 10.0**-digits, len(requests.ids)
    n_fields = len(requests.averages)
    shared, names = context.broadcast(requests), pa.array(requests.ids, to_arrow_type(query_kind))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[_Scorer]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _Scorer(Block(batch, row, n_fields), shared.value)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(n)
        for scorer in opened(batches):
            bonus, reached = scorer.with_phrases(shared.value), scorer.open(most, slack).tolist()
            for q in [*reached, *(bonus.keys() - set(reached))]:
                most[q] = max(most[q], scorer.reached(q, most[q] - slack, bonus)[1].max(initial=0.0))
        met = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(most[met])], names=["request", "score"])

    top = np.zeros(n)
    for r in blocks.mapInArrow(highest, "request long, score double").groupBy("request").agg(F.max("score").alias("score")).collect():  # a number for each request of this part
        top[r["request"]] = r["score"]
    best = context.broadcast(np.maximum(top, np.finfo(float).tiny))

    def values(scorer: _Scorer, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Request, documents that may reach its floor, their scores over the best one, and what they are compared by."""
        highest, base = best.value, scorer.block.base
        bonus, reached = scorer.with_phrases(shared.value), scorer.open(np.zeros(n), slack)
        least = (floor - base.max(initial=0.0) - slack) / weight * highest if weight > 0 else np.full(n, -np.inf)
        for q in dict.fromkeys([*reached[scorer.reach[reached] >= least[reached] - slack].tolist(), *bonus]):
            at, scores = scorer.reached(q, least[q] - slack, bonus)
            text = scores / highest[q]
            value = weight * text + base[at]
            keep = value >= floor[q] - slack
            if keep.any():
                yield q, at[keep], text[keep], value[keep]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, depth = np.full(n, -np.inf), shared.value.depth
        for scorer in opened(batches):
            request, place, value = [], [], []
            for q, at, _, v in values(scorer, floor):
                if len(at) > 2 * depth[q]:
                    some = np.argsort(-v, kind="stable")[: 2 * depth[q]]
                    at, v = at[some], v[some]
                if len(at) == 2 * depth[q]:
                    floor[q] = max(floor[q], v.min())
                request.append(np.full(len(at), q))
                place.append(at)
                value.append(v)
            if request:
                request = pa.array(np.concatenate(request))
                yield pa.RecordBatch.from_arrays([request, names.take(request), scorer.block.docs.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(value))], names=["request", "query", "doc", "value"])

    kinds = f"query {query_kind.simpleString()}, doc {doc_kind.simpleString()}"
    found = passing(blocks.mapInArrow(first, f"request long, {kinds}, value double")).select("request", F.col("value").alias("score"), F.lit(0).alias("doc"))
    floor, depth = np.full(n, -np.inf), requests.depth
    ranked = top_k(found, int(depth.max(initial=0)), "request", digits=12)
    own = blocks.sparkSession.createDataFrame(pa.table({"request": np.arange(n), "depth": depth}))
    for r in ranked.join(F.broadcast(own), "request").where(F.col("rank") == F.col("depth")).select("request", "score").collect():  # a number for each request of this part
        floor[r["request"]] = r["score"]
    known = context.broadcast(floor)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scorer in opened(batches):
            near, phrases = scorer.near(shared.value), None
            request, place, value = [], [], []
            for q, at, text, _ in values(scorer, known.value - slack):
                request.append(np.full(len(at), q))
                place.append(at)
                value.append(text)
                if q in near:
                    near[q] = np.setdiff1d(near[q], at)
            for q, at in near.items():
                phrases = scorer.with_phrases(shared.value) if phrases is None else phrases
                scores = np.zeros(scorer.block.n)
                scores[at] = scorer.of(q, at)
                if q in phrases:
                    scores[phrases[q][0]] = phrases[q][1]
                request.append(np.full(len(at), q))
                place.append(at)
                value.append(scores[at] / best.value[q])
            if request:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(request))), scorer.block.docs.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(value))], names=["query", "doc", "text"])

    return blocks.mapInArrow(last, f"{kinds}, text double")


def wanted_ids(terms: DataFrame) -> Broadcast | None:
    """The sorted ids of all terms of the requests, or None if they are too many to send."""
    ids = cut(terms.select(term_id(F.col("term")).alias("id")).distinct())
    if ids.count() > MOST_WANTED:
        return None
    return terms.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column("id").to_numpy()))


def blocks_for(queries: DataFrame, docs: DataFrame, query_id: str, query_text: Column, doc_id: str, fields: dict[str, Column], tokenizer: Callable[[Column], Column], tags: Column | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The queries' terms, their phrases where `tags` is given, and the documents' blocks, which then were searched for these."""
    terms = cut(query_terms(queries, query_id, query_text, tokenizer))
    if tags is None:
        return terms, None, cut(make_blocks(hashed_tokens(docs, doc_id, fields, tokenizer), len(fields), wanted_ids(terms)))
    phrases = cut(phrase_rows(queries, query_id, query_text))
    told = docs.withColumn("texts", searched_texts(fields["name"], fields["summary"], fields["category"], tags))
    return terms, phrases, cut(make_blocks(hashed_tokens(told, doc_id, fields, tokenizer, "texts"), len(fields), wanted_ids(terms), phrase_parts(phrases)))


def _retrieved(queries: DataFrame, docs: DataFrame, k: int | None, query_id: str, query_text: Column, doc_id: str, fields: dict[str, Column], tokenizer: Callable[[Column], Column], boosts: dict[str, float], digits: int = 6, scored: Accumulator | None = None) -> DataFrame:
    terms, _, blocks = blocks_for(queries, docs, query_id, query_text, doc_id, fields, tokenizer)
    return top_of_blocks(blocks, terms, k, docs.schema[doc_id].dataType, [boosts[f] for f in fields], digits, scored=scored)


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: Column, doc_id: str, doc_text: Column, tokenizer: Callable[[Column], Column] = T.tokenize_basic) -> DataFrame:
    """(query, doc, score) of every document that shares a term with a query.

    Runs jobs while it is put together: the documents are read and tokenized once, into blocks in the checkpoint folder. Neither tokens nor
    scored pairs are shuffled. Statistics cover all documents.
    """
    return _retrieved(queries, docs, None, query_id, query_text, doc_id, {"text": doc_text}, tokenizer, {"text": 1.0})


def bm25_fielded(queries: DataFrame, docs: DataFrame, query_id: str, query_text: Column, doc_id: str, fields: dict[str, Column], tokenizer: Callable[[Column], Column] = T.tokenize_advanced, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(query, doc, score) over weighted fields: document frequency over the union of fields, length and average per field. See bm25."""
    return _retrieved(queries, docs, None, query_id, query_text, doc_id, fields, tokenizer, boosts)


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: Column, doc_id: str, doc_text: Column, tokenizer: Callable[[Column], Column] = T.tokenize_basic, digits: int = 6, scored: Accumulator | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by BM25, ties by id, as top_k of bm25 gives them, by bounds.

    Documents or queries without tokens have no row. Runs jobs while it is put together, as bm25 does. `scored` counts scored pairs.
    """
    return _retrieved(queries, docs, k, query_id, query_text, doc_id, {"text": doc_text}, tokenizer, {"text": 1.0}, digits, scored)


def bm25_fielded_top(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: Column, doc_id: str, fields: dict[str, Column], tokenizer: Callable[[Column], Column] = T.tokenize_advanced, boosts: dict[str, float] = BOOSTS, digits: int = 6, scored: Accumulator | None = None) -> DataFrame:
    """(query, doc, score, rank) over weighted fields, as top_k of bm25_fielded gives them; see bm25_top."""
    return _retrieved(queries, docs, k, query_id, query_text, doc_id, fields, tokenizer, boosts, digits, scored)


def fielded_phrases_top(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: Column, doc_id: str, fields: dict[str, Column], tags: Column, tokenizer: Callable[[Column], Column] = T.tokenize_advanced, boosts: dict[str, float] = BOOSTS, digits: int = 6) -> DataFrame:
    """(query, doc, score, rank): the k best documents with the bonus of quoted phrases; a phrase alone is a hit.

    Documents are searched for phrases where they become blocks, so a block knows which documents get a bonus: these are scored whole, the
    others by bounds, and at most k rows per request and block are shuffled.
    """
    terms, phrases, blocks = blocks_for(queries, docs, query_id, query_text, doc_id, fields, tokenizer, tags)
    return top_of_blocks(blocks, terms, k, docs.schema[doc_id].dataType, [boosts[f] for f in fields], digits, phrases=phrases)


def keyword_engine(kind: str):
    """The engine by name: basic or fielded; anything else is refused."""
    try:
        return {"basic": bm25, "fielded": bm25_fielded}[kind]
    except KeyError:
        raise ValueError(f"unknown keyword engine {kind!r}") from None
