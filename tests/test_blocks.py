import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.operators import blocks, bm25
from wayfind.operators.index import document_frequencies, field_rows, token_rows, wanted_postings


def plain(q, d, query_id, query_text, doc_id, doc_text):
    """Every score by joins, without blocks."""
    terms = bm25.query_terms(q, query_id, query_text, T.tokenize_basic)
    posted = wanted_postings(token_rows(d, doc_id, doc_text, T.tokenize_basic), terms)
    n, length = posted.where("term = ''").agg(F.count(F.lit(1)), F.avg("length")).first()
    real = posted.where("term <> ''")
    weights = terms.join(document_frequencies(real), "term").select("query", "term", (F.col("qtf") * bm25.idf(F.lit(float(n)), F.col("df"))).alias("w"))
    return real.join(weights, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * bm25.saturation(F.col("tf"), F.col("length"), F.lit(length or 1.0))).alias("score"))


def plain_fielded(q, d, query_id, query_text, doc_id, fields):
    terms = bm25.query_terms(q, query_id, query_text, T.tokenize_advanced)
    posted = wanted_postings(field_rows(d, doc_id, fields, T.tokenize_advanced), terms)
    each = {r["field"]: r["length"] or 1.0 for r in posted.where("term = ''").groupBy("field").agg(F.avg("length").alias("length")).collect()}
    real = posted.where("term <> ''")
    df = real.groupBy("term").agg(F.countDistinct("doc").alias("df"))
    weights = terms.join(df, "term").select("query", "term", (F.col("qtf") * bm25.idf(F.lit(float(d.count())), F.col("df"))).alias("w"))
    average = F.element_at(F.create_map(*[F.lit(x) for kv in each.items() for x in kv]), F.col("field"))
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in bm25.BOOSTS.items() for x in kv]), F.col("field"))
    return real.join(weights, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * bm25.saturation(F.col("tf"), F.col("length"), average) * boost).alias("score"))


def corpus(spark, n=600, seed=3):
    """Texts of words as frequent as in prose, some documents with words of their own, exact copies, empty and null texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)) + [f"rare{i % 40}"])) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)] + [(n + 100, ""), (n + 101, None), (None, "w1 w2 nobody")]
    queries = [(q, " ".join(rng.choices(words, weights, k=25)) + f" rare{q}") for q in range(12)] + [(100, rows[7][1]), (101, ""), (102, None), (103, "unheard-of"), (None, "w1 nobody")]
    d = spark.createDataFrame(rows, "id long, t string").withColumn("doc", F.lit("mine")).withColumn("score", F.lit(1))
    return d.repartition(3), spark.createDataFrame(queries, "q long, t string")


def same(a, b):
    key = lambda rows: sorted(map(repr, ((r["query"], r["doc"], r["rank"], r["score"]) for r in rows.collect())))
    assert key(a) == key(b)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 50)


def test_top_is_that_of_all_scores_and_few_pairs_are_scored(spark, small_blocks):
    d, q = corpus(spark)
    scored = spark.sparkContext.accumulator(0)
    every = plain(q, d, "q", F.col("t"), "id", F.col("t"))
    got = blocks.bm25_top(q, d, 5, "q", F.col("t"), "id", F.col("t"), scored=scored)
    same(got, bm25.top_k(every, 5))
    got.collect()
    # the second pass ran twice
    assert scored.value < 2 * every.count() / 3


def test_all_scores(spark, small_blocks):
    d, q = corpus(spark, 150)
    key = lambda rows: sorted((repr(r["query"]), repr(r["doc"]), round(r["score"], 9)) for r in rows.collect())
    assert key(blocks.bm25(q, d, "q", F.col("t"), "id", F.col("t"))) == key(plain(q, d, "q", F.col("t"), "id", F.col("t")))


def test_fielded_top_is_that_of_all_scores(spark, small_blocks):
    d, q = corpus(spark, 300)
    d = d.where("id is not null")
    fields = {"name": F.substring_index("t", " ", 3), "tags": F.lit("w1"), "category": F.lit(None).cast("string"), "summary": F.col("t")}
    same(blocks.bm25_fielded_top(q, d, 7, "q", F.col("t"), "id", fields), bm25.top_k(plain_fielded(q, d, "q", F.col("t"), "id", fields), 7))


def test_requests_in_parts_and_without_a_filter(spark, small_blocks, monkeypatch):
    d, q = corpus(spark, 200)
    want = bm25.top_k(plain(q, d, "q", F.col("t"), "id", F.col("t")), 4).cache()
    monkeypatch.setattr(blocks, "PART_TERMS", 40)
    monkeypatch.setattr(blocks, "MOST_WANTED", 10)
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 500)
    same(blocks.bm25_top(q, d, 4, "q", F.col("t"), "id", F.col("t")), want)


def test_a_block_hands_on_k_rows_at_most(spark, small_blocks):
    """Also where many documents are equal: the smallest ids go on."""
    d = spark.createDataFrame([(i, "same words here") for i in range(500)], "id long, t string").repartition(2)
    q = spark.createDataFrame([(1, "words")], "q long, t string")
    terms = bm25.query_terms(q, "q", F.col("t"), T.tokenize_basic)
    made = blocks.make_blocks(blocks.hashed_tokens(d, "id", {"t": F.col("t")}, T.tokenize_basic), 1).cache()
    df = spark.createDataFrame([(500,)], "df long").select(blocks.term_id(F.lit("words")).alias("id"), "df")
    (requests,) = blocks.parts_of_requests(terms, df, 500, [3.0], [1.0])
    kind = d.schema["id"].dataType
    rows = blocks.bounded_scores(made, requests, 3, q.schema["q"].dataType, kind)
    assert rows.count() <= 3 * made.count()
    assert [r["doc"] for r in bm25.top_k(rows, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_empty_corpus_and_no_requests(spark):
    d, q = corpus(spark, 20)
    assert blocks.bm25_top(q, d.limit(0), 3, "q", F.col("t"), "id", F.col("t")).count() == 0
    assert blocks.bm25_top(q.limit(0), d, 3, "q", F.col("t"), "id", F.col("t")).count() == 0


def test_text_ids(spark):
    d, q = corpus(spark, 100)
    d, q = d.withColumn("id", F.concat(F.lit("é"), "id")), q.withColumn("q", F.concat(F.lit("q"), "q"))
    same(blocks.bm25_top(q, d, 3, "q", F.col("t"), "id", F.col("t")), bm25.top_k(plain(q, d, "q", F.col("t"), "id", F.col("t")), 3))


def test_lists_are_sorted():
    lists = blocks._lists(np.array([5, 3, 5, 5, 3]), np.array([1, 0, 0, 1, 2]), np.array([0, 0, 0, 0, 1]))
    assert {k: v.tolist() for k, v in lists.items()} == {"field": [0, 0, 1], "term": [3, 5, 3], "start": [0, 1, 3, 4], "ord": [0, 0, 1, 2], "tf": [1, 1, 2, 1]}


def test_phrases_by_hand(spark):
    """Substrings of any field, with and without spaces, at any place; each quote counts."""
    import random

    rng = random.Random(9)
    letters = ["a", "b", "ab", "ba", " ", "  ", "é", "\n", "A"]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    docs = [(i, word(6), word(40), None if i % 5 else word(3), [word(4), None] if i % 2 else None) for i in range(60)]
    queries = [(q, f'x "{word(rng.randint(1, 6))}" "{word(2)}" "{word(9)}" ""') for q in range(60)] + [(99, None), (100, '"a" "a"'), (101, '" "'), (102, '"   "'), (103, '"unpaired')]
    d = spark.createDataFrame(docs, "id long, name string, summary string, category string, tags array<string>")
    q = spark.createDataFrame(queries, "q long, t string")
    got = bm25.phrase_hits(q, d, "q", F.col("t"), "id", F.col("name"), F.col("summary"), F.col("category"), F.col("tags"))
    want = {}
    for qid, t in queries:
        phrases = [p.lower() for p in (t or "").split('"')[1::2] if p] if (t or "").count('"') % 2 == 0 else []
        for i, *fields, tags in docs:
            held = [x.lower() for x in [*fields, *(tags or [])] if x]
            if n := sum(any(p in x for x in held) for p in phrases):
                want[qid, i] = 5.0 * n
    assert {(r["query"], r["doc"]): r["bonus"] for r in got.collect()} == want


def test_top_with_phrases(spark, small_blocks):
    d, q = corpus(spark, 200)
    d = d.where("id is not null")
    q = q.withColumn("t", F.concat("t", F.lit(' "w1 w2" "are3"')))
    fields = {"name": F.substring_index("t", " ", 3), "tags": F.lit("w1"), "category": F.lit(None).cast("string"), "summary": F.col("t")}
    tags = F.array(F.lit("w1"))
    bonus = bm25.phrase_hits(q, d, "q", F.col("t"), "id", fields["name"], fields["summary"], fields["category"], tags)
    want = bm25.top_k(bm25.with_phrases(plain_fielded(q, d, "q", F.col("t"), "id", fields), bonus), 6)
    same(blocks.fielded_phrases_top(q, d, 6, "q", F.col("t"), "id", fields, tags), want)


def test_phrases_do_not_bring_scored_pairs_of_other_documents(spark, small_blocks, monkeypatch):
    """Every document shares a word with the request; only those with its phrase are scored whole, and few rows leave the blocks."""
    monkeypatch.setattr(blocks, "every_score", lambda *a: pytest.fail("every pair was scored"))
    d = spark.createDataFrame([(i, f"common word{i} " + ("rare pair" if i % 40 == 3 else "pair rare")) for i in range(300)], "id long, t string")
    q = spark.createDataFrame([(1, 'common "rare pair"'), (2, '"of the" "y of t"'), (3, '"pair rare" "pair rare"')], "q long, t string")
    d = d.unionByName(spark.createDataFrame([(900, "of the of the"), (901, "say of them")], "id long, t string"))
    fields = {"name": F.lit(None).cast("string"), "tags": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "summary": F.col("t")}
    none = F.lit(None).cast("array<string>")
    bonus = bm25.phrase_hits(q, d, "q", F.col("t"), "id", fields["name"], fields["summary"], fields["category"], none)
    want = bm25.top_k(bm25.with_phrases(plain_fielded(q, d, "q", F.col("t"), "id", fields), bonus), 5)
    same(blocks.fielded_phrases_top(q, d, 5, "q", F.col("t"), "id", fields, none), want)


def test_finder_in_slices(monkeypatch):
    """Phrases at any place, with letters of several bytes, in texts that are searched a few bytes at a time."""
    import random

    import pyarrow as pa

    from wayfind.functions import phrases

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é日 ") for _ in range(n))
    for size in [1, 30, 1 << 20] * 10:
        monkeypatch.setattr(phrases, "SLICE", size)
        texts = [word(rng.randint(0, 40)) if rng.random() < 0.9 else None for _ in range(25)]
        wanted = sorted({word(rng.randint(1, 12)) for _ in range(20)})
        row, at = phrases.Finder(wanted).find(pa.array(["a"] * 2 + texts).slice(2))
        assert sorted(zip(row.tolist(), at.tolist())) == [(i, j) for i, t in enumerate(texts) if t for j, p in enumerate(wanted) if p in t]
