import pytest
from pyspark.sql import functions as F

from wayfind.operators import blocks, bm25, segments
from wayfind.sources.commits import Conflict, Log


def index_at(spark, path):
    return segments.Index(spark, str(path / "index"), "id", {"t": F.col("t")})


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, t string")


def terms(index):
    return {r["term"]: (r["df"], r["cf"]) for r in index.terms().collect()}


def counted(rows):
    from collections import Counter

    df, cf = Counter(), Counter()
    for _, t in rows:
        words = (t or "").split()
        df.update(set(words))
        cf.update(words)
    return {w: (df[w], cf[w]) for w in df}


@pytest.fixture
def docs():
    return [(i, f"word{i % 7} word{i % 3} same same only{i}") for i in range(300)]


def test_changes_touch_only_their_own_documents(spark, tmp_path, docs, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 40)
    index = index_at(spark, tmp_path)
    index.create(frame(spark, docs).repartition(3))
    assert terms(index) == counted(docs)
    read = []
    write = index._write_segment
    monkeypatch.setattr(index, "_write_segment", lambda df: read.append(df.count()) or write(df))
    index.update(frame(spark, [(5, "new text"), (1000, "added word1")]), frame(spark, [(7, ""), (5, ""), (9999, "")]).select("id"))
    assert read == [2]
    now = {**dict(docs), 5: "new text", 1000: "added word1"}
    del now[7]
    assert terms(index) == counted(now.items())
    # again: a replaced document is replaced, a removed one comes back
    index.update(frame(spark, [(5, "newer"), (7, "back")]))
    now |= {5: "newer", 7: "back"}
    assert terms(index) == counted(now.items())
    q = spark.createDataFrame([(1, "newer word1"), (2, "same only8"), (3, "back")], "q long, t string")
    want = bm25.top_k(blocks.bm25(q, frame(spark, list(now.items())), "q", F.col("t"), "id", F.col("t")), 4)
    key = lambda rows: sorted(tuple(r) for r in rows.select("query", "doc", "rank", "score").collect())
    assert key(index.top(q, 4, "q", F.col("t"))) == key(want)
    index.merge(most=1)
    assert len(index.log.read()[1]["segments"]) == 1
    assert key(index.top(q, 4, "q", F.col("t"))) == key(want)
    assert terms(index) == counted(now.items())


def test_readers_keep_their_state_and_sweep_deletes_the_rest(spark, tmp_path, docs):
    index = index_at(spark, tmp_path)
    first = index.create(frame(spark, docs[:50]))
    opened = index.blocks()
    index.update(None, frame(spark, docs[:10]).select("id"))
    assert opened.select(F.explode("docs")).count() == 50
    assert index.blocks(first).select(F.explode("docs")).count() == 50
    index.create(frame(spark, docs[:20]))
    assert len(index.sweep(keep=1, older_than=0)) == 2
    assert terms(index) == counted(docs[:20])


def test_a_beaten_writer_deletes_over_what_the_other_left(spark, tmp_path, docs, monkeypatch):
    a, b = index_at(spark, tmp_path), index_at(spark, tmp_path)
    a.create(frame(spark, docs[:30]))
    read, once = a.log.read, []

    def slow(version=None):
        seen = read(version)
        if not once:
            once.append(1)
            b.update(frame(spark, [(3, "theirs")]))
        return seen

    monkeypatch.setattr(a.log, "read", slow)
    a.update(frame(spark, [(3, "mine"), (4, "mine")]))
    now = {**dict(docs[:30]), 3: "mine", 4: "mine"}
    assert terms(b) == counted(now.items())


def test_null_ids_empty_texts_and_empty_index(spark, tmp_path):
    index = index_at(spark, tmp_path)
    with pytest.raises(ValueError, match="no index"):
        index.terms()
    rows = [(None, "nobody here"), (1, None), (2, ""), (3, "x y")]
    index.create(frame(spark, rows))
    assert terms(index) == {"nobody": (1, 1), "here": (1, 1)}
    index.update(frame(spark, [(1, "now here")]))
    assert terms(index)["here"] == (2, 2)
    index.create(frame(spark, []))
    q = spark.createDataFrame([(1, "here")], "q long, t string")
    assert index.terms().count() == 0 and index.top(q, 3, "q", F.col("t")).count() == 0


def test_commits(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.read() == (0, {})
    assert log.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    assert log.change(lambda n, old: {"a": old["a"] + n}) == 2
    assert log.read() == (2, {"a": 2}) and log.read(1) == (1, {"a": 1})
    assert log.change(lambda n, old: None) == 2
    assert not [n for n in log._names(f"{log.path}/_commits") if not n.endswith((".json", ".crc"))]
