import pytest
from pyspark.sql import functions as F

from wayfind.functions import naming, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "n"), [("hello world", 2), ("code-review", 3), ("a b c", 0), ("one two three four five"[:18], 4), ("", 0), (None, 0), ("job-scrapper-service", 4)])
def test_basic_tokens(spark, value, n):
    assert len(one(spark, text.tokenize_basic(F.lit(value).cast("string")))) == n


@pytest.mark.parametrize(("word", "stem"), [("running", "runn"), ("nation", "nation"), ("translation", "transla"), ("bus", "bus"), ("services", "servic"), ("queries", "quer")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem


def test_advanced_tokens(spark):
    got = one(spark, text.tokenize_advanced(F.lit("The AI code-review of Straße")))
    assert got == ["ai", "code-review", "code", "review", "straße", "artificial-intelligence", "machine-learning", "ml", "programming", "software", "development", "analysis", "audit", "check"]


def test_ngrams(spark):
    config = text.TokenizerConfig(stemming=False, synonyms={}, ngram_min=2, ngram_max=3)
    assert one(spark, text.tokenize_advanced(F.lit("red green blue"), config)) == ["red", "green", "blue", "red_green", "green_blue", "red_green_blue"]


def test_phrases(spark):
    assert one(spark, text.quoted_phrases(F.lit('find "Code Review" and "" or "open'))) == ["code review"]


@pytest.mark.parametrize(("handle", "error"), [
    ("alice", None), ("dev-team", None), ("a1b", None), ("x" * 40, None), ("", "required"), ("ab", "malformed"), ("x" * 41, "malformed"), ("1abc", "malformed"), ("-abc", "malformed"),
    ("Abc", "malformed"), ("abc-", "ends with a hyphen"), ("a--b", "consecutive hyphens"), ("admin", "reserved"), ("a b", "malformed"), (None, "required"),
])
def test_handles(spark, handle, error):
    assert one(spark, naming.handle_error(F.lit(handle).cast("string"))) == error


@pytest.mark.parametrize(("fqan", "want"), [
    ("h.example/d/bot@0.9#sum.short", ("h.example/d/bot", "0.9", "sum.short", None)), ("zns://host/dev/agent", ("host/dev/agent", None, None, None)),
    ("host/dev/agent#cap", ("host/dev/agent", None, "cap", None)), ("host/dev/agent@1", ("host/dev/agent", "1", None, None)), ("host/dev/agent@", (None, None, None, "empty version")),
    ("host/dev/agent#", (None, None, None, "empty capability")), ("", (None, None, None, "empty name")), ("@1", (None, None, None, "empty base")), (None, (None, None, None, "empty name")),
    ("a@b@c#d", ("a@b", "c", "d", None)), ("a@1#b#c", ("a", "1#b", "c", None)),
])
def test_qualified(spark, fqan, want):
    assert tuple(one(spark, naming.parse_qualified(F.lit(fqan).cast("string")))) == want


def test_fqan(spark):
    assert tuple(one(spark, naming.parse_fqan(F.lit("host/dev/agent@2")))) == ("host", "dev", "agent", None)
    assert one(spark, naming.parse_fqan(F.lit("host/dev")))["error"] == "not host/handle/name"
    assert one(spark, naming.parse_fqan(F.lit("host/admin/agent")))["error"] == "handle: reserved"
    assert one(spark, naming.parse_fqan(F.lit("/dev/agent")))["error"] == "empty host"


@pytest.mark.parametrize(("record", "match"), [("v=dns1 key=k fqan=h/d/n", True), ("key=k v=dns1", False), ("v=dns2 key=k fqan=h/d/n", False), ("", False)])
def test_txt(spark, record, match):
    assert one(spark, naming.txt_matches(F.lit(record), F.lit("dns1"), F.lit("k"), F.lit("h/d/n"))) is match


def test_vectors(spark):
    v = one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert v == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert one(spark, vectors.pad_or_trim(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0]


def test_hash_embedder(spark):
    import numpy as np

    assert vectors.fnv1a([b"a", b"", b"foobar"]).tolist() == [0xAF63DC4C8601EC8C, 0xCBF29CE484222325, 0x85944171F73967E8]
    embed = vectors.embedder("hash", dims=384)
    df = spark.createDataFrame([("python code review",), ("python code review",), ("weather in tokyo",), ("",), (None,)], "t string").coalesce(1)
    a, b, c, d, e = (np.array(r.v) for r in df.select(embed(F.col("t")).alias("v")).collect())
    assert len(a) == 384
    assert abs(a @ b - 1) < 1e-6
    assert a @ c <= 0.9
    assert not d.any()
    assert not e.any()
    with pytest.raises(ValueError, match="unknown"):
        vectors.embedder("nope")
    with pytest.raises(ValueError, match="dims"):
        vectors.embedder("hash", dims=0)


def test_hash_embedder_takes_texts_together(spark, monkeypatch):
    import re

    import numpy as np
    import pyarrow as pa

    texts = ["a-bc--de_f x _ -- q-r aa-bb", None, "", "İstanbul KELVINK ßab", "same same same_same", "äb cd\tef\n\n-gh-", "x" * 3000 + " yy", "-", "ab"]

    def plain(text):
        words = []
        for run in re.findall("[a-z0-9_-]{2,}", (text or "").lower()):
            words += [run, *(p for p in re.split("[-_]", run) if len(p) >= 2 and p != run)]
        v = np.zeros(48)
        for w, n in [(w, 1.0) for w in words] + [(f"{a}_{b}", 0.5) for a, b in zip(words, words[1:])]:
            h = int(vectors.fnv1a([w.encode()])[0])
            v[h % 48] += n if h & 1 else -n
        return v / (np.linalg.norm(v) or 1.0)

    want = np.array([plain(t) for t in texts])
    assert np.allclose(vectors._embedded(pa.array(texts), 48), want)
    assert not len(vectors._embedded(pa.array([], pa.string()), 48))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    monkeypatch.setattr(vectors, "EMBED_CHARS", 20)
    got = np.array([r.v for r in df.select("i", vectors.embedder("hash", dims=48)(F.col("t")).alias("v")).orderBy("i").collect()])
    assert np.allclose(got, want, atol=1e-6)
