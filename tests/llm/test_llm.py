import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayfind.llm import components, decontamination, html_text, language, language_model, line_dedup, minhash, mixing, sharding, token_counts, vector_dedup

ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "  \t\n ", "en", "a"), (4, "word", None, "a"), (5, "word", "en", None), (None, "no id here at all", "en", "a"), (7, "é ß 日本語 🙂 Привет", "fr", "b"), (8, "long " * 20_000, "en", "b"), (9, "x" * 50_000, "en", "b"), (9, "same id twice", "en", "b"), (9, "same id twice", "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def clashing(df):
    """Extra columns with names that the operators use themselves."""
    return df.withColumns({c: F.lit("mine") for c in ("shard", "slot", "score", "lang_pred", "leaks", "n_tokens", "removed", "copy", "rate", "id", "key", "n")})


def odd(spark):
    return clashing(docs(spark, ODD))


# sharding


@pytest.mark.parametrize(("key", "n", "want"), [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)])
def test_jump_hash_published_values(spark, key, n, want):
    assert spark.range(1).select(sharding.jump_hash(F.lit(key), n).alias("x")).first()["x"] == want


def jump(key, n):
    b, j = -1, 0
    key &= 2**64 - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_brute_force(spark):
    keys = [0, -1, 2**63 - 1, -(2**63), *range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = df.select("k", sharding.jump_hash(F.col("k"), 40).alias("a"), sharding.jump_hash(F.col("k"), 41).alias("b")).collect()
    for r in rows:
        assert (r["a"], r["b"]) == (jump(r["k"], 40), jump(r["k"], 41))
        assert r["a"] == r["b"] or r["b"] == 40


def test_shard_table(spark):
    rows = sharding.shard_table(odd(spark), 4).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {r["size"] for r in rows if r["doc_id"] == 1} == {16}
    assert sharding.shard_table(docs(spark, [])).count() == 0


# mixing


def test_poisson_inverse(spark):
    for rate in (0.1, 1.0, 7.5):
        df = spark.range(1000).select((F.col("id") / 1000.0).alias("u"))
        got = [r["k"] for r in df.select(mixing.poisson_count(F.col("u"), mixing.poisson_cdf(F.lit(rate), rate)).alias("k")).collect()]
        for i, k in enumerate(got):
            below, p, want = 0.0, math.exp(-rate), 0
            while below + p <= i / 1000:
                below += p
                want += 1
                p *= rate / want
            assert k == want
        assert got == sorted(got)


def test_mixing_meets_targets(spark):
    rows = [(i, "w" * 99, "en", "big" if i % 10 else "small") for i in range(20_000)]
    out = mixing.mix_sources(docs(spark, rows), weights={"big": 1.0, "small": 1.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] / 10_000 - 1) < 0.05
    assert abs(n["small"] / 10_000 - 1) < 0.05
    again = mixing.mix_sources(docs(spark, rows).repartition(7), weights={"big": 1.0, "small": 1.0})
    assert again.select("doc_id", "copy", "shuffle_key").exceptAll(out.select("doc_id", "copy", "shuffle_key")).count() == 0
    keys = [r["shuffle_key"] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    with pytest.raises(ValueError, match="rate"):
        mixing.mix_sources(docs(spark, rows), weights={"small": 1.0}, most_rate=2.0)


def test_mixing_draws_any_rate(spark):
    rows = [(i, "w" * 9999, "en", "big") for i in range(4000)] + [(-1, None, "en", "rare"), (-2, "", "en", "rare")]
    rates = {r["__source"]: r for r in mixing.source_rates(docs(spark, rows), "source", None, 0.5, 1.0).collect()}
    rate = rates["rare"]["rate"]
    assert rate > 3 * mixing.PART_RATE
    assert rates["big"]["__parts"] == 1
    out = mixing.mix_sources(docs(spark, rows)).where("source = 'rare'").select("doc_id", "copy", "n_copies").collect()
    for i in (-1, -2):
        mine = [r for r in out if r["doc_id"] == i]
        assert sorted(r["copy"] for r in mine) == list(range(mine[0]["n_copies"]))
        assert abs(len(mine) - rate) < 6 * math.sqrt(rate)
    assert len({r["n_copies"] for r in out}) == 2


def test_mixing_odd(spark):
    out = mixing.mix_sources(odd(spark), output_share=3.0).collect()
    sizes = {r[0]: len(r[1] or "") + 1 for r in ODD}
    assert {r["doc_id"] for r in out} <= set(sizes)
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"], r["text"]].append(r["copy"])
        assert r["shard"] == "mine"
        assert r["rate"] != "mine"
    for (i, _), copies in by.items():
        assert sorted(set(copies)) == list(range(max(copies) + 1)), i
    assert mixing.mix_sources(docs(spark, [])).count() == 0


# token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return public_tokenizers.path("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark, tokenizer):
    path, library = tokenizer
    rnd = random.Random(5)
    alphabet = "abcdehillrstuvmABST'’ \n\t0123²½!?<|>Éßéèñ日本語καΣςİ́​ \x85\x1c🙂👍🏽-_."
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(2000)]
    texts += ["I'll we've 's'd store'store don''t's 'STORE x<|endoftext|>y <|startoftext|><|endoftext|>", "a" * 3000, "ab " * 2000, None, ""]
    rows = token_counts.token_table(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), path, 100).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(t.encode()), want > 100)


def test_chunks_compose(tokenizer, monkeypatch):
    path, library = tokenizer
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 50)
    text = " ".join(f"wörd{i} 'll {i}" for i in range(300)) + "<|endoftext|>" + "z" * 400
    pieces = list(token_counts._pieces(text, re.compile(re.escape("<|endoftext|>"))))
    assert len(pieces) > 20
    assert token_counts._word_counts(path, [p for p, _ in pieces]).sum() + sum(n for _, n in pieces) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk, warm", [(256, 64), (7, 3), (5, 0)])
def test_state_maps_of_long_words_compose(tokenizer, monkeypatch, chunk, warm):
    path, library = tokenizer
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "WARM", warm)
    rnd = random.Random(8)
    texts = ["a" * 2000, "ab" * 900, "the" * 700, "日本語" * 300, "=" * 1500, "-=" * 333, *("".join(rnd.choice(x) for _ in range(rnd.randint(500, 1500))) for x in ("ab", "etaoinshrdlu", "日本語中国", ".,-=", "éèaz") for _ in range(2))]
    got = token_counts._word_counts(path, texts)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_odd(spark, tokenizer):
    assert token_counts.count_tokens(odd(spark), path=tokenizer[0]).count() == len(ODD)
    assert token_counts.token_table(docs(spark, []), tokenizer[0]).count() == 0


# near duplicates


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def classes(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_copies(seed, groups=12, size=6, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(words)] = rnd.choice(vocabulary)
            rows.append(" ".join(copy))
    rnd.shuffle(rows)
    return [(i, t, "en", "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_minhash_brute_force(spark, width, percent):
    rows = near_copies(width)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, rows), width=width, percent=percent).collect()}
    sets = {i: shingles(t, width) for i, t, *_ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = classes(sets, linked)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) and r["n_shingles"] == len(sets[i]) for i, r in got.items())


def loose_copies(seed, size=60, words=60):
    """Copies of one text that differ from it in about as many words as a link allows, and from each other in more."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(size):
        copy = list(base)
        for k in rnd.sample(range(words), rnd.randint(3, 9)):
            copy[k] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(copy), "en", "s"))
    return rows


def test_minhash_tests_all_that_share_a_band(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2000)
    monkeypatch.setattr(minhash, "PART", 7)
    bands, percent = 3, 80
    rows = loose_copies(1)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), width=1, percent=percent, bands=bands, band_bins=1).collect()}
    sets = {i: shingles(t, 1) for i, t, *_ in rows}
    texts = [t.encode() for _, t, *_ in rows]
    hashed = minhash.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 1)
    low = minhash.signatures(hashed, bands).astype("<u2")
    linked = [(a, b) for a in sets for b in sets if a < b and (low[a] == low[b]).any() and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert got == classes(sets, linked)


def test_minhash_odd_bits_bound_the_difference():
    rng = np.random.RandomState(3)
    for n, m in ((5, 6), (90, 80), (900, 1500)):
        a = np.unique(rng.randint(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.randint(0, 2**63, m - n // 2).astype(np.uint64)]))
        differ = int(np.bitwise_count(minhash.odd_bits(a, 1024) ^ minhash.odd_bits(b, 1024)).sum())
        real = len(np.setxor1d(a, b))
        assert differ <= real
        assert (real - differ) % 2 == 0


@pytest.mark.parametrize("seed", range(4))
def test_minhash_new_links_connect_what_any_link_connects(seed):
    rng = np.random.RandomState(seed)
    base = rng.randint(0, 2**62, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        own = base[rng.random(60) < rng.choice([0.85, 0.95, 1])]
        sets.append(np.unique(np.concatenate([own, rng.randint(0, 2**62, rng.randint(0, 8)).astype(np.uint64)])))
    component = rng.randint(0, 40, 80).astype(np.int64)
    for side in (np.full(80, 2), rng.randint(0, 2, 80)):
        meets = [(i, j) for i in range(80) for j in range(i) if side[i] == 2 or side[i] != side[j]]
        linked = [(int(component[i]), int(component[j])) for i, j in meets if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        names = sorted(set(component.tolist()))
        assert classes(names, minhash.new_links(component, side, sets, 80)) == classes(names, linked)


def test_minhash_variants_of_an_absent_source(spark):
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        copy = list(base)
        for k in rnd.sample(range(150), rnd.randint(1, 6)):
            copy[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy), "en", "s"))
    sets = {i: shingles(t, 3) for i, t, *_ in rows}
    linked = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), width=3, percent=85).collect()}
    assert got == classes(sets, linked)


def test_minhash_odd(spark):
    rows = minhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_shingles"], by[2]["n_shingles"], by[3]["n_shingles"]) == (0, 0, 0)
    assert by[1]["kept"] and by[2]["kept"]
    assert by[5]["component_id"] == 4
    assert by[None]["component_id"] is None
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_densified_signatures():
    rng = np.random.RandomState(1)
    sets = [np.zeros(0, np.uint64), np.array([7], np.uint64), np.unique(rng.randint(0, 2**63, 500).astype(np.uint64) * np.uint64(2))]
    sig = minhash.signatures(sets, 125)
    assert (sig[0] == 0).all()
    assert (sig[1] == 7).all()
    assert set(sig[2].tolist()) <= set(sets[2].tolist())


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == classes({x for e in real for x in e}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors


def test_vectors_brute_force(spark):
    rng = np.random.RandomState(3)
    x = rng.standard_normal((600, 16))
    for i in range(0, 600, 5):
        x[i] = x[(i + 7) % 600] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])
    x[10] = x[11]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.array([r for _, r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = {(int(a), int(b)) for a, b in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if a != b}
    n = Counter(a for a, _ in linked)
    found = sum(r["n_links"] for r in got.values())
    assert found <= len(linked)
    assert found >= 0.9 * len(linked)
    assert all(r["n_links"] <= n[i] for i, r in got.items())


def test_vectors_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SAMPLE", 500)
    monkeypatch.setattr(vector_dedup, "BLOCK", 100)
    rng = np.random.RandomState(11)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 1200, 2):
        side = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        c = rng.uniform(0.9005, 0.96)
        x[i + 1] = c * x[i] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x[2000:2400] = x[2000] + 0.04 * rng.standard_normal((400, 24))
    x = x.astype(np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    got = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= want[i] for i in found)
    alone = [i for i in range(3000) if not 2000 <= i < 2400]
    assert sum(found[i] for i in alone) >= 0.98 * want[alone].sum()
    assert sum(found.values()) >= 0.99 * want.sum()
    assert {r["component_id"] for r in got if 2000 <= r["vec_id"] < 2400} == {2000}


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit(1), "node": F.lit(2), "label": F.lit(None).cast("int")})
    out = vector_dedup.near_duplicate_vectors(df).collect()
    assert len(out) == len(rows)
    by = {r["vec_id"]: r for r in out}
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 9))
    assert by[8]["component_id"] == 7
    assert not by[8]["kept"]
    assert by[None]["component_id"] is None
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


# decontamination


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(s):
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def test_leaks_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(40, 150)))) for i in range(12)]
    rows, planted = [], []
    for d in range(80):
        i, item = rnd.choice(items)
        s = list(plain(item))
        for _ in range(int(rnd.random() * 0.14 * len(s))):
            at = rnd.randrange(len(s))
            if rnd.random() < 0.5:
                s[at] = rnd.choice("abcxyz")
            else:
                del s[at]
        rows.append((d, "Intro: " + "qq zz " * rnd.randint(0, 9) + "".join(s).upper() + "... the end", "en", "s"))
        planted.append((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"]: x["edits"] for x in r["leaks"]} for r in decontamination.find_leaks(docs(spark, rows), bench).collect()}
    by = dict(items)
    for d, i in planted:
        p, t = plain(by[i]), plain(rows[d][1])
        most = min(int(len(p) * decontamination.ERROR_RATE), (len(p) - decontamination.Q) // decontamination.Q)
        e = edit_distance(p, t)
        assert (i in got[d]) == (e <= most)
        if e <= most:
            assert got[d][i] == e


def test_leaks_in_blocks_and_spans(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 60)
    items = [(i, f"benchmark question number {i} about planet {chr(97 + i) * 6} and its moons") for i in range(6)]
    text = "Before. " + items[2][1].upper() + " After; " + items[4][1]
    out = decontamination.find_leaks(docs(spark, [(1, text, "en", "s"), (2, "nothing at all", "en", "s")]), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert {2, 4} <= {x["item_id"] for x in out[0]["leaks"]}
    exact = [x for x in out[0]["leaks"] if x["item_id"] == 2][0]
    assert text[exact["start"] : exact["end"]] == items[2][1].upper()
    assert out[1]["leaks"] == []


def test_leaks_stay_within_a_document(spark):
    """An item split over neighbouring texts is no leak, and order and partitions change nothing."""
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60)]
    items = [(i, " ".join(rnd.sample(words, 12))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for k, (_, t) in enumerate(items):
        half = len(t) // 2
        rows += [(10 * k, " ".join(rnd.sample(words, 5)) + " " + t[:half], "en", "s"), (10 * k + 1, t[half:] + " " + " ".join(rnd.sample(words, 5)), "en", "s"), (10 * k + 2, "x " + t, "en", "s")]
    want = {(10 * k + 2, k) for k in range(4)}
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        for parts in (1, 5):
            got = decontamination.leak_table(docs(spark, order).coalesce(1).repartition(parts) if parts > 1 else docs(spark, order).coalesce(1), bench).collect()
            assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_leak_table_brute_force(spark):
    rnd = random.Random(15)
    items = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(30, 60)))) for i in range(6)] + [(6, "2 + 2 = 4"), (7, "?!")]
    rows = [(i, "z" * rnd.randint(0, 30) + plain(items[i % 6][1])[rnd.randint(0, 3) :] + "y" * rnd.randint(0, 30), "en", "s") for i in range(30)] + [(90, "2+2=4!", None, None), (91, "so 2 + 2 = 4 then", None, None), (92, "?!", None, None)]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leak_table(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t, *_ in rows:
        for i, item in items:
            p = plain(item)
            if len(p) >= decontamination.Q:
                e = edit_distance(p, plain(t))
                if e <= min(int(len(p) * decontamination.ERROR_RATE), (len(p) - decontamination.Q) // decontamination.Q):
                    want[d, i] = e
            elif p and p == plain(t):
                want[d, i] = 0
    assert got == want
    assert (90, 6) in got


def test_leaks_odd(spark):
    bench = spark.createDataFrame([(1, None), (None, "a text of some length"), (3, "short"), (4, "same id twice and more words"), (4, "same id twice and more words"), (5, "long long long long")], "item_id long, text string")
    found = {(r["doc_id"], x["item_id"]) for r in decontamination.find_leaks(odd(spark), bench).collect() for x in r["leaks"]}
    assert found == {(8, 5)}
    kept = decontamination.decontaminate(odd(spark), bench)
    assert kept.columns == odd(spark).columns
    assert {r["leaks"] for r in kept.select("leaks").distinct().collect()} == {"mine"}
    assert kept.count() == len(ODD) - 1
    assert decontamination.leak_table(docs(spark, []), bench).count() == 0
    assert decontamination.find_leaks(docs(spark, ODD), bench.limit(0)).count() == len(ODD)


# lines


def kept_lines(rows, percent=80):
    sets, seen = [], []
    out = defaultdict(list)
    for d, text in rows:
        for line in (text or "").split("\n"):
            s = frozenset(re.findall(r"[^ \t\x0b\x0c\r]+", line.lower()))
            bad = bool(s) and any(100 * len(s & x) >= percent * len(s | x) for x in seen)
            seen.append(s) if s else None
            sets.append(s)
            if not bad:
                out[d].append(line)
    return {d: "\n".join(out[d]) for d, _ in rows}


def test_lines_brute_force(spark):
    rnd = random.Random(6)
    words = [f"t{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 14))] for _ in range(40)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            line = list(rnd.choice(base))
            if rnd.random() < 0.6:
                line[rnd.randrange(len(line))] = rnd.choice(words)
            lines.append(" ".join(line) if rnd.random() < 0.9 else "")
        rows.append((d, "\n".join(lines), "en", "s"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == kept_lines([(d, t) for d, t, *_ in rows])


def test_lines_odd(spark):
    out = line_dedup.dedup_lines(odd(spark).withColumn("doc", F.lit("mine"))).collect()
    assert {r["doc"] for r in out} == {"mine"}
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert (by[1]["text"], by[1]["n_lines"]) == (None, 0)
    assert by[2]["text"] == ""
    assert by[5]["text"] == ""
    assert line_dedup.line_table(docs(spark, [])).count() == 0


def test_lines_long_lists_and_many_words(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_LIST", 3)
    rnd = random.Random(8)
    base = [[f"r{i}x{j}" for j in range(n)] for i, n in enumerate([20, 130])]
    rows = [(d, " ".join([*rnd.sample(b, len(b) - rnd.randrange(len(b) // 5)), f"own{d}"]), "en", "s") for d, b in enumerate(base * 6)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == kept_lines([(d, t) for d, t, *_ in rows])


def test_lines_kept_texts_are_not_shuffled(spark):
    out = line_dedup.dedup_lines(docs(spark, [(1, "a b c", "en", "s"), (2, "a b c\nd e", "en", "s"), (3, "f g", "en", "s")]))
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: (r["text"], r["removed"]) for r in out.collect()} == {1: ("a b c", []), 2: ("d e", [0]), 3: ("f g", [])}


# language


TRAIN = {"en": "the thing that was on the table and the thinking of others", "fr": "être là où les éléments de la théorie sont présents dans une forêt", "el": "το πράγμα που ήταν στο τραπέζι και η σκέψη των άλλων"}


def labelled(spark, n=60):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        lang = ["en", "fr", "el"][i % 3]
        words = TRAIN[lang].split()
        rows.append((i, " ".join(rnd.choice(words) for _ in range(30)), lang, "s"))
    return docs(spark, rows)


def test_language_held_out(spark):
    df = labelled(spark)
    rows = language.language_table(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["held_out"] for r in rows) > 5
    assert all(r["lang_pred"] == r["lang"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_spans(spark):
    model = language.learn(labelled(spark))
    text = "the thing that was on the table, " + "être là où les éléments de la théorie; " + "το πράγμα που ήταν"
    r = language.identify_languages(docs(spark, [(1, text, None, None)]), model).first()
    assert [s["lang"] for s in r["spans"]] == ["en", "fr", "el"]
    assert text[r["spans"][2]["start"] : r["spans"][2]["end"]] == "το πράγμα που ήταν"


def test_viterbi_brute_force():
    import itertools

    rng = np.random.RandomState(8)
    first, count = np.array([0, 4, 4, 9]), np.array([4, 0, 5, 1])
    scores = rng.standard_normal((10, 3)) * 3
    got = language._viterbi(scores, first, count, 1.5)
    for a, n in zip(first, count, strict=True):
        value = lambda path: sum(scores[a + i, k] for i, k in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))  # noqa: B023, E731
        best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(value(got[a : a + n].tolist()) - best) < 1e-9


def test_language_stage_keeps_mixed_texts(spark):
    import corpus_pipeline

    df = labelled(spark)
    parts = {x: " ".join(r["text"] for r in df.where(F.col("lang") == x).orderBy("doc_id").limit(3).collect()) for x in ("en", "fr", "el")}
    mixed = docs(spark, [(1000, " ".join(parts.values()), None, "s"), (1001, "12345 !!", None, "s"), (1002, "\u0e01\u0e02\u0e04 " * 99 + "a", None, "s")])
    kept = corpus_pipeline.language_stage(spark, df.unionByName(mixed), "")
    assert [r["doc_id"] for r in kept.where("doc_id >= 1000").collect()] == [1000]
    assert kept.count() == 61


def test_language_takes_any_number_of_labels(spark):
    rows = [(3 * i, f"{'abcdefghij'[i % 10] * 6} {'klmnopqrst'[i // 10] * 6}", f"l{i:02}", "s") for i in range(70)]
    df = docs(spark, rows)
    model = language.LanguageModel(language.language_counts(df, "text", "lang"))
    assert len(model.languages) == 70
    found = language.identify_languages(df, model).select("lang", "lang_pred").collect()
    assert len(found) == 70
    assert {r["lang_pred"] for r in found} <= set(model.languages)


def test_words_start_with_letters(monkeypatch):
    text = "\u0301\u0308 a\u0301b, \u0301c d\u0301"
    for piece in (1 << 20, 2):
        monkeypatch.setattr(language, "PIECE_CHARS", piece)
        w = language.Words(["", text, "xy"])
        assert [(int(r), int(o), int(n)) for r, o, n in zip(w.rows, w.origin, w.sizes, strict=True)] == [(1, 3, 3), (1, 9, 1), (1, 11, 2), (2, 0, 2)]
        grams = w.grams.tolist() if piece > 2 else None
        if grams:
            whole = grams
    assert w.grams.tolist() == whole


def test_language_needs_letters(spark):
    rows = language.identify_languages(docs(spark, [(1, "\u0301\u0308", None, None), (2, "12 \u0301", None, None)]), language.learn(labelled(spark))).collect()
    assert [(r["lang_pred"], r["score"], r["spans"]) for r in rows] == [("und", 0.0, [])] * 2


def test_language_odd(spark):
    rows = language.identify_languages(odd(spark), language.learn(labelled(spark))).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert by[9]["lang_pred"] in ("en", "fr", "el")
    nothing = language.learn(docs(spark, []))
    assert {r["lang_pred"] for r in language.identify_languages(odd(spark), nothing).collect()} == {"und"}
    assert language.language_table(docs(spark, [])).count() == 0


# language model


def test_base_scores_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "A", "cat", "Dog", f"rare{rnd.randrange(50)}"]) for _ in range(rnd.randint(0, 30))), "en", "s") for i in range(60)] + [(60, None, "en", "s"), (61, "é É ß", "en", "s")]
    out = {r["doc_id"]: r for r in language_model.score_table(docs(spark, rows)).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t, *_ in rows}
    counts = Counter(t for i, ts in tokens.items() if not out[i]["held_out"] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert abs(out[i]["base_score"] - base) < 1e-6
        assert out[i]["score"] < 0


@pytest.mark.parametrize("clustered", [1 << 14, 3])
def test_model_is_a_distribution(spark, monkeypatch, clustered):
    rows = [(i, "a b c d e f g"[: 2 * (i % 7) + 1], "en", "s") for i in range(50)]
    monkeypatch.setattr(language_model, "CLUSTERED", clustered)
    model, _ = language_model.train(docs(spark, rows).where(~language_model.held_out("doc_id")))
    assert np.allclose((10**model.transition).sum(1), 1)
    head = model.head
    for k in set(model.kinds.tolist()):
        mine = model.kinds == k
        total = ((head.counts[mine] + language_model.DELTA) / model.emission[k]).sum() + language_model.DELTA / model.emission[k]
        assert abs(total - 1) < 1e-9


def test_classes_beat_single_words(spark):
    rnd = random.Random(10)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(left if (j + i) % 2 else right) for j in range(40)), "en", "s") for i in range(300)]
    out = language_model.score_table(docs(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def sentences(n=120, seed=13):
    rnd = random.Random(seed)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    return [(i, " ".join(rnd.choice(left if (j + i) % 2 else right) for j in range(rnd.randint(1, 30))), "en", "s") for i in range(n)]


def test_scores_do_not_depend_on_partitions(spark):
    found = []
    for parts, shuffled in ((1, 4), (7, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        found.append({r["doc_id"]: round(r["score"], 6) for r in language_model.score_table(docs(spark, sentences()).repartition(parts)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]


def test_sweeps_raise_the_likelihood(spark):
    df = docs(spark, sentences())
    head = language_model._head(language_model.word_counts(df, "text"))
    units = language_model._neighbours(language_model.unit_bigrams(df, "text", spark.sparkContext.broadcast(head)), head.size)
    classes = np.full(head.size, -1, np.int32)
    classes[head.end] = 0
    table = language_model._class_bigrams(units, classes)
    classes, table = language_model.exchange(units, classes, table)
    found = [language_model.likelihood(table)]
    for _ in range(3):
        classes, table = language_model.exchange(units, classes, table)
        found.append(language_model.likelihood(table))
    assert found == sorted(found)
    assert found[-1] > found[0]


@pytest.mark.parametrize("clustered, most", [(1 << 14, 1 << 17), (8, 25), (0, 0)])
def test_scores_brute_force(spark, monkeypatch, clustered, most):
    rows = [*sentences(60), (900, None, None, None), (901, "l1 never seen seen r2 never", None, None)]
    monkeypatch.setattr(language_model, "CLUSTERED", clustered)
    monkeypatch.setattr(language_model, "HEAD", most)
    model, others = language_model.train(docs(spark, rows[:50]))
    kind_of = {r["word"]: r["kind"] for r in others.collect()}
    head, k = model.head, language_model.CLASSES

    def parts(text):
        data = (text or "").encode()
        found = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
        if not found:
            return [], [model.classes[head.end]], [model.classes[head.end]]
        raw, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
        starts, ends, _, hashes = language_model.words(raw, offsets)
        _, units, _ = head.look(hashes, language_model._signatures(raw, starts, ends))
        as_before = model.classes[units].tolist()
        own = [kind_of.get(int(h), c) for h, c in zip(hashes.view(np.int64), as_before, strict=True)]
        return found, [*own, model.classes[head.end]], [*as_before, model.classes[head.end]]

    table, seen, kinds = np.zeros((k, k)), Counter(), {}
    for _, t, *_ in rows[:50]:
        found, own, as_before = parts(t)
        seen.update([*found, None])
        kinds.update(zip([*found, None], own, strict=True))
        for a, b in zip([model.classes[head.end], *as_before], own, strict=False):
            table[a, b] += 1
    share = (table.sum(0) + 1) / (table.sum() + k)
    n_kinds = Counter(c for w, c in kinds.items() if w is not None)
    got = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs(spark, rows), model, others).collect()}
    for i, t, *_ in rows:
        found, own, as_before = parts(t)
        want, before = 0.0, model.classes[head.end]
        for w, c, after in zip([*found, None], own, as_before, strict=True):
            want += math.log10((table[before, c] + language_model.ALPHA * share[c]) / (table[before].sum() + language_model.ALPHA))
            want += math.log10((seen[w] + language_model.DELTA) / (table[:, c].sum() + language_model.DELTA * (n_kinds[c] + 1)))
            before = after
        assert abs(got[i] - want) < 1e-6


def test_rare_words_get_the_likeliest_class():
    rng = np.random.RandomState(4)
    k = language_model.CLASSES
    lefts = rng.randint(0, 5, (30, k)) * (rng.rand(30, k) < 0.1)
    lefts[:, 5] += 1
    old = rng.randint(1, k, 30)
    table = rng.randint(0, 50, (k, k)).astype(float)
    for row, c in zip(lefts, old, strict=True):
        table[:, c] += row
    word, before = np.nonzero(lefts)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    gains = language_model._gains(before, lefts[word, before].astype(float), first, old, table)
    for i, row in enumerate(lefts):
        bare = table.copy()
        bare[:, old[i]] -= row
        want = []
        for c in range(1, k):
            with_it = bare.copy()
            with_it[:, c] += row
            want.append(language_model.likelihood(with_it))
        assert np.allclose(np.array(want) - want[0], gains[i, 1:] - gains[i, 1])


def test_language_model_odd(spark):
    assert language_model.score_table(odd(spark)).count() == len(ODD)
    assert language_model.score_table(docs(spark, [])).count() == 0


# pages


@pytest.mark.parametrize(("page", "text"), [
    ("<p>Hello <b>wor</b>ld<p>Next &amp; more", "Hello world\n\nNext & more"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>", "- one\n- two\n\n  3. x\n  4. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>10<tr><td>Banana pie<td>2</table>", "Name        Qty\nApple       10\nBanana pie  2"),
    ("<table><td>a<td colspan=2>b<tr><td>c<td>d<td>e</table>", "a  b\nc  d  e"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("<div style='display:none'>no</div><p hidden>no</p><script>if (a < b) {}</script>yes", "yes"),
    ("<title>no</title><textarea>a <b>\nb</textarea>", "a <b>\nb"),
    ("x<!-- <p>no --> y", "x y"),
    ("<blockquote>q1<p>q2</blockquote>z", "  q1\n\n  q2\n\nz"),
    ('<p title="the hidden cost">Price list</p><div data-style="display:none">seen</div>', "Price list\n\nseen"),
    ('<span aria-hidden="true">a</span> <div style="visibility:hidden">b<i style="visibility: visible">c</i></div>', "a\nc"),
    ("<p>x <math><mi>y</mi><mo>=</mo></math> <svg><title>t</title><text>label</text></svg>", "x y= label"),
    ("<select><option>one<option selected>two</select>", "one\ntwo"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>a<td rowspan=0>b<tr><td>c<td>d</table>", "a  b\nc     d"),
    ("<table><tr><td colspan=2>a wide head<td>x<tr><td>b<td>c<td>d</table>", "a wide head  x\nb  c         d"),
    ("<table><tr><td>" + "w" * 500 + "<td>x<tr><td>short<td>y</table>", "w" * 500 + "  x\n" + "short".ljust(122) + "y"),
    ("<table><tr><td>n<td><p>one<p>two<tr><td>a<td>b</table>", "n\none\n\ntwo\na  b"),
    ("<input type=hidden value=v>in<dialog>no</dialog><dialog open>yes</dialog>", "in\nyes"),
    ("", ""), ("   ", ""), ("a < b && c", "a < b && c"), ("<p>unclosed <b>bold", "unclosed bold"), ("</p></div>x", "x"), ("<img alt='cat &amp; dog'>", "cat & dog"),
])
def test_page_text(page, text):
    assert html_text.page_text(page) == text


def test_pages_keep_all_text():
    rnd = random.Random(11)
    tags = ["p", "div", "ul", "li", "table", "tr", "td", "b", "i", "h1", "blockquote", "span", "ol", "dl", "dt", "dd", "pre"]
    for _ in range(300):
        words, page = [], ""
        for k in range(rnd.randint(1, 30)):
            t = rnd.choice(tags)
            page += rnd.choice([f"<{t}>", f"</{t}>", f"<{t}>", ""])
            word = f"w{k}x"
            words.append(word)
            page += word + rnd.choice(["", " ", "\n"])
        found = re.findall(r"w\d+x", html_text.page_text(page))
        assert sorted(found) == sorted(words)


@pytest.mark.parametrize("seed", range(30))
def test_table_cells_stand_where_a_plain_grid_has_them(seed):
    rnd = random.Random(seed)
    spans = [[(rnd.choice([1, 1, 1, 2, 3]), rnd.choice([1, 1, 1, 2, 4])) for _ in range(rnd.randint(1, 5))] for _ in range(rnd.randint(2, 6))]
    grid, cells = {}, []
    page = "<table>"
    for i, r in enumerate(spans):
        page += "<tr>"
        j = 0
        for wide, high in r:
            while (i, j) in grid:
                j += 1
            name = f"c{len(cells)}" + "x" * rnd.randint(0, 4)
            page += f"<td colspan={wide} rowspan={high}>{name}"
            cells.append((i, j, name))
            for a in range(i, min(len(spans), i + high)):
                for b in range(j, j + wide):
                    grid.setdefault((a, b), name)
    lines = html_text.page_text(page + "</table>").split("\n")
    starts = defaultdict(set)
    for i, j, name in cells:
        starts[j].add(lines[i].index(name))
    assert all(len(x) == 1 for x in starts.values())
    order = [min(starts[j]) for j in sorted(starts)]
    assert order == sorted(order)


def test_pages_odd(spark):
    deep = "<ul><li>" * 3000 + "bottom"
    rows = [(1, "u", None), (2, None, ""), (3, "u", deep), (4, "u", "<div>" * 50_000 + "x"), (5, "u", "<a " * 2000), (5, "u", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    out = {r["page_id"]: r for r in html_text.text_table(df).collect()}
    assert out[1]["text"] is None
    assert (out[2]["text"], out[2]["n_lines"]) == ("", 0)
    assert out[3]["text"] == "- " * 3000 + "bottom"
    assert out[4]["text"] == "x"
    assert html_text.text_table(df.limit(0)).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    bench = [(1, "what is the capital of the country with the longest coast line of all")]
    clean = [(i, " ".join(rnd.choice(TRAIN["en"].split()) for _ in range(60)), "en", f"s{i % 3}") for i in range(60)]
    rows = [*clean, (100, clean[0][1], "en", "s0"), (101, "Note: " + bench[0][1].upper() + "?", "en", "s1"), (102, "12345 !!", "en", "s1"), (103, None, None, None)]
    folder = str(tmp_path)
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = now.columns
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r["doc_id"] for r in now.select("doc_id").distinct().collect()}
        assert set(columns) <= set(now.columns)
    everything = {r[0] for r in rows}
    assert everything - kept["language"] == {102, 103}
    assert kept["language"] - kept["near_duplicates"] == {100}
    assert kept["near_duplicates"] - kept["decontamination"] == {101}
    assert kept["mixing"] == kept["sharding"]
    assert {"shard", "slot"} <= set(now.columns)
    run = corpus_pipeline.run(spark, folder)
    assert run.count() == now.count()


def test_pipeline_stages_odd(spark, tmp_path):
    """Clashing columns keep their values, repeated rows stay together, empty tables stay empty."""
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(1, "what is the capital of the country with the longest coast line")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df = clashing(labelled(spark, 30).withColumn("doc_id", F.col("doc_id") + 100).unionByName(docs(spark, ODD))).withColumns({c: F.lit("mine") for c in ("spans", "known", "n_copies", "shuffle_key", "whole_row")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, folder)
        assert out.columns == df.columns
        rows = out.collect()
        assert all(r[c] == "mine" for r in rows for c in ("score", "rate", "copy", "leaks", "spans", "known", "whole_row", "n"))
        if k == 1:
            assert len([r for r in rows if r["doc_id"] == 9]) == 3
            assert {1, 2, 3, 4, None} <= {r["doc_id"] for r in rows}
            assert 5 not in {r["doc_id"] for r in rows}
        assert stage(spark, df.limit(0), folder).count() == 0


def test_without_shuffles_only_what_may_be_in(spark):
    from wayfind.llm import support

    df = spark.createDataFrame([(i if i % 7 else None, "x") for i in range(500)], "id long, t string")
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(None,)], "k long")
    left = [r["id"] for r in support.without(df, "id", gone).collect()]
    assert sorted(x for x in left if x is not None) == [i for i in range(500) if i % 7 and i % 3]
    assert left.count(None) == len(range(0, 500, 7))
    assert {r["id"] for r in support.maybe_in(df, "id", gone).collect()} >= {i for i in range(0, 500, 3) if i % 7}
