"""Prefix trie, Merkle manifest and packing against brute force."""

import bisect
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfind.llm import merkle, packing, prefix_trie

ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "  \t\n ", "en", "a"), (4, "word", None, "a"), (5, "word", "en", None), (None, "no id here\nat all", "en", "a"), (7, "é ß 日本語 🙂 Привет\n", "fr", "b"), (8, "long " * 20_000, "en", "b"), (9, "x" * 50_000, "en", "b"), (9, "same id twice\n", "en", "b"), (9, "same id twice\n", "en", "b"), (10, "a<|endoftext|> b  <|endoftext|>", "en", "")]
SCHEMA = "doc_id long, text string, lang string, source string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.when(F.col("text") != "", F.length("text")).cast("long"))
    # extra columns with names that the operators use themselves
    return df.withColumns({c: F.lit("mine") for c in ("tree", "key", "leaf", "rank", "size", "hash", "id", "bin", "piece", "length", "offset", "ids", "n", "block", "kind")})


# prefix trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], (role, text)))
    seq = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    whole = {c: tuple(seq.get(c - int(np.fmod(c, 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + s[h:]) for c, s in seq.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(int)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        if s:
            kids[s[:-1]] += 1
    for s in sorted(members, key=len, reverse=True):
        under = [k for k in members if len(k) == len(s) + 1 and k[: len(s)] == s] if kids[s] else []
        leaves[s] = sum(leaves[k] for k in under) or 1
        saved[s] = sum(saved[k] for k in under) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], digest(ends[s])) for s, m in members.items())


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("mine") for c in ("key", "id", "ids", "points", "base", "head", "n", "depth")})


def table(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: (r[0], r[1]))


def some_conversations(seed, n=260):
    rng, rows = random.Random(seed), []
    for c in [*range(n), -5, 100_000, 4_200_007]:
        turns = [("user", f"t{rng.randint(0, 2)}") if rng.random() < 0.8 else ("assistant", f"é{rng.randint(0, 9)}") for _ in range(rng.randint(1, 9))]
        if c % 3 == 0:
            turns = [("user", "hot"), ("assistant", "same answer"), ("user", "thanks")]
        rows += [(c, t if t else None, *x) for t, x in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("turns", "fan"), [(1 << 17, 256), (40, 3), (1, 2)])
def test_trie_by_brute_force(spark, monkeypatch, turns, fan):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "PART_BITS", 3)
    rows = some_conversations(turns)
    assert table(prefix_trie.trie_table(conversations(spark, rows).repartition(5))) == trie_by_hand(rows)


def test_trie_of_odd_rows(spark):
    long = [(700, t, "user", "again") for t in range(3000)]
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "", ""), (2, 5, "user", "x" * 200_000), (2, 5, "user", "tie"), (None, 1, "user", "nobody"), (3, 1, "user", "x"), (103, 1, "user", "x"), *long]
    assert table(prefix_trie.trie_table(conversations(spark, rows))) == trie_by_hand(rows)
    assert prefix_trie.trie_table(conversations(spark, rows).limit(0)).count() == 0


def test_tree_and_medians():
    rng = random.Random(1)
    paths = sorted({tuple(rng.randint(0, 5) for _ in range(rng.randint(0, 6))) for _ in range(300)})
    assert sorted(prefix_trie._medians(len(paths))) == list(range(len(paths)))
    tree = prefix_trie._Tree()
    for i in prefix_trie._medians(len(paths)):
        tree.row[tree.path(list(paths[i]), list(paths[i]))[-1]] = i
    seen, up = tree.parents()
    assert len(seen) == len({p[:d] for p in paths for d in range(len(p) + 1)})
    assert sum(r >= 0 for r in tree.row) == len(paths)
    place = {v: i for i, v in enumerate(seen)}
    assert all(place[up[v]] < place[v] for v in seen[1:])


def test_joined_paths_are_those_of_one_block():
    """Joining blocks of any sizes leaves the same nodes."""
    rng = random.Random(5)
    seqs = sorted({tuple(rng.randint(0, 2) for _ in range(rng.randint(0, 5))) for _ in range(120)})
    rows = [{"ids": list(s), "points": [3] * len(s), "n": 1 + i % 3, "least": 1000 - i, "ends": f"e{i}"} for i, s in enumerate(seqs)]

    def nodes(cuts):
        done, paths = [], None
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            *inner, outer = prefix_trie._block(rows[a:b], a)
            done += inner
            if paths is None:
                paths = prefix_trie._Paths(outer)
            else:
                done += paths.join(prefix_trie._Paths(outer))
        done += paths.close()
        return sorted((x["conv_id"], x["depth"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"]) for x in done)

    whole = nodes([])
    for _ in range(20):
        assert nodes(sorted(rng.sample(range(1, len(rows)), rng.randint(1, 30)))) == whole


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_by_hand(nodes):
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for leaf, p in enumerate(places):
            paths[leaf].append(("".join(runs[p // 3][: p % 3]), "".join(runs[p // 3][p % 3 + 1 :])))
        places, nodes = [p // 3 for p in places], [H(*r) for r in runs]
    return nodes[0], paths


def manifest_by_hand(rows):
    by = defaultdict(list)
    for r in rows:
        text = r["text"]
        other = text.replace("\n", "") if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 else text
        head = [field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")]
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, H(*head, field(text)), H(*head, field(other)), r["doc_id"]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    lower = [tree_by_hand([x[2] for x in sorted(by[s])]) for s in names]
    root, upper = tree_by_hand([r for r, _ in lower])
    out = []
    for s, (sub, paths), above in zip(names, lower, upper):
        for x, path in zip(sorted(by[s]), paths):
            path, folded = path + above, x[3]
            for a, b in path:
                folded = H(a, folded, b)
            out.append((x[4], x[2], sub, root, H(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=repr)


def manifest(df):
    return sorted((tuple(r) for r in merkle.manifest_table(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_manifest_by_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "WIDTH", 3**digits)
    rows = ODD + [(100 + i, f"text {i}\nline", "en", f"s{(i % 7) ** 2 % 11}") for i in range(60)] + [(200 + i, "hot\n", "en", "é") for i in range(41)]
    df = docs(spark, rows).repartition(3)
    got = manifest(df)
    assert got == manifest_by_hand(df.collect())
    # a proof covers all siblings, so a text that has lost its line feeds doesn't verify
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_one_tree(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "DIGITS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)
    df = docs(spark, [(i, "t", "en", "only") for i in range(n)])
    got = manifest(df)
    assert got == (manifest_by_hand(df.collect()) if n else [])
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H()


# packing


def coded(rows):
    library = Tokenizer.from_file(VOCABULARY)
    return [(i, x.ids + [0]) for i, x in zip([r[0] for r in rows], library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))]


def pieces_by_hand(rows, capacity):
    out = []
    for doc, ids in coded(rows):
        over = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(over, len(ids) + 1, capacity)]
        out += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=repr)


def by_best_fit_decreasing(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        n += at == len(rooms)
        room = (rooms.pop(at) if at < len(rooms) else capacity) - x
        bisect.insort(rooms, room)
    return n


def check(spark, rows, capacity):
    got = packing.packing_table(docs(spark, rows).repartition(3), VOCABULARY, capacity).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == pieces_by_hand(rows, capacity)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in got) // capacity)


def test_packing_odd_texts(spark):
    check(spark, ODD, 2048)
    used, least = check(spark, ODD, 16)
    assert used <= 1.02 * least + 2
    assert packing.packing_table(docs(spark, ODD).limit(0), VOCABULARY, 64).count() == 0


@pytest.mark.parametrize("ranges", [40, 100_000])
def test_packing_is_near_the_least(spark, monkeypatch, ranges):
    monkeypatch.setattr(packing, "_LEAST_ROWS", ranges)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "straße", "do not", "it's", "12"]) for _ in range(int(rng.paretovariate(0.8)) % 90)), "en", "a") for i in range(900)]
    rows += rows[:1] * 300
    used, _ = check(spark, rows, 64)
    assert used <= 1.02 * by_best_fit_decreasing([r[3] for r in pieces_by_hand(rows, 64)], 64) + 2


@pytest.mark.parametrize(("length", "each"), [(700, 2), (683, 2), (682, 3), (1024, 2), (1025, 1), (1, 2048)])
def test_packing_equal_pieces(spark, length, each):
    n = 500
    pieces = spark.range(n).select(F.col("id").alias("key"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    assert packing.pack(pieces).select("sequence_id").distinct().count() == -(-n // each)


def test_codes_are_the_librarys():
    rng, library = random.Random(4), Tokenizer.from_file(VOCABULARY)
    letters = ["a", "b", "Z", "é", "ß", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\u0085", "'s", "'LL", "don't", "1", "²", "中", "🙂", "<|endoftext|>", "<|", "-", "...", "\x00", "x" * 300]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    coder = packing._Coder(VOCABULARY)
    raw = [t.encode() for t in texts]
    ids, begin = coder.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, x in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[begin[k] : begin[k + 1]].tolist() == x.ids + [0], texts[k]


def test_spans_match_the_nearest_range_before():
    assert packing._between([(0, 0, 2), (1, 3, 0), (2, 1, 2), (3, 0, 5)]) == [(0, 1, 0, 2, 0), (1, 2, 0, 2, 0), (0, 2, 0, 1, 2), (1, 3, 0, 1, 2), (0, 1, 2, 3, 3), (1, 3, 1, 2, 3)]
