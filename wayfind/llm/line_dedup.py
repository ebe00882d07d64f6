"""Near-duplicate lines across all documents: an exact set-similarity join in DataFrame expressions only.

A line is the set of its lower-cased words. Words are ordered by rarity: by how often their hash bucket occurs in all
documents, then by hash (any fixed order gives exact results; a rare-first one gives few candidates). Two sets with Jaccard
of at least t share a word among the first n - ceil(t n) + 1 of the larger one and the first n - ceil(2 t n / (1 + t)) + 1 of
the smaller one, so only these are joined, under the positional filter and a filter by parity bits: sets that are near
differ in few bits. Neither filter drops a match, and every candidate is verified on the full sets. A line with an earlier
match goes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.support import SMALL_ROWS, cut, maybe_in, with_maybe
from wayfind.operators.sizes import new_folder

#: Hash buckets of the rarity table: one byte each, held as a literal.
BUCKETS = 1 << 16
#: A word in the prefixes of more lines is met in rounds first, in which all its lines are compared with one of them.
LONG_LIST = 1024
STAR_ROUNDS = 2
#: Sets of more words have 128 parity bits, others 64.
FEW_WORDS = 100
#: Posts to a task of the join, so that one side of them can be hashed in memory.
TASK_POSTS = 1 << 19
#: So many of a line's rarest words tell the first lines that it is compared with.
STAR_WORDS = 2
#: Added to the line numbers of a document without an id, so that these lines come last.
_NO_ID = 1 << 40
_AT = ("doc", "place")


def _lower(text: Column) -> Column:
    """The text in lower case with a blank for each other character between words but the line feed (replace searches much slower than contains)."""
    for c in "\t\x0b\x0c\r":
        text = F.when(F.contains(text, F.lit(c)), F.replace(text, F.lit(c), F.lit(" "))).otherwise(text)
    return F.lower(text)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, place, line) of each line; doc and place tell where it stands, and are never null."""
    lines = docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    place = F.col("place").cast("long") + F.when(F.col("doc").isNull(), F.lit(_NO_ID)).otherwise(F.lit(0))
    return lines.select(F.coalesce("doc", F.lit(0)).alias("doc"), place.alias("place"), "line")


def _at(side: str = "") -> Column:
    """The order of lines: by document, those without an id last, then by place."""
    return F.struct(F.shiftright(f"{side}place", 40), f"{side}doc", f"{side}place")


def _bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1))


def rarity_table(docs: DataFrame, text: str = "text") -> bytes:
    """A byte for each bucket: thrice the binary logarithm of how many words of all documents fall into it."""
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).where("line <> ''")
    words = lines.select(F.explode(F.split(_lower(F.col("line")), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_bucket(F.col("w")).cast("int").alias("b")).count()
    level = F.least(F.lit(126), F.floor(3 * F.log2(F.col("count") + 1))).cast("int")
    table = bytearray(BUCKETS)
    for row in counts.select("b", level.alias("v")).collect():  # BUCKETS rows at most
        table[row["b"]] = row["v"]
    return bytes(table)


def _sets(lines: DataFrame, table: bytes) -> DataFrame:
    """(doc, place, id, n, words): the sorted set of word codes (rarity in the high byte), its size and a hash of it."""
    levels = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # becomes a literal

    def code(h: Column) -> Column:
        level = F.coalesce(F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1))), F.lit(0).cast("long"))
        return F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    # a word is hashed once, and only different ones are coded
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(_lower(F.col("line")), " "), lambda word: F.xxhash64(word))), F.xxhash64(F.lit("")))
    codes = F.transform(hashes, code)
    # an explode of one row: what follows refers to the codes and does not make them again
    coded = lines.where("line <> ''").select(*_AT, F.explode(F.array(F.sort_array(codes))).alias("words"))
    return coded.withColumn("n", F.size("words")).where("n > 0").withColumn("id", F.xxhash64("words"))


def _parity(keep: Column | None = None) -> Column:
    """64 bits, each the parity of how many codes point to it; of the codes with bit 6 as in `keep` where that is given."""

    def bit(c: Column) -> Column:
        one = F.lit(1).cast("long") if keep is None else F.shiftright(c, 6).bitwiseXOR(keep).bitwiseAND(F.lit(1))
        return F.call_function("shiftleft", one, c.bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate("words", F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def _described(sets: DataFrame, percent: int) -> DataFrame:
    """Instead of the codes their prefix, in 31 bits each (two words that agree in them only give more candidates), and parity bits. Codes of
    words that may have a long list are negative."""
    # the level in the table of a bucket that has as many words as a long list
    long = min(126, math.floor(3 * math.log2(LONG_LIST + 2) - 1e-9)) << 56

    def short(c: Column) -> Column:
        bits = c.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        return F.when(c < long, bits).otherwise(F.bitwise_not(bits))

    few, prefix = F.col("n") <= FEW_WORDS, F.slice("words", F.lit(1), F.col("n") - F.ceil(percent * F.col("n") / 100).cast("int") + 1)
    first = F.when(few, _parity()).otherwise(_parity(F.lit(1)))
    second = F.when(few, F.lit(0)).otherwise(_parity(F.lit(0)))
    return sets.select(*_AT, "id", "n", first.alias("b1"), second.alias("b2"), F.transform(prefix, short).alias("prefix"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as written to the shared folder in columns, which takes less of the disk than a checkpoint."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _side(posts: DataFrame, side: str, *more: str) -> DataFrame:
    return posts.select("word", *[F.col(c).alias(f"{side}{c}") for c in (*_AT, "n", "pos", "b1", "b2", *more)])


def _may_match(a: str, b: str, percent: int) -> Column:
    """Positional filter for the first word in common: what follows it must be enough on both sides; then that by bits."""
    n, m, p, q = (F.col(c).cast("long") for c in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    b1, b2 = F.col(f"{a}b1").bitwiseXOR(F.col(f"{b}b1")), F.col(f"{a}b2").bitwiseXOR(F.col(f"{b}b2"))
    differ = F.when(F.least(n, m) <= FEW_WORDS, F.bit_count(b1.bitwiseXOR(b2))).otherwise(F.bit_count(b1) + F.bit_count(b2))
    return ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _pairs(met: DataFrame, a: str, b: str, a_first: Column) -> DataFrame:
    """(e_doc, e_place, l_doc, l_place) of the earlier and the later line, and how many words have brought them together."""
    early = [F.when(a_first, F.col(f"{a}{c}")).otherwise(F.col(f"{b}{c}")).alias(f"e_{c}") for c in _AT]
    late = [F.when(a_first, F.col(f"{b}{c}")).otherwise(F.col(f"{a}{c}")).alias(f"l_{c}") for c in _AT]
    return met.select(*early, *late).groupBy("e_doc", "e_place", "l_doc", "l_place").agg(F.count(F.lit(1)).alias("shared"))


def _matched(pairs: DataFrame, docs: DataFrame, table: bytes, percent: int) -> DataFrame:
    """(doc, place, id, ok) of the later lines: whether the full sets of one of their pairs meet the threshold."""
    ends = pairs.select(F.explode(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in _AT]) for s in "el"])).alias("at")).select("at.*").distinct()
    ends = cut(ends)
    # of the documents only lines that may be wanted are coded; where rows share an id, several sets may stand at one place
    lines = _lines(maybe_in(docs.withColumn("known", F.coalesce("doc", F.lit(0))), "known", ends.select("doc")).select("doc", "text"))
    lines = with_maybe(lines.withColumn("key", F.xxhash64(*_AT)), "key", ends.select(F.xxhash64(*_AT).alias("key")), "wanted").where("wanted")
    sets = _sets(lines, table).select(*_AT, "id", "words").repartition(*_AT).dropDuplicates([*_AT, "id"])
    early = sets.select(F.col("doc").alias("e_doc"), F.col("place").alias("e_place"), F.col("words").alias("we"))
    late = sets.select(F.col("doc").alias("l_doc"), F.col("place").alias("l_place"), "id", F.col("words").alias("wl"))
    both = pairs.join(early, ["e_doc", "e_place"]).join(late, ["l_doc", "l_place"]).withColumn("common", F.size(F.array_intersect("we", "wl")))
    ok = 100 * F.col("common") >= percent * (F.size("we") + F.size("wl") - F.col("common"))
    return cut(both.groupBy(F.col("l_doc").alias("doc"), F.col("l_place").alias("place"), "id").agg(F.max(ok).alias("ok")))


def _settled(found: DataFrame) -> DataFrame:
    """Places whose sets have all got a match."""
    return found.groupBy(*_AT, "id").agg(F.max("ok").alias("ok")).groupBy(*_AT).agg(F.min("ok").alias("ok")).where("ok").select(*_AT)


def _best(pairs: DataFrame) -> DataFrame:
    """Of each later line the pair that shares most."""
    best = pairs.groupBy("l_doc", "l_place").agg(F.max(F.struct("shared", "e_doc", "e_place")).alias("e"))
    return best.select("e.e_doc", "e.e_place", "l_doc", "l_place")


def _verified(pairs: DataFrame, docs: DataFrame, table: bytes, percent: int) -> DataFrame:
    """As _matched, but a later line is compared with the one that shares most first, and with the others only if it does not match that one."""
    best = _best(pairs)
    found = _matched(best, docs, table, percent)
    done = _settled(found).select(F.col("doc").alias("l_doc"), F.col("place").alias("l_place"))
    others = pairs.join(done, ["l_doc", "l_place"], "left_anti").join(best, ["e_doc", "e_place", "l_doc", "l_place"], "left_anti")
    return found.unionByName(_matched(cut(others), docs, table, percent))


def _stars(posts: DataFrame, percent: int) -> DataFrame:
    """The pairs of each line with the first one of each of its words' lists."""
    first = posts.groupBy("word").agg(F.min(F.struct(_at().alias("at"), *_AT, "n", "pos", "b1", "b2")).alias("c"), F.count(F.lit(1)).alias("m"))
    first = _side(first.where("m > 1").select("word", "c.*"), "a_")
    met = _side(posts, "b_").join(first, "word").where((_at("a_") < _at("b_")) & _may_match("a_", "b_", percent))
    return _pairs(met, "a_", "b_", F.lit(True))


def _with_open(groups: DataFrame, settled: DataFrame) -> DataFrame:
    """Adds `open`: whether the line is not among `settled`. Only lines that may be among them are shuffled."""
    settled = settled.withColumn("done", F.lit(True))
    flagged = with_maybe(groups.withColumn("key", F.xxhash64(*_AT)), "key", settled.select(F.xxhash64(*_AT).alias("key")), "maybe").drop("key")
    unsure = flagged.where("maybe").join(settled, [*_AT], "left").withColumn("open", F.col("done").isNull())
    return flagged.where("not maybe").withColumn("open", F.lit(True)).drop("maybe").unionByName(unsure.drop("maybe", "done"))


def _long_lists(posts: DataFrame, found: DataFrame, docs: DataFrame, table: bytes, percent: int) -> DataFrame:
    """The matches by words in very many prefixes: first with one line of a word's list, then what is still in with all of them."""
    left = cut(posts.join(_settled(found), [*_AT], "left_anti"))
    for _ in range(STAR_ROUNDS):
        now = _verified(cut(_stars(left, percent)), docs, table, percent)
        found, left = found.unionByName(now), cut(left.join(_settled(now), [*_AT], "left_anti"))
    met = _side(left, "b_").join(_side(posts, "a_"), "word").where((_at("a_") < _at("b_")) & _may_match("a_", "b_", percent))
    return found.unionByName(_verified(cut(_pairs(met, "a_", "b_", F.lit(True))), docs, table, percent))


def matched_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(doc, line) of every line with an earlier line whose Jaccard is at least percent / 100.

    Earlier is by id (nulls last), then by place. Equal sets match. Lines without words match nothing. Rows that share an id
    count as one document with all their lines. Runs jobs while it is put together.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    table = rarity_table(docs)
    lines = _stored(_described(_sets(_lines(docs), table), percent), "lines")
    # equal sets: the first line stands for all; sets are told apart by a hash, their size and the parity bits
    same = ["id", "n", "b1", "b2"]
    again = cut(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    flagged = with_maybe(lines, "id", again, "again")
    groups = flagged.where("again").groupBy(*same).agg(F.min(_at()).alias("first"), F.any_value("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies"))
    alone = flagged.where("not again").select(*_AT, *same, "prefix", F.lit(1).cast("long").alias("copies"))
    groups = _stored(groups.select("first.doc", "first.place", *same, "prefix", "copies").unionByName(alone), "sets")

    def posted(rows: DataFrame, *more: str) -> DataFrame:
        posts = rows.select(*_AT, "n", "b1", "b2", *more, F.posexplode("prefix").alias("pos", "word"))
        # nothing is null here; as it is said before the exchange, both sides of the join share one
        return posts.where(" and ".join(f"{c} is not null" for c in posts.columns))

    # most near copies are found by one comparison with the first line that has one of their rarest words, and are late no more
    found = _matched(_best(cut(_stars(posted(groups.withColumn("prefix", F.slice("prefix", 1, STAR_WORDS))), percent))), docs, table, percent)
    opened = _with_open(groups, cut(_settled(found)))
    posts = posted(opened, "open")
    longs = cut(posted(groups).where("word < 0").groupBy("word").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LONG_LIST).select("word"))
    crowded = longs.count()
    if crowded:
        longs = F.broadcast(longs) if crowded <= SMALL_ROWS else longs
        crowd = _stored(posted(groups).join(longs, "word", "left_semi"), "posts")
        posts = posts.join(longs, "word", "left_anti")
    size = groups.agg(F.sum(F.size("prefix"))).first()[0] or 0
    posts = posts.repartition(max(12, -(-size // TASK_POSTS)), "word")
    # the smaller set by its short prefix, the larger one by its long one; of equal sizes the earlier one counts as smaller
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (_at("a_") < _at("b_")))
    # the id is there so that the filter stays behind the exchange, which both sides share; no word has more than LONG_LIST posts here
    short = posts.where(F.when(F.monotonically_increasing_id() >= 0, (100 + percent) * (F.col("n") - F.col("pos")).cast("long") >= 2 * percent * F.col("n")))
    late = F.when(_at("a_") < _at("b_"), F.col("b_open")).otherwise(F.col("a_open"))
    met = _side(short, "a_", "open").join(_side(posts, "b_", "open"), "word").where(smaller & _may_match("a_", "b_", percent) & (_at("a_") != _at("b_")) & late)
    found = found.unionByName(_matched(_stored(_pairs(met, "a_", "b_", _at("a_") < _at("b_")), "pairs"), docs, table, percent))
    if crowded:
        found = _long_lists(crowd, found, docs, table, percent)
    # only lines of sets that occur again or have a match are brought together
    gone = cut(found.where("ok").select(*_AT, "id").distinct()).withColumn("gone", F.lit(True))
    heads = with_maybe(groups.select(*_AT, *same, "copies"), "id", gone.select("id"), "maybe").where("copies > 1 or maybe").drop("maybe")
    heads = heads.join(gone, [*_AT, "id"], "left").where("copies > 1 or gone")
    heads = cut(heads.select(*same, "gone", _at().alias("first")))
    places = maybe_in(lines.select(*_AT, *same), "id", heads.select("id")).join(heads, same).where(F.col("gone").isNotNull() | (_at() != F.col("first")))
    unset = F.col("place") >= _NO_ID
    return places.select(F.when(~unset, F.col("doc")).alias("doc"), F.when(unset, F.col("place") - _NO_ID).otherwise(F.col("place")).cast("int").alias("line")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows with their later matching lines removed from the text; adds n_lines and removed, the numbers of those lines.

    A null text stays null with no lines, an empty one is one line without words. Documents whose lines all go keep an
    empty text. Columns of the input named n_lines or removed are replaced; null ids count as one document. Documents that
    keep all their lines are not shuffled.
    """
    docs = docs.drop("n_lines", "removed")
    marked = cut(matched_lines(docs, id_col, text, percent).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed")))
    flagged = with_maybe(docs, id_col, marked.select("doc"), "__some")
    marked = marked.withColumnRenamed("doc", "__doc")
    joined = flagged.where("__some").join(marked, F.col(id_col).eqNullSafe(marked["__doc"]), "left").drop("__doc", "__some")
    joined = joined.unionByName(flagged.where("not __some").drop("__some"), allowMissingColumns=True)
    # each explode is of one row: what follows refers to the lines and the numbers and does not make them again
    split = joined.select("*", F.explode(F.array(F.split(text, "\n"))).alias("__lines"))
    numbers = F.filter(F.coalesce("removed", F.array().cast("array<int>")), lambda i: i < F.size("__lines"))
    split = split.select("*", F.explode(F.array(numbers)).alias("__removed"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__removed"), lambda i: F.get("__lines", i))
    removed = F.when(F.col(text).isNull(), F.array().cast("array<int>")).otherwise(F.col("__removed"))
    out = split.withColumns({"n_lines": F.coalesce(F.greatest(F.size("__lines"), F.lit(0)), F.lit(0)), "removed": removed, text: F.when(F.col(text).isNotNull(), F.array_join(kept, "\n"))})
    return out.select(*docs.columns, "n_lines", "removed")


def line_table(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many went and which, and the text that is left."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", "text")
