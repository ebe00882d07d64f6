"""Merkle manifests of a table: a tree for each group, a tree over the groups' roots, and a proof for every row.

Rank digits are grouped away one after the other within blocks of WIDTH leaves, each time nesting runs of child structs; a
block's root is a leaf of the tier above. On the way down a block meets its own path in a grouping by block, and a nested
transform with one explode hands every leaf its siblings, so proofs need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.support import SMALL_ROWS, cut, packed

RUN = 3
DIGITS = 6
#: Leaves of a block; its nested row holds some 400 bytes for each of them.
WIDTH = RUN**DIGITS
_POWERS = [RUN**k for k in range(40)]


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for a null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds rank (from 0, in the order of the columns, nulls first) and size within each tree, and drops nothing.

    Rows are sorted by ranges, so a tree of any size is spread; a row per tree and range says where its ranks begin. Rows that
    are equal in all columns of the order are dealt out by where they were read.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [tree, *order, "__read"]
    dealt = rows.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    placed = cut(dealt.drop("__read").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    runs = placed.groupBy(F.col(tree).alias("__tree"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    one = Window.partitionBy("__tree")
    ahead = F.coalesce(F.sum("__n").over(one.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs, n = packed(runs.select("__tree", "__part", (ahead - F.col("__first")).alias("__from"), F.sum("__n").over(one).alias("size")))
    runs = F.broadcast(runs) if n <= SMALL_ROWS else runs
    joined = placed.withColumn("__own", part).join(runs, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("__own") == F.col("__part")))
    return joined.withColumn("rank", F.col("__at") + F.col("__from")).drop("__at", "__own", "__tree", "__part", "__from")


def _rolled(nodes: DataFrame) -> DataFrame:
    """(tree, block, levels, size, hash, kids) from (tree, rank, size, hash, item): one nested row for each block of WIDTH nodes.

    levels is the number of levels that the whole tree still has above these nodes; a node that is alone on its level
    isn't hashed again.
    """
    digits = [(F.floor(F.col("rank") / p) % RUN).cast("tinyint").alias(f"d{k}") for k, p in enumerate(_POWERS[:DIGITS])]
    levels = F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < F.col("size")))
    block = F.floor(F.col("rank") / WIDTH).alias("block")
    rows = nodes.select("tree", block, levels.alias("levels"), "size", *digits, "hash", F.col("item").alias("kids")).repartition("tree", "block")
    for k in range(DIGITS):
        run = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "hash", "kids")))
        rows = rows.groupBy("tree", "block", "levels", "size", *[f"d{j}" for j in range(k + 1, DIGITS)]).agg(run.alias("run"))
        rows = rows.withColumn("hashes", F.col("run.hash"))

        def kid(x: Column, i: Column) -> Column:
            before, after = F.slice("hashes", F.lit(1), i), F.slice("hashes", i + 2, F.lit(RUN))
            return F.struct(F.concat_ws("", before).alias("before"), F.concat_ws("", after).alias("after"), x["kids"].alias("kids"))

        top = F.when(F.col("levels") > k, digest(F.concat_ws("", "hashes"))).otherwise(F.col("hashes")[0])
        rows = rows.withColumn("kids", F.transform("run", kid)).withColumn("hash", top).drop("run", "hashes")
    return rows


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The blocks of the nodes, the blocks of these blocks' roots, and so on until every tree is one block."""
    tiers = []
    while True:
        tiers.append(cut(_rolled(nodes)))
        if most <= WIDTH:
            return tiers
        most = -(-most // WIDTH)
        size = F.ceil(F.col("size") / WIDTH)
        nodes = tiers[-1].select("tree", F.col("block").alias("rank"), size.alias("size"), "hash", F.struct("block").alias("item"))


def _with_paths(kids: Column, level: int, above: list[Column]) -> Column:
    """All items under the runs, each with the steps of its path from the lowest level up."""

    def step(x: Column) -> Column:
        return F.struct(x["before"].alias("before"), x["after"].alias("after"))

    if level == 0:
        return F.transform(kids, lambda x: F.struct(x["kids"].alias("item"), F.array(step(x), *above).alias("path")))
    return F.flatten(F.transform(kids, lambda x: _with_paths(x["kids"], level - 1, [step(x), *above])))


def _down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(item, path, and the other columns of paths) from the paths (tree, block, path, ...) of the blocks themselves."""
    more = [c for c in paths.columns if c not in ("tree", "block")]
    both = blocks.select("tree", "block", "levels", "kids").unionByName(paths, allowMissingColumns=True)
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("levels", "kids", *more)])
    spread = met.select("tree", "levels", *[F.col(c).alias(f"__{c}") for c in more], F.explode(_with_paths(F.col("kids"), DIGITS - 1, [])).alias("x"))
    path = F.concat(F.slice("x.path", F.lit(1), F.col("levels")), F.col("__path"))
    return spread.select("tree", "x.item", path.alias("path"), *[F.col(f"__{c}").alias(c) for c in more if c != "path"])


def prove(leaves: DataFrame) -> DataFrame:
    """Adds to (tree, key, leaf, tampered) rows the columns subroot, root and path, an array of (before, after) siblings.

    tree is a text that may be null, leaf a lowercase digest; leaves of a tree stand in the order of key and then of leaf,
    trees bytewise with null first. tampered only travels along. A tree of one leaf has that leaf as its root, and one tree its
    subroot. No rows in, none out.
    """
    # ranges are sampled first, which would make every leaf twice
    nodes = ranked(cut(leaves.select("tree", "key", "leaf", "tampered")), "tree", "key", "leaf")
    nodes = nodes.select("tree", "rank", "size", F.col("leaf").alias("hash"), F.struct("key", "leaf", "tampered").alias("item"))
    most = nodes.agg(F.max("size")).first()[0]
    lower = _tiers(nodes, most or 0)
    tops = lower[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), F.col("hash").alias("subroot"))
    nodes = ranked(tops, "tree", "name").select("tree", "rank", "size", F.col("subroot").alias("hash"), F.struct("name", "subroot").alias("item"))
    most = nodes.agg(F.max("size")).first()[0]
    upper = _tiers(nodes, most or 0)
    steps = "array<struct<before:string,after:string>>"
    paths = upper[-1].select("tree", "block", F.array().cast(steps).alias("path"), F.col("hash").alias("root"))
    for tier in upper[:0:-1]:
        paths = _down(tier, paths).select("tree", "item.block", "path", "root")
    named = _down(upper[0], paths)
    paths = named.select(F.col("item.name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "root", F.col("item.subroot").alias("subroot"))
    for tier in lower[:0:-1]:
        paths = _down(tier, paths).select("tree", "item.block", "path", "root", "subroot")
    return _down(lower[0], paths).select("tree", "item.key", "item.leaf", "item.tampered", "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["before"], h, step["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level and left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


def row_digest(row: dict[str, Column]) -> Column:
    return digest(*[field(value) for value in row.values()])


def manifest_table(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, its source's root, the root of all, and whether a copy of it without line feeds in half of the
    texts (by the CRC-32 of the id) still folds to that root.

    Null values are told from empty ones in a leaf. A null id or a null text is never tampered with. Repeated rows are leaves
    of their own, side by side; rows that share an id stand in the order of their leaves. Only digests are shuffled, so texts may be of
    any length. Other columns of the table are not read. No rows in, none out.
    """
    row = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(odd & F.col("text").contains("\n"), row_digest(row | {"text": F.translate("text", "\n", "")}))
    leaves = docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("key"), row_digest(row).alias("leaf"), other.alias("tampered"))
    proven = prove(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return proven.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
