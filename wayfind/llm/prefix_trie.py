"""Prefix trie of conversations: ternary search trees by range of the sorted turn sequences, joined along their outer paths.

Turns are coded by a dictionary, equal conversations become one row, and the rows are range-sorted by their codes. A task cuts
its range into blocks of bounded size. Each block is a ternary search tree, filled from the median outwards and read by
an iterative traversal. Only nodes on the paths of a block's first and last sequence can go on in a neighbour: these paths are
all that blocks exchange, and are joined in order, FAN blocks to a task, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.support import SMALL_ROWS, cut

#: Turns after which a block ends.
BLOCK_TURNS = 1 << 17
#: Blocks whose outer paths one task joins.
FAN = 256
#: Ids of 2**PART_BITS neighbouring numbers are put together before a group's ids are hashed.
PART_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_STATS = "array<struct<n:long,least:long,kids:long,leaves:long,saved:long,points:long,ends:string>>"
_BOTH = f"{_NODE}, block long, first array<long>, last array<long>, left {_STATS}, right {_STATS}"
_stats = pa.list_(pa.struct([*[(c, pa.int64()) for c in ("n", "least", "kids", "leaves", "saved", "points")], ("ends", pa.string())]))
_arrow = pa.schema(
    [
        *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id")],
        *[(c, pa.binary()) for c in ("parent_key", "key")],
        *[(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        ("ends_sha256", pa.string()),
        ("block", pa.int64()),
        *[(c, pa.list_(pa.int64())) for c in ("first", "last")],
        *[(c, _stats) for c in ("left", "right")],
    ]
)


def encode(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, points): the turns of each conversation in order as dictionary codes, with the code points of their texts.

    Null roles and texts are empty. Turns with a null number come first; those with one number stand by a digest of role and
    text. Rows without a conv_id belong to no conversation. A conversation's codes, 24 bytes a turn, must fit into a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(whole, 1, 32)).alias("key"), F.length(text).cast("long").alias("points"))
    turns = cut(turns)
    # codes ascend with the digests, so neither depends on how the rows were dealt out
    listed = turns.groupBy("key").agg(F.max("points").alias("points")).orderBy("key")
    listed = cut(listed.withColumn("id", F.monotonically_increasing_id()))
    coded = turns.drop("points").join(listed, "key")
    ordered = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "points"))).alias("x"))
    return ordered.select("conv_id", F.col("x.id").alias("ids"), F.col("x.points").alias("points"))


def rebuild(encoded: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % every (all if it has fewer, none if it isn't there), and goes
    on with its own after the first h; h is the CRC-32 of c's digits modulo `most`."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    bases = encoded.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most).alias(f"base_{c}") for c in ("ids", "points")])
    met = encoded.withColumn("head", head).join(bases, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    none = F.array().cast("array<long>")
    return met.select("conv_id", *[F.concat(F.slice(F.coalesce(f"base_{c}", none), F.lit(1), F.col("head")), F.slice(c, F.col("head") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c) for c in ("ids", "points")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per sequence from its rows in the order of their parts, whose ids run through one hash as they come."""
    names = ("ids", "points", "n", "least", "ends")
    kinds = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.list_(pa.int64())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    key = row = digest = None
    for batch in batches:
        done = []
        for x in batch.to_pylist():
            if x["key"] == key:
                digest.update(b"," + x["listed"].encode())
                row["n"] += x["n"]
                row["least"] = min(row["least"], x["least"])
                continue
            if row is not None:
                done.append(row | {"ends": digest.hexdigest()})
            key, row, digest = x["key"], {c: x[c] for c in names[:-1]}, hashlib.sha256(x["listed"].encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)
    if row is not None:
        yield pa.RecordBatch.from_pylist([row | {"ends": digest.hexdigest()}], schema=kinds)


def _distinct(sequences: DataFrame) -> DataFrame:
    """(ids, points, n, least, ends): a row per distinct sequence with the number, the smallest and the hash of its conversations."""
    key = F.unhex(F.substring(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256), 1, 32)).alias("key")
    listed = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("listed")
    parts = sequences.groupBy(key, F.shiftright("conv_id", PART_BITS).alias("part")).agg(
        F.first("ids").alias("ids"), F.first("points").alias("points"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), listed
    )
    dealt = parts.repartition("key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_hashed, "ids array<long>, points array<long>, n long, least long, ends string")


def _prefix_keys(ids: list[int]) -> list[bytes]:
    """A digest of each prefix, from the empty one to the whole."""
    running = hashlib.blake2b(digest_size=16)
    keys = [running.digest()]
    for x in ids:
        running.update(x.to_bytes(8, "little", signed=True))
        keys.append(running.copy().digest())
    return keys


class _Tree:
    """A ternary search tree over code sequences; node 0 is the empty prefix, and `same` of a node is the tree of its next turns."""

    def __init__(self) -> None:
        self.code, self.less, self.more, self.same = [0], [-1], [-1], [-1]
        self.points, self.row = [0], [-1]

    def _new(self, code: int, points: int) -> int:
        self.code.append(code)
        self.points.append(points)
        for links in (self.less, self.more, self.same, self.row):
            links.append(-1)
        return len(self.code) - 1

    def path(self, ids: list[int], points: list[int]) -> list[int]:
        """The nodes of all prefixes of a sequence, which are made where they are missing."""
        path = [0]
        for code, size in zip(ids, points):
            links, at = self.same, path[-1]
            while links[at] >= 0:
                links, at = links, links[at]
                if code == self.code[at]:
                    break
                links = self.less if code < self.code[at] else self.more
            else:
                links[at] = at = self._new(code, size)
            path.append(at)
        return path

    def parents(self) -> tuple[list[int], list[int]]:
        """All nodes, each after the node of its prefix, and the prefix of each."""
        seen, up, waiting = [0], [-1] * len(self.code), [(self.same[0], 0)]
        while waiting:
            at, above = waiting.pop()
            if at < 0:
                continue
            seen.append(at)
            up[at] = above
            waiting += [(self.less[at], above), (self.more[at], above), (self.same[at], at)]
        return seen, up


def _medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            yield (a + b) // 2
            ranges += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def _block(rows: list[dict], block: int) -> list[dict]:
    """The inner nodes of a block of sorted sequences, and one row with the nodes of its outer paths."""
    tree = _Tree()
    for i in _medians(len(rows)):
        tree.row[tree.path(rows[i]["ids"], rows[i]["points"])[-1]] = i
    seen, up = tree.parents()
    size = len(seen)
    n, kids, leaves, saved, depth = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    least: list[int | None] = [None] * size
    first, last = rows[0]["ids"], rows[-1]["ids"]
    left, right = tree.path(first, rows[0]["points"]), tree.path(last, rows[-1]["points"])
    outer = dict(zip(left, _prefix_keys(first))) | dict(zip(right, _prefix_keys(last)))
    for v in seen[1:]:
        depth[v] = depth[up[v]] + 1
    for v in reversed(seen):
        if (i := tree.row[v]) >= 0:
            n[v] += rows[i]["n"]
            least[v] = rows[i]["least"] if least[v] is None else min(least[v], rows[i]["least"])
        above = up[v]
        if above >= 0:
            n[above] += n[v]
            least[above] = least[v] if least[above] is None else min(least[above], least[v])
        if v not in outer:
            leaves[v] = leaves[v] or 1
            saved[v] += (n[v] - 1) * tree.points[v]
            kids[above] += 1
            leaves[above] += leaves[v]
            saved[above] += saved[v]

    def ends(v: int) -> str | None:
        return rows[tree.row[v]]["ends"] if tree.row[v] >= 0 else None

    def stats(v: int) -> dict:
        return {"n": n[v], "least": least[v], "kids": kids[v], "leaves": leaves[v], "saved": saved[v], "points": tree.points[v], "ends": ends(v)}

    found = []
    for v in seen:
        if v not in outer:
            parent = {"parent_key": outer[up[v]]} if up[v] in outer else {"parent_conv_id": least[up[v]]}
            found.append({"conv_id": least[v], "depth": depth[v], "n_convs": n[v], "n_children": kids[v], "n_leaves": leaves[v], "saved_tokens": saved[v], "ends_sha256": ends(v) or EMPTY, **parent})
    shared = _common(first, last)
    found.append({"block": block, "first": first, "last": last, "left": [stats(v) for v in left], "right": [stats(v) for v in right[shared + 1 :]]})
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of a range of sorted sequences, block by block."""
    rows, turns, block = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for x in batch.to_pylist():
            rows.append(x)
            turns += len(x["ids"]) + 1
            if turns >= BLOCK_TURNS:
                yield pa.RecordBatch.from_pylist(_block(rows, block), schema=_arrow)
                rows, turns, block = [], 0, block + 1
    if rows:
        yield pa.RecordBatch.from_pylist(_block(rows, block), schema=_arrow)


def _common(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Paths:
    """The first and the last path of neighbouring blocks, with what each node on them knows so far. The two share their upper nodes.

    A node counts all members of its blocks, but only those children that have been closed.
    """

    def __init__(self, row: dict) -> None:
        self.block, self.first, self.last, self.left = row["block"], row["first"], row["last"], row["left"]
        self.shared = _common(self.first, self.last)
        self.right = self.left[: self.shared + 1] + row["right"]

    def row(self) -> dict:
        return {"block": self.block, "first": self.first, "last": self.last, "left": self.left, "right": self.right[self.shared + 1 :]}

    def join(self, other: _Paths) -> list[dict]:
        """Takes in the next blocks, and returns the nodes that no block outside can reach any more."""
        met = _common(self.last, other.first)
        done = _closed(self.right, max(met, self.shared), _prefix_keys(self.last))
        done += _closed(other.left, max(met, other.shared), _prefix_keys(other.first))
        for a, b in zip(self.right[: met + 1], other.left):
            for c in ("n", "kids", "leaves", "saved"):
                a[c] += b[c]
            a["least"] = min(a["least"], b["least"])
            a["ends"] = a["ends"] or b["ends"]
        open_to = min(met, other.shared)
        done += _closed(self.right[: met + 1], max(open_to, self.shared), _prefix_keys(self.last))
        self.right = self.right[: open_to + 1] + other.right[open_to + 1 :]
        self.last = other.last
        self.shared = min(self.shared, met, other.shared)
        return done

    def close(self) -> list[dict]:
        done = _closed(self.right, self.shared, _prefix_keys(self.last))
        keys = _prefix_keys(self.first)
        return done + _closed(self.left, 0, keys) + [_final(self.left[0], 0, keys)]


def _final(node: dict, depth: int, keys: list[bytes]) -> dict:
    parent = {"parent_key": keys[depth - 1]} if depth else {}
    return {"conv_id": node["least"], "depth": depth, "key": keys[depth], "n_convs": node["n"], "n_children": node["kids"], "n_leaves": node["leaves"] or 1, "saved_tokens": node["saved"] + (node["n"] - 1) * node["points"], "ends_sha256": node["ends"] or EMPTY, **parent}


def _closed(path: list[dict], keep: int, keys: list[bytes]) -> list[dict]:
    """The nodes of a path below depth `keep`, the deepest first, each added to the node above it."""
    done = []
    for depth in range(len(path) - 1, keep, -1):
        done.append(x := _final(path[depth], depth, keys))
        above = path[depth - 1]
        above["kids"] += 1
        above["leaves"] += x["n_leaves"]
        above["saved"] += x["saved_tokens"]
    return done


def _joined(last: bool):
    """Joins the paths of a task's blocks in order; at last closes what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = None
        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if paths is None:
                    paths = _Paths(x)
                else:
                    done += paths.join(_Paths(x))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_arrow)
        if paths is not None:
            yield pa.RecordBatch.from_pylist(paths.close() if last else [paths.row()], schema=_arrow)

    return run


def trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of (conv_id, ids, points) rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    conv_ids are distinct; points holds a size for each code. A conversation without turns is a member of the root alone. Equal conversations
    share all their nodes. No rows in, none out. A block holds about BLOCK_TURNS turns, or one longer sequence.
    """
    unique = cut(_distinct(sequences))
    ranges = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = unique.repartitionByRange(ranges, "ids").sortWithinPartitions("ids")
    made = cut(sorted_rows.mapInArrow(_blocks, _BOTH))
    outer = made.where("block is not null").select("block", "first", "last", "left", "right")
    finished = []
    while (blocks := outer.count()) > FAN:
        step = cut(outer.repartitionByRange(-(-blocks // FAN), "block").sortWithinPartitions("block").mapInArrow(_joined(False), _BOTH))
        finished.append(step.where("block is null"))
        outer = step.where("block is not null").select("block", "first", "last", "left", "right")
    finished.append(cut(outer.coalesce(1).sortWithinPartitions("block").mapInArrow(_joined(True), _BOTH)))
    nodes, keyed = made.where("block is null"), finished[0]
    for more in finished[1:]:
        keyed = keyed.unionByName(more)
    nodes = nodes.unionByName(keyed)
    # the smallest member of a parent on an outer path is known only now
    known = keyed.where("depth > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    known = F.broadcast(known) if known.count() <= SMALL_ROWS else known
    root = keyed.where("depth = 0").first()
    columns = [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    inner = nodes.where("parent_key is null").select(*columns)
    high = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"] if root else None).cast("long")).select(*columns)
    deep = nodes.where("depth > 1 and parent_key is not null").drop("parent_conv_id").join(known, "parent_key").select(*columns)
    return inner.unionByName(high).unionByName(deep)


def trie_table(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations. Conversations are ordered, coded and rebuilt as encode and rebuild say; repeated rows are
    turns of their own, texts may be of any length as only their digests travel, other columns aren't read. No rows in, none out."""
    return trie(rebuild(encode(conversations)))
