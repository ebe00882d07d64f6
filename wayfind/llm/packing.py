"""Packing documents into sequences of a fixed number of tokens: bulk-synchronous best fit.

A round sorts documents and gaps by size in ranges. A sweep over each range gives every gap the largest document before it that no
smaller gap has taken; documents that meet the same gap go on to the next ones by rank. What a range leaves over, gaps
first and documents last, is matched between ranges by the ranks of both. Gaps are then what is left of them, and the next round
begins.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.support import cut
from wayfind.llm.textarrays import released, string_slices

SLICE_BYTES = 1 << 22
#: Chunks that can stand side by side in one text, of code points whose classes every version of Unicode agrees on. Others, and long
#: ones, go to the library itself.
_PLAIN = re.compile("[ \n][\x00-ɏ]{0,200}[!-~]")
#: Chunks and characters that a worker remembers before it begins anew.
_KEPT_CHUNKS, _KEPT_CHARS = 1 << 19, 1 << 23
#: Documents and gaps of a range: at least and at most about so many rows.
_LEAST_ROWS, _MOST_ROWS = 20_000, 250_000

# The pattern that cuts texts before pairs are merged, fixed by the format of the vocabulary file.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Coder:
    """Token ids of chunks, remembered. A chunk is white space and what follows it up to the next space or line feed behind an
    ASCII character: tokens never reach over such a place, so a text's ids are those of its chunks."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            listed = json.load(file)
        self.special = [x["content"] for x in listed["added_tokens"]]
        letters = _byte_of()
        ranks = {bytes(letters[c] for c in token): i for token, i in listed["model"]["vocab"].items() if token not in self.special}
        # merges by the same ranks, several times faster for many chunks
        self.fast = tiktoken.Encoding("from-file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        # number 0 is the end of a text
        self.number: dict[str, int] = {}
        self.chars, self.filled = 0, 1
        self.ids, self.offsets = np.zeros(1 << 16, np.uint32), [0, 1]

    def _learn(self, chunks: list[str], ids: np.ndarray, ends: list[int]) -> None:
        """Remembers chunks whose ids stand one after the other and end at these places."""
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        first = len(self.offsets) - 1
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        self.offsets += [self.filled + e for e in ends]
        self.filled += len(ids)
        self.chars += sum(map(len, chunks))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk, under which its ids stand in self.ids."""
        if len(self.number) > _KEPT_CHUNKS or self.chars > _KEPT_CHARS:
            self._forget()
        found = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = [chunks[i] for i in np.flatnonzero(found < 0).tolist()]
        if not new:
            return found
        plain = [c for c in new if _PLAIN.fullmatch(c)]
        together = "".join(plain)
        if any(s in together for s in self.special):
            plain = [c for c in plain if not any(s in c for s in self.special)]
            together = "".join(plain)
        if plain:
            # one call for all of them; a chunk's ids are those that make up its bytes
            ids = self.fast.encode_to_numpy(together, disallowed_special=())
            bytes_ = np.cumsum(self.bytes[ids])
            sizes = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in plain])
            self._learn(plain, ids, (np.searchsorted(bytes_, sizes) + 1).tolist())
        other = [c for c in new if c not in self.number]
        if other:
            coded = [x.ids for x in self.library.encode_batch_fast(other, add_special_tokens=False)]
            self._learn(other, np.fromiter(chain.from_iterable(coded), np.uint32), np.cumsum(list(map(len, coded))).tolist())
        found[found < 0] = [self.number[c] for c in new]
        return found

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with an end, and where each begins."""
        n = len(data)
        start = np.zeros(n, bool)
        if n:
            start[1:] = ((data[1:] == 32) | (data[1:] == 10)) & (data[:-1] > 32) & (data[:-1] < 127)
            start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        bounds = pa.py_buffer(np.append(starts, n).astype(np.int64))
        chunks = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        numbers = self.numbers(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        ends = np.searchsorted(starts, offsets[1:], side="left")
        numbers = np.insert(numbers, ends, 0)
        first = np.asarray(self.offsets, np.int64)
        sizes = (first[1:] - first[:-1])[numbers]
        scan = np.concatenate([[0], np.cumsum(sizes)])
        kind = np.int32 if self.filled + scan[-1] < 2**31 else np.int64
        ids = self.ids[np.repeat((first[numbers] - scan[:-1]).astype(kind), sizes) + np.arange(scan[-1], dtype=kind)]
        return ids, scan[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


_coders: dict[str, _Coder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): the texts' token ids, each text with id 0 at its end, in pieces of `capacity` tokens.

    Only texts of more tokens are cut; their first piece takes what is over. A null text is empty and has its end alone. `path` is a
    byte-level byte-pair file, read on each executor; special strings inside a text are tokens of their own. A text of any
    length is coded whole, in a slice of its own.
    """
    keys = docs.schema[key].dataType
    schema = "piece int, start long, length long, ids_crc32 long"
    names = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.get(path) or _coders.setdefault(path, _Coder(path))
        for batch in released(batches):
            for at, data, offsets in string_slices(batch.column(1), SLICE_BYTES):
                ids, begin = coder.texts(data, offsets)
                total = np.diff(begin)
                pieces = -(-total // capacity)
                rows = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                over = total - (pieces - 1) * capacity
                start = np.where(piece > 0, over[rows] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, over[rows])
                a = begin[rows] + start
                whole = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist())]
                columns = [batch.column(0).take(pa.array(at + rows)), *[pa.array(x, t) for x, t in zip((piece, start, length, crc), names.types)]]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *names.names])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {keys.simpleString()}, {schema}")


_DOC = ("id", "key", "piece", "start", "length", "ids_crc32")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches a range of documents (kind 0) and gaps (kind 1) in the order of their sizes.

    A gap meets the last open document before it. Going over the range, the number of open documents rises at a document and
    falls at a gap; the two that meet pass the same level one after the other. Matched documents get the gap's sequence,
    matched gaps what they have taken; the others get their rank: documents from the largest, gaps from the smallest.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    kind, bins, size = (rows.column(c).to_numpy() for c in ("kind", "bin", "size"))
    open_ = np.cumsum(np.where(kind == 0, 1, -1))
    level = np.where(kind == 0, open_, open_ + 1)
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    met = (level[a] == level[b]) & (kind[a] == 0) & (kind[b] == 1)
    docs, gaps = a[met], b[met]
    bin_, taken, rank = bins.copy(), np.zeros(len(kind), np.int64), np.full(len(kind), -1, np.int64)
    bin_[docs] = bins[gaps]
    taken[gaps] = size[docs]
    free = np.ones(len(kind), bool)
    free[docs] = free[gaps] = False
    left, room = np.flatnonzero(free & (kind == 0)), np.flatnonzero(free & (kind == 1))
    rank[left[::-1]] = np.arange(len(left))
    rank[room] = np.arange(len(room))
    part = pa.array(np.full(len(kind), TaskContext.get().partitionId(), np.int64))
    for name, column in (("bin", pa.array(bin_)), ("taken", pa.array(taken)), ("rank", pa.array(rank)), ("part", part)):
        rows = rows.set_column(rows.schema.get_field_index(name), name, column) if name in rows.column_names else rows.append_column(name, column)
    yield from rows.to_batches(max_chunksize=10_000)


def _between(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(kind, part, from rank, to rank, first number): which left documents and gaps of different ranges meet, from the numbers
    (part, documents, gaps) that each range has left. A gap meets the nearest range before it that has documents left."""
    open_, spans, number = [], [], 0
    for part, docs, gaps in sorted(left):
        at = 0
        while at < gaps and open_:
            other, begin, n = open_.pop()
            m = min(n, gaps - at)
            spans += [(0, other, begin, begin + m, number), (1, part, at, at + m, number)]
            number, at = number + m, at + m
            if n > m:
                open_.append((other, begin + m, n - m))
        if docs:
            open_.append((part, 0, docs))
    return spans


def _round(docs: DataFrame, gaps: DataFrame, width: int, most: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents that have found a sequence, documents that have not, and gaps as they are then. A gap offers as many equal
    parts of itself as have room for `width` tokens, at least one and at most `most`."""
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-rows // _MOST_ROWS), min(shuffle, rows // _LEAST_ROWS))
    none = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in _DOC]
    parts = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("room") / width))).cast("int")
    offered = gaps.select("bin", "room", parts.alias("parts")).select(
        *none, F.floor(F.col("room") / F.col("parts")).alias("size"), F.lit(1).alias("kind"), "bin", "room", F.col("bin").alias("tie"), F.explode(F.sequence(F.lit(1), "parts")).alias("slot")
    )
    zero = F.lit(0).cast("long")
    asking = docs.select(*_DOC, F.col("length").alias("size"), F.lit(0).alias("kind"), zero.alias("bin"), zero.alias("room"), F.col("id").alias("tie"), F.lit(0).alias("slot"))
    by = ("size", "kind", "tie", "slot")
    dealt = asking.unionByName(offered).repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("tie", "slot")
    key = docs.schema["key"].dataType.simpleString()
    schema = f"id long, key {key}, piece int, start long, length long, ids_crc32 long, size long, kind int, bin long, room long, taken long, rank long, part long"
    swept = cut(dealt.mapInArrow(_sweep, schema))
    found, free = swept.where("rank < 0"), swept.where("rank >= 0")
    # a row for each range comes to the driver, and a few for each go back
    spans = _between([tuple(x) for x in free.groupBy("part").agg(F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") == 1)).collect()])
    if spans:
        listed = F.broadcast(spark.createDataFrame(spans, "kind int, part long, low long, high long, number long"))
        paired = free.join(listed, ["kind", "part"]).where("rank >= low and rank < high").withColumn("pair", F.col("number") + F.col("rank") - F.col("low"))
        doc, gap = F.struct(*_DOC), F.struct("bin", "room")
        pairs = cut(paired.groupBy("pair").agg(F.max(F.when(F.col("kind") == 0, doc)).alias("doc"), F.max(F.when(F.col("kind") == 1, gap)).alias("gap")))
        free = free.join(listed.select("kind", "part", "low", "high").groupBy("kind", "part").agg(F.max("high").alias("high")), ["kind", "part"], "left").where("high is null or rank >= high")
        placed = found.where("kind = 0").select(*_DOC, "bin").unionByName(pairs.select("doc.*", "gap.bin"))
        after = found.where("kind = 1").select("bin", "room", "taken").unionByName(pairs.select("gap.*", F.col("doc.length").alias("taken"))).unionByName(free.where("kind = 1").select("bin", "room", "taken"))
    else:
        placed = found.where("kind = 0").select(*_DOC, "bin")
        after = swept.where("kind = 1").select("bin", "room", "taken")
    gaps = after.groupBy("bin").agg((F.max("room") - F.sum("taken")).alias("room"))
    return placed, free.where("kind = 0").select(*_DOC), gaps


def _fewest(n: int, total: int, least: int, capacity: int) -> int:
    """So many sequences at least are needed for n documents of so many tokens, none shorter than `least`."""
    return max(-(-total // capacity), -(-n // (capacity // max(1, least))))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to (key, piece, start, length, ids_crc32) rows whose length is 1 to `capacity`.

    Pieces of more than half the capacity open sequences of their own. The others are placed by rounds of best fit. While they are more than
    twice the gaps, the longest go first: those above half of the longest one's length, for which a gap offers as many parts as it can hold of
    them. Where no gap takes any, as many sequences are opened as are needed at least. A round is a job of its own and its rows
    are written to the checkpoint folder; the number of rounds follows the logarithm of the number of documents in a sequence, and not the
    number of rows. Equal pieces and repeated rows are placed each for itself. No rows in, none out.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces.withColumn("id", F.monotonically_increasing_id())).select(*_DOC)
    alone = F.col("length") * 2 > capacity
    placed = [pieces.where(alone).withColumn("bin", F.col("id"))]
    gaps = pieces.where(alone & (F.col("length") < capacity)).select(F.col("id").alias("bin"), (F.lit(capacity) - F.col("length")).alias("room"))
    docs, opened, more = pieces.where(~alone), 0, 0
    shape = (F.count(F.lit(1)), F.sum("length"), F.min("length"), F.max("length"))
    n, total, least, longest = docs.agg(*shape).first()
    if n:
        tokens, sequences = pieces.where(F.col("length") < capacity).agg(F.sum("length"), F.count_if(alone)).first()
        more = max(0, -(-tokens // capacity) - sequences)
    while n:
        gaps = cut(gaps.where(F.col("room") >= least))
        rooms = gaps.count()
        if not rooms:
            more = max(more, _fewest(n, total, least, capacity))
        if more:
            fresh = spark.range(opened, opened + more).select((-1 - F.col("id")).alias("bin"), F.lit(capacity).cast("long").alias("room"))
            gaps, opened, rooms, more = gaps.unionByName(fresh), opened + more, rooms + more, 0
        if n > 2 * rooms:
            first = F.col("length") * 2 > longest
            most = -(-2 * n // rooms)
            found, left, gaps = _round(docs.where(first), gaps, longest, most, n + rooms)
            docs = cut(left.unionByName(docs.where(~first)))
        else:
            first = F.lit(True)
            found, left, gaps = _round(docs, gaps, capacity, 1, n + rooms)
            docs = cut(left)
        placed.append(found)
        before = n
        n, total, least, longest = docs.agg(*shape).first()
        if n == before:
            more = _fewest(*docs.where(first).agg(*shape[:3]).first(), capacity)
    whole = placed[0]
    for x in placed[1:]:
        whole = whole.unionByName(x)
    before = Window.partitionBy("bin").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select("key", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def packing_table(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens, a row per piece. Null and empty texts are one end each; rows that share an id
    are documents of their own; other columns aren't read. No rows in, none out."""
    return pack(token_pieces(docs, path, capacity), capacity).withColumnRenamed("key", "doc_id")
