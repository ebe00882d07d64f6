"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment.

Texts and benchmark items are compared in a canonical form: lower case, every run of characters that are neither letters
nor digits as one space. An item of n characters may be met with k = floor(rate * n) edits. A region that holds it
then shares at least n - q + 1 - q * k of its q-grams (the q-gram lemma), all within k + 1 neighbouring diagonals; bands
of 2 (k + 1) diagonals at steps of k + 1 hold any such run. Bands that reach the bound are aligned inside the band, and
those with at most k edits are leaks.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.textarrays import mix, released

Q = 10
ERROR_RATE = 0.08
#: Items are matched in blocks of about so many characters; a task holds the index of one block at a time.
BLOCK_CHARS = 4 << 20
SLICE_CHARS = 1 << 19
PAIRS_AT_ONCE = 1 << 21

LEAKS = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"
_LEAK = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
_GAP = np.uint32(0x110000)  # between texts; equals no character
_STEP = 1 << 12  # an edit's weight where the start is carried along in the low bits


def _letters() -> np.ndarray:
    """For code points below U+0250 the canonical character; above, letters and digits are told by str.isalnum."""
    return np.array([ord(chr(c).lower()) if chr(c).isalnum() and len(chr(c).lower()) == 1 else 32 for c in range(0x250)], np.uint32)


_TABLE = _letters()


def canonical(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, place of each in its text, offsets): the canonical forms one after the other, a gap after each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    low = _TABLE[np.minimum(raw, 0x24F)]
    for i in np.flatnonzero(raw >= 0x250).tolist():
        c = chr(raw[i])
        low[i] = ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else raw[i] if c.isalnum() else 32
    ends = np.cumsum(lengths)
    first = np.zeros(len(raw) + 1, bool)
    first[ends - lengths] = True
    space = low == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep &= ~(space & first[:-1])
    at = np.flatnonzero(keep)
    rows = np.searchsorted(ends, at, side="right")
    kept = np.bincount(rows, minlength=len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(kept + 1, out=offsets[1:])
    chars = np.full(offsets[-1], _GAP, np.uint32)
    place = np.zeros(offsets[-1], np.int64)
    to = np.arange(len(at)) + rows
    chars[to] = low[at]
    place[to] = at - (ends - lengths)[rows]
    return chars, place, offsets


def _grams(chars: np.ndarray, q: int) -> np.ndarray:
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    h = chars[: len(chars) - q + 1].astype(np.uint64)
    for j in range(1, q):
        h *= np.uint64(0x100000001B3)
        h += chars[j : len(chars) - q + 1 + j]
    return mix(h)


@dataclass
class BenchmarkIndex:
    """The q-grams of a block of benchmark items, sorted, with the item and place of each occurrence."""

    ids: np.ndarray
    chars: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    short: dict[str, list[int]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str], q: int, rate: float) -> BenchmarkIndex:
        chars, _, offsets = canonical(texts)
        items = [chars[a : b - 1] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        items = [x[:-1] if len(x) and x[-1] == 32 else x for x in items]
        own = [(i, x) for i, x in zip(ids, items, strict=True) if len(x) >= q]
        short: dict[str, list[int]] = {}
        for i, x in zip(ids, items, strict=True):
            if 0 < len(x) < q:
                short.setdefault(_string(x), []).append(i)
        sizes = np.array([len(x) for _, x in own], np.int64)
        # fewer edits for short items, so that at least one q-gram must be shared
        edits = np.minimum((sizes * rate).astype(np.int64), np.maximum(sizes - q, 0) // q)
        grams = [_grams(x, q) for _, x in own]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        seen = np.zeros(1 << 22, bool)
        seen[(distinct >> np.uint64(42)).astype(np.int64)] = True
        item = np.repeat(np.arange(len(own), dtype=np.int32), [len(g) for g in grams])[order] if own else np.zeros(0, np.int32)
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order] if own else np.zeros(0, np.int32)
        return cls(np.array([i for i, _ in own], np.int64), [x for _, x in own], edits, sizes - q + 1 - q * edits, distinct, np.append(first, len(flat)), item, place, seen, short)

    def bands(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands with as many shared q-grams as the bound asks for."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return none
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        hit = self.grams[slot] == grams[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return none
        often = self.first[slot + 1] - self.first[slot]
        upto = np.cumsum(often)
        step = self.edits + 1
        keys, counts = [], []
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
            n = often[a:b]
            where = np.repeat(self.first[slot[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item = self.item[where].astype(np.int64)
            diagonal = np.repeat(at[a:b], n) - self.place[where] + (1 << 24)
            band = diagonal // step[item]
            both = np.concatenate([item << 40 | band, item << 40 | (band - 1)])
            k, c = np.unique(both, return_counts=True)
            keys.append(k)
            counts.append(c)
            a = b
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts))
        item = k >> 40
        enough = n >= self.needed[item]
        item, band = item[enough], (k & ((1 << 40) - 1))[enough]
        return item, band * step[item] - (1 << 24)

    def aligned(self, chars: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, start, end) of the best alignment of each item inside its band, all bands a row at a time.

        Entry x of a row stands for diagonal low + x; a value is edits * _STEP + the x it started from. No alignment reads a
        gap, so none reaches from one text into the next.
        """
        sizes = np.array([len(self.chars[i]) for i in item], np.int64)
        width = 2 * (self.edits[item] + 1)
        most, rows = int(width.max()), int(sizes.max())
        pattern = np.full((len(item), rows), _GAP + 1, np.uint32)
        for r, i in enumerate(item):
            pattern[r, : sizes[r]] = self.chars[i]
        x = np.arange(most)
        off = np.where(x[None, :] < width[:, None], 0, 1 << 30)
        padded = np.concatenate([chars, np.full(1, _GAP, np.uint32)])
        now = x[None, :] + off
        final = np.full((len(item), most), 1 << 30, np.int64)
        for i in range(rows):
            at = low[:, None] + x[None, :] + i
            there = padded[np.where((at < 0) | (at >= len(chars)), len(chars), at)]
            gap = there == _GAP
            step = now + np.where(there == pattern[:, i : i + 1], 0, np.where(gap, 1 << 30, _STEP))
            step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + _STEP)
            # to go on by x places in the text costs x edits, and more than any alignment over a gap
            passed = np.zeros_like(step)
            np.cumsum(gap[:, 1:], axis=1, out=passed[:, 1:])
            weight = x * _STEP + (passed << 30)
            now = np.minimum.accumulate(step - weight, axis=1) + weight + off
            now = np.minimum(now, 1 << 30)
            done = sizes == i + 1
            final[done] = now[done]
        end = (final // _STEP).argmin(1)
        best = final[np.arange(len(item)), end]
        return best // _STEP, low + best % _STEP, low + sizes + end


def _string(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le")


def _found(indexes: Iterable[BenchmarkIndex], texts: list[str], q: int) -> list[list[dict]]:
    chars, place, offsets = canonical(texts)
    grams = _grams(chars, q)
    small = [r for r in np.flatnonzero(np.diff(offsets) <= q + 1).tolist() if offsets[r + 1] - offsets[r] > 1]
    out: list[list[dict]] = [[] for _ in texts]
    for index in indexes:
        for r in small if index.short else ():
            own = chars[offsets[r] : offsets[r + 1] - 1]
            for i in index.short.get(_string(own).rstrip(" "), ()):
                out[r].append({"item_id": int(i), "start": int(place[offsets[r]]), "end": int(place[offsets[r + 1] - 2]) + 1, "edits": 0})
        items, lows = index.bands(grams)
        for a in range(0, len(items), 256):
            item, low = items[a : a + 256], lows[a : a + 256]
            edits, start, end = index.aligned(chars, item, low)
            for i, e, s, t in zip(item.tolist(), edits.tolist(), start.tolist(), end.tolist(), strict=True):
                if e > index.edits[i]:
                    continue
                s, t = max(s, 0), min(t, len(chars))
                row = int(np.searchsorted(offsets, (s + t) // 2, side="right")) - 1
                s, t = max(s, int(offsets[row])), min(t, int(offsets[row + 1]) - 1)
                if t > s:
                    out[row].append({"item_id": int(index.ids[i]), "start": int(place[s]), "end": int(place[t - 1]) + 1, "edits": e})
    return [_best(leaks) for leaks in out]


def _in_turn(shared: list[Broadcast]) -> Iterator[BenchmarkIndex]:
    """One index after the other; of several, each is dropped from the worker's memory before the next one is read."""
    for each in shared:
        yield each.value
        if len(shared) > 1:
            vars(each).pop("_value", None)


def _best(leaks: list[dict]) -> list[dict]:
    """Of alignments of one item that overlap, the one with fewest edits; in order of their starts."""
    kept: dict[int, list[dict]] = {}
    for x in sorted(leaks, key=lambda x: (x["edits"], x["start"], x["end"])):
        own = kept.setdefault(x["item_id"], [])  # in order, none overlapping
        at = bisect_left(own, x["start"], key=lambda y: y["start"])
        if (at == len(own) or own[at]["start"] >= x["end"]) and (at == 0 or own[at - 1]["end"] <= x["start"]):
            own.insert(at, x)
    return sorted((x for own in kept.values() for x in own), key=lambda x: (x["start"], x["item_id"]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = ERROR_RATE) -> DataFrame:
    """Adds `leaks` to the rows: the benchmark items met, with start and end in characters and the edits needed.

    A null or empty text has none. Null items and those without letters or digits are no evidence and are left out; an item
    of fewer than q canonical characters has no q-gram and is met by a document that equals it as a whole; equal items are
    each reported. Of overlapping places of one item the one with fewest edits is reported. No item anywhere gives empty
    lists. The benchmark is read in blocks of about BLOCK_CHARS characters by a hash of its rows, each a bounded
    broadcast; documents are scanned once, each run of them is held against one block after the other, and nothing is
    shuffled. Neither the order of rows nor how they are dealt out changes a result. A column named leaks is replaced.
    """
    docs = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAKS))
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / BLOCK_CHARS))
    schema, column, own = T.StructType(docs.schema.fields), docs.columns.index(text), docs.columns.index("leaks")
    shared = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        shared.append(docs.sparkSession.sparkContext.broadcast(BenchmarkIndex.of([r.i for r in rows], [r.t for r in rows], q, rate)))
    limit = SLICE_CHARS if blocks == 1 else 4 * SLICE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            run_of: list[str] = []
            held = 0
            for value in batch.column(column):
                run_of.append(value.as_py() or "")
                held += len(run_of[-1])
                if held >= limit:
                    found += _found(_in_turn(shared), run_of, q)
                    run_of, held = [], 0
            found += _found(_in_turn(shared), run_of, q) if run_of else []
            columns = list(batch.columns)
            columns[own] = pa.array(found, pa.list_(_LEAK))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows without any leak, with the columns and values they came with."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return find_leaks(whole, benchmark).where(F.size("leaks") == 0).select("row.*")


def leak_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leak: the document, the benchmark item, where it stands and the edits needed; clean documents have none."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
