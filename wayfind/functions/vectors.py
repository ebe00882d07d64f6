"""Vector expressions, and the registry of embedders."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import tokenize_basic


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1 in doubles; a zero vector stays."""
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """The dot product in doubles; 0 for vectors of different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def pad_or_trim(v: Column, dims: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dims)), 1, dims)


#: Documents whose vectors a task holds at once.
VECTOR_ROWS = 1024


#: Hashes made at once, so that their words stay in a core's cache; the longest text that fits into one round of MD5.
_MD5_ROWS, _MD5_BYTES = 8192, 55
_MD5_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).astype(np.uint32)
_MD5_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)


def _md5_round(m: np.ndarray) -> np.ndarray:
    """The first word of the MD5 of messages of one round, given as 16 rows of words."""
    a, b, c, d = (np.full(m.shape[1], v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    some = m.any(axis=1)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _MD5_SINES[i]
        if some[g]:
            f += m[g]
        turned = f << _MD5_TURNS[i]
        turned |= f >> (32 - _MD5_TURNS[i])
        turned += b
        a, b, c, d = d, turned, b, c
    return a + np.uint32(0x67452301)


def md5_heads(data: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first 32 bits of the MD5 of texts, each the parts (start, length in data) with a _ in between."""
    n = len(parts[0][0])
    size = sum(length for _, length in parts) + len(parts) - 1
    out = np.empty(n, np.int64)
    short = np.flatnonzero(size <= _MD5_BYTES)
    for at in range(0, len(short), _MD5_ROWS):
        own = short[at : at + _MD5_ROWS]
        text, place = np.zeros(64 * len(own), np.uint8), 64 * np.arange(len(own))
        for k, (start, length) in enumerate(parts):
            if k:
                text[place] = ord("_")
                place = place + 1
            count = length[own]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            text[np.repeat(place, count) + within] = data[np.repeat(start[own], count) + within]
            place = place + count
        text[place] = 0x80
        words = text.view("<u4").reshape(-1, 16)
        words[:, 14] = 8 * size[own]
        out[own] = _md5_round(np.ascontiguousarray(words.T)).astype("<u4").view(">u4")
    for i in np.flatnonzero(size > _MD5_BYTES).tolist():
        text = b"_".join(data[start[i] : start[i] + length[i]].tobytes() for start, length in parts)
        out[i] = int.from_bytes(hashlib.md5(text, usedforsecurity=False).digest()[:4], "big")
    return out


def _hashed(docs: DataFrame, id_col: str, text: Column, dims: int, entries: bool) -> DataFrame:
    """(id, vector) for each row, where they are read: no token is shuffled. entries gives the sparse form, (slot, value) by slot.

    A batch's different words and pairs are hashed once, all together in NumPy.
    """
    tokens = docs.select(F.col(id_col).alias("id"), tokenize_basic(text).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sums(column: pa.Array) -> np.ndarray:
        coded = column.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary())
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
        start, length = ends[:-1], np.diff(ends)
        row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        near = np.flatnonzero(row[1:] == row[:-1])
        pairs, pair = np.unique(code[near] * len(words) + code[near + 1], return_inverse=True)
        first, second = (pairs // len(words), pairs % len(words)) if len(pairs) else (pairs, pairs)
        own, both = md5_heads(data, [(start, length)]), md5_heads(data, [(start[first], length[first]), (start[second], length[second])])
        # multiples of a half: sums are exact in any order
        h = np.concatenate([own[code], both[pair]])
        value = np.where(h % 2 == 0, -1.0, 1.0) * np.repeat([1.0, 0.5], [len(code), len(pair)])
        return np.bincount(np.concatenate([row, row[near]]) * dims + h % dims, value, len(column) * dims).reshape(len(column), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_ROWS):
                part = batch.slice(at, VECTOR_ROWS)
                x = sums(part.column(1))
                norm = np.sqrt((x * x).sum(axis=1))
                live = np.flatnonzero(norm)
                x = x[live] / norm[live, None]
                if entries:
                    row, slot = np.nonzero(x)
                    values = pa.StructArray.from_arrays([pa.array(slot, pa.int32()), pa.array(x[row, slot])], names=["slot", "value"])
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(live)))])
                else:
                    values, offsets = pa.array(x.reshape(-1)), np.arange(len(live) + 1) * dims
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(live)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["id", "vector"])

    return tokens.mapInArrow(run, f"id {kind}, vector array<{'struct<slot:int,value:double>' if entries else 'double'}>")


def hashed_slots(docs: DataFrame, id_col: str, text: Column, dims: int = 384) -> DataFrame:
    """(id, slot, value): unit vectors of hashed tokens and bigrams, sparse.

    A token adds 1 and a bigram of neighbours 0.5 to slot hash % dims, negative if the hash is even; the hash is the first 32
    bits of MD5. Vectors whose entries cancel to zero have no rows. Each row of the input has a vector of its own.
    """
    return _hashed(docs, id_col, text, dims, True).select("id", F.explode("vector").alias("e")).select("id", "e.slot", "e.value")


def hashed_vectors(docs: DataFrame, id_col: str, text: Column, dims: int = 384) -> DataFrame:
    """(id, vector): the vectors of hashed_slots in dense form; those that cancel to zero have no row."""
    return _hashed(docs, id_col, text, dims, False)


_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def _mixed(h: np.ndarray, data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a hashes h carried on over so many bytes of data each, byte place by byte place for all together."""
    order = np.argsort(-lengths, kind="stable")
    h, start, ends = h[order], start[order], np.sort(lengths)
    for i in range(int(lengths.max(initial=0))):
        n = len(ends) - int(np.searchsorted(ends, i, side="right"))
        h[:n] = (h[:n] ^ data[start[:n] + i]) * _PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a(words: list[bytes]) -> np.ndarray:
    """The 64-bit FNV-1a hashes of words, byte place by byte place for all words together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
    return _mixed(np.full(len(words), _BASIS, np.uint64), data, start, lengths)


#: Characters that an embedder's task takes at once, unless one text has more.
EMBED_CHARS = 1 << 21


def _tokens(texts: pa.Array) -> pa.Array:
    """tokenize_basic on many texts at once, as lists: Spark runs no Python function over a higher-order one."""
    pc = pa.compute
    # the one letter whose lower case, as Spark has it, is an ASCII letter and something else
    plain = pc.utf8_lower(pc.replace_substring(pc.fill_null(texts, ""), "\u0130", "i\u0307"))
    runs = pc.split_pattern_regex(plain, "[^a-z0-9_-]+")
    row, word = pc.list_parent_indices(runs).to_numpy(), pc.list_flatten(runs)
    keep = pc.greater_equal(pc.binary_length(word), 2)
    row, word = row[keep.to_numpy(zero_copy_only=False)], word.filter(keep)
    # the parts of compound words come after each
    at = np.flatnonzero(pc.match_substring_regex(word, "[-_]").to_numpy(zero_copy_only=False))
    if len(at):
        compound = word.take(pa.array(at))
        pieces = pc.split_pattern_regex(compound, "[-_]")
        owner, piece = pc.list_parent_indices(pieces).to_numpy(), pc.list_flatten(pieces)
        long = np.flatnonzero(pc.greater_equal(pc.binary_length(piece), 2).to_numpy(zero_copy_only=False))
        place = np.concatenate([np.arange(len(word)), at[owner[long]]])
        order = np.argsort(place, kind="stable")
        row, word = row[place[order]], pa.concat_arrays([word, piece.take(pa.array(long))]).take(pa.array(order))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), word)


def _embedded(texts: pa.Array, dims: int) -> np.ndarray:
    """The unit vectors of texts, a row each."""
    lists = _tokens(texts)
    coded = lists.values.dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lengths = pa.compute.binary_length(words).to_numpy().astype(np.int64)
    start = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    own = _mixed(np.full(len(words), _BASIS, np.uint64), data, start, lengths)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    near = np.flatnonzero(row[1:] == row[:-1])
    pairs, pair = np.unique(code[near] * len(words) + code[near + 1], return_inverse=True)
    first, second = (pairs // len(words), pairs % len(words)) if len(pairs) else (pairs, pairs)
    joined = _mixed((own[first] ^ np.uint64(ord("_"))) * _PRIME, data, start[second], lengths[second])
    # multiples of a half: sums are exact in any order
    h = np.concatenate([own[code], joined[pair]])
    value = np.where(h & np.uint64(1), 1.0, -1.0) * np.repeat([1.0, 0.5], [len(code), len(pair)])
    at = np.concatenate([row, row[near]]) * dims + (h % np.uint64(dims)).astype(np.int64)
    v = np.bincount(at, value, len(texts) * dims).astype(np.float64).reshape(len(texts), dims)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def hash_embedder(dims: int = 384) -> Callable[[Column], Column]:
    """The dense form with 64-bit FNV-1a, as an Arrow-batched function of the text."""
    if dims <= 0:
        raise ValueError("dims must be positive")

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            parts, at = [], 0
            while at < len(texts) or not parts:
                passed = size[at - 1] if at else 0
                end = max(at + 1, min(at + VECTOR_ROWS, int(np.searchsorted(size, passed + EMBED_CHARS, side="right"))))
                made = _embedded(texts.slice(at, end - at), dims).astype(np.float32)
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * dims), pa.array(made.reshape(-1))))
                at = end
            yield pa.concat_arrays(parts)

    return embed


_EMBEDDERS: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def register_embedder(name: str, factory: Callable[..., Callable[[Column], Column]]) -> None:
    """Adds or replaces a factory: keyword parameters to a function from a text column to a vector column."""
    if not name or factory is None:
        raise ValueError("an embedder needs a name and a factory")
    _EMBEDDERS[name] = factory


def embedder(name: str, **config) -> Callable[[Column], Column]:
    """Makes a registered embedder; an unknown name or bad dims fail before any job starts."""
    if name not in _EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; registered: {', '.join(embedder_names())}")
    if config.get("dims", 1) <= 0:
        raise ValueError("dims must be positive")
    made = _EMBEDDERS[name](**config)
    if made is None:
        raise ValueError(f"embedder {name!r} made nothing")
    return made


def embedder_names() -> list[str]:
    return sorted(_EMBEDDERS)


register_embedder("hash", hash_embedder)
