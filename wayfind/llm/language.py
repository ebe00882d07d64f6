"""Language identification by spans: script ranges, per-word scores and Viterbi with a switching penalty.

A word is a run of letters and marks that starts with a letter. Its score in a language is the sum over its character trigrams (with the word's
edges) of log probabilities learned from labelled texts; a language is a candidate for a word only if it was learned with
the script of the word's first letter. Viterbi over a text's words, at a fixed cost for each switch, labels every word,
and runs of one label are spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.textarrays import mix
from wayfind.llm.support import cut

#: Trigrams are hashed to so many buckets, which bounds the model at BUCKETS numbers per language.
BUCKETS = 1 << 16
#: A task holds the counts of at most so many languages; with more, shorter runs of texts are scored at once.
HELD_LANGUAGES = 64
#: A language is learned with a script that at least this share of its letters has.
SCRIPT_SHARE = 0.001
SLICE_CHARS = 1 << 20
#: Words whose trigrams are looked up at once.
WORDS_AT_ONCE = 1 << 16

# First code points of runs of letters of one script (Unicode block ranges), with the script's number.
# 0 other, 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Devanagari, 8 Bengali, 9 other Indic,
# 10 Thai, 11 Georgian, 12 Hangul, 13 Kana, 14 Han, 15 Ethiopic
SCRIPT_RANGES = [
    (0x0000, 1), (0x0250, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0),
    (0x08A0, 6), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 15), (0x13A0, 0),
    (0x1C80, 3), (0x1C90, 11), (0x1CC0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0),
    (0x3040, 13), (0x3100, 0), (0x3130, 12), (0x3190, 0), (0x31F0, 13), (0x3200, 0), (0x3400, 14), (0x4DC0, 0), (0x4E00, 14), (0xA000, 0),
    (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB10, 0), (0xFF21, 1),
    (0xFF5B, 0), (0x20000, 14), (0x32000, 0),
]
SCRIPTS = 16


#: Words are cut out of pieces of about so many characters, which end where a word cannot go on.
PIECE_CHARS = 1 << 20
_PIECE_END = re.compile(r"[\s.,;:!?\u3002\u3001]")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter (2), a mark (1) or neither (0), and its script."""
    import unicodedata

    word = np.array(["ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)], np.uint8)
    script = np.zeros(0x110000, np.uint8)
    for first, kind in SCRIPT_RANGES:
        script[first:] = kind
    return word, script


class Words:
    """The words of some texts as arrays: hashed trigrams (flat), the first one of each word, row, script, place."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        joined = "\n".join(texts) + "\n"
        low = joined.lower()
        if len(low) != len(joined):  # a few characters get longer in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
        edges = np.cumsum(lengths)
        found, at = [], 0
        while at < len(low):
            stop = _PIECE_END.search(low, at + PIECE_CHARS) if len(low) - at > PIECE_CHARS else None
            to = stop.end() if stop else len(low)
            found.append(self._piece(low[at:to], at))
            at = to
        self.starts, self.sizes, self.scripts, self.grams = (np.concatenate(x) for x in zip(*found, strict=True))
        self.ends = self.starts + self.sizes
        self.rows = np.searchsorted(edges, self.starts, side="right")
        self.origin = self.starts - (edges - lengths)[self.rows]
        self.first = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _piece(low: str, offset: int) -> tuple[np.ndarray, ...]:
        points = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        kinds, script = _tables()
        kind = kinds[points]
        inside = kind > 0
        # marks before the first letter of a run are not part of a word
        letters = np.cumsum(kind == 2)
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        runs = np.flatnonzero(new)
        if len(runs):
            before = letters[runs] - (kind[runs] == 2)
            inside &= letters > before[np.maximum(np.cumsum(new) - 1, 0)]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        # around a letter at i: i - 1, i, i + 1, where whatever is no letter counts as an edge
        held = np.concatenate([[32], np.where(inside, points, 32), [32]]).astype(np.uint64)
        at = np.flatnonzero(inside) + 1
        code = held[at - 1] << np.uint64(42) | held[at] << np.uint64(21) | held[at + 1]
        return starts + offset, ends - starts, script[points[starts]], (mix(code) >> np.uint64(64 - 16)).astype(np.int32)


def _slices(values: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    at, held, run = 0, 0, []
    for i, v in enumerate(values):
        run.append(v or "")
        held += len(run[-1])
        if held >= most:
            yield at, run
            at, held, run = i + 1, 0, []
    if run:
        yield at, run


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): how often each trigram bucket occurs in each language's texts; buckets from BUCKETS on count
    letters by script. Counted by numpy inside tasks and summed by Spark: languages * (BUCKETS + SCRIPTS) rows from each
    task, or more where a task meets more than HELD_LANGUAGES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for at, texts in _slices(batch.column(0).to_pylist()):
                w = Words(texts)
                own = labels[at : at + len(texts)][w.rows]
                for label in set(own.tolist()):
                    if label not in sums:
                        if len(sums) >= HELD_LANGUAGES:
                            yield from counted(sums)
                            sums = {}
                        sums[label] = np.zeros(BUCKETS + SCRIPTS, np.int64)
                    mine = own == label
                    sums[label][:BUCKETS] += np.bincount(w.grams[np.repeat(mine, w.sizes)], minlength=BUCKETS)
                    sums[label][BUCKETS:] += np.bincount(w.scripts[mine], weights=w.sizes[mine], minlength=SCRIPTS).astype(np.int64)
        yield from counted(sums)

    def counted(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "bucket", "n"])

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).cast("string").alias("lang"))
    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log probabilities of trigram buckets for each learned language, and the scripts of each.

    BUCKETS numbers for each language met.
    """

    def __init__(self, counts: DataFrame):
        rows = counts.toPandas()
        self.languages = sorted(set(rows["lang"]))
        place = {x: i for i, x in enumerate(self.languages)}
        n = np.zeros((BUCKETS + SCRIPTS, len(self.languages)))
        n[rows["bucket"].to_numpy(np.int64), rows["lang"].map(place).to_numpy(np.int64)] = rows["n"].to_numpy()
        grams, scripts = n[:BUCKETS], n[BUCKETS:]
        self.log = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
        self.uses = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(0))


def _viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; all texts take a step at once. first, count: each text's words."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    most = int(count[0]) if len(count) else 0
    if scores.shape[1] == 1 or not most:
        return labels
    active = np.searchsorted(-count, -np.arange(1, most + 1), side="right")
    back = np.zeros(scores.shape, np.int16)
    best = np.zeros((active[0], scores.shape[1]))
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(most):
        n = active[t]
        at = first[:n] + t
        best = best[:n]
        if t:
            top = best.argmax(1)
            switched = best[np.arange(n), top] - penalty
            stay = best >= switched[:, None]
            back[at] = np.where(stay, own, top[:, None].astype(np.int16))
            best = np.where(stay, best, switched[:, None])
        best = best + scores[at]
        # texts end here if fewer are active in the next step
        rest = active[t + 1] if t + 1 < most else 0
        if rest < n:
            labels[at[rest:]] = best[rest:].argmax(1)
    for t in range(most - 1, 0, -1):
        at = first[: active[t]] + t
        labels[at - 1] = back[at, labels[at]]
    return labels


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = 12.0) -> DataFrame:
    """Adds lang_pred, score, spans and known to the rows.

    spans lists (start, end, lang) in characters of the text, in order, each from its first word's start to its last
    word's end. lang_pred is the language with most letters, ties to the first by name; score is its share of all
    letters times how far, per word and on average over the words with that label, it is ahead of the next candidate (0 to
    1). known is the share of letters in words of a script that some language was learned with, whichever their labels. A null text and
    one without a letter (marks alone are none) get `und`, 0 and no spans, and so does every text if nothing was learned. A word in a script that
    no language was learned with is open to all languages and adds nothing to the score. Columns of the input with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans", "known")
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log, model.uses))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += ", lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>, known double"
    column = docs.columns.index(text)
    span_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def label(texts: list[str]) -> tuple[list[str], np.ndarray, pa.Array, np.ndarray]:
        languages, log, uses = shared.value
        w = Words(texts)
        n, most = len(texts), len(languages)
        if not most or not len(w.starts):
            return ["und"] * n, np.zeros(n), pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], span_type)), np.zeros(n)
        scores = np.empty((len(w.first), most))
        for a in range(0, len(w.first), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(w.first))
            grams = w.grams[w.first[a] : w.first[b] if b < len(w.first) else None]
            scores[a:b] = np.add.reduceat(log[grams], w.first[a:b] - w.first[a], axis=0, dtype=np.float64)
        open_to = uses[w.scripts]
        scores = np.where(open_to | ~open_to.any(1, keepdims=True), scores, -1e6)
        firsts = np.searchsorted(w.rows, np.arange(n + 1))
        labels = _viterbi(scores, firsts[:-1], np.diff(firsts), penalty)
        letters = np.bincount(w.rows * most + labels, weights=w.sizes, minlength=n * most).reshape(n, most)
        top = letters.argmax(1)
        total = letters.sum(1)
        pick = top[w.rows]
        lead = scores[np.arange(len(scores)), pick]
        others = scores.copy()
        others[np.arange(len(scores)), pick] = -np.inf
        gap = np.clip(lead - others.max(1), -20, 20) if most > 1 else np.full(len(scores), 20.0)
        own = labels == pick
        ahead = np.bincount(w.rows[own], weights=gap[own], minlength=n) / np.maximum(1, np.bincount(w.rows[own], minlength=n))
        known = np.bincount(w.rows * most + labels, weights=w.sizes * open_to.any(1), minlength=n * most).reshape(n, most)
        share = known[np.arange(n), top] / np.maximum(1, total)
        score = np.clip(share / (1 + np.exp(-np.clip(ahead, -30, 30))), 0, 1)
        new = np.ones(len(labels), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (w.rows[1:] != w.rows[:-1])
        opens = np.flatnonzero(new)
        last = np.append(opens[1:], len(labels)) - 1
        names = pa.array(languages).take(pa.array(labels[opens].astype(np.int32)))
        spans = pa.StructArray.from_arrays([pa.array(w.origin[opens].astype(np.int32)), pa.array((w.origin[last] + w.sizes[last]).astype(np.int32)), names], fields=list(span_type))
        offsets = np.searchsorted(w.rows[opens], np.arange(n + 1)).astype(np.int32)
        return [languages[t] if k else "und" for t, k in zip(top, total, strict=True)], score, pa.ListArray.from_arrays(pa.array(offsets), spans), known.sum(1) / np.maximum(1, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(column).to_pylist(), SLICE_CHARS * HELD_LANGUAGES // max(HELD_LANGUAGES, len(shared.value[0]))):
                found, score, spans, known = label(texts)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array(score), spans, pa.array(known)], names=[*batch.schema.names, "lang_pred", "score", "spans", "known"])

    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learns from all labelled texts that are not held out."""
    return LanguageModel(cut(language_counts(docs.where(~held_out(id_col)), text, lang)))


def language_table(docs: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, the language and the score. Only texts are looked at."""
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify_languages(rows, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")
