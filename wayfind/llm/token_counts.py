"""Token counts of whole texts by a compiled word transducer.

The tokenizer is a cascade: special strings cut the raw text, a small automaton over character classes cuts the
normalised rest into words, and byte-pair merges split each word. The merge stage is compiled into one deterministic
transducer. After a prefix of a word, the tokens of that prefix are fixed by its last token, and a token may follow
another only if merging both together gives just these two; so a state needs the last token at each earlier place from
which a vocabulary token can still grow, and a transition on a byte carries the change of the number of tokens.
Transitions are compiled when first met and kept. White space, special strings and text ends reset the machine, so any
piece of text between two resets maps every state to the start and a count, and maps compose by adding: a prefix sum
over the words of a batch, read off at the text ends, gives the counts. A long word is cut at fixed places into chunks that
are walked side by side; each one's state map holds the states that can enter it, and the maps are composed by a scan.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.textarrays import _BASE, _INVERSE, _power, mix

#: A worker keeps at most so many compiled transitions; beyond that it starts anew. The counts don't depend on it.
MOST_TRANSITIONS = 500_000
#: Texts are put through in runs of about so many characters; longer ones are cut at white space, which resets.
SLICE_CHARS = 1 << 20
#: Bytes of the chunks of words that are longer than two of them, and bytes before a chunk from which its first state is guessed.
CHUNK, WARM = 256, 64

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_RESET = re.compile(r"\s")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point: white space, letter, number or other."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = LETTER
        elif kind == "N":
            kinds[c] = NUMBER
    # Unicode's White_Space property
    for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        kinds[c] = SPACE
    return kinds


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _no_moves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)


def _joined(a: tuple, b: tuple) -> tuple:
    """Two tables of transitions sorted by (state, symbol) as one."""
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


def _looked_up(table: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, to, change = table
    if not len(keys):
        none = np.zeros(len(wanted), np.int32)
        return none, none.copy(), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return to[at], change[at], keys[at] == wanted


class WordTransducer:
    """A byte-pair vocabulary with an end-of-word mark as a deterministic transducer over symbols.

    Symbols 0..255 are bytes, 256..511 a word's last byte. State 0 is the start of a word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.end = model["end_of_word_suffix"]
        letters = _byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(self.end)
            out = [letters[c] for c in (token.removesuffix(self.end) if last else token)]
            return tuple([*out[:-1], out[-1] + 256] if last else out)

        self.rank: dict[tuple[tuple, tuple], int] = {}
        self.parts: dict[tuple, tuple[tuple, tuple]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            a, b = symbols(a), symbols(b)
            self.rank.setdefault((a, b), r)
        self.tokens: set[tuple] = {(s,) for s in range(512)}
        for (a, b) in sorted(self.rank, key=self.rank.get):
            if a in self.tokens and b in self.tokens and a + b not in self.tokens and self.merged(a + b) == [a + b]:
                self.tokens.add(a + b)
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fits: dict[tuple, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {((), ()): 0}
        self.keys: list[tuple] = [((), ())]
        self.table, self.recent = _no_moves(), _no_moves()

    def merged(self, word: tuple) -> list[tuple]:
        """Merging by rank, leftmost first: the definition, used on tokens and pairs of them."""
        parts = [(s,) for s in word]
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, a: tuple, b: tuple) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.merged(a + b) == [a, b]
        return known

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the change of the number of tokens.

        A state is (suffix, lasts): the longest suffix from which a token can grow, and for each split of it the last
        token before and the number of tokens there less the number now.
        """
        suffix, lasts = self.keys[state]
        word = (*suffix, symbol)
        before = lasts if lasts else ((None, 0),)
        for i in range(len(word)):
            piece = word[i:]
            last, n = before[i]
            if piece in self.tokens and (last is None or self.may_follow(last, piece)):
                change = n + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        if symbol >= 256:
            return 0, change
        own = (piece, 0)
        for i in range(len(word) + 1):
            if i == len(word) or word[i:] in self.prefixes:
                key = (word[i:], tuple((x, n - change) for x, n in before[i:]) + (own,))
                break
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
        return to, change

    def moves(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transitions of many words at once; those not met before are compiled."""
        wanted = states.astype(np.int64) << 9 | symbols
        to, change, known = _looked_up(self.table, wanted)
        left = np.flatnonzero(~known)
        if len(left):
            to[left], change[left], known[left] = _looked_up(self.recent, wanted[left])
            left = left[~known[left]]
        if len(left):
            fresh = np.unique(wanted[left])
            both = np.array([self.step(k >> 9, k & 511) for k in fresh.tolist()], np.int32)
            self.recent = _joined(self.recent, (fresh, both[:, 0], both[:, 1]))
            to[left], change[left], _ = _looked_up(self.recent, wanted[left])
            if len(self.recent[0]) > 20_000:
                self.table, self.recent = _joined(self.table, self.recent), _no_moves()
        return to, change

    def walk(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last state and the number of tokens of each run data[start : start + length] from its state on, all runs a
        byte further in each round; a final run ends a word."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, states, final = starts[order], lengths[order], states[order].astype(np.int32), final[order]
        totals = np.zeros(len(starts), np.int64)
        n = len(starts)
        at = 0
        while n:
            symbols = data[starts[:n] + at].astype(np.int64)
            symbols += (final[:n] & (lengths[:n] == at + 1)) * 256
            states[:n], change = self.moves(states[:n], symbols)
            totals[:n] += change
            at += 1
            n = int(np.searchsorted(-lengths, -at, side="left"))
        ends, counted = np.empty_like(states), np.empty_like(totals)
        ends[order], counted[order] = states, totals
        return ends, counted

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start : start + length]."""
        if len(self.table[0]) > MOST_TRANSITIONS:
            self.clear()
        out = np.zeros(len(starts), np.int64)
        long = lengths > 2 * CHUNK
        out[long] = self.composed(data, starts[long], lengths[long])
        short = ~long
        out[short] = self.walk(data, starts[short], lengths[short], np.zeros(short.sum(), np.int32), np.ones(short.sum(), bool))[1]
        return out

    def composed(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each long word by its chunks' state maps.

        A chunk's map begins with one guessed state, and takes in every state in which a map before it ends until none is
        new; so it is exact, whether guesses are right or not. Then the maps are composed by doubling.
        """
        if not len(starts):
            return np.zeros(0, np.int64)
        per = -(-lengths // CHUNK)
        word = np.repeat(np.arange(len(starts)), per)
        heads = np.cumsum(per) - per
        nth = np.arange(len(word)) - heads[word]
        at = starts[word] + nth * CHUNK
        size = np.minimum(CHUNK, lengths[word] - nth * CHUNK)
        last = nth == per[word] - 1
        later = np.flatnonzero(nth > 0)
        entry = np.zeros(len(word), np.int64)
        entry[later] = self.walk(data, at[later] - WARM, np.full(len(later), WARM), np.zeros(len(later), np.int32), np.zeros(len(later), bool))[0]
        # a node is a chunk and a state that enters it
        fresh = np.arange(len(word)) << 32 | entry
        nodes, to, counted = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(fresh):
            chunk = fresh >> 32
            ends, n = self.walk(data, at[chunk], size[chunk], fresh & 0xFFFFFFFF, last[chunk])
            goes = np.where(last[chunk], -1, chunk + 1 << 32 | ends)
            order = np.argsort(np.concatenate([nodes, fresh]), kind="stable")
            nodes, to, counted = (np.concatenate(x)[order] for x in ((nodes, fresh), (to, goes), (counted, n)))
            fresh = np.setdiff1d(goes[goes >= 0], nodes)
        # the node after each one; beyond a word's last chunk stands one that counts nothing and follows itself
        after = np.append(np.where(to >= 0, np.searchsorted(nodes, to), len(nodes)), len(nodes))
        totals = np.append(counted, 0)
        for _ in range(int(per.max()).bit_length()):
            totals = totals + totals[after]
            after = after[after]
        return totals[np.searchsorted(nodes, heads << 32)]


@lru_cache(2)
def _transducer(path: str) -> WordTransducer:
    return WordTransducer(path)


def _pieces(text: str, specials: re.Pattern | None) -> Iterator[tuple[str, int]]:
    """The normalised runs of a raw text between resets, and the special strings met before each."""
    parts = specials.split(text) if specials else [text]
    for i, part in enumerate(parts):
        at = 0
        while True:
            cut = _RESET.search(part, at + SLICE_CHARS)
            piece = part[at : cut.end()] if cut else part[at:]
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            # lower case goes character by character: no final sigma
            yield piece.replace("\u03a3", "\u03c3").lower(), int(i > 0 and at == 0)
            if not cut:
                break
            at = cut.end()


def _word_counts(path: str, pieces: list[str]) -> np.ndarray:
    """Tokens of each piece."""
    lengths = np.array([len(x) for x in pieces], np.int64)
    ends = np.cumsum(lengths)
    whole = "".join(pieces)
    n = len(whole)
    if not n:
        return np.zeros(len(pieces), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kinds = _classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[0] = True
    fresh[ends] = True
    start = fresh[:n].copy()
    start[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    # 's 't 'm 'd 're 've 'll are words of their own where a word starts with the apostrophe
    for p in np.flatnonzero((points == 39) & start).tolist():
        rest = whole[p + 1 : p + 3]
        more = 1 if rest[:1] in ("s", "t", "m", "d") and rest else 2 if rest in ("re", "ve", "ll") else 0
        if more and not fresh[p + 1 : p + 1 + more].any():
            start[p + 1] = False
            if p + 1 + more < n and (kinds[p + 1 + more] == LETTER):
                start[p + 1 + more] = True
    starts = np.flatnonzero(start)
    stops = np.append(starts[1:], n)
    real = kinds[starts] != SPACE
    starts, stops = starts[real], stops[real]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * _power("up", _BASE, n)[:n], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * _power("down", _INVERSE, n)[starts])
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    at_byte = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at_byte[1:])
    data = np.frombuffer(whole.encode(), np.uint8)
    words_at = at_byte[starts[first]]
    each = _transducer(path).counts(data, words_at, at_byte[stops[first]] - words_at)
    # the prefix scan: the count up to each word, read at the ends of the pieces
    scan = np.concatenate([[0], np.cumsum(each[inverse])])
    upto = scan[np.searchsorted(starts, ends, side="left")]
    return np.diff(upto, prepend=0)


def count_tokens(docs: DataFrame, text: str = "text", *, path: str, out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens that the tokenizer file at `path` gives for each whole text, as a bigint.

    `path` is a byte-level byte-pair file with an end-of-word mark (read on each executor; it comes with the Python
    installation; of its added tokens only the strings are read). No begin, end or added tokens; special strings inside a text count one token each. A null or empty
    text has 0. Texts of any length are handled in bounded slices. Rows, their order and other columns stay as they
    are; a column named as `out` is replaced.
    """
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            pieces: list[str] = []
            rows: list[int] = []
            held = 0

            def flush() -> None:
                nonlocal held
                np.add.at(totals, rows, _word_counts(path, pieces))
                pieces.clear()
                rows.clear()
                held = 0

            for row, value in enumerate(batch.column(at)):
                for piece, extra in _pieces(value.as_py() or "", pattern):
                    totals[row] += extra
                    pieces.append(piece)
                    rows.append(row)
                    held += len(piece)
                    if held >= SLICE_CHARS:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def token_table(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: bytes, tokens and whether the tokens pass the limit."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, "text", path=path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
