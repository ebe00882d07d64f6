"""Finding many phrases in many texts at once: NumPy over the bytes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are searched in slices of about so many bytes, so that what is kept for each byte or space of them stays small.
SLICE = 1 << 22
#: A key goes on to the exact table only if one of so many bits is set.
FILTER_BITS = 18
_SPACE = ord(" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _side(n: int) -> int:
    """How many bytes of n stand in an anchor: 0, 1, 2 or 4."""
    return 4 if n >= 4 else min(n, 2)


def _ints(data: np.ndarray) -> np.ndarray:
    """The four bytes that begin at each place, as one number; copied, as NumPy would copy all of them at each look-up."""
    return np.ndarray(max(0, len(data) - 3), "<u4", data, strides=(1,)).copy()


def _low(n: int) -> np.uint32:
    return np.uint32((1 << 8 * n) - 1)


class _Shape:
    """Anchors with so many bytes before and after a place."""

    def __init__(self, before: int, after: int, keys: np.ndarray, phrases: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.high, self.low, self.phrases = ~_low(4 - before), _low(after), phrases[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def key(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return (before & self.high).astype(np.uint64) << np.uint64(32) | (after & self.low).astype(np.uint64)

    def met(self, places: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase) for every phrase whose anchor is there."""
        keys = self.key(before, after)
        some = np.flatnonzero(self.maybe[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = self.keys[at] == keys[some]
        some, at = some[same], at[same]
        n = self.first[at + 1] - self.first[at]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(places[some], n), self.phrases[np.repeat(self.first[at], n) + within]


class Finder:
    """Phrases by anchors: up to four bytes on either side of that space of a phrase which has most of them; a phrase without a space has
    its first bytes. Every meeting of an anchor is compared with the whole phrase."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = [np.frombuffer(p.encode(), np.uint8) for p in phrases]
        self.offsets = np.zeros(len(phrases), np.int64)
        spaced: dict[tuple[int, int], list[int]] = {}
        lone: dict[tuple[int, int], list[int]] = {}
        for i, p in enumerate(self.phrases):
            spaces = np.flatnonzero(p == _SPACE).tolist()
            if spaces:
                self.offsets[i] = max(spaces, key=lambda s: _side(s) + _side(len(p) - s - 1))
                spaced.setdefault((_side(int(self.offsets[i])), _side(len(p) - int(self.offsets[i]) - 1)), []).append(i)
            else:
                lone.setdefault((0, _side(len(p))), []).append(i)
        self.spaced, self.lone = [self._shape(k, v, 1) for k, v in spaced.items()], [self._shape(k, v, 0) for k, v in lone.items()]

    def _shape(self, shape: tuple[int, int], phrases: list[int], skip: int) -> _Shape:
        before, after = np.zeros(len(phrases), np.uint32), np.zeros(len(phrases), np.uint32)
        for j, i in enumerate(phrases):
            padded, at = np.pad(self.phrases[i], 4), 4 + int(self.offsets[i])
            before[j], after[j] = padded[at - 4 : at].view("<u4")[0], padded[at + skip : at + skip + 4].view("<u4")[0]
        made = _Shape(*shape, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return _Shape(*shape, made.key(before, after), np.array(phrases))

    def find(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, phrase), each pair once: the texts that hold a phrase. Nulls hold nothing."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        rows, found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            row, phrase = self._in_slice(np.pad(whole[ends[at] : ends[to]], 4), ends[at : to + 1] - ends[at] + 4)
            rows.append(row + at)
            found.append(phrase)
            at = to
        return np.concatenate(rows), np.concatenate(found)

    def _in_slice(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ints, met = _ints(data), []
        if self.spaced:
            places = np.flatnonzero(data[4:-4] == _SPACE) + 4
            before, after = ints[places - 4], ints[places + 1]
            met += [s.met(places, before, after) for s in self.spaced]
        if self.lone:
            places = np.arange(4, len(data) - 4)
            met += [s.met(places, ints[places - 4], ints[places]) for s in self.lone]
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for places, phrases in met:
            order = np.argsort(phrases, kind="stable")
            places, phrases = places[order], phrases[order]
            heads = np.flatnonzero(np.diff(phrases, prepend=-1))
            for i, own in zip(phrases[heads].tolist(), np.split(places, heads[1:])):
                row = self._confirmed(data, ints, ends, i, own)
                rows.append(row)
                found.append(np.full(len(row), i))
        return np.concatenate(rows), np.concatenate(found)

    def _confirmed(self, data: np.ndarray, ints: np.ndarray, ends: np.ndarray, i: int, places: np.ndarray) -> np.ndarray:
        """The rows in which the whole phrase stands at one of these places of its anchor."""
        phrase, starts = self.phrases[i], places - self.offsets[i]
        n = len(phrase)
        row = np.searchsorted(ends, starts, side="right") - 1
        fits = (row >= 0) & (row < len(ends) - 1)
        fits[fits] = starts[fits] + n <= ends[row[fits] + 1]
        row, starts = row[fits], starts[fits]
        wide = _ints(phrase)
        for j in [*range(0, n - 3, 4), *([n - 4] if n % 4 else [])] if n >= 4 else range(n):
            same = ints[starts + j] == wide[j] if n >= 4 else data[starts + j] == phrase[j]
            row, starts = row[same], starts[same]
        return np.unique(row)
