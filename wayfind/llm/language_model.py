"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Units are the commonest training words, the end of a text, and signatures (hashed endings) that stand for all other words.
Exchange clustering gives each unit a class: units are dealt into a fixed number of groups by hash, and each group, in the
order of its units, moves every unit to the class with the most gain in the likelihood of the class bigrams, on a table of
its own; between sweeps Spark sums the class bigrams anew, and a sweep counts only if they are likelier than before (else
half of its groups are taken, and so on). Then every other training word, however rare, gets a class of its own by one
exchange of the same kind, from all the classes that stand before it: so what is learnt grows with the texts. Such a word
is emitted by its own class; as the word before another one it counts by the class of its signature. All classes depend on
the texts alone, not on how rows lie in partitions. A text's probability is the product over its tokens of
P(class | class before) * P(word | class), both smoothed; unknown words have one place in every class, so the model sums
to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.support import cut
from wayfind.llm.textarrays import list_array, mix, released, string_slices, words

#: The head: at most so many words, the commonest, whose counts each task holds (16 bytes each). Counts of all others are joined.
HEAD = 1 << 17
#: Words of the head that are units of the exchange, and signatures that stand for all others in it.
CLUSTERED, SIGNATURES = 1 << 14, 1 << 11
CLASSES, SWEEPS = 64, 3
DELTA, ALPHA = 0.5, 20.0
WORDS_AT_ONCE = 1 << 20
#: Groups of units that are exchanged side by side; of a refused sweep half of the groups are tried, down to one.
GROUPS = 64


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashed last three bytes of each word, A-Z lowered."""
    code = np.zeros(len(starts), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        b = data[np.maximum(at, 0)]
        b = b | ((b >= 65) & (b <= 90)).view(np.uint8) << 5
        code = code << np.uint64(8) | np.where(at >= starts, b, 0).astype(np.uint64)
    return (mix(code) % np.uint64(SIGNATURES)).astype(np.int32)


def _counted(keys: list[np.ndarray], extra: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    flat = np.concatenate(keys)
    if extra is None:
        k, n = np.unique(flat, return_counts=True)
        return k, n
    k, first, n = np.unique(flat, return_index=True, return_counts=True)
    return k, np.concatenate(extra)[first], n


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, sig, c): the 64-bit hash of each word, its signature and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(hashes: list, sigs: list) -> pa.RecordBatch:
            k, s, n = _counted(hashes, sigs)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s), pa.array(n.astype(np.int64))], names=["word", "sig", "c"])

        hashes, sigs, held = [], [], 0
        for batch in batches:
            for _, data, offsets in string_slices(batch.column(0)):
                starts, ends, _, h = words(data, offsets)
                hashes.append(h)
                sigs.append(_signatures(data, starts, ends))
                held += len(h)
                if held >= WORDS_AT_ONCE:
                    yield out(hashes, sigs)
                    hashes, sigs, held = [], [], 0
        if held:
            yield out(hashes, sigs)

    return docs.select(text).mapInArrow(lambda batches: released(run(batches)), "word long, sig int, c long").groupBy("word", "sig").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The commonest words, sorted by hash: count and unit of each, and the least level of count among them."""

    words: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    clustered: int
    level: int

    @property
    def end(self) -> int:
        return self.clustered

    @property
    def size(self) -> int:
        return self.clustered + 1 + SIGNATURES

    def look(self, hashes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count or 0, unit, place in the head or -1) of each word."""
        own = self.clustered + 1 + sigs
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), own, np.full(len(hashes), -1)
        h = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        unit = np.where(hit & (self.units[at] >= 0), self.units[at], own)
        return np.where(hit, self.counts[at], 0), unit, np.where(hit, at, -1)


def _level() -> Column:
    return F.floor(16 * F.log2("c")).cast("int")


def _head(counts: DataFrame) -> Head:
    """At most HEAD words: those above a power of 2 ** (1/16) that leaves so many."""
    level = _level()
    left = HEAD
    least = None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 16 * 63 rows
        if row["count"] > left:
            break
        left -= row["count"]
        least = row["level"]
    if least is None:
        return Head(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0, 1 << 20)
    rows = counts.where(level >= least).select("word", "c").toPandas()
    word, c = rows["word"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
    order = np.lexsort((word, -c))
    units = np.full(len(word), -1, np.int32)
    top = order[:CLUSTERED]
    units[top] = np.arange(len(top))
    by = np.argsort(word)
    return Head(word[by], c[by], units[by], len(top), least)


def _unit_rows(data: np.ndarray, offsets: np.ndarray, head: Head):
    """Tokens of the rows with the end of each: row, unit, count and place in the head, hash, signature; and where each row's
    end is."""
    starts, ends, rows, hashes = words(data, offsets)
    sigs = _signatures(data, starts, ends)
    count, unit, place = head.look(hashes, sigs)
    n = len(offsets) - 1
    per = np.bincount(rows, minlength=n)
    stops = np.cumsum(per + 1) - 1
    total = len(rows) + n
    to = np.arange(len(rows)) + rows
    all_units = np.full(total, head.end, np.int64)
    all_units[to] = unit
    return rows, to, all_units, stops, count, place, hashes, sigs, per


def unit_bigrams(docs: DataFrame, text: str, shared) -> DataFrame:
    """(pair, n): unit before * units + unit, over the texts; the unit before a first word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list) -> pa.RecordBatch:
            k, n = _counted(keys)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["pair", "n"])

        keys, held = [], 0
        for batch in batches:
            for _, data, offsets in string_slices(batch.column(0)):
                units = _unit_rows(data, offsets, shared.value)[2]
                before = np.empty_like(units)
                before[0] = shared.value.end
                before[1:] = units[:-1]  # a row's last unit is the end, so the next row starts after one
                keys.append(before * shared.value.size + units)
                held += len(units)
                if held >= WORDS_AT_ONCE:
                    yield out(keys)
                    keys, held = [], 0
        if held:
            yield out(keys)

    return docs.select(text).mapInArrow(lambda batches: released(run(batches)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _neighbours(bigrams: DataFrame, size: int) -> DataFrame:
    """A row for each unit: its neighbours on both sides and how often; at most 2 * size entries."""
    a, b = F.floor(F.col("pair") / size).cast("int"), F.pmod("pair", F.lit(size)).cast("int")
    both = bigrams.select(F.explode(F.array(F.struct(a.alias("unit"), b.alias("other"), F.lit(1).alias("side"), "n"), F.struct(b.alias("unit"), a.alias("other"), F.lit(0).alias("side"), "n"))).alias("x")).select("x.*")
    code = (F.col("other") * 2 + F.col("side")).cast("int")
    rows = both.groupBy("unit").agg(F.collect_list(F.struct(code.alias("code"), F.col("n"))).alias("x"))
    return rows.select("unit", F.col("x.code").alias("codes"), F.col("x.n").alias("ns"), F.pmod(F.xxhash64("unit"), F.lit(GROUPS)).cast("int").alias("part")).repartition(GROUPS, "part").sortWithinPartitions("part", "unit")


def _units_of(batches: Iterator[pa.RecordBatch], classes: np.ndarray):
    """For each unit: its group, counts of the classes to its left and right without itself, and how often it follows itself."""
    k = CLASSES
    for batch in batches:
        codes, ns = batch.column(1), batch.column(2)
        for row, (unit, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            code, n = codes[row].values.to_numpy(), ns[row].values.to_numpy()
            other, side = code >> 1, code & 1
            mine = other == unit
            own = int(n[mine & (side == 1)].sum())
            keep = ~mine & (classes[other] >= 0)
            both = np.bincount(side[keep] * k + classes[other[keep]], weights=n[keep], minlength=2 * k)
            yield part, unit, both[:k], both[k:], own


def _class_bigrams(units: DataFrame, classes: np.ndarray) -> np.ndarray:
    """The number of each class after each class, summed by Spark: CLASSES ** 2 numbers."""
    shared = units.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CLASSES))
        for _, unit, _, right, own in _units_of(batches, shared.value):
            c = shared.value[unit]
            if c >= 0:
                total[c] += right
                total[c, c] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for row in units.mapInArrow(lambda batches: released(run(batches)), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out.reshape(CLASSES, CLASSES)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """What of the class bigram model's log likelihood depends on the classes."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def _sweep(units: DataFrame, classes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One exchange of every unit that may move: units, their new classes and their groups."""
    shared = units.sparkSession.sparkContext.broadcast((classes, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_classes, start = shared.value
        n, before, after, last = start, start, start, -1
        diagonal = np.arange(CLASSES)
        moved = []
        for part, unit, left, right, own in _units_of(batches, own_classes):
            if part != last:
                n, last = start.copy(), part
                before, after = n.sum(1), n.sum(0)
            c = own_classes[unit]
            if c == 0:  # the end keeps a class of its own
                continue
            out, into = right.sum() + own, left.sum() + own
            if c >= 0:
                n[c] -= right
                n[:, c] -= left
                n[c, c] -= own
                before[c] -= out
                after[c] -= into
                before -= left
                after -= right
            if out + into == 0:
                best = c if c > 0 else 1 + unit % (CLASSES - 1)
            else:
                gain = (_f(n + right[None, :]) - _f(n)).sum(1) + (_f(n + left[:, None]) - _f(n)).sum(0)
                d = n[diagonal, diagonal]
                gain += _f(d + right + left + own) + _f(d) - _f(d + right) - _f(d + left)
                gain -= _f(before + out) - _f(before) + _f(after + into) - _f(after)
                gain[0] = -np.inf
                best = int(gain.argmax())
            n[best] += right
            n[:, best] += left
            n[best, best] += own
            before[best] += out
            after[best] += into
            before += left
            after += right
            moved.append((unit, best, part))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in moved], pa.int32()) for k in range(3)], names=["unit", "class", "part"])

    rows = units.mapInArrow(lambda batches: released(run(batches)), "unit int, class int, part int").toPandas()  # a row per unit, CLUSTERED + SIGNATURES at most
    return rows["unit"].to_numpy(np.int64), rows["class"].to_numpy(), rows["part"].to_numpy()


def exchange(units: DataFrame, classes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and class bigrams after one sweep; they are never less likely, once every unit has a class."""
    unit, best, part = _sweep(units, classes, table)
    first = bool((classes[unit] < 0).any())
    groups = GROUPS
    while groups:
        new, taken = classes.copy(), part < groups
        new[unit[taken]] = best[taken]
        counted = _class_bigrams(units, new)
        if first or likelihood(counted) >= likelihood(table):
            return new, counted
        groups //= 2
    return classes, table


def _before_words(docs: DataFrame, text: str, shared) -> DataFrame:
    """(word, sig, befores, ns): for every word that is no unit of its own, the classes before it and how often each one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = shared.value

        def out(found: list) -> pa.RecordBatch:
            word, sig, before = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((before, word))
            word, sig, before = word[order], sig[order], before[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
            first = np.flatnonzero(new)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (word[first], sig[first], before[first], np.diff(np.append(first, len(word))))], names=["word", "sig", "before", "n"])

        found, held = [], 0
        for batch in batches:
            for _, data, offsets in string_slices(batch.column(0)):
                _, to, units, _, _, _, hashes, sigs, _ = _unit_rows(data, offsets, head)
                rare = np.flatnonzero(units[to] > head.end)
                # before a row's first word is the end of the row before it; place -1 is the end of the last row
                found.append((hashes[rare].view(np.int64), sigs[rare], classes[units[to[rare] - 1]].astype(np.int32)))
                held += len(rare)
                if held >= WORDS_AT_ONCE // 2:
                    yield out(found)
                    found, held = [], 0
        if held:
            yield out(found)

    rows = docs.select(text).mapInArrow(lambda batches: released(run(batches)), "word long, sig int, before int, n long")
    # dealt by word once; both sums keep to that. A word has CLASSES entries at most
    each = rows.repartition("word").groupBy("word", "before").agg(F.min("sig").alias("sig"), F.sum("n").alias("n"))
    listed = each.groupBy("word").agg(F.min("sig").alias("sig"), F.sort_array(F.collect_list(F.struct("before", "n"))).alias("x"))
    return listed.select("word", "sig", F.col("x.before").alias("befores"), F.col("x.n").alias("ns"))


def _gains(before: np.ndarray, n: np.ndarray, first: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the likelihood gains from each word in each class, all words against one table; a word's entries begin at first."""
    word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
    total, columns = np.add.reduceat(n, first), table.sum(0)
    around = table[before]
    gains = np.add.reduceat(_f(around + n[:, None]) - _f(around), first) - (_f(columns + total[:, None]) - _f(columns))
    # in its own class it is counted already
    own = table[before, old[word]]
    gains[np.arange(len(first)), old] = np.add.reduceat(_f(own) - _f(own - n), first) - (_f(columns[old]) - _f(columns[old] - total))
    gains[:, 0] = -np.inf
    return gains


def assign(found: DataFrame, own: np.ndarray, table: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, c, kind): a class for every word of _before_words, and the class bigrams with them; never less likely.

    own: the class of each signature, as which the words are counted in the table that is given.
    """
    shared = found.sparkSession.sparkContext.broadcast((own, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, start = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lengths = np.diff(batch.column(2).offsets.to_numpy())
                before, n = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.float64)
                old = signatures[batch.column(1).to_numpy()]
                first = np.cumsum(lengths) - lengths
                best = _gains(before, n, first, old, start).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.add.reduceat(n, first).astype(np.int64)), pa.array(old.astype(np.int32)), pa.array(best.astype(np.int32)), batch.column(2), batch.column(3)], names=["word", "c", "old", "best", "befores", "ns"])

    rows = cut(found.mapInArrow(lambda batches: released(run(batches)), "word long, c long, old int, best int, befores array<int>, ns array<long>"))
    part = F.pmod(F.xxhash64("word"), F.lit(GROUPS))
    groups = GROUPS
    while groups:
        moved = rows.where((part < groups) & (F.col("best") != F.col("old"))).select("old", "best", F.explode(F.arrays_zip("befores", "ns")).alias("x"))
        ends = F.array(*[F.struct((F.col("x.befores") * CLASSES + F.col(k)).alias("at"), (sign * F.col("x.ns")).alias("n")) for k, sign in (("best", 1), ("old", -1))])
        new = table.copy().ravel()
        for row in moved.select(F.explode(ends).alias("y")).groupBy("y.at").agg(F.sum("y.n").alias("n")).collect():  # CLASSES ** 2 rows at most
            new[row["at"]] += row["n"]
        new = new.reshape(CLASSES, CLASSES)
        if likelihood(new) >= likelihood(table):
            table = new
            break
        groups //= 2
    return rows.select("word", "c", F.when(part < groups, F.col("best")).otherwise(F.col("old")).alias("kind")), table


@dataclass
class ClassModel:
    head: Head
    #: the class of each unit, and that of each word of the head
    classes: np.ndarray
    kinds: np.ndarray
    #: log10 P(class | class before)
    transition: np.ndarray
    #: what a count plus DELTA is divided by, for each class
    emission: np.ndarray
    total: int
    vocabulary: int
    ends: int


def train(docs: DataFrame, text: str = "text") -> tuple[ClassModel, DataFrame]:
    """The model of all the texts, and a table (word, c, kind) of the words that are no units: hash, count and class."""
    context = docs.sparkSession.sparkContext
    counts = cut(word_counts(docs, text))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = docs.count()
    head = _head(counts)
    shared = context.broadcast(head)
    units = cut(_neighbours(unit_bigrams(docs, text, shared), head.size))
    # the end in class 0, the commonest words as first members of the others, all else open
    classes = np.full(head.size, -1, np.int32)
    classes[head.end] = 0
    seeds = min(CLASSES - 1, head.clustered)
    classes[:seeds] = np.arange(1, seeds + 1)
    table = _class_bigrams(units, classes)
    for _ in range(SWEEPS):
        classes, table = exchange(units, classes, table)
    never = classes < 0
    classes[never] = 1 + np.flatnonzero(never) % (CLASSES - 1)
    found = _before_words(docs, text, context.broadcast((head, classes)))
    others, table = assign(found, classes[head.clustered + 1 :], table)
    share = (table.sum(0) + 1) / (table.sum() + CLASSES)
    transition = np.log10((table + ALPHA * share[None, :]) / (table.sum(1, keepdims=True) + ALPHA))
    kinds = np.zeros(CLASSES)
    np.add.at(kinds, classes[: head.clustered], 1)
    for row in others.groupBy("kind").count().collect():  # CLASSES rows
        kinds[row["kind"]] += row["count"]
    own = np.where(head.units >= 0, classes[head.units], 0)
    rest = others.where(_level() >= head.level).select("word", "kind").toPandas()  # words of the head
    own[np.searchsorted(head.words, rest["word"].to_numpy(np.int64))] = rest["kind"].to_numpy()
    emission = table.sum(0) + DELTA * (kinds + 1)
    return ClassModel(head, classes, own, transition, emission, int(n) + ends, int(v) + (ends > 0), ends), others


def score_texts(docs: DataFrame, model: ClassModel, others: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, base_score, score and perplexity to the rows.

    score is the model's log10 probability of the whole text with its end, perplexity 10 ** (-score / n_tokens), and base_score
    that of single words with a half added to each count. A null or empty text is one token, the end. Words outside
    the head are joined with their counts and classes by hash; the rows of a text are told apart by a number of their own, so repeated ids
    are no matter. Columns of the input with these names are replaced.
    """
    docs = docs.drop("n_tokens", "n_known", "base_score", "score", "perplexity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base_of = float(model.total + DELTA * (model.vocabulary + 1))
    column = docs.columns.index(text)
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema += ", __tokens long, __known long, __base double, __score double, __words array<long>, __codes array<int>, __ns array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rest = [c for i, c in enumerate(batch.columns) if i != column]
            for at, data, offsets in string_slices(batch.column(column)):
                rows, to, units, stops, count, place, hashes, _, per = _unit_rows(data, offsets, m.head)
                n = len(per)
                kinds = m.classes[units]
                before = np.zeros(len(units), np.int64)
                before[1:] = kinds[:-1]
                inside = place >= 0
                kinds[to[inside]] = m.kinds[place[inside]]
                word_kind = kinds[to]
                move = m.transition[before, kinds]
                move[to[~inside]] = 0
                moves = np.add.reduceat(move, np.concatenate([[0], stops[:-1] + 1]))
                base = np.bincount(rows[inside], weights=np.log10((count[inside] + DELTA) / base_of), minlength=n).astype(np.float64)
                emit = np.bincount(rows[inside], weights=np.log10((count[inside] + DELTA) / m.emission[word_kind[inside]]), minlength=n).astype(np.float64)
                known = np.bincount(rows[inside], minlength=n)
                base += math.log10((m.ends + DELTA) / base_of)
                emit += math.log10((m.ends + DELTA) / m.emission[0])
                # the others: each word once per text and class before it, with the class that it has if it is unknown
                out = np.flatnonzero(~inside)
                code = before[to] * CLASSES + word_kind
                order = np.lexsort((code[out], hashes[out], rows[out]))
                out = out[order]
                new = np.ones(len(out), bool)
                new[1:] = (hashes[out[1:]] != hashes[out[:-1]]) | (rows[out[1:]] != rows[out[:-1]]) | (code[out[1:]] != code[out[:-1]])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(out))).astype(np.int32)
                out = out[first]
                lists = np.bincount(rows[out], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, n) for c in rest], pa.array(per + 1), pa.array(known + (m.ends > 0)), pa.array(base), pa.array(moves + emit), list_array(hashes[out].view(np.int64), lists, pa.int64()), list_array(code[out].astype(np.int32), lists, pa.int32()), list_array(times, lists, pa.int32())],
                    names=[*[x for i, x in enumerate(batch.schema.names) if i != column], "__tokens", "__known", "__base", "__score", "__words", "__codes", "__ns"],
                )

    rows = cut(docs.mapInArrow(lambda batches: released(run(batches)), schema).withColumn("__row", F.monotonically_increasing_id()))
    tail = rows.select("__row", F.explode(F.arrays_zip("__words", "__codes", "__ns")).alias("x")).select("__row", F.col("x.__words").alias("word"), F.col("x.__codes").alias("code"), F.col("x.__ns").alias("n"))
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(others, "word", "left").withColumn("at", F.coalesce(F.col("code") - F.col("code") % CLASSES + F.col("kind"), F.col("code")))
    # class before and class: CLASSES ** 2 rows
    odds = (model.transition - np.log10(model.emission)[None, :]).ravel().tolist()
    odds = docs.sparkSession.createDataFrame(list(enumerate(odds)), "at int, odds double")
    tail = tail.join(F.broadcast(odds), "at").groupBy("__row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("__k"),
        F.sum(F.col("n") * F.log10((c + DELTA) / base_of)).alias("__b"),
        F.sum(F.col("n") * (F.log10(c + DELTA) + F.col("odds"))).alias("__e"),
    )
    both = rows.drop("__words", "__codes", "__ns").join(tail, "__row", "left")
    score = F.col("__score") + F.coalesce("__e", F.lit(0.0))
    return both.select(
        *[f"`{x}`" for x in kept], F.col("__tokens").alias("n_tokens"), (F.col("__known") + F.coalesce("__k", F.lit(0))).alias("n_known"),
        (F.col("__base") + F.coalesce("__b", F.lit(0.0))).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("__tokens")).alias("perplexity"),
    )


def score_table(docs: DataFrame) -> DataFrame:
    """One row per document, scored by the model of those that are not held out."""
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    model, others = train(rows.where("not held_out"))
    scored = score_texts(rows, model, others)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
