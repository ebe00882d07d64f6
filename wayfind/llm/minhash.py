"""Near-duplicate documents: one-permutation hashing with optimal densification, bands and star-shaped candidates.

A text's word shingles are hashed to 64 bits once; the hash range is cut into equal bins and each bin keeps its least
hash. A bin without any takes the value of a non-empty one that a fixed sequence of hashes picks, the same sequence for
every text. Runs of bins make band keys. In every bucket of a band key the members are compared with one centre, and these
links are confirmed on the full shingle sets. Where a bucket's members are still in more than one component, all pairs of
different components in it are tested, in blocks: by sizes, then by a bit for each residue of the hashes (set if an odd
number of shingles have it), which bounds from below how many shingles only one of two texts has, then on the full sets.
So no two documents that share a bucket and meet the threshold are left in different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.components import connected_components
from wayfind.llm.support import cut, maybe_in, packed
from wayfind.llm.textarrays import list_array, mix, string_slices, words

BANDS, BAND_BINS = 25, 5
#: Edges of a star in one part of it.
PART = 512
#: Shingles, and 64 for each member, in one block of a bucket's members: what a task holds of one side.
BLOCK = 1 << 20
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word shingles; a row with fewer words has its whole sequence as one."""
    _, _, rows, hashes = words(data, offsets)
    n = len(offsets) - 1
    firsts = np.searchsorted(rows, np.arange(n + 1))
    acc = hashes.copy()
    short = {}
    for j in range(1, width + 1):
        for r in np.flatnonzero(np.diff(firsts) == j) if j < width else ():
            short[int(r)] = mix(acc[firsts[r] : firsts[r] + 1] + np.uint64(j))
        if j < width:
            m = len(acc) - 1
            acc = mix(acc[:m] * _FOLD + hashes[j : j + m]) if m > 0 else acc[:0]
    out = []
    for r in range(n):
        a, b = firsts[r], firsts[r + 1]
        out.append(short.get(r, acc[:0]) if b - a < width else np.unique(acc[a : b - width + 1]))
    return out


@lru_cache(2)
def _tries(bins: int) -> np.ndarray:
    """For each try the bin that an empty bin looks at."""
    n = 64 * bins
    return (mix(np.arange(n * bins, dtype=np.uint64) + np.uint64(1 << 40)) % np.uint64(bins)).astype(np.int32).reshape(n, bins)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of densified bin minima for each set; the rows of empty sets are 0."""
    edges = (np.arange(bins + 1, dtype=object) * 2**64 // bins)[:bins].astype(np.uint64)
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for r, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            full[r] = np.diff(at, append=len(s)) > 0
            out[r] = s[np.minimum(at, len(s) - 1)]
    some = full.any(axis=1)
    row, hole = np.nonzero(~full & some[:, None])
    table = _tries(bins)
    for t in range(len(table)):
        if not len(row):
            break
        at = table[t, hole]
        hit = full[row, at]
        out[row[hit], hole[hit]] = out[row[hit], at[hit]]
        row, hole = row[~hit], hole[~hit]
    if len(row):  # after 64 * bins tries in vain: the first bin that has one
        out[row, hole] = out[row, full[row].argmax(axis=1)]
    out[~some] = 0
    return out


def _signed(docs: DataFrame, id_col: str, text: str, width: int, bins: int) -> DataFrame:
    """id, size of the shingle set, 128 bits of it and the low 16 bits of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in string_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                low = signatures(sets, bins).astype("<u2")
                sizes = np.array([len(s) for s in sets], np.int64)
                one = np.array([np.add.reduce(mix(s + np.uint64(1))) for s in sets], np.uint64)
                two = np.array([np.add.reduce(mix(s ^ _FOLD)) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(sets)], pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "n", "set_a", "set_b", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "id long, n long, set_a long, set_b long, sig binary")


def odd_bits(hashes: np.ndarray) -> bytes:
    """A bit for each residue by a power of two of at least four times the hashes: whether an odd number of them have it."""
    size = 1 << max(6, (4 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The bits for the residues by a smaller power of two."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _sets(docs: DataFrame, id_col: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the rows whose id is in `wanted`, and of a few others; no text is shuffled for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in string_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(sets)], list_array(flat, np.array([len(s) for s in sets], np.int64), pa.int64())], names=["id", "shingles"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    return maybe_in(own, "id", wanted.select("id")).mapInArrow(run, "id long, shingles array<long>")


def _confirmed_stars(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a: a star's centre, b) whose full sets meet the threshold. A large star is dealt into parts, each with a
    copy of its centre's set, so no centre's edges meet in one task.
    """
    centres = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = edges.join(centres, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts")
    leaves = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    hubs = centres.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    hubs = hubs.select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = leaves.join(hubs, ["a", "part"]).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels with the components that links connect made one."""
    merged = connected_components(links).toDF("old", "new")
    return labels.join(merged, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"))


def odd_bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """A bit for each residue by `size`, a power of two: whether an odd number of the hashes have it. As many bits as differ
    between two sets, so many hashes at least are in one of them only."""
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).view(np.uint64)


def new_links(component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as (component, component), that connect all components of the group
    that any of its links connect: every pair is linked, ruled out by its bits or its sizes, refuted on the full sets, or
    in one component already. side: 0 and 1 mark two blocks, of which only members of different ones are compared, and 2
    a block whose members are all compared.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, component, side, sets = n[order], component[order], side[order], [sets[i] for i in order]
    name = component.copy()
    links: list[tuple[int, int]] = []
    at = 0
    while at < len(n):
        # a run of members of about one size with all that are large enough to be its partners
        upto = int(np.searchsorted(n, n[at] + n[at] // 8, side="right"))
        last = int(np.searchsorted(n, n[upto - 1] * 100 // percent, side="right"))
        size = 1 << max(9, int(16 * n[at] - 1).bit_length())
        bits = np.stack([odd_bits(s, size) for s in sets[at:last]])
        for p in range(at, upto):
            fit = (name[p + 1 : last] != name[p]) & (100 * n[p] >= percent * n[p + 1 : last])
            if side[p] < 2:
                fit &= side[p + 1 : last] != side[p]
            met = np.flatnonzero(fit) + p + 1
            if not len(met):
                continue
            alone = np.bitwise_count(bits[met - at] ^ bits[p - at]).sum(axis=1, dtype=np.int64)
            both = n[met] + n[p]
            met = met[100 * (both - alone) >= percent * (both + alone)]
            if not len(met):
                continue
            own = sets[p]
            flat = np.concatenate([sets[q] for q in met])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n[met])[:-1]]), dtype=np.int64)
            for q in met[100 * common >= percent * (n[met] + n[p] - common)].tolist():
                if name[q] != name[p]:
                    links.append((int(component[p]), int(component[q])))
                    name[name == name[q]] = name[p]
        at = upto
    return links


def _links_across(own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): components to be made one, by links between members of one bucket of `own` (id, n, key, component).

    In a bucket with several components the members of its largest one are compared with all others, and the others with
    each other. Both sides are dealt into blocks of bounded bytes, and every two blocks meet in a group of their own, which
    hands on no more links than it has components.
    """

    def run(rows: pa.Table) -> pa.Table:
        flat = rows.column("shingles").combine_chunks()
        ends = flat.offsets.to_numpy()
        values = flat.values.to_numpy(zero_copy_only=False).view(np.uint64)
        each = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        links = new_links(rows.column("component").to_numpy(), rows.column("side").to_numpy(), each, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    parts = own.groupBy("key", "component").agg(F.sum(F.col("n") + 64).alias("n"))
    whole = parts.groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).where("components > 1")
    blocks = whole.select("key", F.col("top.component").alias("top"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("tops"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("others"))
    here = own.join(blocks, "key").withColumn("first", F.col("component") == F.col("top"))
    here = here.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("first"), F.col("tops")).otherwise(F.col("others"))).cast("int"))
    many, tops = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("tops") - 1)

    def group(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    among = F.transform(many, lambda j: group(1, F.least("block", j), F.greatest("block", j), F.when(F.col("block") == j, 2).otherwise((F.col("block") > j).cast("int"))))
    first = F.transform(many, lambda j: group(0, F.col("block"), j, F.lit(0)))
    rest = F.concat(F.transform(tops, lambda i: group(0, i, F.col("block"), F.lit(1))), among)
    here = here.select("key", "id", "n", "component", F.explode(F.when(F.col("first"), first).otherwise(rest)).alias("g")).select("key", "g.*", "id", "n", "component")
    here = here.join(sets, "id").where(F.size("shingles") == F.col("n")).select("key", "kind", "i", "j", "side", "component", "shingles")
    return here.groupBy("key", "kind", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, band_bins: int = BAND_BINS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links) and kept.

    Two documents are linked if they share a band and 100 * common shingles >= percent * shingles of either. Equal sets are
    one node from the start, so copies are never compared. Null and empty texts and texts of white space have no shingles and link with
    nothing. Rows that share an id are one node with all their texts; a row with a null id links with nothing, has a
    null component_id and is kept. Other columns are not looked at. No rows in, none out.
    """
    signed = cut(_signed(docs, id_col, text, width, bands * band_bins))
    nodes = signed.where("n > 0 and id is not null").groupBy("n", "set_a", "set_b").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"))

    def band(b: int) -> Column:
        return F.substring("sig", 2 * band_bins * b + 1, 2 * band_bins)

    # different sets can only meet the threshold if the smaller one and one shingle more would
    keyed = nodes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("id", F.col("n").cast("int").alias("n"), F.explode(F.array(*[F.xxhash64(F.lit(b), band(b)) for b in range(bands)])).alias("key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members, n_members = packed(keyed.join(several, "key").select("id", "n", "key", "m"))
    labels = members.select("id", F.col("id").alias("component")).limit(0)
    if n_members:
        # a node's degree is how many it meets in all its buckets: what copies were made from meets most of them, and makes the best centre
        ranked = members.join(members.groupBy("id").agg(F.sum("m").alias("degree")), "id")
        hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("id"), "id", "n")).alias("c"))
        alike = (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")) & (F.col("id") != F.col("c.id"))
        edges = members.join(hubs, "key").where(alike).select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()
        wanted = members.select("id").distinct()
        sets = cut(_sets(docs, id_col, text, width, wanted))
        linked = connected_components(_confirmed_stars(packed(edges)[0], sets, percent))
        labels, _ = packed(wanted.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
        # what shares a bucket with another component
        links, n_links = packed(_links_across(members.select("id", "n", "key").join(labels, "id"), sets, percent))
        labels = _joined(labels, links) if n_links else labels
    labels = labels.toDF("node", "component")
    labelled = nodes.select("n", "set_a", "set_b", F.col("id").alias("node")).join(labels, "node", "left").select("n", "set_a", "set_b", F.coalesce("component", "node").alias("component"))
    out = signed.drop("sig").join(labelled, ["n", "set_a", "set_b"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
