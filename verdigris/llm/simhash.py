"""SimHash near-duplicates: fingerprints linked by a grid range join over segment bit counts, verified bit by bit.

A fingerprint is cut into 32 segments of two bits. The Manhattan distance of two vectors of segment bit counts is never above
the Hamming distance of the fingerprints, so a range join over the count vectors loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import (
    _LOWER, blocks, columns_but, filled, fresh, lowered, mixed, row_of, run_hashes, sift, slices, span_hashes, text_bytes, with_column,
    word_spans,
)
from verdigris.llm.graphs import components
from verdigris.session import forget, settle

_FOLD = bytes(_LOWER)
_SEGMENTS = 32
_LOW_BITS = 0x5555555555555555
_CHUNK = 1 << 15


def fingerprint_of(words: list[bytes], shingle: int) -> int:
    """Bit j is 1 where it is set in more than half of the shingles' XXH64 (seed 42), repeats included; 0 without words."""
    import xxhash

    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for first in range(0, n, _CHUNK):
        last = min(first + _CHUNK, n)
        part = words[first : last + shingle - 1]
        runs = [join(part)] if n == 1 else map(join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter((digest(run, 42) for run in runs), np.uint64, last - first)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little", signed=True)


def with_fingerprint(docs: DataFrame, shingle: int = 5, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64-bit fingerprint (long) of every whole text.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than ``shingle`` is one shingle, a null
    text and one without words have fingerprint zero. Other columns stay, one called like ``fingerprint`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [fingerprint_of((value or "").encode().translate(_FOLD).split(), shingle) for value in batch.column(text).to_pylist()]
            yield with_column(batch, kept, fingerprint, pa.array(found, pa.int64()))

    base, kept, fields = columns_but(docs, fingerprint)
    return base.mapInArrow(run, f"{fields}`{fingerprint}` long")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def counts_code(fingerprint: Column) -> Column:
    """The bit counts of the 32 segments, each as 00, 01 or 11: the Manhattan distance is the number of differing code bits."""
    low, high = F.lit(_LOW_BITS), F.shiftrightunsigned(fingerprint, 1)
    either, both = fingerprint.bitwiseOR(high).bitwiseAND(low), fingerprint.bitwiseAND(high).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def links(fingerprints: DataFrame, max_distance: int = 3, column: str = "fingerprint") -> DataFrame:
    """All pairs of different fingerprints that differ in at most ``max_distance`` bits: ``a`` < ``b`` and ``distance``.

    Nulls play no part, repeated fingerprints count once. The segments are dealt into max_distance // 2 + 1 groups; vectors
    within that Manhattan distance are within 1 in one group at least. The counts of a group are the cell of a grid; each
    fingerprint stands in its own cell, and one whose counts have an even sum also asks the cells one step away, where only
    odd sums stand. Pairs that meet are cut to the Manhattan distance, then to the Hamming distance.
    """
    groups = max_distance // 2 + 1
    edges = [_SEGMENTS * k // groups for k in range(groups + 1)]
    coded = (
        fingerprints.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("f")).distinct()
        .withColumn("code", counts_code(F.col("f")))
    )
    entries = []
    for group in range(groups):
        first, last = 2 * edges[group], 2 * edges[group + 1]
        bits = ((1 << last) - (1 << first)) & ((1 << 64) - 1)
        bits = bits - (1 << 64) if bits >> 63 else bits
        cell = F.col("code").bitwiseAND(F.lit(bits))
        steps = []
        for at in range(first, last, 2):
            low, high = F.getbit("code", F.lit(at)), F.getbit("code", F.lit(at + 1))
            one, two = (1 << at), (1 << (at + 1))
            two = two - (1 << 64) if two >> 63 else two
            steps.append(F.when(high == 0, cell.bitwiseXOR(F.lit(one))))
            steps.append(F.when(low == 1, cell.bitwiseXOR(F.lit(two))))
        even = F.bit_count(cell) % 2 == 0
        asked = F.when(even, F.array_compact(F.array(*steps))).otherwise(F.array().cast("array<long>"))
        entries.append(F.struct(F.lit(group).alias("g"), cell.alias("cell"), even.alias("even"), asked.alias("asked")))
    each = coded.select("f", "code", F.explode(F.array(*entries)).alias("e"))
    standing = each.select("f", "code", F.col("e.g").alias("g"), F.col("e.cell").alias("cell"), F.col("e.even").alias("even"))
    asking = each.select("f", "code", F.col("e.g").alias("g"), F.explode("e.asked").alias("cell"))
    left = standing.select("f", "code", "g", "cell", F.lit(0).alias("step")).unionByName(
        asking.select("f", "code", "g", "cell", F.lit(1).alias("step"))
    )
    right = standing.select(F.col("f").alias("f2"), F.col("code").alias("code2"), "g", "cell", "even")
    near = F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= max_distance
    exact = F.bit_count(F.col("f").bitwiseXOR(F.col("f2")))
    met = left.join(right, ["g", "cell"]).where(
        ((F.col("step") == 0) & (F.col("f") < F.col("f2")) | (F.col("step") == 1) & ~F.col("even")) & near & (exact <= max_distance)
    )
    return met.select(F.least("f", "f2").alias("a"), F.greatest("f", "f2").alias("b"), exact.alias("distance")).distinct()


def group_of(docs: DataFrame, key: str = "doc_id", fingerprint: str = "fingerprint", max_distance: int = 3, group: str = "component_id") -> DataFrame:
    """``docs`` with the least key among the rows that they reach over links of at most ``max_distance`` bits, itself included.

    Equal fingerprints are linked, null ones reach only themselves. Copies meet as one fingerprint, so a group of any size costs one row in the search. Null
    keys are reached like others but never the least; a group of null keys only has a null. Equal rows stay as many as they are.
    """
    code, least, root = fresh(docs, "code_of"), fresh(docs, "least_of"), fresh(docs, "root_of")
    distinct = settle(docs.groupBy(F.col(fingerprint).alias(code)).agg(F.min(key).alias(least)), "fingerprints")
    roots = components(links(distinct, max_distance, code)).select(F.col("node").alias(code), F.col("root").alias(root))
    linked = distinct.join(roots, code, "left").withColumn(root, F.coalesce(root, code))
    lowest = linked.groupBy(root).agg(F.min(least).alias(group))
    named = linked.select(code, root).join(lowest, root).select(code, group)
    plain = docs.drop(group)
    return plain.join(named, plain[fingerprint] == named[code], "left").select(
        *(plain[f"`{one}`"] for one in plain.columns), F.when(named[code].isNull(), plain[key]).otherwise(named[group]).alias(group)
    )


#: A passage ends after a pair of words whose hash is divisible by the first number, or after that many words.
PASSAGE, LONGEST_PASSAGE = 16, 64
#: Fingerprints of texts with similar shingles differ in fewer bits: for a Jaccard similarity of 0.8 about 10 of 64 with a
#: deviation of 3. Candidates beyond this distance aren't read again.
FAR = 20
#: Random orders by which the texts that share a passage choose whom they all meet.
CENTRES = 8
#: Up to so many texts of one length that share a passage are all compared with each other by length and fingerprint.
SMALL = 64
#: Shingles that so many sampled texts hold come last in the order of prefixes, up to so many of them; they decide costs only.
SAMPLED, COMMON, MOST_COMMON = 20_000, 3, 1 << 16


def _majority(hashes: np.ndarray, starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes, which begin at ``starts``, of those that are ``counted``."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits[~counted] = 0
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    whole = np.add.reduceat(counted, starts, dtype=np.int32)
    return np.packbits(2 * sums > whole[:, None], axis=1, bitorder="little").view("<i8").ravel()


def shingle_hashes(data: np.ndarray, begins: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of texts that lie end to end, by row and hash."""
    starts, ends, firsts = word_spans(lowered(data), begins)
    words = span_hashes(lowered(data), starts, ends)
    row, at = row_of(firsts, len(words)), np.arange(len(words))
    inner = (at + shingle <= firsts[1:][row]) | (at == firsts[:-1][row])
    hashes, row = run_hashes(words, at, np.minimum(at + shingle, firsts[1:][row]))[inner], row[inner]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], hashes[new]


def prefixes(row: np.ndarray, hashes: np.ndarray, rows: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's n distinct shingles the first n - ceil(least n) + 1 in one order for all texts, ``common`` ones (sorted
    hashes and their counts) last: row and hash, and per text the number of shingles, modulo 256, in each 64th of the hash space.

    Two texts whose similarity is ``least`` or more share one of these, whatever the order.
    """
    bins = np.bincount(row * 64 + (hashes >> np.uint64(58)).astype(np.int64), minlength=rows * 64).astype(np.uint8).reshape(rows, 64)
    if not len(row):
        return row, hashes, bins
    weight = np.zeros(len(row), np.int64)
    if len(common[0]):
        place = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        weight = np.where(common[0][place] == hashes, common[1][place], 0)
    order = np.lexsort((hashes, weight, row))
    n = np.bincount(row, minlength=rows)
    at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    kept = at <= (n - np.ceil(n * least - 1e-9))[row]
    return row[kept], hashes[order][kept], bins


def passages(data: np.ndarray, begins: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts that lie end to end: distinct shingles per text, their fingerprint, row and fingerprint of each passage, and a
    sketch per text: for each 64th of the hash space a byte of the least shingle hash in it, or zero.

    Passage ends depend on the words around them alone, so an edit changes one passage or two. Passages of fewer words than
    a shingle are left to the fingerprint of the text, which counts as a passage too.
    """
    data = lowered(data)
    starts, ends, firsts = word_spans(data, begins)
    words = span_hashes(data, starts, ends)
    n, rows = len(words), len(begins) - 1
    length = np.diff(firsts)
    if not n:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.arange(rows), np.zeros(rows, np.int64), np.zeros((rows, 64), np.uint8)
    row = row_of(firsts, n)
    at = np.arange(n)
    last = np.minimum(at + shingle, firsts[1:][row])
    hashes = run_hashes(words, at, last)
    inner = (at + shingle <= firsts[1:][row]) | (at == firsts[:-1][row])
    order = np.lexsort((hashes, row))
    again = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    inner[order[1:][again]] = False
    shingles = np.bincount(row[inner], minlength=rows)
    ordered = order[inner[order]]
    bin_of = row[ordered] * 64 + (hashes[ordered] >> np.uint64(58)).astype(np.int64)
    least = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    sketch = np.zeros((rows, 64), np.uint8)
    sketch.ravel()[bin_of[least]] = (mixed(hashes[ordered[least]]) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    filled_rows = np.flatnonzero(length > 0)
    whole = np.zeros(rows, np.int64)
    whole[filled_rows] = _majority(hashes, firsts[:-1][filled_rows], inner)
    cut = np.zeros(n, bool)
    cut[1:] = mixed(mixed(words[:-1]) + words[1:]) % np.uint64(PASSAGE) == 0
    cut[firsts[:-1][filled_rows]] = True
    begin = np.flatnonzero(cut)
    cut |= (at - np.repeat(begin, np.diff(np.r_[begin, n]))) % LONGEST_PASSAGE == 0
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], n]
    inside = at + shingle <= np.repeat(end, end - begin)
    prints = _majority(hashes, begin, inside)
    long_enough = end - begin >= shingle
    return (
        shingles, whole, np.concatenate([np.arange(rows), row[begin[long_enough]]]), np.concatenate([whole, prints[long_enough]]),
        sketch,
    )


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles that are most common in a sample of the texts, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said"):
            said = filled(batch.column("said"))
            for first, last in blocks(said):
                _, hashes = shingle_hashes(*text_bytes(said, first, last), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    parts = max(1, texts.count() // SAMPLED)
    sampled = texts.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == 0).select("said").mapInArrow(run, "hash long")
    counted = sampled.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = counted.orderBy(F.desc("n"), "hash").limit(MOST_COMMON).collect()
    hashes = np.array([row["hash"] for row in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([row["n"] for row in rows], np.int64)[order]


def _profiles(texts: DataFrame, shingle: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per text: node, shingles, fingerprint, the distinct fingerprints of its passages, sketch, prefix (a single zero for a
    text without words) and bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said"):
            said = filled(batch.column("said"))
            for first, last in blocks(said):
                shingles, whole, row, prints, sketch = passages(*text_bytes(said, first, last), shingle)
                order = np.lexsort((prints, row))
                row, prints = row[order], prints[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])]
                offsets = np.searchsorted(row[new], np.arange(last - first + 1)).astype(np.int32)
                of, prefix, bins = prefixes(*shingle_hashes(*text_bytes(said, first, last), shingle), last - first, least, common)
                wordless = np.flatnonzero(shingles == 0)
                of, prefix = np.r_[of, wordless], np.r_[prefix.view(np.int64), np.zeros(len(wordless), np.int64)]
                by_row = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[by_row], np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node")[first:last], pa.array(shingles), pa.array(whole),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(prints[new])),
                        pa.array([one.tobytes() for one in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(prefix[by_row])),
                        pa.array([one.tobytes() for one in bins], pa.binary()),
                    ],
                    names=["node", "shingles", "fingerprint", "passages", "sketch", "prefix", "bins"],
                )

    return texts.mapInArrow(
        run, "node string, shingles long, fingerprint long, passages array<long>, sketch binary, prefix array<long>, bins binary"
    )


def _fewer(pairs: DataFrame, a: str, b: str, width: int, least: float, modulus: int) -> DataFrame:
    """The pairs (``{a}``, ``{b}`` with ``bins_a``, ``n_a`` and so on) without those whose bins alone hold more differences than ``least`` allows.

    The shingles of one text only are at least as many as the bins' counts differ, modulo any number too, so no link is lost.
    """
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in pairs.select(a, b).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                one, other = (np.frombuffer(b"".join(part.column(name).to_pylist()), np.uint8).reshape(-1, width) for name in ("bins_a", "bins_b"))
                if modulus == 16:  # two counts a byte
                    one, other = (np.concatenate([bins & 15, bins >> 4], axis=1) for bins in (one, other))
                apart = (one - other) % np.uint8(modulus) if modulus < 256 else one - other
                apart = np.minimum(apart, (modulus - apart.astype(np.int16)) % modulus).sum(1, dtype=np.int64)
                both = part.column("n_a").to_numpy() + part.column("n_b").to_numpy()
                yield part.select([a, b]).filter(pa.array(apart <= both * (1 - least) / (1 + least) + 1e-9, pa.bool_()))

    return pairs.select(a, b, "bins_a", "bins_b", "n_a", "n_b").mapInArrow(run, kinds)


def _within(profiles: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs ``id``, ``other`` as nodes ``a``, ``b``, without those that the bins of their profiles tell apart."""
    bins = lambda one, as_: profiles.select(F.col("id").alias(one), F.col("bins").alias(f"bins_{as_}"), F.col("shingles").alias(f"n_{as_}"))
    left = settle(_fewer(pairs.join(bins("id", "a"), "id").join(bins("other", "b"), "other"), "id", "other", 64, least, 256), "near-ids")
    name = lambda one, as_: profiles.select(F.col("id").alias(one), F.col("node").alias(as_))
    return left.join(name("id", "a"), "id").join(name("other", "b"), "other").select("a", "b")


#: Bins of the second look at pairs, two counts a byte: fine enough to tell nearly all pairs apart that aren't alike.
FINE = 1024


def _fine_bins(texts: DataFrame, shingle: int) -> DataFrame:
    """``node``, ``n`` distinct shingles and how many of them, modulo 16, lie in each of ``FINE`` parts of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said"):
            said = filled(batch.column("said"))
            for first, last in blocks(said):
                row, hashes = shingle_hashes(*text_bytes(said, first, last), shingle)
                rows = last - first
                counts = np.bincount(row * FINE + (hashes >> np.uint64(64 - FINE.bit_length() + 1)).astype(np.int64), minlength=rows * FINE).reshape(rows, FINE) % 16
                packed = (counts[:, : FINE // 2] | counts[:, FINE // 2 :] << 4).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node")[first:last], pa.array(np.bincount(row, minlength=rows)), pa.array([one.tobytes() for one in packed], pa.binary())],
                    names=["node", "n", "bins"],
                )

    return texts.select("node", "said").mapInArrow(run, "node string, n long, bins binary")


def _sharers(profiles: DataFrame, least: float) -> DataFrame:
    """``hash``, ``id``, ``n``, ``at``: the texts that share a shingle of their prefixes, and its place in each.

    Where the first shingle that two texts share stands at places i and j, i + j shingles are of one text only, at most
    (n + m)(1 - least) / (1 + least). So one of the texts has it in the first part of its prefix, or nobody need meet there.
    """
    each = profiles.select("id", F.col("shingles").alias("n"), F.posexplode("prefix").alias("at", "hash"))
    early = F.col("at") <= F.col("n") * ((1 - least) / (1 + least)) + 1e-9
    shared = settle(
        each.groupBy("hash").agg(F.count(F.lit(1)).alias("members"), F.max(early).alias("early")).where("members > 1 and early").select("hash"),
        "shared-shingles",
    )
    return settle(sift(each, shared, ["hash"]).join(shared, "hash").select("hash", "id", "n", "at"), "shingle-sharers")


def _apart(sharers: DataFrame, roots: DataFrame, least: float, centres: bool) -> DataFrame:
    """Pairs ``id`` < ``other`` of unconnected texts that share a shingle of their prefixes and can be similar by length and place.

    With ``centres`` each text meets one of the texts that share the shingle, else all of them. Of a shingle's texts the
    largest connected group is never compared within, so one group of near copies costs a row for each text.
    """
    root = roots.select(F.xxhash64("node").alias("id"), F.xxhash64("root").alias("root"))
    named = sift(sharers, root, ["id"]).join(root, "id", "left").select("hash", "id", "n", "at", F.coalesce("root", "id").alias("root"))
    single = sift(sharers, root, ["id"], keep=False).select("hash", "id", "n", "at", F.col("id").alias("root"))
    rooted = settle(named.unionByName(single), "rooted-sharers")
    one, order = F.struct("id", "n", "at", "root"), F.xxhash64("id", "hash")
    if centres:
        groups = rooted.groupBy("hash").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min_by(one, order).alias("c"))
        mixed_ones = groups.where("least < most").select("hash", "c")
    else:
        groups = rooted.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("hash")
        mixed_ones = groups.agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    mixed_ones = settle(mixed_ones, "unconnected-shingles")
    placed = sift(rooted, mixed_ones, ["hash"]).join(mixed_ones, "hash")
    if centres:
        met = placed.select("id", "n", "at", "root", *(F.col(f"c.{name}").alias(f"{name}2") for name in ("id", "n", "at", "root"))).where("root <> root2")
    else:
        placed = settle(placed, "placed-sharers")
        other = placed.select("hash", *(F.col(name).alias(f"{name}2") for name in ("id", "n", "at", "root")))
        met = placed.where("root <> main").join(other, "hash").where("root <> root2 and (root2 = main or id < id2)")
    can = (F.least("n", "n2") >= least * F.greatest("n", "n2") - 1e-9) & (
        F.col("at") + F.col("at2") <= (F.col("n") + F.col("n2")) * ((1 - least) / (1 + least)) + 1e-9
    )
    return met.where(can).select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("other")).distinct()


def _promising(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches agree in as many places as the similarity asks for, less four standard deviations and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(-1, 64) for name in ("sketch_a", "sketch_b")
            )
            used = ((a > 0) | (b > 0)).sum(1)
            same = ((a == b) & (a > 0)).sum(1)
            good = same >= used * least - 4 * np.sqrt(used * least * (1 - least)) - 1
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a string, b string")


def similarity(a: str, b: str, shingle: int) -> float:
    """Jaccard similarity of the distinct word shingles; texts without words are alike."""
    sets = []
    for text in (a, b):
        words = text.encode().translate(_FOLD).split()
        k = min(shingle, len(words))
        sets.append(set(zip(*(words[at : len(words) - k + 1 + at] for at in range(k)), strict=True)) if k else set())
    union = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / union if union else 1.0


def near_duplicates(texts: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """Links between distinct texts (``node``, ``said``): pairs ``a``, ``b`` whose shingles' Jaccard similarity is ``least`` or more,
    enough of them to connect all texts that such pairs connect.

    First the cheap candidates: texts whose fingerprints differ in at most 3 bits (``links``), and texts that share the
    fingerprint of a passage of some sixteen words: all of about one length up to ``SMALL``, else the first in each of
    ``CENTRES`` random orders. Lengths, fingerprints and sketches sort out most of these. They connect most near copies, but
    not all, for passages of short texts seldom stay whole and random members may be the wrong ones.

    Then the exact ones: two texts of that similarity share a shingle of their prefixes (``prefixes``), and the place where they
    share it bounds how much they differ. Texts that aren't connected yet meet one of each shingle's texts, then all others;
    only bounds that lose no link sort these out. What is left is read again and compared shingle by shingle.
    """
    found, last, _ = _links_in_turn(texts, least, shingle)
    return found.unionByName(last)


def _links_in_turn(texts: DataFrame, least: float, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links of ``near_duplicates``: all but the last ones, the last ones, and the roots of what the former connect."""
    profiles = settle(_profiles(texts, shingle, least, _common(texts, shingle)).withColumn("id", F.xxhash64("node")), "text-profiles")
    each = profiles.select("id", F.col("shingles").alias("n"), F.col("fingerprint").alias("f"), F.explode("passages").alias("passage"))
    shared = settle(
        each.groupBy("passage").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("passage"),
        "shared-passages",
    )
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1 / least)))
    banded = sift(each, shared, ["passage"]).join(shared, "passage").select("id", "n", "f", "passage", F.explode(F.array(band, band + 1)).alias("band"))
    order = lambda turn: F.xxhash64("id", F.lit(turn))
    centres = banded.groupBy("passage", "band").agg(
        F.count(F.lit(1)).alias("members"),
        *(F.min_by(name, order(turn)).alias(f"{name}{turn}") for turn in range(CENTRES) for name in ("id", "n", "f")),
    )
    centres = settle(centres, "passage-centres")  # a table between, so that a passage of very many texts is split over tasks
    like = lambda n, f: (
        (F.least("n", n) >= least * F.greatest("n", n) - 1e-9) & (F.bit_count(F.col("f").bitwiseXOR(f)) <= FAR)
    )
    chosen = F.filter(
        F.array(*(F.when(like(F.col(f"n{turn}"), F.col(f"f{turn}")), F.col(f"id{turn}")) for turn in range(CENTRES))),
        lambda one: one.isNotNull() & (one != F.col("id")),
    )
    placed = banded.join(centres, ["passage", "band"])
    by_passage = placed.where(F.col("members") > SMALL).select("id", F.explode(F.array_distinct(chosen)).alias("other"))
    small = placed.where(F.col("members") <= SMALL).select("passage", "band", "id", "n", "f")
    others = small.select("passage", "band", F.col("id").alias("other"), F.col("n").alias("n2"), F.col("f").alias("f2"))
    by_group = small.join(others, ["passage", "band"]).where((F.col("id") < F.col("other")) & like(F.col("n2"), F.col("f2"))).select("id", "other")
    prints = profiles.groupBy("fingerprint").agg(F.min("id").alias("id"))
    near = links(prints, 3).join(prints.select(F.col("fingerprint").alias("a"), "id"), "a")
    by_bits = near.join(prints.select(F.col("fingerprint").alias("b"), F.col("id").alias("other")), "b").select("id", "other")
    name = lambda one, as_: profiles.select(F.col("id").alias(one), F.col("node").alias(as_), F.col("sketch").alias(f"sketch_{as_}"))
    met = (
        by_passage.unionByName(by_group).unionByName(by_bits).select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
        .join(name("id", "a"), "id").join(name("other", "b"), "other")
    )
    candidates = settle(_promising(met, least), "near-candidates")
    # First one pair per text; of the others only those whose texts are not connected by then.
    star = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = _alike(star, texts, least, shingle)
    roots = settle(components(first), "near-roots")
    root = lambda one: roots.select(F.col("node").alias(one), F.col("root").alias(f"root_{one}"))
    rest = candidates.join(root("a"), "a", "left").join(root("b"), "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    ).select("a", "b").join(star, ["a", "b"], "left_anti")
    sharers = _sharers(profiles, least)
    some = _within(profiles, _apart(sharers, roots, least, centres=True), least)
    second = _alike(rest.unionByName(some).distinct(), texts, least, shingle)
    roots = settle(components(_stars(roots).unionByName(second)), "near-roots")
    others = _within(profiles, _apart(sharers, roots, least, centres=False), least)
    return first.unionByName(second), _alike(others, texts, least, shingle), roots


def _stars(roots: DataFrame) -> DataFrame:
    """An edge from each node to its root, which connects what the edges behind the roots did."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _alike(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs whose texts are that similar.

    Their texts are first read into fine bins, which tell most of the others apart; only what is left is read as text and
    compared shingle by shingle. Texts are chosen by a map of the wanted ones, so the whole table is never shuffled.
    """
    def of(held: DataFrame) -> DataFrame:
        nodes = held.select(F.col("a").alias("node")).unionByName(held.select(F.col("b").alias("node"))).distinct()
        return sift(texts, nodes, ["node"])

    pairs = settle(pairs, "near-pairs")
    bins = settle(_fine_bins(of(pairs), shingle), "near-bins")
    side = lambda as_: bins.select(F.col("node").alias(as_), F.col("bins").alias(f"bins_{as_}"), F.col("n").alias(f"n_{as_}"))
    likely = settle(_fewer(pairs.join(side("a"), "a").join(side("b"), "b"), "a", "b", FINE // 2, least, 16), "near-likely")
    forget(bins)
    read = settle(of(likely), "near-texts")
    both = likely.join(read.select(F.col("node").alias("a"), F.col("said").alias("said_a")), "a").join(
        read.select(F.col("node").alias("b"), F.col("said").alias("said_b")), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said_a"):
            good = [
                similarity(a or "", b or "", shingle) >= least - 1e-9
                for a, b in zip(batch.column("said_a").to_pylist(), batch.column("said_b").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = settle(both.select("a", "b", "said_a", "said_b").mapInArrow(verify, "a string, b string"), "near-links")
    forget(read, pairs, likely)
    return found


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least key (nulls last), a single one of equal rows.

    Groups are what links of ``near_duplicates`` connect; equal texts are one node, null texts count as empty ones, which are
    alike. Rows outside any group stay as they are and aren't shuffled. All columns stay.
    """
    node, low, n, lost = (fresh(docs, name) for name in ("text_node", "low_key", "text_rows", "text_lost"))
    keyed = docs.withColumn(node, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    nodes = settle(
        keyed.groupBy(node).agg(F.min(key).alias(low), F.count(F.lit(1)).alias(n)), "text-nodes"
    )
    once = keyed.select(F.col(node).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    copied = nodes.where(f"`{n}` > 1").select(F.col(node).alias("node"))
    several = sift(once, copied, ["node"])
    alone = sift(once, copied, ["node"], keep=False)
    texts = alone.unionByName(several.groupBy("node").agg(F.first("said").alias("said")))
    _, last, roots = _links_in_turn(texts, least, shingle)
    linked = components(_stars(roots).unionByName(last))
    members = linked.join(nodes.select(F.col(node).alias("node"), F.col(low).alias("low")), "node")
    winners = members.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("w"))
    losers = members.join(winners, "root").where("node <> w.node").select(F.col("node").alias(node), F.lit(True).alias(lost))
    touched = settle(
        nodes.where(f"`{n}` > 1").select(node, low).join(losers, node, "full").select(node, low, F.coalesce(lost, F.lit(False)).alias(lost)),
        "near-copies",
    )
    names = [f"`{name}`" for name in docs.columns]
    # Who stays is told by keys alone; of the texts only those of the rows that stay are joined.
    asked = sift(keyed.select(node, F.col(key).alias(low + "_own")), touched, [node]).join(touched, node, "left")
    stays = asked.where(F.col(lost).isNull() | ~F.col(lost) & F.col(low + "_own").eqNullSafe(F.col(low)))
    stays = settle(stays.groupBy(node, low + "_own").agg(F.count(F.lit(1)).alias(n)).select(node, F.col(low + "_own").alias(low), n), "near-kept")
    own = fresh(docs, "row_key")
    rows = sift(keyed.withColumn(low, F.col(key)), stays, [node, low]).withColumnRenamed(low, own).alias("l").join(
        stays.alias("r"), (F.col(f"l.{node}") == F.col(f"r.{node}")) & F.col(f"l.{own}").eqNullSafe(F.col(f"r.{low}"))
    ).select(*(f"l.{name}" for name in names), f"l.{node}", f"r.{n}")
    # Equal rows are one; most rows that stay are the only ones of their key.
    single, several = rows.where(F.col(n) == 1), rows.where(F.col(n) > 1).dropDuplicates([node])
    return sift(keyed, touched, [node], keep=False).select(names).unionByName(single.select(names)).unionByName(several.select(names))
