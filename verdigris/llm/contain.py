"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdigris.llm.common import (
    _LOWER, blocks, columns_but, filled, fresh, lowered, row_of, run_hashes, sift, slices, span_hashes, text_bytes, with_column, word_spans,
)
from verdigris.llm.ordering import tied
from verdigris.session import settle

_FOLD = bytes(_LOWER)


def shingles_of(text: str | None, shingle: int) -> tuple[int, set[bytes]]:
    """Distinct shingles of a text and their length in words: all words where the text has fewer than ``shingle``."""
    words = (text or "").encode().translate(_FOLD).split()
    k = min(shingle, len(words))
    return k, {b" ".join(words[at : at + k]) for at in range(len(words) - k + 1)} if k else set()


def _hashes(shingles: list[bytes]) -> np.ndarray:
    """The hashes that the documents' word runs get."""
    data = np.frombuffer(b"".join(shingles), np.uint8)
    begins = np.cumsum([0, *map(len, shingles)])
    starts, ends, firsts = word_spans(data, begins)
    words = span_hashes(data, starts, ends)
    return run_hashes(words, firsts[:-1], firsts[1:])


def sketch_length(n: int, threshold: float) -> int:
    """How many of the least hashes of ``n`` shingles always share one with a text that holds ``threshold`` of the shingles."""
    return n - math.ceil(threshold * n - 1e-9) + 1


class Index:
    """Items partitioned by shingle length and size; each partition has sketches of one length, its largest item's."""

    def __init__(self, items: list[tuple[object, str]], shingle: int, threshold: float):
        self.threshold = threshold
        self.items: list[tuple[object, set[bytes], np.ndarray]] = []
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for key, text in items:
            k, found = shingles_of(text, shingle)
            if found:
                ordered = sorted(found)
                parts[k, len(found).bit_length()].append(len(self.items))
                self.items.append((key, found, _hashes(ordered)))
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        owners: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for (k, _), members in parts.items():
            length = max(sketch_length(len(self.items[at][1]), threshold) for at in members)
            for at in members:
                for value in np.sort(self.items[at][2])[:length].tolist():
                    owners[k][value].append(at)
        for k, found in owners.items():
            values = np.sort(np.array(list(found), np.uint64))
            low = np.zeros(1 << 16, bool)
            low[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.by_length[k] = (values, low, dict(found))

    def search(self, data: np.ndarray, begins: np.ndarray) -> list[list[tuple[int, int]]]:
        """(item place, shared shingles) for each of the texts that lie end to end in ``data``."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(begins) - 1)]
        data = lowered(data)
        starts, ends, firsts = word_spans(data, begins)
        words = span_hashes(data, starts, ends)
        row = row_of(firsts, len(starts))
        for k, (values, low, owners) in self.by_length.items():
            first = np.arange(max(0, len(words) - k + 1))
            first = first[row[first] == row[first + k - 1]] if len(first) else first
            runs = run_hashes(words, first, first + k)
            maybe = np.flatnonzero(low[(runs & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(values, runs[maybe]), len(values) - 1)
            hits = maybe[values[place] == runs[maybe]]
            candidates = {(int(row[first[hit]]), at) for hit in hits for at in owners[int(runs[hit])]}
            if not candidates:
                continue
            run_row = row[first]
            bounds = np.searchsorted(run_row, np.arange(len(begins)))
            for r, at in sorted(candidates):
                own = slice(bounds[r], bounds[r + 1])
                _, shingles, hashes = self.items[at]
                same = np.flatnonzero(np.isin(runs[own], hashes)) + bounds[r]
                exact = set()
                for one in same:
                    w = first[one]
                    exact.add(b" ".join(bytes(data[starts[i] : ends[i]]) for i in range(w, w + k)))
                shared = len(exact & shingles)
                if shared >= self.threshold * len(shingles) - 1e-9:
                    out[r].append((at, shared))
        return out


def _sketches(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``no``, ``k``, ``n`` and ``sketch``, the least hashes of the item's n shingles of k words, for every item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said"):
            rows = []
            for no, said in zip(batch.column("no").to_pylist(), batch.column("said").to_pylist(), strict=True):
                k, found = shingles_of(said, shingle)
                if found:
                    least = np.sort(_hashes(sorted(found)))[: sketch_length(len(found), threshold)]
                    rows.append({"no": no, "k": k, "n": len(found), "sketch": least.view(np.int64).tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("no", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))]))

    return items.select("no", "said").mapInArrow(run, "no long, k long, n long, sketch array<long>")


def _word_runs(texts: DataFrame, lengths: list[int], kept: np.ndarray) -> DataFrame:
    """``node``, ``hash``: the distinct runs of words of each text, of those lengths, that the map ``kept`` lets through."""
    bits = np.uint64(len(kept) * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said"):
            said = filled(batch.column("said"))
            for first, last in blocks(said):
                data, begins = text_bytes(said, first, last)
                starts, ends, firsts = word_spans(lowered(data), begins)
                words, row = span_hashes(lowered(data), starts, ends), row_of(firsts, len(starts))
                found = [np.zeros((0, 2), np.int64)]
                for k in lengths:
                    at = np.arange(max(0, len(words) - k + 1))
                    at = at[row[at] == row[at + k - 1]] if len(at) else at
                    runs = run_hashes(words, at, at + k)
                    place = runs % bits
                    through = (kept[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    found.append(np.unique(np.column_stack([row[at][through], runs[through].view(np.int64)]), axis=0))
                rows = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([batch.column("node")[first:last].take(pa.array(rows[:, 0])), pa.array(rows[:, 1])], names=["node", "hash"])

    return texts.mapInArrow(run, "node string, hash long")


def _joined_matches(texts: DataFrame, items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``node``, ``no``, ``shared``, ``n``: what each text (``node``, its digest, and ``said``) holds of any number of items (``no``, ``said``).

    Sketches are a table. Of a text's runs of words only those go to the join that a map of fixed size lets through; who
    shares a hash is read again and compared exactly.
    """
    sketches = settle(_sketches(items, shingle, threshold), "item-sketches")
    hashes = sketches.select("no", F.explode("sketch").alias("hash"))
    lengths = sorted(row["k"] for row in sketches.select("k").distinct().collect())  # at most ``shingle`` numbers
    bits = 1 << 24
    # As unsigned numbers, in two halves, because Spark's are signed.
    place = F.pmod(F.col("hash").bitwiseAND(F.lit(bits - 1)), F.lit(bits))
    word = F.shiftright(place, 6)
    mask = F.expr(f"shiftleft(1L, cast((hash & {bits - 1}) & 63 as int))")
    kept = np.zeros(bits // 64, np.uint64)
    for row in hashes.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        kept[row["word"]] = np.uint64(row["mask"] & (1 << 64) - 1)
    runs = settle(_word_runs(texts, lengths, kept), "text-runs")
    pairs = settle(runs.join(hashes, "hash").select("node", "no").distinct(), "containment-pairs")
    wanted = pairs.select("node").distinct()
    copies = sift(texts, wanted, ["node"]).groupBy("node").agg(F.any_value("said").alias("said"))
    read = copies.join(pairs, "node").withColumnRenamed("said", "held").join(items.select("no", "said"), "no")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "held"):
            rows = []
            for node, no, held, said in zip(*(batch.column(name).to_pylist() for name in ("node", "no", "held", "said")), strict=True):
                k, own = shingles_of(said, shingle)
                words = held.encode().translate(_FOLD).split()
                shared = len(own & {b" ".join(words[at : at + k]) for at in range(len(words) - k + 1)})
                if shared >= threshold * len(own) - 1e-9:
                    rows.append({"node": node, "no": no, "shared": shared, "n": len(own)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("node", pa.string()), ("no", pa.int64()), ("shared", pa.int64()), ("n", pa.int64())]))

    return read.select("node", "no", "held", "said").mapInArrow(verify, "node string, no long, shared long, n long")


def with_matches(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, item_key: str = "item_id", item_text: str = "text",
    text: str = "text", matches: str = "matches", items_at_once: int = 20_000, characters_at_once: int = 32_000_000,
) -> DataFrame:
    """``docs`` with an array of (item key, shared, shingles, containment) for the items that each whole text holds.

    Containment is the share of an item's distinct shingles (``shingle`` words, A-Z lower-cased) that the text has; an item of
    fewer words is one shingle of all its words, one without words is in no text. Null texts hold nothing. Equal item rows
    count once; items come by key. Other columns stay, one called like ``matches`` is replaced.

    The sketches are lossless: of an item's n shingles a text at the threshold misses at most n - ceil(threshold n), so it
    has one of the n - ceil(threshold n) + 1 least hashes. Up to ``items_at_once`` items and ``characters_at_once`` characters
    go to every task as one index, and documents are read in place without any shuffle. More items than that stay a table,
    and documents meet them by joins (``_joined_matches``).
    """
    distinct = items.select(F.col(item_key).alias("key"), F.coalesce(F.col(item_text), F.lit("")).alias("said")).where("said <> ''").distinct()
    totals = distinct.agg(F.count(F.lit(1)), F.sum(F.length("said"))).first()
    small = (totals[0] or 0) <= items_at_once and (totals[1] or 0) <= characters_at_once
    item_type = items.schema[item_key].dataType
    struct = f"struct<`{item_key}`:{item_type.simpleString()},shared:long,shingles:long,containment:double>"
    kind = pa.list_(
        pa.struct([(item_key, to_arrow_type(item_type)), ("shared", pa.int64()), ("shingles", pa.int64()), ("containment", pa.float64())])
    )
    base, kept, fields = columns_but(docs, matches)
    if small:
        rows = distinct.orderBy("key", "said").collect()
        index = Index([(row["key"], row["said"]) for row in rows], shingle, threshold)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                texts = filled(batch.column(text))
                lists: list[list[dict]] = []
                for first, last in blocks(texts):
                    for row in index.search(*text_bytes(texts, first, last)):
                        lists.append([
                            {item_key: index.items[at][0], "shared": shared, "shingles": len(index.items[at][1]), "containment": shared / len(index.items[at][1])}
                            for at, shared in row
                        ])
                yield with_column(batch, kept, matches, pa.array(lists, kind))

        return base.mapInArrow(run, f"{fields}`{matches}` array<{struct}>")

    numbered = settle(tied(distinct, "no"), "items")
    node = fresh(base, "text_node")
    keyed = base.withColumn(node, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    texts = keyed.select(F.col(node).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("said"))
    found = settle(_joined_matches(texts, numbered, threshold, shingle), "containment")
    one = F.struct(F.col("key").alias(item_key), "shared", F.col("n").alias("shingles"), (F.col("shared") / F.col("n")).alias("containment"))
    listed = found.join(numbered, "no").groupBy(F.col("node").alias(node)).agg(F.array_sort(F.collect_list(F.struct("key", "said", one.alias("one")))).alias(matches))
    listed = settle(listed.select(node, F.transform(matches, lambda held: held["one"]).alias(matches)), "containment")
    named = [F.col("`" + name.replace("`", "``") + "`") for name in kept]
    with_some = sift(keyed, listed, [node]).join(listed, node, "left")
    nothing = F.array().cast(f"array<{struct}>")
    return (
        with_some.select(*named, F.coalesce(matches, nothing).alias(matches))
        .unionByName(sift(keyed, listed, [node], keep=False).select(*named, nothing.alias(matches)))
    )
