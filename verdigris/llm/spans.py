"""Substring dedup over word windows, cut into paths between minimisers.

These paths stand in for the compaction of a De Bruijn graph by joins: nonbranching runs are compacted inside each text, before
it is known which of them repeat, so that a window costs no row; joins then find the repeated ones. Windows of ``length`` words are the edges of the graph. Every window is owned by its minimiser, the least-hashed run of
``anchor`` words in it (the leftmost of equals), which depends on the window's words alone: equal windows have equal owners
at equal offsets. Consecutive windows with one owner are a path without inner branches as far as one text shows it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import (
    blocks, filled, fresh, mixed, row_of, run_hashes, sift, slices, span_hashes, text_bytes, word_spans,
)
from verdigris.session import settle

LENGTH, ANCHOR = 50, 16


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, covered = np.arange(len(values)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        covered += step
    return at[:n]


def paths(data: np.ndarray, begins: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Paths of the texts that lie end to end in ``data``: text row, anchor hash, path hash, first window, number of windows."""
    starts, ends, firsts = word_spans(data, begins)
    words = span_hashes(data, starts, ends)
    row = row_of(firsts, len(starts))
    empty = np.zeros(0, np.int64)
    if len(words) < length:
        return {"row": empty, "anchor": empty, "path": empty, "first": empty, "windows": empty, "words": np.diff(firsts)}
    at = np.arange(len(words) - anchor + 1)
    kmers = run_hashes(words, at, at + anchor)
    owner = _sliding_argmin(kmers, length - anchor + 1)
    window = np.flatnonzero(row[: len(owner)] == row[length - 1 : length - 1 + len(owner)])
    own = owner[window]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1) | (row[window[1:]] != row[window[:-1]])])[: len(window)]
    if not len(window):
        new = empty
    count = np.diff(np.r_[new, len(window)])
    first = window[new]
    last = first + count - 1
    key = kmers[own[new]] if len(new) else np.zeros(0, np.uint64)
    path = run_hashes(words, first, last + length) ^ mixed((own[new] - first).astype(np.uint64)) if len(new) else np.zeros(0, np.uint64)
    return {
        "row": row[first], "anchor": key.view(np.int64), "path": path.view(np.int64), "first": first - firsts[row[first]], "windows": count,
        "words": np.diff(firsts),
    }


def _runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """All paths of all texts: anchor, path, id, version (hash of the text), first, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said"):
            texts = filled(batch.column("said"))
            for begin, end in blocks(texts):
                found = paths(*text_bytes(texts, begin, end), length, anchor)
                rows = pa.array(found["row"] + begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found["anchor"]), pa.array(found["path"]), batch.column("id").take(rows), batch.column("version").take(rows),
                        pa.array(found["first"].astype(np.int32)), pa.array(found["windows"].astype(np.int32)),
                    ],
                    names=["anchor", "path", "id", "version", "first", "windows"],
                )

    return docs.mapInArrow(run, "anchor long, path long, id long, version long, first int, windows int")


def _digests(texts: DataFrame, length: int) -> DataFrame:
    """Digests of the words at the runs' coordinates: one for each run, and one for each window of a run to be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "said"):
            out: tuple[list, ...] = ([], [], [], [], [])
            halves = []
            columns = (batch.column(name).to_pylist() for name in ("id", "version", "said", "runs"))
            for one, version, said, runs in zip(*columns, strict=True):
                words = said.encode().split()
                joined = b" ".join(words)
                ends = np.cumsum([len(word) + 1 for word in words]).tolist()
                starts = [0, *ends]
                for item in runs:
                    first, windows = item["first"], item["windows"]
                    spots = [(first, windows)]
                    if item["open"] and windows > 1:
                        spots += [(at, 1) for at in range(first, first + windows)]
                    for at, many in spots:
                        halves.append(hashlib.blake2b(joined[starts[at] : ends[at + many + length - 2] - 1], digest_size=16).digest())
                        for column, value in zip(out, (one, version, at, many), strict=False):
                            column.append(value)
            pairs = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()),
                ],
                names=["d1", "d2", "id", "version", "first", "windows"],
            )

    return texts.mapInArrow(run, "d1 long, d2 long, id long, version long, first int, windows int")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Where texts repeat ``length`` words or more of a text with a smaller key: ``id``, ``version``, ``spans``.

    ``version`` is xxhash64 of the text, so that different texts with one key stay apart; ``spans`` is an array of (first
    window, number of windows): every window of ``length`` consecutive words whose words also stand in a row of a smaller key.
    Rows with a null key or text have none and cause none; texts with one key never cause each other's.

    1. Every text is cut into paths (see above), one row per minimiser instead of one per window.
    2. Anchors of two keys or more are kept; an anchor whose paths all agree is no branching point.
    3. The words at the coordinates of the remaining paths are read again and digested, 128 bits each. A path at a branching
       anchor is opened into its windows, but only where its least key has it: all others repeat that one whole.
    4. Digests are grouped for their least key and joined back: spans of greater keys are repeats.
    Groups are combined before each shuffle and only the least and greatest key of one is kept.
    """
    source = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("said")
    )
    runs = settle(_runs(source, length, anchor), "word-paths")
    shared = settle(
        runs.groupBy("anchor")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), (F.min("path") != F.max("path")).alias("branches"))
        .where("low < high").select("anchor", "branches"),
        "shared-anchors",
    )
    repeated = settle(sift(runs, shared, ["anchor"]).join(shared, "anchor"), "shared-paths")
    least = settle(repeated.where("branches").groupBy("anchor", "path").agg(F.min("id").alias("low")), "path-owners")
    marked = repeated.join(least, ["anchor", "path"], "left").select(
        "id", "version", "first", "windows", F.coalesce(F.col("branches") & (F.col("id") == F.col("low")), F.lit(False)).alias("open")
    )
    wanted = settle(
        marked.distinct().groupBy("id", "version").agg(F.collect_list(F.struct("first", "windows", "open")).alias("runs")), "coordinates"
    )
    texts = sift(source, wanted, ["id", "version"]).join(wanted, ["id", "version"])
    digests = settle(_digests(texts, length), "span-digests")
    owners = settle(
        digests.groupBy("d1", "d2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("d1", "d2", "low"),
        "span-owners",
    )
    found = sift(digests, owners, ["d1", "d2"]).join(owners, ["d1", "d2"]).where("id > low")
    return found.groupBy("id", "version").agg(F.array_sort(F.collect_set(F.struct("first", "windows"))).alias("spans"))


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", kept: str = "kept", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """``docs`` with ``kept``, the words of the text that no repeated span covers, joined by one space, and ``n_words`` and
    ``n_removed`` (long). Words are runs without ASCII white space, unchanged.

    A word goes where a window of ``length`` words around it also stands in a text of a smaller key; windows are judged on the
    input, not on what is left. Texts with fewer words, null texts (no words, kept is empty) and rows with a null key lose
    nothing. Other columns stay, ones called like the new ones are replaced; equal rows lose the same words each.
    """
    names = [name for name in docs.columns if name not in (kept, "n_words", "n_removed")]
    base = docs.select([f"`{name}`" for name in names])
    id_, version, spans = (fresh(base, name) for name in ("span_id", "span_version", "repeated_spans"))
    found = settle(
        repeated_spans(base, key, text, length, anchor).select(F.col("id").alias(id_), F.col("version").alias(version), "spans")
        .withColumnRenamed("spans", spans),
        "repeated-spans",
    )
    keyed = base.withColumns({id_: F.col(key).cast("long"), version: F.xxhash64(text)})
    touched = sift(keyed, found, [id_, version]).join(found, [id_, version], "left").select(*names, spans)
    others = sift(keyed, found, [id_, version], keep=False).select(*names, F.lit(None).cast(found.schema[spans].dataType).alias(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out, words_of, removed_of = [], [], []
            for said, marks in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                words = (said or "").encode().split()
                words_of.append(len(words))
                if marks:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for mark in marks:
                        edges[mark["first"]] += 1
                        edges[mark["first"] + mark["windows"] + length - 1] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    words = [word for word, away in zip(words, gone.tolist(), strict=True) if not away]
                removed_of.append(words_of[-1] - len(words))
                out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(out, pa.string()), pa.array(words_of, pa.int64()), pa.array(removed_of, pa.int64())],
                names=[*names, kept, "n_words", "n_removed"],
            )

    fields = "".join(f"`{name.replace('`', '``')}` {kind}, " for name, kind in base.dtypes)
    return touched.unionByName(others).mapInArrow(run, f"{fields}`{kept}` string, n_words long, n_removed long")
