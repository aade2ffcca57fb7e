"""Shared pieces of the training-data operators: tables, words as numpy arrays, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.sifting import fresh, sift  # noqa: F401  operators take them from here

#: ASCII white space; a word is a run of other characters.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multiplier of the byte polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fraction_of(column: Column | str, parts: int = 5) -> Column:
    """crc32 of the value as text, modulo ``parts``; null counts as the empty string."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def blocks(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, so that scratch arrays stay small; a longer text is a range of its own."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about a megabyte of text, so that a worker's memory doesn't depend on their size."""
    for batch in batches:
        column = batch.column(text)
        if not column.type.equals(pa.string()) and not pa.types.is_binary(column.type):
            column = column.cast(pa.string())
        for first, last in blocks(column, 1 << 20):
            yield batch.slice(first, last - first)


def with_column(batch: pa.RecordBatch, kept: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(one) for one in kept), column], names=[*kept, name])


def columns_but(df: DataFrame, name: str) -> tuple[DataFrame, list[str], str]:
    """``df`` without a column, the names that are left and their types as a schema string."""
    kept = [one for one in df.columns if one.lower() != name.lower()]
    quoted = ["`" + one.replace("`", "``") + "`" for one in kept]
    base = df.select(quoted)
    return base, kept, "".join(f"{one} {kind}, " for one, (_, kind) in zip(quoted, base.dtypes, strict=True))


def text_bytes(texts: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows ``first`` to ``last`` without a copy, and where each row begins (one more entry than rows)."""
    kind = np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset + first : texts.offset + last + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Null texts as empty ones, in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (one more entry than rows)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(begins), np.int64)
    inside = ~_IS_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = begins[(begins > 0) & (begins < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, begins)


def _power(n: int, base: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.empty(size, np.uint64)
        known[0] = 1
        done = 1
        while done < size:  # doubles the filled part: b**(i+done) = b**i * b**done
            take = min(done, size - done)
            known[done : done + take] = known[:take] * np.uint64(pow(base, done, 1 << 64))
            done += take
        if size <= 1 << 22:
            _powers[base] = known
    return known[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial by prefix sums, then mixed. Equal bytes, equal hash, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data), _BASE), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(len(data), _INVERSE)[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run words[first:last], from the words' own hashes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(len(words), _BASE), out=sums[1:])
    return mixed((sums[last] - sums[first]) * _power(max(len(words), 1) + 1, _INVERSE)[first] + (last - first).astype(np.uint64))


def row_of(firsts: np.ndarray, n: int) -> np.ndarray:
    """The row of each of ``n`` words, from the first word of each row."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)) if n else np.zeros(0, np.int64)
