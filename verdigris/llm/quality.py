"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import (
    blocks, columns_but, filled, mixed, row_of, slices, span_hashes, text_bytes, with_column, word_spans,
)

_MARKS = [bytes([one]) for one in b".,!?;:|-_'\"()[]{}<>/\\@#$%&*+=~^`"]
#: Statistics of a document, in the order of the feature vector.
NAMES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_deviation", "short_words", "long_words", "distinct_words", "top_word",
    "repeated_neighbours", "distinct_pairs", "upper", "lower", "digit", "not_ascii", "control", "space", "newline", "entropy",
    "lines", "line_bytes", "distinct_lines", "capitalised_words", "shouted_words", "words_with_digit", "words_ending_in_mark",
    *(f"mark_{one.decode()}" for one in _MARKS),
)


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct values, and how often the commonest stands."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])])
    counts = np.diff(np.r_[new, len(rows)])
    top = np.zeros(n)
    np.maximum.at(top, rows[new], counts)
    return np.bincount(rows[new], minlength=n).astype(float), top


def statistics(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Feature vectors of the texts that lie end to end in ``data``; an empty text has zeros."""
    n = len(begins) - 1
    size = np.diff(begins)
    row = np.repeat(np.arange(n), size)
    histogram = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    share = histogram / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    starts, ends, firsts = word_spans(data, begins)
    words = np.diff(firsts)
    word_row = row_of(firsts, len(starts))
    length = ends - starts
    total = lambda mask: np.bincount(word_row[mask], minlength=n).astype(float)
    mean = _ratio(np.bincount(word_row, length, n), words)
    deviation = np.sqrt(np.maximum(_ratio(np.bincount(word_row, length.astype(float) ** 2, n), words) - mean**2, 0))
    hashes = span_hashes(data, starts, ends)
    distinct, top = _distinct(word_row, hashes, n)
    same_row = word_row[1:] == word_row[:-1]
    neighbours = np.bincount(word_row[1:][same_row & (hashes[1:] == hashes[:-1])], minlength=n)
    pairs, _ = _distinct(word_row[1:][same_row], (mixed(hashes[:-1]) + hashes[1:])[same_row], n)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122)
    sums = lambda mask: np.r_[0, np.cumsum(mask)]
    upper_sums, lower_sums, digit_sums = sums(upper), sums(lower), sums(digit)
    ups, lows, digits = (one[ends] - one[starts] for one in (upper_sums, lower_sums, digit_sums))
    final = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    mark = (final < 128) & ~((final >= 48) & (final <= 57) | (final >= 65) & (final <= 90) | (final >= 97) & (final <= 122))
    newline = np.flatnonzero(data == 10)
    line_starts = np.union1d(begins[:-1][size > 0], newline + 1)
    line_starts = line_starts[line_starts < len(data)].astype(np.int64)
    line_ends = np.r_[line_starts[1:], len(data)] if len(line_starts) else line_starts
    line_row = np.searchsorted(begins, line_starts, "right") - 1
    lines = np.bincount(line_row, minlength=n).astype(float)
    stripped = np.where((line_ends > line_starts) & (data[line_ends - 1] == 10), line_ends - 1, line_ends) if len(line_starts) else line_ends
    distinct_lines, _ = _distinct(line_row, span_hashes(data, line_starts, stripped), n)
    bytes_of = lambda *codes: share[:, list(codes)].sum(1)
    features = [
        np.log1p(size), np.log1p(words), mean, deviation, _ratio(total(length <= 3), words), _ratio(total(length > 15), words),
        _ratio(distinct, words), _ratio(top, words), _ratio(neighbours, words), _ratio(pairs, np.maximum(words - 1, 0)),
        share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1), share[:, 128:].sum(1),
        share[:, :9].sum(1) + share[:, 14:32].sum(1), bytes_of(32), bytes_of(10), entropy, np.log1p(lines), _ratio(size, lines),
        _ratio(distinct_lines, lines), _ratio(total((ups > 0) & (lows > 0)), words), _ratio(total((ups > 1) & (lows == 0)), words),
        _ratio(total(digits > 0), words), _ratio(total(mark), words),
    ]
    features += [bytes_of(one[0]) for one in _MARKS]
    return np.column_stack(features).astype(np.float32)


def with_features(docs: DataFrame, text: str = "text", features: str = "features") -> DataFrame:
    """``docs`` with the statistics of every whole text (array of floats, see ``NAMES``); null counts as empty.

    Only the text is read: labels, languages, sources and ids never enter. Other columns stay, one called like ``features``
    is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield with_column(batch, kept, features, _lists(_matrix(batch.column(text))))

    base, kept, fields = columns_but(docs, features)
    return base.mapInArrow(run, f"{fields}`{features}` array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    texts = filled(column)
    parts = [statistics(*text_bytes(texts, first, last)) for first, last in blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), pa.float32()))


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: inner nodes in level order, a leaf value per path. Small, whatever the corpus."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        trees = np.arange(len(self.feature))[None, :]
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            rows = np.arange(len(part))[:, None]
            while node.size and node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[at : at + 4096] = self.base + self.leaf[trees, node - inner].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0
) -> Forest:
    """Boosts logistic loss over binned features. Without rows the score is one half; with one class it follows that class."""
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    features, thresholds, values = [], [], []
    if n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)]).astype(np.int64)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(depth):
                wide, first = 1 << level, (1 << level) - 1
                best, choice, cut = np.full(wide, 1e-9), np.zeros(wide, np.int64), np.full(wide, -1)
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    place = node * bins + binned[:, f]
                    g = np.bincount(place, gradient, wide * bins).reshape(wide, bins).cumsum(1)
                    h = np.bincount(place, weight, wide * bins).reshape(wide, bins).cumsum(1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                    gain = np.where((h >= least) & (h_all - h >= least), gain, 0)[:, : len(cuts[f])]
                    at = gain.argmax(1)
                    value = gain[np.arange(wide), at]
                    better = value > best
                    best, choice, cut = np.where(better, value, best), np.where(better, f, choice), np.where(better, at, cut)
                for k in range(wide):
                    if cut[k] >= 0:
                        feature[first + k], threshold[first + k] = choice[k], cuts[choice[k]][cut[k]]
                right = np.where(cut[node] >= 0, binned[np.arange(n), choice[node]] > cut[node], False)
                node = 2 * node + right
            g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
            value = -rate * g / (h + ridge)
            margin += value[node]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
    shape = (len(features), inner)
    return Forest(
        base, np.array(features, np.int64).reshape(shape), np.array(thresholds).reshape(shape), np.array(values).reshape(len(values), leaves)
    )


def fit(labelled: DataFrame, label: str, order: Column, features: str = "features", sample_rows: int = 20_000, **options: float) -> Forest:
    """Trains on at most ``sample_rows`` labelled rows, those whose ``order`` hashes least: the bound of what the driver holds.

    ``labelled`` has the feature vectors and labels 0 or 1; rows with a null in either are left out, equal rows count each.
    """
    rows = (
        labelled.where(F.col(label).isNotNull() & F.col(features).isNotNull())
        .select(F.xxhash64(order).alias("place"), F.col(label).cast("double").alias("y"), F.col(features).alias("x"))
        .orderBy("place", "y", "x").limit(sample_rows).toArrow()
    )
    y = rows.column("y").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) if len(y) else np.zeros((0, len(NAMES)))
    return boost(np.asarray(x, np.float64), y, **options)


def with_score(docs: DataFrame, forest: Forest, text: str | None = "text", features: str | None = None, score: str = "score") -> DataFrame:
    """``docs`` with the forest's probability of label 1, from a column of features or, without one, from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if features else slices(batches, text):
            if features:
                column = batch.column(features)
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))
            else:
                x = _matrix(batch.column(text))
            yield with_column(batch, kept, score, pa.array(forest.probability(np.asarray(x, np.float64)), pa.float64()))

    base, kept, fields = columns_but(docs, score)
    return base.mapInArrow(run, f"{fields}`{score}` double")


def labels_of(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One label per document; several for the same count as the lowest, nulls not at all."""
    return labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
