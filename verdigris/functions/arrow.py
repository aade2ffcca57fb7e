"""The few functions Spark has no builtin for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda text: None if text is None else unicodedata.normalize(form, text))

    return apply


_nfc = _normal_form("NFC")
_nfkc = _normal_form("NFKC")


def nfc(value: Column) -> Column:
    """Composed Unicode form; pure ASCII values are passed through (they are already composed)."""
    return F.when(_is_ascii(value), value).otherwise(_nfc(value))


def nfkc(value: Column) -> Column:
    return F.when(_is_ascii(value), value).otherwise(_nfkc(value))


def _is_ascii(value: Column) -> Column:
    return F.length(value) == F.octet_length(value)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def newline_offsets(values: pd.Series) -> pd.Series:
    """Character position at which each line starts, counting "\\n" only; linear in the text."""
    return values.map(lambda text: None if text is None else [0, *(hit.end() for hit in re.finditer("\n", text))])


#: From this length on the matcher of the library treats frequent characters as junk.
JUNK_LENGTH = 200


def name_ratio(left: str, right: str) -> float:
    """``SequenceMatcher(None, left, right).ratio()``, by substring searches: names are short."""
    if len(right) >= JUNK_LENGTH:
        return difflib.SequenceMatcher(None, left, right).ratio()
    total, matches, pending = len(left) + len(right), 0, [(left, right)]
    while pending:
        a, b = pending.pop()
        # The longest common block: the first one in a, and of that the first place in b.
        longest = at = 0
        for start in range(len(a)):
            if start + longest >= len(a):
                break
            while start + longest < len(a) and a[start : start + longest + 1] in b:
                longest, at = longest + 1, start
        if not longest:
            continue
        matches += longest
        place = b.find(a[at : at + longest])
        if at and place:
            pending.append((a[:at], b[:place]))
        if at + longest < len(a) and place + longest < len(b):
            pending.append((a[at + longest :], b[place + longest :]))
    return 2.0 * matches / total if total else 1.0


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio 2M/T of two names."""
    return pd.Series([name_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def _character_counts(names: list[str], alphabet: dict[str, int]) -> np.ndarray:
    counts = np.zeros((len(names), len(alphabet)), dtype=np.int32)
    for row, name in enumerate(names):
        for char in name:
            counts[row, alphabet[char]] += 1
    return counts


def most_similar(names: list[str], candidates: list[str], minimum: float, most: int, cells: int = 1 << 16) -> Iterator[tuple[str, str, float, int]]:
    """(name, candidate, ratio, position): of each name its best candidates other than itself, by ratio, then by candidate.

    The ratio can't exceed what the shared characters allow. Candidates are tried by that bound, until it falls below the
    last of the best. At most ``cells`` pairs, or one name's, are bounded at once.
    """
    alphabet = {char: at for at, char in enumerate(sorted({char for name in (*names, *candidates) for char in name}))}
    theirs = _character_counts(candidates, alphabet)
    lengths = theirs.sum(axis=1)
    step = max(1, cells // max(1, len(candidates)))
    for begin in range(0, len(names), step):
        part = names[begin : begin + step]
        own = _character_counts(part, alphabet)
        shared = np.zeros((len(part), len(candidates)), dtype=np.int32)
        for char in np.flatnonzero(own.any(axis=0)):
            shared += np.minimum(own[:, char, None], theirs[None, :, char])
        bounds = 2.0 * shared / np.maximum(1, own.sum(axis=1)[:, None] + lengths[None, :])
        for name, bound in zip(part, bounds):
            order = np.flatnonzero(bound >= minimum)
            order = order[np.argsort(-bound[order], kind="stable")]
            ratios: list[float] = []  # the best so far, as a heap
            found = []
            for at, limit in zip(order.tolist(), bound[order].tolist()):
                if len(ratios) == most and limit < ratios[0]:
                    break
                if candidates[at] == name:
                    continue
                ratio = name_ratio(name, candidates[at])
                if ratio < minimum:
                    continue
                found.append((-ratio, candidates[at]))
                (heappushpop if len(ratios) == most else heappush)(ratios, ratio)
            for position, (ratio, candidate) in enumerate(sorted(found)[:most], 1):
                yield name, candidate, -ratio, position
