"""Elias-Fano sequences and the n-gram trie made of them, as flat bytes that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Values whose bits are spread out at a time, a multiple of eight.
_PART = 1 << 16


class EliasFano:
    """A monotone sequence of unsigned 64-bit values: low bits packed, high bits in unary, one rank per 64 bits.

    ``parts`` are views of flat arrays, of a file mapped by ``numpy.memmap`` as well as of a buffer.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values`` ascending and below ``universe``."""
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low_bits = min(low_bits, 56)
        shift = np.uint64(low_bits)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(ones[-1]) if n else 0) // 64 + 2) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        low = np.zeros(0, np.uint8)
        if low_bits:
            packed = []
            for at in range(0, n, _PART):  # a multiple of eight values fills whole bytes
                part = values[at : at + _PART]
                columns = np.empty((len(part), low_bits), np.uint8)
                for bit in range(low_bits):
                    columns[:, bit] = (part >> np.uint64(bit)).astype(np.uint8) & 1
                packed.append(np.packbits(columns.ravel(), bitorder="little"))
            low = np.concatenate([low, *packed])
        low = np.concatenate([low, np.zeros(16, np.uint8)])
        return cls(n, low_bits, low, high, cls._zero_ranks(high))

    @staticmethod
    def _zero_ranks(high: np.ndarray) -> np.ndarray:
        zeros = 64 - np.bitwise_count(high).astype(np.int64)
        return np.concatenate([[0], np.cumsum(zeros)]).astype("<u4")

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        pad = b"\0" * (-len(self.low) % 8)
        ranks = self.ranks.tobytes()
        return head.tobytes() + self.low.tobytes() + pad + self.high.tobytes() + ranks + b"\0" * (-len(ranks) % 8)

    @classmethod
    def open(cls, buffer: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence at byte ``at`` of a uint8 array, without a copy, and where the next one begins."""
        n, low_bits, low, high = (int(one) for one in buffer[at : at + 32].view("<u8"))
        at += 32
        lows = buffer[at : at + low]
        at += low + -low % 8
        highs = buffer[at : at + 8 * high].view("<u8")
        at += 8 * high
        ranks = buffer[at : at + 4 * (high + 1)].view("<u4")
        size = 4 * (high + 1)
        return cls(n, low_bits, lows, highs, ranks), at + size + -size % 8

    def _low_at(self, places: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(places), np.uint64)
        bit = places * self.low_bits
        byte, offset = bit >> 3, (bit & 7).astype(np.uint64)
        value = np.zeros(len(places), np.uint64)
        for k in range(8):
            value |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        value >>= offset
        return value & ((_ONE << np.uint64(self.low_bits)) - _ONE)

    def _ones_before_zero(self, which: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most ``which``: the ones before that zero (counted from 0)."""
        word = np.searchsorted(self.ranks, which.astype(np.int64), "right") - 1
        beyond = word >= len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        left = which.astype(np.int64) - self.ranks[word].astype(np.int64)
        bits = ~self.high[word]
        position = np.zeros(len(which), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # the place of the zero that has ``left`` zeros before it
            part = bits & ((_ONE << np.uint64(step)) - _ONE)
            inside = np.bitwise_count(part).astype(np.int64)
            skip = inside <= left
            left = np.where(skip, left - inside, left)
            position += np.where(skip, step, 0)
            bits = np.where(skip, bits >> np.uint64(step), part)
        return np.where(beyond, self.n, word * 64 + position - which.astype(np.int64))

    def successor(self, values: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first entry of [first, last) that isn't below each value, and whether it equals it."""
        values = values.astype(np.uint64)
        high = values >> np.uint64(self.low_bits)
        top = np.uint64(int(self.ranks[-1]))
        clipped = np.minimum(high, top)
        low_end = self._ones_before_zero(clipped)
        low_start = np.where(clipped > 0, self._ones_before_zero(np.maximum(clipped, _ONE) - _ONE), 0)
        last = self.n if last is None else last
        a, end = np.maximum(low_start, first), np.minimum(low_end, last)
        b = np.maximum(end, a)
        wanted = values & ((_ONE << np.uint64(self.low_bits)) - _ONE) if self.low_bits else np.zeros(len(values), np.uint64)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            middle = (a[open_] + b[open_]) >> 1
            less = self._low_at(middle) < wanted[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
        found = (a < end) & (high < top)
        at = np.flatnonzero(found)
        found[at] = self._low_at(a[at]) == wanted[at]
        return a, found

    def access(self, places: np.ndarray) -> np.ndarray:
        """Values at the places (by a search for the one that stands there)."""
        word_ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))])
        word = np.searchsorted(word_ones, places, "right") - 1
        left = places - word_ones[word]
        bits, position = self.high[word], np.zeros(len(places), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = bits & ((_ONE << np.uint64(step)) - _ONE)
            inside = np.bitwise_count(part).astype(np.int64)
            skip = inside <= left
            left = np.where(skip, left - inside, left)
            position += np.where(skip, step, 0)
            bits = np.where(skip, bits >> np.uint64(step), part)
        high = (word * 64 + position - places).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low_at(places)


class Trie:
    """Two levels: contexts, and for each the successors with a quantised log10 probability.

    Contexts are an Elias-Fano sequence of hashes, so are the pointers to their successors. A successor is stored relative
    to its context (context place in the upper half, word hash in the lower), which makes the whole level monotone.
    Probabilities are one byte each, an entry of a table of 255 evenly spaced logarithms.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, table: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes, self.table = contexts, pointers, successors, codes, table

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, logs: np.ndarray) -> Trie:
        """From distinct (context hash, 32-bit word hash) pairs in ascending order and their log10 probabilities."""
        new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(context)]))
        low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        table = np.concatenate([[-np.inf], np.linspace(low, high, 255)])
        codes = np.rint((logs - low) / max(high - low, 1e-12) * 254).astype(np.uint8) + np.uint8(1) if len(logs) else np.zeros(0, np.uint8)
        return cls(
            EliasFano.of(context[new], 1 << 64),
            EliasFano.of(np.r_[new, len(context)], len(context) + 1),
            EliasFano.of((place.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), max(1, len(new)) << 32),
            codes, table,
        )

    def to_bytes(self) -> bytes:
        return b"".join(
            [
                self.contexts.to_bytes(), self.pointers.to_bytes(), self.successors.to_bytes(), self.table.astype("<f8").tobytes(),
                self.codes.tobytes(),
            ]
        )

    @classmethod
    def open(cls, levels: bytes | np.ndarray) -> Trie:
        """From bytes, or a uint8 array such as ``numpy.memmap(path, numpy.uint8, 'r')``; nothing is copied."""
        buffer = np.frombuffer(levels, np.uint8) if isinstance(levels, (bytes, memoryview)) else levels
        contexts, at = EliasFano.open(buffer, 0)
        pointers, at = EliasFano.open(buffer, at)
        successors, at = EliasFano.open(buffer, at)
        table = buffer[at : at + 8 * 256].view("<f8")
        return cls(contexts, pointers, successors, buffer[at + 8 * 256 :], table)

    def codes_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """One byte per pair, zero where the pair isn't stored: find the context, then the successor within its range."""
        out = np.zeros(len(context), np.uint8)
        if not self.contexts.n or not len(context):
            return out
        new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])  # runs of one context are looked up once
        place, known = self.contexts.successor(context[new])
        place = np.where(known, place, 0)
        bounds = self.pointers.access(np.concatenate([place, place + 1])).astype(np.int64)
        lengths = np.diff(np.r_[new, len(context)])
        each = lambda values: np.repeat(values, lengths)
        asked = np.flatnonzero(each(known))
        first, last = each(bounds[: len(place)])[asked], each(bounds[len(place) :])[asked]
        relative = (each(place)[asked].astype(np.uint64) << np.uint64(32)) | word[asked].astype(np.uint64)
        at, found = self.successors.successor(relative, first, last)
        out[asked[found]] = self.codes[at[found]]
        return out

    def logs(self, codes: np.ndarray) -> np.ndarray:
        return self.table[codes]
