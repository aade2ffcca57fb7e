"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.llm.common import columns_but, slices, with_column

#: White space as the split pattern knows it (Unicode White_Space). Fixed values.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run this long would exhaust the stack of the tokenizer's look-ahead.
_LONG_RUN = re.compile(f"[{_WHITE}]{{500,}}")
#: Between a non-white and a white character every match of the pattern ends.
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
#: Texts beyond this many characters are encoded piece by piece.
PIECE = 1 << 18


class Codec:
    """Encodes and decodes by a rank file; one per Python worker and file."""

    _open: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._ranks = ranks

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        key = (path, pattern)
        if key not in cls._open:
            cls._open[key] = cls(path, pattern)
        return cls._open[key]

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, as one call of the library gives them."""
        if len(text) < 500:
            return self._plain.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _LONG_RUN.finditer(text):
            self._pieces(text, at, run.start(), ids)
            # A run before a word is one match but for its last character, which goes to what follows.
            at = run.end() if run.end() == len(text) else run.end() - 1
            ids.extend(self._one(text[run.start() : at]))
        self._pieces(text, at, len(text), ids)
        return ids

    def _one(self, match: str) -> list[int]:
        raw = match.encode()
        rank = self._ranks.get(raw)
        return [rank] if rank is not None else self._plain._core_bpe.encode_single_piece(raw)

    def _pieces(self, text: str, at: int, end: int, ids: list[int]) -> None:
        while end - at > PIECE:
            cut = _SAFE.search(text, at + PIECE, end)
            if cut is None:
                break
            ids.extend(self._plain.encode_ordinary(text[at : cut.start()]))
            at = cut.start()
        if at < end:
            ids.extend(self._plain.encode_ordinary(text[at:end]))

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes; ids outside the ranks raise KeyError."""
        return self._plain.decode_bytes(ids)


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", packed: bool = False, decoded: str | None = None
) -> DataFrame:
    """``docs`` with the token ids of every whole text, without special tokens.

    ``ids`` is an array of integers, or with ``packed`` a binary of little-endian unsigned 32-bit integers. With
    a name for ``decoded``, the bytes that the ids decode to come in the same pass. A null or empty
    text has no ids. Long texts are cut at safe boundaries only, so ids do not depend on the cuts. Other columns stay as
    they are, one called like ``ids`` is replaced; equal rows give equal results; an empty table gives an empty one. The
    rank file must lie at ``path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in slices(batches, text):
            found = [np.array(codec.encode(value or ""), "<u4") for value in batch.column(text).to_pylist()]
            if packed:
                column = pa.array([one.tobytes() for one in found], pa.binary())
            else:
                flat = np.concatenate(found) if found else np.zeros(0, "<u4")
                column = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat.astype(np.int32), pa.int32())
                )
            out = with_column(batch, kept, ids, column)
            if decoded:
                out = with_column(out, [*kept, ids], decoded, pa.array([codec.decode(one.tolist()) for one in found], pa.binary()))
            yield out

    base, kept, fields = columns_but(docs.drop(decoded) if decoded and decoded != text else docs, ids)
    more = f", `{decoded}` binary" if decoded else ""
    return base.mapInArrow(run, f"{fields}`{ids}` {'binary' if packed else 'array<int>'}{more}")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes of its ids (array or packed), which may be no valid text; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                column = pa.array([codec.decode(_listed(value)) for value in part.column(ids).to_pylist()], pa.binary())
                yield with_column(part, kept, decoded, column)

    base, kept, fields = columns_but(encoded, decoded)
    return base.mapInArrow(run, f"{fields}`{decoded}` binary")


def _listed(value: bytes | list[int] | None) -> list[int]:
    return np.frombuffer(value, "<u4").tolist() if isinstance(value, bytes) else value or []
