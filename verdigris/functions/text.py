"""Column expressions over source text. All run inside whole-stage codegen."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"

# The characters that end a line, besides "\r\n".
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# White space as understood by a whitespace split.
WHITESPACE = "(?U)[\\s\\x1c-\\x1f]+"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squash_whitespace(value: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(value), WHITESPACE, " "))


def normalize_evidence(value: str | Column) -> Column:
    """Case-insensitive, whitespace-insensitive form of a quoted piece of code.

    Uses ``lower``; full case folding differs on a few letters such as the sharp s.
    """
    return squash_whitespace(F.lower(col(value)))


def split_lines(value: str | Column) -> Column:
    """Lines of a text without their terminators; a final empty piece is dropped."""
    pieces = F.split(col(value), f"\r\n|[{LINE_BREAKS}]", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def utf8_bytes(value: str | Column) -> Column:
    return F.octet_length(col(value))


def estimate_tokens(value: str | Column) -> Column:
    """Conservative count: half the UTF-8 bytes, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(utf8_bytes(value) / 2).cast("int"))


def estimate_request_tokens(chars: str | Column, max_output: str | Column | int) -> Column:
    """Admission estimate for one request: a third of the characters plus the output budget."""
    budget = F.lit(max_output) if isinstance(max_output, int) else col(max_output)
    return F.greatest(F.lit(1), F.floor(col(chars) / 3).cast("int")) + budget


def contains_any(value: str | Column, markers: tuple[str, ...]) -> Column:
    """True when the text holds one of the literal markers."""
    return reduce(or_, [col(value).contains(marker) for marker in markers])


def joined_hash(*parts: Column) -> Column:
    """sha256 over parts separated by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(part, F.lit("")) for part in parts]), 256)


def fingerprint(path: Column, file_id: Column, rule_id: Column, symbol: Column, evidence: Column) -> Column:
    """Identity of an issue that survives moves inside a file."""
    return joined_hash(
        F.lower(F.coalesce(path, file_id)),
        F.lower(rule_id),
        symbol,
        normalize_evidence(evidence),
    )


def glob_to_regex(pattern: str) -> str:
    """Shell glob as a Java regex. ``*`` and ``**`` both cross ``/``; ``?`` and ``[...]`` as usual."""
    out: list[str] = []
    at = 0
    while at < len(pattern):
        char = pattern[at]
        close = pattern.find("]", at + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[at + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            at = close
        else:
            out.append(re.escape(char))
        at += 1
    return "(?s)^" + "".join(out) + "$"
