"""Secret scans: candidates in texts, told apart by how many owners in the whole corpus have them.

A credential that one owner alone has looks live; one that stands in texts of several owners is a copied example.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import columns_but, fresh, slices, with_column
from verdigris.session import settle

#: Kinds of base findings in the order in which they are listed, then the kind that ownership adds.
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYWORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_HEX_RUN = b"x" * 24
_TOKEN_RUN = b"x" * 20


def _only(allowed: bytes) -> bytes:
    return bytes(ord("x") if byte in allowed else ord(" ") for byte in range(256))


_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_HEX_MASK = _only(_DIGITS + b"abcdef")
_TOKEN_MASK = _only(_UPPER + _LOWER + _DIGITS + b"+/_=-")
_FOLD = bytes(byte + 32 if byte in _UPPER else byte for byte in range(256))

_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("entropy", pa.float64())])
)
SPAN = "struct<kind:string,start:long,end:long,secret:string,entropy:double>"


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(count / n * math.log2(count / n) for count in Counter(value).values()) if n else 0.0


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) in code points: base findings, and token-like runs (kind ``owned``) that overlap none of them.

    A token-like run has 20 or more characters of ``[A-Za-z0-9+/_=-]`` with an upper-case letter, a lower-case letter and a
    digit. The cheap byte tests before each expression never change what it finds.
    """
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[str, int, int, str]] = []
    folded = raw.translate(_FOLD)
    if any(word in folded for word in _KEYWORDS):
        found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in raw.translate(_HEX_MASK):
        found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    if _TOKEN_RUN in raw.translate(_TOKEN_MASK):
        taken = sorted((start, end) for _, start, end, _ in found)
        at = 0
        for m in _TOKEN.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            free = at == len(taken) or taken[at][0] >= end
            if free and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0]):
                found.append(("owned", start, end, m[0]))
    found.sort(key=lambda one: (one[1], KINDS.index(one[0])))
    return found


def candidates(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with all candidate spans of every whole text.

    ``spans`` is an array of (kind, start, end, secret, entropy) by start and kind, in code points, end exclusive. Null and
    empty texts have an empty array. Other columns stay, one called like ``spans`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = [
                [{"kind": k, "start": s, "end": e, "secret": secret, "entropy": entropy(secret)} for k, s, e, secret in find(value or "")]
                for value in batch.column(text).to_pylist()
            ]
            yield with_column(batch, kept, spans, pa.array(rows, _SPANS))

    base, kept, fields = columns_but(docs, spans)
    return base.mapInArrow(run, f"{fields}`{spans}` array<{SPAN}>")


def ownership(found: DataFrame, repository: Column, owner: Column, spans: str = "spans") -> DataFrame:
    """One row per distinct secret: ``secret_hash``, ``occurrences``, ``repositories``, ``owners`` over the whole corpus.

    Counted in two steps, each combined before its shuffle, so that a secret in a third of all rows moves as a few rows.
    A null repository or owner counts as one of its own.
    """
    each = found.select(
        F.coalesce(repository.cast("string"), F.lit("\x00")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("\x00")).alias("owner"),
        F.explode(spans).alias("span"),
    ).select(F.sha2(F.col("span.secret"), 256).alias("secret_hash"), "repository", "owner")
    by_place = each.groupBy("secret_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_place.groupBy("secret_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("secret_hash").agg(
        F.sum("n").alias("occurrences"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners")
    )


def judge(
    found: DataFrame, repository: Column, owner: Column, spans: str = "spans", most_owners: int = 1, least_entropy: float = 3.5
) -> DataFrame:
    """Spans of ``found`` that hold, each with its counts and whether it looks live.

    ``found`` comes from ``candidates``. A secret with more than ``most_owners`` owners is a widely copied example; one with
    at most that many and at least ``least_entropy`` bits per character looks live. Base findings are always kept;
    token-like runs (kind ``owned``) only where they look live. The result has the rows and columns of ``found``, with
    (kind, start, end, secret, entropy, repositories, owners, live) in ``spans``. Equal rows stay as many as they are.
    """
    struct = (
        "array<struct<kind:string,start:long,end:long,secret:string,entropy:double,repositories:long,owners:long,live:boolean>>"
    )
    names = [f"`{name}`" for name in found.columns]
    counts = settle(ownership(found, repository, owner, spans), "secret-owners")
    # Rows are matched by the secrets that they hold, not by an id: equal lists get equal answers.
    key, held = fresh(found, "list_key"), fresh(found, "judged_spans")
    keyed = found.withColumn(key, F.when(F.size(spans) > 0, F.sha2(F.to_json(spans), 256)))
    lists = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.first(spans).alias("list"))
    judged = (
        lists.select(key, F.explode("list").alias("span"))
        .withColumn("secret_hash", F.sha2(F.col("span.secret"), 256))
        .join(counts, "secret_hash")
        .withColumn("live", (F.col("owners") <= most_owners) & (F.col("span.entropy") >= least_entropy))
        .where((F.col("span.kind") != "owned") | F.col("live"))
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("span.start").alias("start"),
                        F.array_position(F.array(*map(F.lit, KINDS)), F.col("span.kind")).alias("rank"),
                        "span", "repositories", "owners", "live",
                    )
                )
            ).alias("ordered")
        )
        .select(
            key,
            F.transform(
                "ordered",
                lambda one: F.struct(
                    one["span"]["kind"].alias("kind"), one["span"]["start"].alias("start"), one["span"]["end"].alias("end"),
                    one["span"]["secret"].alias("secret"), one["span"]["entropy"].alias("entropy"),
                    one["repositories"].alias("repositories"), one["owners"].alias("owners"), one["live"].alias("live"),
                ),
            ).cast(struct).alias(held),
        )
    )
    # A table between: a list in very many rows is then split over tasks when it meets its answer.
    answers = settle(judged, "secret-answers")
    some = keyed.where(F.col(key).isNotNull()).join(answers, key, "left").withColumn(spans, F.coalesce(held, F.array().cast(struct)))
    none = keyed.where(F.col(key).isNull()).withColumn(spans, F.array().cast(struct))
    return some.select(names).unionByName(none.select(names))


def mask(judged: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]", only_live: bool = False) -> DataFrame:
    """``judged`` with the spans' texts replaced by ``mark``; overlapping spans become one mark. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            new = []
            for value, found in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                if value is not None and found:
                    parts, at = [], 0
                    for one in found:
                        if only_live and not one["live"]:
                            continue
                        if one["start"] >= at:
                            parts += [value[at : one["start"]], mark]
                        at = max(at, one["end"])
                    value = "".join(parts) + value[at:] if parts else value
                new.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.string()) if name == text else batch.column(name) for name in names], names=names
            )

    names = judged.columns
    return judged.mapInArrow(run, judged.schema)


def digest(kinds_and_places: list[tuple[str, int, int]]) -> str:
    """Hex digest of kind:start:end, comma-joined; the check of the SQL-free tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in kinds_and_places).encode()).hexdigest()
