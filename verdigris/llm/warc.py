"""WARC archives: records written to volumes, duplicate payloads resolved to revisits, and archives read back.

Only headers are shuffled by payload digest. A revisit record is its header alone, joined to the original response of its
digest; a page whose digest nobody shares goes from the table to its archive without any shuffle; of a shared payload each
task sends one copy at most. Archives are files of bounded size, written and read by Spark's own sources, so that they can
lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import sift
from verdigris.llm.ordering import tied
from verdigris.session import settle

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
_HEX_DIGITS, _BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = "record_type string, page_id long, url string, date string, record_id string, payload_bytes long, payload_digest string, refers_to_record string, intact boolean"
_PAYLOAD = ["payload_digest", "payload_bytes"]


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1, upper case: each 20 bits are five hex digits and four of base 32."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _HEX_DIGITS, _BASE32_DIGITS)


def _header() -> list[Column]:
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return [
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), payload_digest(payload).alias("payload_digest"),
    ]


def headers(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload_bytes``, ``payload_digest`` of every page; a null html is an empty payload."""
    return pages.select(*_header())


def _record_id(tie: Column) -> Column:
    """A urn of its own for each record, the same whenever the record is made again."""
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("payload_digest"), F.coalesce("url", F.lit("-")), tie.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def resolve(found: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """From ``headers``: the original response of each payload that several pages have, and the revisit records.

    Payloads are equal if digest and length are. Of those of at least ``least_bytes``, the one with the smallest page_id (null
    first; then the smallest url, then any of the equal rows) is the response and the others revisit it. Shorter payloads
    and those that stand alone are in neither table.
    """
    found = settle(tied(found, "tie"), "warc-headers")
    # Nulls are the least in a struct, so the first page is the minimum.
    lowest = F.min(F.struct("page_id", "url", "tie"))
    shared = found.where(F.col("payload_bytes") >= least_bytes).groupBy(*_PAYLOAD).agg(lowest.alias("first"), F.count(F.lit(1)).alias("n"))
    shared = settle(shared.where("n > 1").select(*_PAYLOAD, "first.*"), "warc-originals")
    target = shared.withColumn("refers_to_record", _record_id(F.lit("original")))
    target = target.select(*_PAYLOAD, F.col("url").alias("to_url"), F.col("tie").alias("to_tie"), "refers_to_record")
    # Most payloads stand alone: their headers don't come to the join.
    revisits = sift(found, shared, _PAYLOAD).join(target, _PAYLOAD).where("tie <> to_tie").withColumn("record_id", _record_id(F.col("tie")))
    return shared, revisits


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line ends inside become percent escapes, so that none can be forged."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record(kind: str, date: str, payload: Column | None) -> Column:
    """A whole record without its closing line ends. A revisit's block ends with the HTTP header of the response."""
    fields = [
        _field("WARC-Type", F.lit(kind)), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")), _field("X-Page-ID", F.col("page_id").cast("string")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), _field("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    if kind == "revisit":
        fields += [
            _field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", F.col("refers_to_record")),
            _field("WARC-Refers-To-Target-URI", F.col("to_url")), _field("WARC-Refers-To-Date", F.lit(date)),
        ]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = http if payload is None else F.concat(http, payload)
    return F.concat(F.lit(f"{VERSION}\r\n"), *fields, _field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def records(pages: DataFrame, least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """One WARC record per page, as column ``record``: a response with the payload, or a revisit of the one that has it.

    ``pages`` has page_id, url and html, any of them null; other columns play no part. Every row gets a record, equal rows
    too. ``date`` is written as the time of capture (default: now).
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    shared, revisits = resolve(headers(pages), least_bytes)
    whole = tied(pages.select(*_header(), "html"), "tie")
    alone = sift(whole, shared, _PAYLOAD, keep=False).withColumn("record_id", _record_id(F.col("tie")))
    # A few that nobody shares come through the map as well; each is the first of its own payload.
    copies = sift(whole, shared, _PAYLOAD).groupBy(*_PAYLOAD).agg(F.min(F.struct("page_id", "url")).alias("first"), F.any_value("html").alias("html"))
    first = copies.select("first.*", *_PAYLOAD, "html").withColumn("record_id", _record_id(F.lit("original")))
    full = alone.select(first.columns).unionByName(first).select(_record("response", date, F.col("html")).alias("record"))
    return full.unionByName(revisits.select(_record("revisit", date, None).alias("record")))


def write(found: DataFrame, path: str, volume_bytes: int = 32 << 20) -> None:
    """Archives of about ``volume_bytes`` each (a longer record has one to itself), packed by gzip, with a warcinfo record first.

    Each volume is a row and each row a file, so Spark's commit protocol leaves only those of tasks that succeeded.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                one = record.as_py()
                if held and size + len(one) > volume_bytes:
                    yield _volume(held)
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield _volume(held)

    volumes = found.select("record").mapInArrow(packed, "value string")
    volumes.write.option("maxRecordsPerFile", 1).option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _volume(held: list[str]) -> pa.RecordBatch:
    about = "software: verdigris\r\nformat: WARC File Format 1.1\r\n"
    own = hashlib.md5(held[0][:2048].encode()).hexdigest()
    first = (
        f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:]}>\r\n"
        f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}"
    )
    return pa.RecordBatch.from_arrays([pa.array([RECORD_END.join([first, *held])], pa.string())], names=["value"])


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record of an archive; lengths decide, so a block may hold anything."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        yield fields, view[begin:at]
        at += len(RECORD_END)


def _rows(data: bytes, payloads: bool) -> Iterator[tuple]:
    for fields, block in parsed(data):
        if fields["warc-type"] not in ("response", "revisit"):
            continue
        page, stated = fields.get("x-page-id"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        size = digest = payload = None
        if fields["warc-type"] == "response":
            payload = block[bytes(block[:4096]).index(b"\r\n\r\n") + 4 :]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield (
            fields["warc-type"], int(page) if page else None, fields.get("warc-target-uri"), fields.get("warc-date"), fields["warc-record-id"],
            size, digest or stated, fields.get("warc-refers-to"), digest in (None, stated), *([payload and bytes(payload)] if payloads else []),
        )


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Response and revisit records of all archives in a folder, packed or not, with ``payload`` if asked for.

    A response's digest and length are those of its payload as read (``intact``: as stated in its header); a revisit has the
    digest that its header states and no length.
    """
    names = ["record_type", "page_id", "url", "date", "record_id", "payload_bytes", "payload_digest", "refers_to_record", "intact"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), *[pa.string()] * 2, pa.bool_()]
    schema = _RECORD
    if payloads:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows, size = [], 0
                for row in _rows(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, payloads):
                    rows.append(row)
                    size += 200 + (len(row[-1] or b"") if payloads else 0)
                    if size > 1 << 20:
                        yield given(rows)
                        rows, size = [], 0
                if rows:
                    yield given(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpacked, schema)


def resolved(found: DataFrame) -> DataFrame:
    """The records of ``read`` with ``refers_to`` (page_id of the response that a revisit stands for) and its length.

    Revisits meet responses by payload digest and record id. One whose response is in none of the archives keeps its header,
    with neither.
    """
    key = ["payload_digest", "refers_to_record"]
    response, revisit = found.where("record_type = 'response'"), found.where("record_type = 'revisit'")
    target = response.select("payload_digest", F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    joined = revisit.join(target, key, "left").select(
        *(F.col("full_bytes").alias(name) if name == "payload_bytes" else F.col(name) for name in found.columns), "refers_to"
    )
    return response.withColumn("refers_to", F.lit(None).cast("long")).unionByName(joined)
