"""WARC archives: one gzip member per record, and a sequential reader that trusts nothing but the bytes."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, sliced, stored

#: An archive is closed after so many bytes of payload.
ARCHIVE_BYTES = 1 << 20
#: The reader inflates so much at a time.
CHUNK = 1 << 16
#: Records that the reader gives at a time, at most.
SLICE_RECORDS = 10_000
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([f"{first}\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, with the length of the payload that it doesn't repeat."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "") or f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields[3:3] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>"),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_head("WARC/1.1", fields) + block + b"\r\n\r\n") + pack.flush()


class Damaged(ValueError):
    """The bytes are no whole archive."""


def members(archive: bytes) -> Iterator[bytes]:
    """The contents of each gzip member, inflated a chunk at a time."""
    rest = memoryview(archive)
    while len(rest):
        inflate, parts = zlib.decompressobj(31), []
        try:
            while not inflate.eof:
                if not len(rest):
                    raise Damaged("the last member is cut short")
                piece, rest = rest[:CHUNK], rest[CHUNK:]
                parts.append(inflate.decompress(piece))
        except zlib.error as e:
            raise Damaged(str(e)) from e
        if inflate.unused_data:
            at = len(archive) - len(rest) - len(inflate.unused_data)
            rest = memoryview(archive)[at:]
        yield b"".join(parts)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:  # heads may be in Latin-1, in which any bytes are text
        text = head.decode("latin-1")
    first, *lines = text.split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _whole(number: str | None) -> int | None:
    """A whole number as heads write it; null if it is none."""
    return int(number) if number is not None and re.fullmatch(r"[0-9]{1,18}", number) else None


def _number(field: str | None) -> int | None:
    return int(field) if re.fullmatch(r"-?[0-9]{1,19}", field or "") else None


def parse(member: bytes) -> dict:
    """A record's fields, its block framed by the record's Content-Length, its digests verified. Raises `Damaged`.

    The payload is what follows the HTTP head. That head's own Content-Length may tell of an encoded body or be no number, so it only counts for revisits, which don't
    repeat their payload. Digests of other kinds than SHA-1 in base32 aren't verified.
    """
    head, gap, body = member.partition(b"\r\n\r\n")
    first, fields = _fields(head)
    if not gap or not first.startswith("WARC/"):
        raise Damaged("no record head")
    size = _whole(fields.get("content-length"))
    if size is None:
        raise Damaged("no length")
    block, end = body[:size], body[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise Damaged("the block isn't as long as said")
    if _sha1(fields.get("warc-block-digest")) not in (None, digest(block)):
        raise Damaged("block digest")
    is_http = fields.get("content-type", "").replace(" ", "").startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    said = _sha1(fields.get("warc-payload-digest"))
    length = len(payload)
    if fields.get("warc-type") == "revisit":
        length = _whole(_fields(http)[1].get("content-length"))
    elif said not in (None, digest(payload)):
        raise Damaged("payload digest")
    fields |= {"payload": payload, "payload_bytes": length, "payload_digest": said or digest(payload)}
    return fields


def _sha1(field: str | None) -> str | None:
    """The digest of a field ``sha1:...`` in base32; null for others."""
    found = re.fullmatch(r"sha1:([A-Za-z2-7]{32})", field or "", re.IGNORECASE)
    return found[1].upper() if found else None


def write_archives(df: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """Rows ``archive`` (a name), ``n_records`` and ``content`` (the bytes of a ``.warc.gz``), each of about `ARCHIVE_BYTES` of payload.

    Of the records with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is the response and the others are revisits of it. A null payload
    is an empty one. A null id never is the largest, and revisits another if there is one; repeated rows of the largest id are all responses. Empty tables give no
    archives. Other columns are ignored, whatever their names.

    The rows are joined with one row for each digest, found by a partial maximum, so a payload that a third of the rows share is split like any skewed join.
    """
    rows = df.select(df[id_col].alias("__id"), df[url_col].cast("string").alias("__url"), F.coalesce(F.encode(df[html_col], "UTF-8"), F.lit(b"")).alias("__body"))
    rows = rows.withColumn("__sha", F.unhex(F.sha1("__body")))
    long_enough = F.octet_length("__body") >= min_bytes
    last = rows.where(long_enough).groupBy("__sha").agg(F.max("__id").alias("__last"), F.count("*").alias("__n")).where("__n > 1").select("__sha", "__last")
    own = F.when(long_enough & F.col("__last").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__last")), F.col("__last"))
    made = rows.join(last, "__sha", "left").select("__id", "__url", "__body", own.alias("__refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            name = f"{uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha1(b''.join(parts)).hexdigest())}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts)], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["archive", "n_records", "content"])

        parts: list[bytes] = []
        size = 0
        for batch in sliced(batches, "__body"):
            for page, url, body, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(record(page, url, body, refers))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    parts, size = [], 0
        if parts:
            yield closed()

    return made.mapInArrow(run, "archive string, n_records long, content binary")


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """A row for each record of the archives in ``content_col`` (as here, or of Spark's ``binaryFile`` source): ``page_id``, ``url``, ``record_type``,
    ``payload_bytes``, ``payload_digest``, ``refers_to``, ``payload`` and ``fault``.

    A damaged record gives a row with only ``fault``; the reader goes on with the next member, or ends the archive where inflating fails. Null and empty archives have
    no records. Archives of others, whose records lack the two fields of page numbers, have null ``page_id`` and ``refers_to``. A worker holds an archive's packed bytes
    and one slice of its records, not all of them.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "fault"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def rows(archive: bytes) -> Iterator[tuple]:
        try:
            for member in members(archive):
                try:
                    r = parse(member)
                    yield (_number(r.get("x-page-id")), r.get("warc-target-uri"), r.get("warc-type"), r["payload_bytes"], r["payload_digest"], _number(r.get("x-refers-to-page-id")), r["payload"], None)
                except Damaged as e:
                    yield (*[None] * 7, str(e))
        except Damaged as e:
            yield (*[None] * 7, str(e))

    def table(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                got: list[tuple] = []
                size = 0
                for r in rows(archive.as_py() or b""):
                    got.append(r)
                    size += len(r[6] or b"")
                    if size >= SLICE_BYTES or len(got) >= SLICE_RECORDS:
                        yield table(got)
                        got, size = [], 0
                if got:
                    yield table(got)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, fault string"
    return archives.select(archives[content_col]).mapInArrow(run, schema)


def round_trip(df: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """The records of `write_archives`, stored in the shared folder and read back."""
    return read_archives(stored(write_archives(df, id_col, url_col, html_col, min_bytes), "warc"))
