"""WARC archives of a page table, and a reader that salvages damaged ones.

Writing: every page is one gzip member holding one WARC/1.1 record.  Pages with equal payloads
share one stored body: the page with the largest id is the ``response``, the others are
``revisit`` records that carry the payload digest and name it.  Archives are blobs of a few MB
in a table of the shared folder, so any executor can read any of them.

Reading: members are read one after another; one member may hold several records, of any type.  A
member counts only if its checksum holds, a record only if its header and length do, and its payload
digest where it has one.  After a failed check the reader looks for the next offset at which a whole
valid member or an uncompressed version line with a valid record begins, goes on from there, and
reports the bytes in between as a ``gap`` row.  A record that fails inside a sound member is a gap of
that member, and so is what follows up to the next valid version line in it.

Defined cases: null html is an empty payload; a null page id is written without an id and comes
back null; repeated rows are records of their own, and rows that repeat the largest id of their
payload are all responses; records of very long pages are held one at a time; an empty table gives
no archives; further columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of, utf8

log = logging.getLogger(__name__)

ARCHIVE_BYTES = 4 << 20
WINDOW = 16 << 10  #: bytes fed to the decompressor at once
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
DATE = "1970-01-01T00:00:00Z"  #: of records whose pages have no date of their own
RECORDS = "archive_id string, offset long, length long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, note string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def compose(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit names its payload but does not hold it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if kind == "response" else b""
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def parse(record: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, body and end of the record that begins at ``at``; None if it is not valid."""
    if not record.startswith(VERSION, at):
        return None
    end = record.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    try:
        lines = record[at:end].decode().split("\r\n")
    except UnicodeDecodeError:
        return None
    head = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    size = head.get("content-length", "")
    if not size.isdigit() or not head.get("warc-type"):
        return None
    body = record[end + 4 : end + 4 + int(size)]
    stop = end + 4 + int(size)
    if len(body) != int(size) or record[stop : stop + 4] != b"\r\n\r\n":
        return None
    named = head.get("warc-payload-digest", "")
    if head["warc-type"] == "response" and named.startswith("sha1:") and named != f"sha1:{digest32(body)}":
        return None
    return head, body, stop + 4


Found = tuple[int, int, dict[str, str] | None, bytes]  #: offset, length, headers (None for a gap), body


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The contents of the member that begins at ``at`` and the offset after it, if it is sound."""
    unpack, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and end < len(data):
            parts.append(unpack.decompress(data[end : end + WINDOW]))
            end += WINDOW
    except zlib.error:
        return None
    return (b"".join(parts), min(end, len(data)) - len(unpack.unused_data)) if unpack.eof else None


def records(text: bytes) -> Iterator[Found]:
    """The records of a member's contents, and what lies between valid ones."""
    at, bad = 0, -1
    while at < len(text):
        found = parse(text, at)
        if found:
            if bad >= 0:
                yield bad, at - bad, None, b""
                bad = -1
            yield at, found[2] - at, found[0], found[1]
            at = found[2]
            continue
        bad = at if bad < 0 else bad
        ahead = text.find(VERSION, at + 1)
        at = ahead if ahead >= 0 else len(text)
    if bad >= 0:
        yield bad, len(text) - bad, None, b""


def salvage(data: bytes) -> Iterator[Found]:
    """Records and quarantined gaps of an archive.  Those inside a member have the member's offset and length."""
    at, bad = 0, -1
    while at < len(data):
        own: list[Found] = []
        end = at
        if data.startswith(MAGIC, at) and (opened := inflate(data, at)):
            end = opened[1]
            own = [(at, end - at, head, body) for _, _, head, body in records(opened[0])]
        elif found := parse(data, at):
            end = found[2]
            own = [(at, end - at, found[0], found[1])]
        if any(head for _, _, head, _ in own):
            if bad >= 0:
                yield bad, at - bad, None, b""
                bad = -1
            yield from own
            at = end
            continue
        bad = at if bad < 0 else bad
        ahead = [x for x in (data.find(MAGIC, at + 1), data.find(VERSION, at + 1)) if x >= 0]
        at = min(ahead, default=len(data))
    if bad >= 0:
        yield bad, len(data) - bad, None, b""


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive_id, data, n_records) of ``pages`` (page_id, url, html), in the shared folder.

    Payloads of at least ``least`` bytes are stored once.  The digests of repeated payloads come
    from an aggregate that is combined before its shuffle; its join back to the pages is on the
    digest alone, so that Spark may split a digest that a large share of the pages has.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload").alias("size")
    repeated = own.groupBy("digest", size).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= least))
    joined = own.join(repeated.select("digest", "first"), "digest", "left").select("page_id", "url", "payload", "first")

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, weight = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{serial:06d}"]), pa.array([b"".join(held)], pa.binary()), pa.array([len(held)], pa.int64())], ["archive_id", "data", "n_records"])

        for batch in source:
            for page_id, url, payload, first in rows_of(batch, "page_id", "url", "payload", "first"):
                kind = "revisit" if first is not None and page_id != first and page_id is not None else "response"
                held.append(member(compose(kind, page_id, url, payload, first)))
                weight += len(held[-1])
                if weight >= archive_bytes:
                    yield flush()
                    serial, held, weight = serial + 1, [], 0
        if held:
            yield flush()

    return materialise(joined.mapInArrow(pack, "archive_id string, data binary, n_records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives (archive_id, data), as RECORDS says."""

    def number(text: str | None) -> int | None:
        tail = (text or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in source:
            for i in range(batch.num_rows):
                name, data = batch.column("archive_id")[i].as_py(), batch.column("data")[i].as_py()
                held, weight = [], 0
                for at, length, head, body in salvage(data or b""):
                    if head is None:
                        held.append((name, at, length, "gap", None, None, None, None, None, None, f"quarantined bytes {at} to {at + length}"))
                    else:
                        kind = head["warc-type"]
                        held.append((name, at, length, kind, number(head.get("warc-record-id")), head.get("warc-target-uri"), int(head["warc-payload-length"]) if kind == "revisit" and head.get("warc-payload-length", "").isdigit() else len(body), head.get("warc-payload-digest", "").removeprefix("sha1:"), number(head.get("warc-refers-to")), None if kind == "revisit" else body, None))
                    weight += len(body)
                    if weight > 4 << 20 or len(held) >= 5000:
                        yield flush(held)
                        held, weight = [], 0
                if held:
                    yield flush(held)

    return archives.select("archive_id", "data").mapInArrow(read, RECORDS)


def log_gaps(records: DataFrame) -> int:
    """Warns of quarantined gaps with their number, bytes and archives; returns the number."""
    found = records.where("kind = 'gap'").agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.count_distinct("archive_id").alias("archives")).first()
    if found.n:
        log.warning("%d gaps of %d bytes in %d archives were quarantined", found.n, found.size, found.archives)
    return int(found.n)
