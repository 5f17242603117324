import base64
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from dendrospark.llm import warc
from dendrospark.llm.entry import op4_warc_salvage

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://b/3", None), (4, None, ""), (5, "http://b/5", "<p>\u00e9</p>" * 2000), (5, "http://b/5", "<p>\u00e9</p>" * 2000), (None, "http://b/6", "<p>no id</p>"), (9, "http://a/9\r\nX: y", "WARC/1.1\r\n\r\n tricky")]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, payload string, digest string, size int").repartition(3)


def test_query_against_plain_python(spark, folder):
    rows = op4_warc_salvage(spark, folder(pages=table(spark))).collect()
    groups = {}
    for i, _, h in PAGES:
        groups.setdefault((h or "").encode(), []).append(i)
    expected = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        ids = groups[raw]
        top = max((x for x in ids if x is not None), default=None)
        revisit = len(ids) > 1 and i != top
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected


def test_payloads_come_back(spark):
    read = warc.read_archives(warc.write_archives(table(spark), archive_bytes=300))
    stored = {bytes(r.payload) for r in read.where("kind = 'response'").collect()}
    assert stored == {(h or "").encode() for _, _, h in PAGES}
    assert read.where("kind = 'gap'").count() == 0


def records(n=6):
    return [warc.compose("response", i, f"http://h/{i}", f"payload {i}".encode() * 9, None) for i in range(n)]


def test_salvage_after_damage():
    members = [warc.member(r) for r in records()]
    data = b"".join(members)
    ends = [0]
    for m in members:
        ends.append(ends[-1] + len(m))
    for victim in range(6):
        broken = bytearray(data)
        broken[ends[victim] + 30] ^= 0xFF
        found = list(warc.salvage(bytes(broken)))
        gaps = [(at, n) for at, n, head, _ in found if head is None]
        assert gaps == [(ends[victim], len(members[victim]))]
        assert len(found) == 6 and sum(n for _, n, _, _ in found) == len(data)


def test_salvage_plain_records_junk_and_truncation():
    rows = records(3)
    data = b"junk" + rows[0] + warc.member(rows[1]) + b"\x1f\x8b\x08 not gzip WARC/1.1 not a record" + rows[2] + warc.member(rows[0])[:-5]
    kinds = [head and head["warc-record-id"] for _, _, head, _ in warc.salvage(data)]
    assert kinds == [None, "<urn:page:0>", "<urn:page:1>", None, "<urn:page:2>", None]
    assert list(warc.salvage(b"")) == []


def test_wrong_digest_is_quarantined():
    bad = records(1)[0].replace(b"payload 0", b"payload X", 1)
    assert [h for _, _, h, _ in warc.salvage(warc.member(bad))] == [None]


def test_gap_rows(spark):
    data = b"".join(warc.member(r) for r in records())
    df = spark.createDataFrame([("a", bytearray(data[:100] + b"\0\0" + data[102:])), ("b", bytearray(b""))], "archive_id string, data binary")
    out = warc.read_archives(df)
    assert out.where("kind = 'gap'").select(F.sum("length")).first()[0] > 0
    assert out.where("kind = 'response'").count() == 5


def test_empty_table(spark, folder):
    assert op4_warc_salvage(spark, folder(pages=table(spark).limit(0))).count() == 0


def test_members_with_several_records_of_any_type():
    """A whole archive in one member, records of other types and without digest, damage between them."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    bare = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    rows = [info, *records(2), bare]
    whole = warc.member(b"".join(rows))
    assert [(h["warc-type"], b) for _, _, h, b in warc.salvage(whole)] == [("warcinfo", b"abcd"), ("response", b"payload 0" * 9), ("response", b"payload 1" * 9), ("response", b"ok")]
    spoiled = rows[1].replace(b"payload 0", b"payload X", 1)
    found = list(warc.salvage(warc.member(info + spoiled + rows[2])))
    assert [h and h["warc-type"] for _, _, h, _ in found] == ["warcinfo", None, "response"]


def test_gaps_are_counted_and_logged(spark, caplog):
    data = b"".join(warc.member(r) for r in records())
    df = spark.createDataFrame([("a", bytearray(data[:100] + b"\0\0" + data[102:]))], "archive_id string, data binary")
    assert warc.log_gaps(warc.read_archives(df)) == 1 and "1 gaps of" in caplog.text
    assert warc.log_gaps(warc.read_archives(df.limit(0))) == 0
