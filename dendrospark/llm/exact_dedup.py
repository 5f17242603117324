"""Exact duplicates by an exchange of Golomb-coded fingerprints, then of suspects alone.

Texts are equal if they are so after every blank (space and bytes 9 to 13) is deleted.

Each partition is a row of senders: runs of at most ``MOST_ROWS`` rows or about ``MOST_BYTES`` bytes of
text.  A sender compares its own texts byte by byte, so that each different one counts once however often
it occurs, and sends its fingerprints (the first bits of SHA-256), sorted, to the owners of their ranges:
the gaps in a Golomb code, which takes some 1.5 bits more than the logarithm of the mean gap.  An owner answers with a bitmap for each
sender: which of its fingerprints another sender has too.  The senders' texts lie in buckets by sender,
so only the bitmaps travel to them.

What is set is suspect, and only suspects' texts are shuffled: rows with equal bytes form a group, summed
up before the shuffle, so a text that is a third of the corpus is one row of a task there.  Of a
group, the longest original text stays, then the smallest id.

Fingerprints have ``SPARE`` bits more than would number the rows, so about one in 2^SPARE texts is suspect
without cause; the bytes tell.  There are at least as many owners as shuffle partitions, more for more
rows, so an owner holds some 2^18 fingerprints.

Defined cases: null and blank texts are equal to the empty one; a null id is after all others; of rows
equal in length and id, one stays (the first of the first sender); repeated rows are copies like any other;
long texts are read whole, one at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, materialise

BLANKS = b" \t\n\v\f\r"
MOST_ROWS, MOST_BYTES = 1 << 16, 32 << 20
SPARE = 10  #: bits of a fingerprint beyond those that number the rows
OWNED = 1 << 18  #: fingerprints of an owner, about


def digest(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def parameter(gap: float) -> int:
    """The Golomb parameter for geometric gaps (from 0) of this mean."""
    return max(1, math.ceil(gap * math.log(2)))


def golomb_encode(values: np.ndarray, m: int) -> bytes:
    """Sorted different integers as gaps: quotients in unary, remainders in truncated binary, each in a part of its own."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    quotient, rest = gaps // m, gaps % m
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    wide = (m - 1).bit_length()
    cut = (1 << wide) - m  # remainders below it take one bit less
    long = rest >= cut
    code = np.where(long, (rest + cut) >> 1, rest)
    short = ((code[:, None] >> np.arange(max(0, wide - 1))) & 1).astype(np.uint8).ravel()
    last = ((rest + cut) & 1)[long].astype(np.uint8) if wide else np.zeros(0, np.uint8)
    return len(unary).to_bytes(4, "little") + np.packbits(np.concatenate([unary, short, last])).tobytes()


def golomb_decode(blob: bytes, count: int, m: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=4))
    at = int.from_bytes(blob[:4], "little")
    quotient = np.diff(np.flatnonzero(bits[:at]), prepend=-1) - 1
    wide = (m - 1).bit_length()
    if not wide:
        return np.cumsum(quotient + 1) - 1
    cut, size = (1 << wide) - m, wide - 1
    code = bits[at : at + count * size].reshape(count, size).astype(np.int64) @ (np.int64(1) << np.arange(size, dtype=np.int64))
    at += count * size
    long = code >= cut
    rest = code.copy()
    rest[long] = 2 * code[long] + bits[at : at + int(long.sum())] - cut
    return np.cumsum(quotient * m + rest + 1) - 1


def plan(n: int, partitions: int) -> tuple[int, int]:
    """Bits of a fingerprint, and how many of them name its owner, for ``n`` rows."""
    owner = max(partitions - 1, n // OWNED).bit_length()
    return max(n.bit_length() + SPARE, owner), owner


def messages(prints: np.ndarray, bits: int, owner_bits: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(owner, first, count, parameter, code) for sorted different fingerprints; ``first`` is their place among all."""
    low = bits - owner_bits
    owner = prints >> low
    cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(prints)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            m = parameter(max(0.0, (1 << low) / (b - a) - 1))
            yield int(owner[a]), a, b - a, m, golomb_encode(prints[a:b] & ((1 << low) - 1), m)


class Sender:
    """A run of rows of one task: its different texts, by bytes, with the rows that have them."""

    def __init__(self, most_rows: int, most_bytes: int) -> None:
        self.slots: dict[bytes, list[tuple]] = {}
        self.rows = self.weight = 0
        self.most_rows, self.most_bytes = most_rows, most_bytes

    def add(self, body: bytes, row_id: object, length: int) -> None:
        own = body.translate(None, BLANKS)
        found = self.slots.setdefault(own, [])
        if not found:
            self.weight += len(own)
        found.append((-length, row_id is None, row_id, self.rows))
        self.rows += 1

    @property
    def full(self) -> bool:
        return self.rows >= self.most_rows or self.weight >= self.most_bytes

    def tables(self, number: int, bits: int, owner_bits: int, schema: pa.Schema, digest: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
        """Its texts, then its messages."""
        bodies = list(self.slots)
        digests = [digest(b) for b in bodies]
        prints = np.array([int.from_bytes(d[:8], "big") >> (64 - bits) for d in digests], np.int64)
        different, place = np.unique(prints, return_inverse=True)
        members = list(self.slots.values())
        flat = [(*m[:3], number, m[3]) for own in members for m in own]
        kind = schema.field("members").type
        parts = [pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), kind.value_type, strict=True)]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, members)]).astype(np.int32), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)
        own = {"kind": pa.array(["text"] * len(bodies)), "sender": pa.array(np.full(len(bodies), number)), "sha": pa.array(digests, pa.binary()), "place": pa.array(place.astype(np.int32)), "members": lists, "body": pa.array(bodies, pa.binary())}
        yield batch(own, len(bodies), schema)
        sent = list(messages(different, bits, owner_bits))
        owner, first, count, m, code = zip(*sent, strict=True)
        yield batch({"kind": pa.array(["message"] * len(sent)), "sender": pa.array(np.full(len(sent), number)), "owner": pa.array(owner, pa.int32()), "first": pa.array(first, pa.int32()), "count": pa.array(count, pa.int32()), "m": pa.array(m, pa.int64()), "body": pa.array(code, pa.binary())}, len(sent), schema)


def batch(columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def duplicates(table: pa.Table) -> pa.Table:
    """An owner's answers: for each message with a fingerprint that others sent too, which ones, as bits."""
    rows = table.to_pylist()
    lists = [golomb_decode(r["body"], r["count"], r["m"]) for r in rows]
    values, times = np.unique(np.concatenate(lists), return_counts=True)
    common = values[times > 1]
    out = []
    for r, own in zip(rows, lists, strict=True):
        hit = np.isin(own, common)
        if hit.any():
            out.append((r["sender"], r["first"], r["count"], np.packbits(hit, bitorder="little").tobytes()))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sender", "first", "count", "bitmap"])


def merged(table: pa.Table) -> pa.Table:
    """All answers to a sender as one bitmap over its fingerprints."""
    rows = table.to_pylist()
    whole = np.zeros(max(r["first"] + r["count"] for r in rows), np.uint8)
    for r in rows:
        whole[r["first"] : r["first"] + r["count"]] = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["count"], bitorder="little")
    return pa.table([pa.array([rows[0]["sender"]]), pa.array([np.packbits(whole, bitorder="little").tobytes()], pa.binary())], names=["sender", "bitmap"])


def send(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """Texts and messages of all senders."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, owner_bits = plan(n, partitions)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = df.select(F.col(id_col).alias("id"), body.cast("binary").alias("body"), F.char_length(body).cast("long").alias("length"))
    member = T.StructType([T.StructField("shorter", T.LongType()), T.StructField("unnamed", T.BooleanType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("sender", T.LongType()), T.StructField("at", T.IntegerType())])
    out = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("sender", T.LongType()), ("sha", T.BinaryType()), ("place", T.IntegerType()), ("members", T.ArrayType(member)), ("owner", T.IntegerType()), ("first", T.IntegerType()), ("count", T.IntegerType()), ("m", T.LongType()), ("body", T.BinaryType()))])

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, schema = TaskContext.get().partitionId() << 24, Sender(MOST_ROWS, MOST_BYTES), None
        for rows in source:
            if schema is None:
                kind = rows.schema.field("id").type
                fields = [pa.field("shorter", pa.int64()), pa.field("unnamed", pa.bool_()), pa.field("id", kind), pa.field("sender", pa.int64()), pa.field("at", pa.int32())]
                schema = pa.schema([("kind", pa.string()), ("sender", pa.int64()), ("sha", pa.binary()), ("place", pa.int32()), ("members", pa.list_(pa.struct(fields))), ("owner", pa.int32()), ("first", pa.int32()), ("count", pa.int32()), ("m", pa.int64()), ("body", pa.binary())])
            for row_id, text, length in zip(rows.column("id").to_pylist(), rows.column("body"), rows.column("length").to_pylist(), strict=True):
                own.add(text.as_py(), row_id, length)
                if own.full:
                    yield from own.tables(number, bits, owner_bits, schema, digest)
                    number, own = number + 1, Sender(MOST_ROWS, MOST_BYTES)
        if own.rows:
            yield from own.tables(number, bits, owner_bits, schema, digest)

    return read.mapInArrow(part, out)


def groups(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``df``."""
    with bucketed(send(df, id_col, text, df.count()), "sender", "kind") as sent:
        asked = sent.where("kind = 'message'").select("sender", "owner", "first", "count", "m", "body")
        answers = asked.groupBy("owner").applyInArrow(lambda t: duplicates(t), "sender long, first int, count int, bitmap binary")
        answers = materialise(answers.groupBy("sender").applyInArrow(lambda t: merged(t), "sender long, bitmap binary"), "answers")
        # only the bitmaps move: the texts are in buckets by sender, and few numbers make the other side
        texts = sent.where("kind = 'text'").select("sender", "sha", "place", "members", "body").join(answers.hint("shuffle_hash"), "sender", "left")
        byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
        suspect = F.coalesce(F.getbit(byte, F.col("place").bitwiseAND(7)) == 1, F.lit(False))
        best = F.array_min("members")
        marked = materialise(texts.select("sha", "members", suspect.alias("suspect")), "marked")
        alike = texts.where(suspect).select("sha", "body", F.size("members").cast("long").alias("n"), best.alias("best"))
        alike = alike.groupBy("sha", "body").agg(F.sum("n").alias("size"), F.min("best").alias("best"))
        # equal bytes are a group; two of them under one digest would be told here, never merged
        one = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.min("best"))
        facts = materialise(alike.groupBy("sha").agg(F.sum("size").alias("size"), one.alias("best")), "facts")
    alone = marked.where("NOT suspect").select("sha", "members", F.size("members").cast("long").alias("size"), best.alias("best"))
    shared = marked.where("suspect").select("sha", "members").join(facts, "sha")
    rows = alone.unionByName(shared).select("sha", "size", "best", F.explode("members").alias("row"))
    kept = (F.col("row.sender") == F.col("best.sender")) & (F.col("row.at") == F.col("best.at"))
    return rows.select(F.col("row.id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
