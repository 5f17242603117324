"""Byte-level BPE with public vocabularies, over documents of any length.

The vocabulary's ranks are read on the driver and sent to the executors once (about 1 MB, a
fixed file).  Texts are cut into overlapping chunks, so that one long text is pre-tokenised by
many tasks.  The pre-tokeniser looks only ahead, and at most ``MARGIN`` characters past a token;
so from an offset where two neighbouring chunks both have a boundary, both go on alike.  Each
chunk owns the tokens between the first such offset it shares with its predecessor and the one
it shares with its successor, and they are encoded where the chunk is; a row takes its chunks' ids
together.  Where an overlap holds no such offset (a run longer than the overlap), the text is
pre-tokenised and encoded whole, in one task.  Both ways give the same ids.  Decoding concatenates the
bytes of the ids.

Defined cases: null text is empty and has no ids; repeated rows keep their own results, since
chunks are grouped by a key of the row, not of the document; lone tokens of any length are
encoded whole; an empty table gives no rows.  Columns named ``ids``, ``decoded`` or starting with ``_``
cannot be kept (ValueError).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialise, own_names, rows_of

CHUNK, OVERLAP, MARGIN = 32_768, 512, 4  #: characters; a chunk is shorter than 65,536
CACHED = 200_000  #: pieces whose ids a task remembers
_encoders: dict[str, Any] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Coder:
    """Encodes pieces of one rank table and decodes its ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.names = {i: b for b, i in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.core._encode_single_piece(piece.encode()))
                if len(piece) <= 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


def coder(name: str, ranks: Any, pattern: str) -> Coder:
    """The coder of a broadcast rank table, built once in each Python worker."""
    if name not in _encoders:
        _encoders[name] = Coder(ranks.value, pattern)
    return _encoders[name]


def chunk_bounds(length: int, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of overlapping chunks that cover a text of ``length`` characters."""
    if length <= size:
        return [(0, length)]
    return [(a, min(a + size, length)) for a in range(0, length - overlap, size - overlap)]


def first_common(tail: list[int] | None, head: list[int] | None, end: int) -> int | None:
    """The first offset both chunks have a boundary at, far enough from the end of the first."""
    known = set(head or ())
    return next((x for x in tail or () if x in known and x <= end - MARGIN), None)


def encode_documents(df: DataFrame, text: str, keep: list[str], ranks: dict[bytes, int], pattern: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns, ``ids`` (array<int>) and ``decoded`` (binary, from the ids) of every row."""
    own_names(keep, "ids", "decoded")
    spark = df.sparkSession
    name = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])[-50:]).encode() + str(len(ranks)).encode() + pattern.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)
    kept = [df.schema[k] for k in keep]
    out_type = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    source = df.select(F.coalesce(df[text].cast("string"), F.lit("")).alias("_text"), *keep)
    is_long = F.length("_text") > size

    def out_schema(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([*(batch.schema.field(k) for k in keep), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def short(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(name, shared, pattern)
        for batch in source:

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for body, *rest in rows_of(batch, "_text", *keep):
                    ids = code.encode(code.pieces(body))
                    yield (*rest, ids, code.decode(ids))

            yield from batches(rows(), out_schema(batch), 1 << 20, 2000)

    whole = source.where(~is_long).mapInArrow(short, out_type)

    # Long texts: a row per chunk, dealt out evenly; its boundaries inside the two overlaps.
    long_rows = source.where(is_long).withColumn("_row", F.concat_ws(":", F.spark_partition_id(), F.monotonically_increasing_id()))
    chunked = long_rows.select("_row", *keep, F.lit(size).alias("_size"), "_text", F.length("_text").alias("_n"))

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            schema = pa.schema([("_row", pa.string()), *(batch.schema.field(k) for k in keep), ("_k", pa.int32()), ("_of", pa.int32()), ("_start", pa.int64()), ("_chunk", pa.string())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for body, row, *rest in rows_of(batch, "_text", "_row", *keep):
                    bounds = chunk_bounds(len(body), size, overlap)
                    for k, (a, b) in enumerate(bounds):
                        yield (row, *rest, k, len(bounds), a, body[a:b])

            yield from batches(rows(), schema)

    cut_type = T.StructType([T.StructField("_row", T.StringType()), *kept, T.StructField("_k", T.IntegerType()), T.StructField("_of", T.IntegerType()), T.StructField("_start", T.LongType()), T.StructField("_chunk", T.StringType())])
    chunks = chunked.mapInArrow(cut, cut_type).repartition("_row", "_k")
    ends = T.ArrayType(T.LongType())
    cut_chunks = materialise(chunks.mapInArrow(partial(boundaries, name, shared, pattern, overlap), T.StructType([*cut_type.fields, T.StructField("_stop", T.LongType()), T.StructField("_head", ends), T.StructField("_tail", ends)])), "chunks")

    # Where neighbours agree is found from the boundaries in their overlaps; texts stay where they are.
    by_row = Window.partitionBy("_row").orderBy("_k")
    common = F.filter(F.array_intersect("_tail", F.lead("_head").over(by_row)), lambda x: x <= F.col("_stop") - MARGIN)
    joints = cut_chunks.select("_row", "_k", "_of", "_stop", F.array_min(common).alias("_joint")).withColumn("_first", F.coalesce(F.lag("_joint").over(by_row), F.lit(0)))
    apart = (F.col("_joint").isNull() & (F.col("_k") < F.col("_of") - 1)).cast("int")
    joints = joints.select("_row", "_k", "_first", F.coalesce("_joint", "_stop").alias("_last"), F.max(apart).over(Window.partitionBy("_row")).alias("_apart"))
    own = cut_chunks.drop("_head", "_tail", "_stop").join(joints, ["_row", "_k"])

    part_type = T.StructType([T.StructField("_row", T.StringType()), *kept, T.StructField("_k", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    coded = own.where("_apart = 0").select("_row", *keep, "_k", "_start", "_first", "_last", "_chunk").mapInArrow(partial(encode_parts, name, shared, pattern, keep), part_type)

    def unsynced(table: pa.Table) -> pa.Table:
        return encode_whole(name, shared, pattern, keep, table)

    coded = coded.unionByName(own.where("_apart = 1").groupBy("_row").applyInArrow(unsynced, part_type))
    gathered = coded.groupBy("_row").agg(*(F.min_by(k, "_k").alias(k) for k in keep), F.sort_array(F.collect_list(F.struct("_k", "ids"))).alias("_parts"))
    joined = gathered.select(*keep, F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))

    def restore(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(name, shared, pattern)
        for batch in source:
            made = ((*row, code.decode(row[-1])) for row in rows_of(batch, *keep, "ids"))
            yield from batches(made, out_schema(batch), most=1)

    return whole.unionByName(joined.mapInArrow(restore, out_type))


def boundaries(name: str, shared: Any, pattern: str, overlap: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a chunk's end, and the ends of its pieces within the overlaps at its head and tail."""
    code = coder(name, shared, pattern)
    for batch in source:
        schema = pa.schema([*batch.schema, ("_stop", pa.int64()), ("_head", pa.list_(pa.int64())), ("_tail", pa.list_(pa.int64()))])

        def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
            at = batch.schema.names.index("_start")
            for row in rows_of(batch, *batch.schema.names):
                start, body = row[at], row[-1]
                ends = start + np.cumsum([len(p) for p in code.pieces(body)], dtype=np.int64)
                stop = start + len(body)
                yield (*row, stop, ends[ends <= start + overlap].tolist(), ends[ends > stop - overlap].tolist())

        yield from batches(rows(), schema, 2 << 20, 500)


def encode_parts(name: str, shared: Any, pattern: str, keep: list[str], source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a chunk's own pieces: those that end after its first joint, up to its last."""
    code = coder(name, shared, pattern)
    for batch in source:
        schema = pa.schema([batch.schema.field("_row"), *(batch.schema.field(k) for k in keep), batch.schema.field("_k"), ("ids", pa.list_(pa.int32()))])

        def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
            for row, *rest, k, start, first, last, body in rows_of(batch, "_row", *keep, "_k", "_start", "_first", "_last", "_chunk"):
                at, own = start, []
                for piece in code.pieces(body):
                    at += len(piece)
                    if first < at <= last:
                        own.append(piece if at - len(piece) >= first else piece[first - at :])
                yield (row, *rest, k, code.encode(own))

        yield from batches(rows(), schema, 1 << 20, 200)


def encode_whole(name: str, shared: Any, pattern: str, keep: list[str], table: pa.Table) -> pa.Table:
    """The ids of a text whose chunks do not resynchronise: a run longer than an overlap."""
    code = coder(name, shared, pattern)
    table = table.sort_by("_k")
    parts, end = [], 0
    for start, body in zip(table.column("_start").to_pylist(), table.column("_chunk").to_pylist(), strict=True):
        parts.append(body[end - start :])
        end = start + len(body)
    ids = code.encode(code.pieces("".join(parts)))
    head = table.slice(0, 1)
    return pa.table([head.column("_row"), *(head.column(k) for k in keep), head.column("_k"), pa.array([ids], pa.list_(pa.int32()))], names=["_row", *keep, "_k", "ids"])
