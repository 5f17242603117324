"""Cost-balanced packing of tokenised documents into training sequences.

The cost of a piece of n tokens is linear plus quadratic (attention inside the piece).  Within a
bucket of some thousand documents, pieces go in descending length, each to the sequence of
lowest cost that still has room for it; a piece that fits nowhere is cut at the room of the
emptiest sequence.  The number of sequences is fixed beforehand from the bucket's token count,
and so are their rooms, whose sum is that count: only a bucket's last sequence is ever padded.

Buckets are dealt by row, so that no bucket grows with the data or with a frequent id.  Only ids
that packing may still cut travel to the buckets, in two bytes each; whole sequences of a long
document travel as their checksums.

Ids are those of the vocabulary's own library: a text is cut at the vocabulary's added tokens, each of
which is one id, and the stretches between are encoded by the ranks.

Defined cases: null text is empty and consists of the end id alone; repeated rows are packed one
by one; equal costs go to the sequence that was opened first; texts of any length are encoded whole;
an empty table gives no pieces.  Columns named like PIECES or starting with ``_`` cannot be kept
(ValueError).
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, own_names, rows_of
from .tokens import read_ranks

ROOM = 2048
END = 1
BUCKET_ROWS = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 512
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long, cost double"


def cost(length: float) -> float:
    return LINEAR * length + QUADRATIC * length * length


def rooms(total: int, room: int = ROOM) -> list[int]:
    """Rooms of the sequences that take ``total`` tokens: full ones and a last, shorter one."""
    return [room] * (total // room) + ([total % room] if total % room else [])


def padded_length(length: int, room: int = ROOM) -> int:
    return length if length & (length - 1) == 0 else room


def assign(lengths: list[int], room: int = ROOM) -> list[tuple[int, int, int, int]]:
    """(item, start, length, sequence) of pieces that cover the items, by falling length."""
    left = np.array(rooms(sum(lengths), room), np.int64)
    spent = np.zeros(len(left))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, item, start = heapq.heappop(queue)
        n = -n
        open_cost = np.where(left >= n, spent, np.inf)
        at = int(open_cost.argmin())
        if open_cost[at] == np.inf:
            at = int(left.argmax())
            take = int(left[at])
            heapq.heappush(queue, (take - n, item, start + take))
            n = take
        left[at] -= n
        spent[at] += cost(n)
        out.append((item, start, n, at))
    return out


def added_tokens(vocabulary_file: str) -> dict[str, int]:
    """The added tokens of a vocabulary in JSON: a handful of strings that are one id each."""
    with open(vocabulary_file, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """Ids of texts: by the ranks alone where no added token occurs in a text, as most have none."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int]) -> None:
        self.added = added
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.added):
            return self.core.encode(text, allowed_special="all", disallowed_special=())
        return self.core.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(name: str, shared: Any, pattern: str) -> Encoder:
    """The encoder of broadcast ranks and added tokens, built once in each Python worker."""
    if name not in _encoders:
        ranks, added = shared.value
        _encoders[name] = Encoder(ranks, pattern, added)
    return _encoders[name]


def pack_documents(df: DataFrame, text: str, keep: list[str], rank_file: str, vocabulary_file: str, pattern: str, room: int = ROOM, end: int = END, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces of all rows of ``df``: the ``keep`` columns and PIECES.

    ``rank_file`` has the vocabulary's ranks, ``vocabulary_file`` its added tokens; it must have fewer
    than 65,536 ids.
    """
    own_names(keep, *(x.split()[0] for x in PIECES.split(", ")))
    spark = df.sparkSession
    ranks, added = read_ranks(rank_file), added_tokens(vocabulary_file)
    if max([*ranks.values(), *added.values()], default=0) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    shared = spark.sparkContext.broadcast((ranks, added))
    name = f"{rank_file}:{len(ranks)}:{sorted(added)}:{pattern}"
    kept = [df.schema[k] for k in keep]
    source = df.select(F.coalesce(df[text].cast("string"), F.lit("")).alias("_text"), *keep)
    buckets = max(1, math.ceil(source.count() / bucket_rows))

    def tokenise(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(name, shared, pattern)
        for batch in source:
            schema = pa.schema([*(batch.schema.field(k) for k in keep), ("_tokens", pa.int64()), ("_full", pa.binary()), ("_tail", pa.binary())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for body, *rest in rows_of(batch, "_text", *keep):
                    ids = np.array([*code.encode(body), end], "<u4")
                    whole = len(ids) // room
                    full = np.array([zlib.crc32(ids[k * room : (k + 1) * room].tobytes()) for k in range(whole)], "<u4")
                    yield (*rest, len(ids), full.tobytes(), ids[whole * room :].astype("<u2").tobytes())

            yield from batches(rows(), schema, 4 << 20, 2000)

    tokens_type = T.StructType([*kept, T.StructField("_tokens", T.LongType()), T.StructField("_full", T.BinaryType()), T.StructField("_tail", T.BinaryType())])
    dealt = source.mapInArrow(tokenise, tokens_type).withColumn("_bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))

    def fill(key: Any, table: pa.Table) -> pa.Table:
        base = key[0].as_py() << 32
        tokens = table.column("_tokens").to_pylist()
        tails = [np.frombuffer(t, "<u2") for t in table.column("_tail").to_pylist()]
        pieces: list[tuple[int, ...]] = []  # row, start, length, crc, sequence, offset, sequence length
        serial = 0
        for row, crcs in enumerate(table.column("_full").to_pylist()):
            for k, crc in enumerate(np.frombuffer(crcs, "<u4").tolist()):
                pieces.append((row, k * room, room, crc, serial, 0, room))
                serial += 1
        placed = assign([len(t) for t in tails], room)
        used: dict[int, int] = {}
        spots = []
        for _, _, n, at in placed:
            spots.append(used.get(at, 0))
            used[at] = spots[-1] + n
        for (row, start, n, at), spot in zip(placed, spots, strict=True):
            crc = zlib.crc32(tails[row][start : start + n].astype("<u4").tobytes())
            pieces.append((row, tokens[row] - len(tails[row]) + start, n, crc, serial + at, spot, used[at]))
        take = pa.array([p[0] for p in pieces], pa.int64())
        own = [table.column(k).take(take).combine_chunks() for k in keep]
        longs = [[p[1] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], [tokens[p[0]] for p in pieces], [base + p[4] for p in pieces], [p[5] for p in pieces], [p[6] for p in pieces], [padded_length(p[6], room) for p in pieces]]
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.table([*own, *(pa.array(c, pa.int64()) for c in longs), pa.array([cost(p[2]) for p in pieces], pa.float64())], names=[*keep, *names])

    out_type = T.StructType([*kept, *T._parse_datatype_string(PIECES).fields])
    return dealt.groupBy("_bucket").applyInArrow(fill, out_type)
